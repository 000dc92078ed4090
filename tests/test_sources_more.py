"""Sources, sinks and ablation plans on small files."""

import hashlib
import json
import sqlite3

from quizmill.functions import similarity as S
from quizmill.plans import ablation
from quizmill.sources import files


def test_line_numbers_over_many_splits(spark, tmp_path):
    for name, n in (("a.txt", 5000), ("b.txt", 7)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" if i % 5 else "\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        x = files.read_lines(spark, str(tmp_path))
        assert x.rdd.getNumPartitions() > 1
        got = sorted((r["file"].rsplit("/", 1)[1], r["line"], r["value"]) for r in x.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted((name, i, f"{name} {i}") for name, n in (("a.txt", 5000), ("b.txt", 7)) for i in range(1, n + 1) if i % 5)


def test_sqlite_table(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "x.db")
    con.execute("CREATE TABLE t (id INTEGER, kind TEXT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(i, f"k{i % 3}") for i in range(100)])
    con.execute("CREATE TABLE e (id INTEGER)")
    con.commit()
    con.close()
    got = files.sqlite_table(spark, str(tmp_path / "x.db"), "t", "kind string, id long", 7).where("kind = 'k1'").orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(1, 100, 3))
    assert files.sqlite_table(spark, str(tmp_path / "x.db"), "e", "id long").count() == 0


def test_digests_objects_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", 1), (1, "ã", 1), (2, "c", 5)], "id long, x string, updated_at long")
    digest = files.write_jsonl_digested(df, str(tmp_path / "o"), "updated_at")
    raw = next((tmp_path / "o").glob("part-*")).read_bytes()
    assert digest == hashlib.sha256(raw).hexdigest() and len(raw.splitlines()) == 3
    (tmp_path / "p.csv").write_bytes(b"abc")
    assert files.as_pinned(spark, str(tmp_path / "p.csv"), hashlib.md5(b"abc").hexdigest()) and not files.as_pinned(spark, str(tmp_path / "p.csv"), "0" * 32)
    assert sorted((r["id"], r["x"]) for r in files.objects(df, "id").collect()) == [(1, "ã"), (2, "c")]
    assert [r["x"] for r in files.objects(df, "id", [2]).collect()] == ["c"]
    assert json.loads(files.json_report(df.where("id = 1"), "t"))["rows"] == [{"id": 1, "x": "ã", "updated_at": 1}]


def test_average_ranks_over_ranges(spark):
    import random

    rnd = random.Random(3)
    xs = [rnd.randint(0, 40) for _ in range(500)]
    got = {(r["v"], r["r"]) for r in S.average_rank(spark.createDataFrame([(x,) for x in xs], "v long"), "v", "r").collect()}
    ordered = sorted(xs)
    assert got == {(v, (ordered.index(v) + 1 + ordered.index(v) + ordered.count(v)) / 2) for v in xs}


def test_ablation_conditions(spark):
    def question(prompt):
        spec = json.loads(prompt)
        if spec["solicitacao"]["spec_id"] == 3:
            return "no json"
        o = ["a", "b", "c", "d", "a" if spec["solicitacao"]["spec_id"] == 2 else "e"]
        return json.dumps({"enunciado": spec["referencia"] or "sem", "alternativas": o, "correta": 1, "explicacao": "x", "competencia": "x", "habilidade": "x", "objeto_conhecimento": "x"})

    def nucleus(prompt):
        return json.dumps({"enunciado": "stem", "resposta_correta": "key", "explicacao": "x", "competencia": "x", "habilidade": "x", "objeto_conhecimento": "x"})

    docs = spark.createDataFrame([(10, "deadlock entre processos do sistema operacional"), (11, "normalizacao de tabelas relacionais")], "id long, texto string")
    specs = spark.createDataFrame([(i, "deadlock processos", "deadlock", None, None, None) for i in (1, 2, 3)] + [(4, "zzzz", "zzzz", None, None, None)], "spec_id long, query string, objeto string, curso string, componente string, exame string")
    one = {r["spec_id"]: r for r in ablation.run("C1_LLM", specs, lambda: question).collect()}
    assert [one[i]["reason"] for i in (1, 2, 3, 4)] == [None, "repetidas", "campo_ausente", None] and one[1]["enunciado"] == "sem" and one[1]["state"] == "COMPLETED"
    two = {r["spec_id"]: r for r in ablation.run("C2_RAG_LLM", specs, lambda: question, docs, min_score=0.1).collect()}
    assert two[1]["reference_id"] == 10 and two[1]["enunciado"].startswith("deadlock") and two[4]["reason"] == "sem_referencia"
    three = {r["spec_id"]: r for r in ablation.run("C3_RAG_LLM_SLM", specs, lambda: nucleus, docs, lambda: lambda p: '["w", "x", "y", "z", "extra"]', min_score=0.1).collect()}
    assert three[1]["reason"] is None and three[1]["alternativas"][three[1]["correta"]] == "key" and sorted(three[1]["alternativas"]) == ["key", "w", "x", "y", "z"]
