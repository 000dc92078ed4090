"""Validation, registries and the pool loop."""

from pyspark.sql import functions as F
from quizmill.operators import contracts as C


def test_validation(spark):
    df = spark.createDataFrame([("Analisar o conteúdo", "ENADE", 3, 2, 2), ("Identificar deadlock", "X", 9, 0, 2), (None, None, None, None, None)], "objetivo_pedagogico string, exame string, dificuldade int, max_attempts int, max_distractor_attempts int")
    assert [r["errors"] for r in C.request_errors(df).collect()] == [["objetivo_generico"], ["exame", "dificuldade", "max_attempts"], ["objetivo_generico"]]
    q = spark.createDataFrame([("x", list("abcde"), 0), ("", list("abcde"), 0), ("x", list("abcd"), 0), ("x", list("abcde"), 5), ("x", ["a", "A ", "c", "d", "e"], 1)], "s string, o array<string>, c int")
    assert [r[0] for r in q.select(C.question_error(F.col("o"), F.col("c"), F.col("s"))).collect()] == [None, "campo_ausente", "alternativas", "correta", "repetidas"]


def test_json(spark):
    df = spark.createDataFrame([('x {"a": 1, "alternativas": []} y',), ("{broken",)], "j string")
    got = df.select(C.outer_json(F.col("j")).alias("o")).select("o", C.forbidden_keys(F.col("o")).alias("k")).collect()
    assert got[0]["k"] == ["alternativas"] and got[1]["o"] is None
    n = spark.createDataFrame([('{"clarity": {"flaw": "true"}}',), ('[{"criterion": "clarity", "flaw": "true"}, {"flaw": "x"}]',)], "j string")
    assert [r[0] for r in n.select(C.named_objects(F.col("j"), "flaw", "criterion", "name")).collect()] == [{"clarity": "true"}] * 2


def test_registry_and_resume(spark):
    reg = spark.createDataFrame([("RF1", 1, True), ("RF2", 1, True)], "red_flag_id string, version int, active boolean")
    got = {(r["red_flag_id"], r["version"], r["active"]) for r in C.new_flag_version(reg, spark.createDataFrame([("RF1",), ("RF9",)], "red_flag_id string")).collect()}
    assert got == {("RF1", 1, False), ("RF1", 2, True), ("RF2", 1, True), ("RF9", 1, True)}
    a = spark.createDataFrame([("a", "REFERENCE"), ("a", "STEM_CHECKPOINT"), ("b", "OTHER")], "request_id string, kind string")
    assert {r["request_id"]: r["next_step"] for r in C.resume_point(a).collect()} == {"a": "candidates", "b": "reference"}
    e = spark.createDataFrame([("a", 1, "Referência recuperada"), ("a", 2, "Distratores gerados")], "request_id string, id int, reason string")
    assert C.stage_of(e).first()["stage"] == "distratores"


def test_pool_loop(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    req = spark.createDataFrame([("a",), ("b",)], "request_id string")
    asked = []

    def propose(open_, k):
        asked.append(sorted(r["request_id"] for r in open_.collect()))
        return open_.select("request_id", F.explode(F.when(F.col("request_id") == "a", F.array(*(F.lit(f"opt {k} {i}") for i in range(3)))).otherwise(F.array(F.lit("Same"), F.lit("same ")))).alias("text"))

    got = C.grow_pools(req, propose, lambda df: df.where("text <> 'opt 0 0'"))
    by = {}
    for r in got.collect():
        by.setdefault(r["request_id"], []).append((r["place"], r["role"]))
    assert len(by["a"]) == 5 and sorted(by["a"])[4] == (5, "reserve") and len(by["b"]) == 1
    assert asked == [["a", "b"], ["a", "b"], ["b"]]
    pool = got.where("request_id = 'a'")
    v = spark.createDataFrame([("a", 1, False, "estranho"), ("a", 1, True, ""), ("a", 9, False, "x")], "request_id string, i int, valid boolean, reason string")
    after = C.gate(pool, v).orderBy("place").collect()
    assert [r["i"] for r in after] == [2, 3, 4, 5] and after[3]["promoted"]
