"""Table functions against the Column forms, files against what was written."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quizmill.functions import similarity as S
from quizmill.operators import generators, tables
from quizmill.sources import files


def made(spark, view, call):
    tables.register(spark)
    return {k: [r["option"] for r in sorted(rows, key=lambda r: r["place"])] for k, rows in grouped(spark.sql(f"SELECT k, f.* FROM {view}, LATERAL {call} AS f").collect()).items()}


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r["k"], []).append(r)
    return out


def test_table_functions_are_the_column_forms(spark):
    spark.range(-1, 34).selectExpr("CAST(id AS INT) AS k").createOrReplaceTempView("numbers")
    for dotted in (False, True):
        answer = F.concat(F.lit("/"), F.col("k")) if not dotted else F.expr("concat('mascara 10.0.0.0 /', k)")
        want = {r["k"]: r["o"] for r in spark.table("numbers").where("k >= 1").select("k", generators.ipv4_neighbours(answer, F.lit("prefixo IPv4")).alias("o")).collect() if r["o"]}
        assert made(spark, "numbers", f"neighbour_prefixes(k, {str(dotted).lower()})") == want and len(want) == 30
    want = {r["k"]: [str(v) for v in r["o"]] for r in spark.table("numbers").select("k", generators.count_options(F.col("k")).alias("o")).collect() if r["o"]}
    assert made(spark, "numbers", "neighbour_counts(k)") == want and len(want) == 5
    sets = [(k, [n for i, n in enumerate(generators.NUMERALS) if k >> i & 1]) for k in range(32)] + [(40, None), (41, ["I", "X"])]
    spark.createDataFrame(sets, "k int, r array<string>").createOrReplaceTempView("sets")
    want = {k: [r["members"] for r in sorted(rows, key=lambda r: r["place"])] for k, rows in grouped(generators.combination_options(spark.table("sets"), "k", "r").collect()).items()}
    assert made(spark, "sets", "neighbour_sets(r)") == want and len(want) == 31
    said = [t for t, _ in generators.ASSERTIONS] + ["A PRIMEIRA afirmação é FALSA", "As duas  são verdadeiras,\nmas a segunda não justifica", "", None, "duas falsas"]
    spark.createDataFrame(list(enumerate(said)), "k int, a string").createOrReplaceTempView("said")
    want = {r["k"]: r["o"] for r in spark.table("said").select("k", generators.assertion_options(F.coalesce("a", F.lit(""))).alias("o")).collect()}
    assert made(spark, "said", "other_assertions(a)") == want and len(want) == 10


def test_best_candidates_of_parts(spark):
    tables.register(spark)
    texts = ["a b c", "a a a", "x", "", "a b", "c d e", "a b c d e f g"]
    rows = [(k, i, texts[(i * (k + 3)) % len(texts)], "uma resposta certa"[: 4 + 5 * k]) for k in range(4) for i in range(9)] + [(9, 0, "so", "")]
    df = spark.createDataFrame(rows, "key long, index int, t string, answer string")
    want = {(r["key"], r["index"], r["place"]) for r in generators.select_pool(df, "key", "index", "t", "answer", 3).collect()}
    x = df.selectExpr("key", "index", "size(regexp_extract_all(t, '[a-z0-9]+', 0)) AS n_words", "size(array_distinct(regexp_extract_all(t, '[a-z0-9]+', 0))) AS n_different", "size(regexp_extract_all(answer, '[a-z0-9]+', 0)) AS wanted")
    got = spark.sql("SELECT * FROM best_candidates(TABLE(SELECT * FROM {x}) PARTITION BY (key), 3)", x=x).collect()
    assert {(r["key"], r["index"], r["place"]) for r in got} == want
    assert spark.sql("SELECT * FROM best_candidates(TABLE(SELECT * FROM {x}) PARTITION BY (key), 3)", x=x.where("false")).count() == 0


def test_self_bleu_by_hand(spark):
    """Orders of n-grams are told apart: rows with words and some pairs in common, against plain Python."""
    texts = {1: "the cat sat on the mat today", 2: "the cat sat on a red mat", 3: "today the dog ran", 4: "unlike words only", 5: "the the the the the"}
    toks = {k: t.split() for k, t in texts.items()}
    grams = lambda t, n: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    want = {}
    for k, t in toks.items():
        logs = []
        for n in range(1, 5):
            mine = grams(t, n)
            if mine:
                hit = sum(min(c, max(grams(o, n)[g] for j, o in toks.items() if j != k)) for g, c in mine.items())
                logs.append((hit, sum(mine.values())) if n == 1 else (hit + 1, sum(mine.values()) + 1))
        want[k] = 0.0 if any(h == 0 for h, _ in logs) else math.exp(sum(math.log(h / a) for h, a in logs) / len(logs))
    df = spark.createDataFrame([*texts.items(), (6, ""), (7, None)], "k int, t string")
    got = {r["k"]: r["self_bleu"] for r in S.self_bleu(df, "k", "t").collect()}
    assert got == pytest.approx(want)


def test_files_read_back(spark, tmp_path):
    rows = [(1, 'a "quoted", field', 1.5), (2, "two\nlines", None), (3, None, -0.1)]
    df = spark.createDataFrame(rows, "i long, t string, v double")
    files.append_jsonl(df, f"file://{tmp_path}/j")
    back = files.read_jsonl(spark, f"file://{tmp_path}/j", "i long, t string, v double")
    assert sorted(tuple(r) for r in back.select("i", "t", "v").collect()) == rows
    spark.createDataFrame([('{"i": 1}',), ("",), ('{"i": ',), ('{"i": 4}',)], "value string").coalesce(1).write.text(f"file://{tmp_path}/b")
    kept = files.read_jsonl(spark, f"file://{tmp_path}/b", "i long", strict=False).orderBy("line").collect()
    assert [(r["line"], r["i"], r["json_invalid"]) for r in kept] == [(1, 1, False), (3, None, True), (4, 4, False)]
    with pytest.raises(Exception, match="invalid JSON in line 3"):
        files.read_jsonl(spark, f"file://{tmp_path}/b", "i long").collect()


def test_options_of_an_argument_are_worked_out_once():
    from quizmill.operators import tables

    tables.nearest_sets.cache_clear()
    tables.other_sentences.cache_clear()
    sets, said = tables.NeighbourSets(), tables.OtherAssertions()
    first = list(sets.eval(["I", "II"])), list(said.eval("As duas são falsas"))
    assert all((list(sets.eval(["I", "II"])), list(said.eval("As duas são falsas"))) == first for _ in range(50))
    assert tables.nearest_sets.cache_info().misses == tables.other_sentences.cache_info().misses == 1
    assert not list(sets.eval(["I", None])) and not list(sets.eval(None))
