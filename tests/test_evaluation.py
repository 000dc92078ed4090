"""Evaluation, parsing, rounding, staging: literal examples."""

import pytest
from pyspark.sql import functions as F
from quizmill.functions.rounding import half_even
from quizmill.operators import evaluation, generators, retrieval


def test_half_even(spark):
    df = spark.createDataFrame([(2.675, 2), (2.5, 0), (3.5, 0), (-0.125, 2), (None, 1)], "x double, n int")
    assert [r[0] for r in df.select(half_even("x", "n")).collect()] == [2.67, 2.0, 4.0, -0.12, None]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('noise {"distratores": [{"texto": " a\\n b ", "erro": "e1", "por_que_e_falso": "p1"}, "c"]} tail', (["a b", "c"], ["e1", ""], ["p1", ""])),
        ("{'distrator': [{'distrator': 'x'}]}", (["x"], [""], [""])),
        ("1) one\n2. two\n- three,\n* 'four'", (["one", "two", "three", "four"], [""] * 4, [""] * 4)),
        ('{"gabarito_distratores": ["x"]}', None), ("- one\n- two", None), ('[{"erro": "no text"}]', None), ("", None), (None, None),
    ],
)
def test_tolerant_parser_keeps_every_field(raw, want):
    got = generators.parsed_options(generators.recover(raw))
    assert (got and (got.texts, got.errors, got.reasons)) == want


def test_best_model_takes_no_long_keys_as_unmeasured(spark):
    df = spark.createDataFrame([("a", 0.9, 1.0, 0.1, 0.0, 0.5), ("b", 0.9, 1.0, 0.1, 0.5, 0.1), ("c", 0.8, 1.0, 0.0, 0.1, 0.9)], "m string, valid_rate double, four_distinct_rate double, copy_rate double, long_rate double, mean_overlap double")
    assert evaluation.best_model(df, "m").first()["m"] == "b"


def test_greedy_dedupe_follows_a_long_chain(spark):
    """Each row shares a key with the one before: every second stays, however many rounds that takes."""
    n = 130
    df = spark.createDataFrame([(i, f"a{(i + 1) // 2}", f"b{i // 2}") for i in range(n)], "n int, a string, b string")
    seen_a, seen_b, want = set(), set(), []
    for i in range(n):
        a, b = f"a{(i + 1) // 2}", f"b{i // 2}"
        if a not in seen_a and b not in seen_b:
            want.append(i)
            seen_a.add(a)
            seen_b.add(b)
    assert sorted(r["n"] for r in retrieval.greedy_dedupe(df.where("n < 24"), "n", ("a", "b")).collect()) == [i for i in want if i < 24]


def test_retrieval_counts_records_without_terms(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, ""), (3, None)], "id long, t string")
    r = retrieval.statistics(df, "id", F.col("t"), {}, [])[1].first()
    assert (r["n_docs"], r["avg_len"]) == (3, 1.0)


def test_object_in_text_needs_five_letters(spark):
    docs = spark.createDataFrame([(1, "xyz alpha words here", "xyz"), (2, "long object alpha words", "alpha")], "id long, texto string, objeto_conhecimento string")
    specs = spark.createDataFrame([(1, "alpha words", "alpha", None, None, None)], "spec_id long, query string, objeto string, curso string, componente string, exame string")
    got = {r["id"]: r["phrase"] for r in retrieval.hybrid(docs, specs, {}, [], {}, fuzzy=False, k=5, min_score=0.0).collect()}
    assert got[1] == pytest.approx(0.45) and got[2] == pytest.approx(0.80)


def test_stop_without_a_shared_folder(spark, monkeypatch):
    from quizmill.sources import staging

    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_folder(Fake())


def test_count_options(spark):
    got = [r[0] for r in spark.range(1, 6).select(generators.count_options(F.col("id").cast("int"))).collect()]
    assert got[0] == [2, 3, 4, 5] and got[2] == [2, 4, 1, 5]
