"""Pipeline stages on empty tables, nulls in every column, repeated rows, very long texts and columns with clashing names."""

import random

import pytest
from quizmill.llm import bpecodec, decontaminate, jaccard, langid, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, secret_spans string, uid long, bad_id int, row string, n_tokens string"
STAGES = [langid.identified, jaccard.one_of_each, decontaminate.clean, secrets.without_secrets, bpecodec.tokenise]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bench"))
    spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(20))), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def row(i, text, lang="en"):
    return (i, text, lang, "s", len(text or ""), 1.0, "x", 7, 8, "r", "n")


@pytest.mark.parametrize("stage", STAGES, ids=lambda f: f.__name__)
def test_empty_table(spark, folder, stage):
    df = spark.createDataFrame([], DOCS)
    out = stage(spark, df, folder)
    assert out.count() == 0 and (stage is bpecodec.tokenise or out.columns == df.columns)


def test_nulls_copies_and_long_texts(spark, folder):
    rnd = random.Random(5)
    long_ = " ".join("".join(rnd.choices("abcdefghij", k=5)) for _ in range(60_000))
    rows = [row(1, "some plain words of a first text"), row(1, "some plain words of a first text"), (None,) * 11, (None, "a text without an id or anything else", *[None] * 9), row(3, None), row(4, ""), row(5, long_), row(6, " ".join(f"item{i}" for i in range(20)))]
    df = spark.createDataFrame(rows, DOCS)
    texts = lambda x: sorted((r["doc_id"] or -1, (r["text"] or "")[:40]) for r in x.collect())
    a = langid.identified(spark, df, folder)
    assert texts(a) == sorted([(1, rows[0][1][:40]), (1, rows[0][1][:40]), (-1, rows[3][1][:40]), (5, long_[:40]), (6, rows[7][1][:40])]) and a.where("lang is null").count() == 0
    b = jaccard.one_of_each(spark, df, folder)
    assert [i for i, _ in texts(b)] == [-1, -1, 1, 3, 4, 5, 6]  # texts without words all stay
    c = decontaminate.clean(spark, df, folder)
    assert [i for i, _ in texts(c)] == [-1, -1, 1, 1, 3, 4, 5]
    d = secrets.without_secrets(spark, df, folder)
    assert texts(d) == texts(df) and d.where("doc_id = 3 and text is null").count() == 1
    e = bpecodec.tokenise(spark, df, folder)
    assert e.count() == len(rows) and {r["doc_id"]: r["n_tokens"] for r in e.collect()}[3] == 0
    assert e.where("doc_id = 5").first()["n_tokens"] > 60_000


def test_whole_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
