"""Rows on which queries once differed from their SQL: made documents, held against DuckDB."""

import pytest


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    duckdb = pytest.importorskip("duckdb")
    texts = {
        125555: "Éè Éè Éè Éè Éè Éè Éè Éè Éè échention échention échention échention échention échention resto do texto",  # a key of `e` and blanks alone, longer than the others
        1: "um dois tres quatro cinco seis sete oito nove dez onze doze treze quatorze quinze dezesseis dezessete veja a figura",
        2: "um dois tres quatro cinco seis sete oito nove dez onze doze treze quatorze quinze dezesseis dezessete dezoito dezenove　 ",
        3: "vía vía vía vía vía vía vía vía vía vía vía vía vía vía vía vía vía vía e mais",
        4: "maßi maßi xßv aßv aßv aßv aßv aßv aßi aßi aßi aßi aßi aßi aßi aßi aßi aßi",
        5: "I I I I I I I I I I I I I I I I I I I",
    }
    folder = tmp_path_factory.mktemp("made")
    spark.createDataFrame([(k, v, "fr", "s", len(v)) for k, v in texts.items()], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"file://{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return str(folder), con


@pytest.mark.parametrize("name", ["discard_reasons", "distractor_rule_flags", "rule_flags"])
def test_made_rows_against_sql(spark, made, name):
    import __spark_entry__ as entry

    folder, con = made
    df = entry.queries()[name](spark, folder)
    cur = con.execute(entry.oracle_sql()[name])
    at = [[c[0] for c in cur.description].index(c) for c in df.columns]
    want = sorted(tuple(str(r[i]) for i in at) for r in cur.fetchall())
    assert sorted(tuple(map(str, r)) for r in df.collect()) == want


def test_numerals_are_whole_words(spark):
    from pyspark.sql import functions as F

    from quizmill.operators.rules import repeated_numeral

    x = spark.createDataFrame([("vía vía",), ("I e I",), ("I e II",), ("aßv aßv",)], "x string")
    assert [tuple(r) for r in x.select(repeated_numeral(F.col("x")), repeated_numeral(F.col("x"), True)).collect()] == [(False, True), (True, True), (False, False), (False, True)]
