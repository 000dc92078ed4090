"""Queries give the whole job: every row, every code, every word."""

from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    import os

    import __spark_entry__ as entry

    if not os.path.isdir(SF):
        pytest.skip("no tables")
    return lambda name: entry.queries()[name](spark, SF)


def rows(spark, name, *cols):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*cols).collect()]


def test_numbers_over_999_stay_whole(spark):
    from quizmill.operators import campaign

    got = {r["id"]: r["case_id"] for r in campaign.numbered(spark.range(1200).selectExpr("id", "'a' AS g"), "g", "id").collect()}
    assert got == {i: f"a-{i + 1:03}" for i in range(1200)}


def test_numbered_cases_has_every_event(spark, run):
    seen, want = Counter(), []
    for i, kind in sorted(rows(spark, "events", "event_id", "event_type")):
        seen[kind] += 1
        want.append((i, kind, seen[kind], f"{kind}-{seen[kind]:03}"))
    assert len(want) > 900 and sorted(tuple(r) for r in run("numbered_cases").collect()) == want


STEMS = {
    "alternativas_embutidas_no_nucleo": ("Escolha entre A) esta primeira opção e B) esta segunda opção do item", "x"),
    "implementacao_nao_delimitada": ("Considere os campos xmin e xmax de uma linha e diga qual vale aqui", "x"),
    "enunciado_ambiguo": ("Quais são os mecanismos que o sistema usa para entregar cada mensagem?", "um"),
    "espaco_de_respostas_binario": ("Este requisito é funcional ou não funcional no sistema descrito acima?", "x"),
    "selecao_de_protocolo_potencialmente_ambigua": ("Qual protocolo entrega os segmentos em ordem na camada de transporte?", "TCP"),
    "possivel_copia_da_referencia": ("Um texto de referência que volta quase palavra por palavra no enunciado", "x"),
}


def test_flags_of_every_rule_are_returned(spark, monkeypatch):
    from quizmill.plans import catalogue

    given = [(i, stem, a, stem if "copia" in code else "outro") for i, (code, (stem, a)) in enumerate(STEMS.items())]
    made = spark.createDataFrame(given, "item_id long, enunciado string, resposta_correta string, referencia string").selectExpr(
        "*", "array(resposta_correta, 'b', 'c', 'd', 'e') AS alternativas", "0 AS correta", "array('b', 'c', 'd', 'e') AS distratores", "'x' AS explicacao", "'x' AS competencia", "'x' AS habilidade", "'x' AS objeto_conhecimento", "false AS tem_imagem", "'' AS recurso_visual"
    )
    monkeypatch.setattr(catalogue, "items", lambda spark, d: made)
    got = {(r["item_id"], r["code"]) for r in catalogue.item_rule_flags(spark, "").collect()}
    assert {(i, code) for i, code in enumerate(STEMS)} <= got
    assert {r["code"] for r in catalogue.flag_distribution(spark, "").collect()} == {code for _, code in got}


def test_copies_of_the_reference_against_difflib(spark, run):
    from difflib import SequenceMatcher

    from quizmill.functions import text as T
    from quizmill.plans.views import items
    from pyspark.sql import functions as F

    x = items(spark, SF).select("item_id", T.words_folded(F.col("enunciado")), T.words_folded(F.col("referencia"))).collect()
    want = {k for k, a, b in x if SequenceMatcher(None, a, b).ratio() >= 0.82}
    assert want and {r["item_id"] for r in run("item_rule_flags").where("code = 'possivel_copia_da_referencia'").collect()} == want


def test_document_frequency_of_every_term(spark, run):
    import duckdb
    from quizmill.plans.catalogue import SQL

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = dict(con.execute(SQL["term_df_stats"].replace(" WHERE df >= 5", "")).fetchall())
    assert min(want.values()) == 1 and {r["term"]: r["df"] for r in run("term_df_stats").collect()} == want


def test_merged_corpus_has_every_document(spark, run):
    docs, labels = ([r[0] for r in rows(spark, t, "doc_id")] for t in ("documents", "labels"))
    assert sorted(r["id"] for r in run("corpus_merge").collect()) == sorted([*docs, *(set(labels) - set(docs))])


def test_items_hold_every_word_of_every_document(spark):
    import re

    from pyspark.sql import functions as F
    from quizmill.plans.views import items, table

    d = table(spark, SF, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), "text")
    want = {k: (w, t) for k, w, t in d.collect() if w}
    got = {r["item_id"]: r["enunciado"] for r in items(spark, SF).collect()}
    assert got.keys() == want.keys() and max(len(w) for w, _ in want.values()) > 80 and min(len(w) for w, _ in want.values()) < 40
    words = {r["item_id"]: r["w"] for r in items(spark, SF).select("item_id", F.regexp_extract_all("enunciado", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w")).collect()}
    for k, (w, text) in want.items():
        n = 1 + k % 4 + sum(2 + (k + i) % 3 for i in range(1, 5))
        assert words[k][: max(0, len(w) - n)] == w[n:]
        assert len(w) <= n or re.sub(r"\s+", "", text)[-5:] in re.sub(r"\s+", "", got[k])


def test_leaks_after_word_80_are_flagged(spark, tmp_path):
    from quizmill.plans import catalogue

    word = " ".join(f"w{i}" for i in range(2000))
    rows = [(1, f"{word} \x01 fim", "pt", "s", 1), (2, word, "pt", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["item_id"], r["field"]) for r in catalogue.item_rule_flags(spark, str(tmp_path)).where("code = 'formatacao_quebrada'").collect()}
    assert got == {(1, "questao"), (2, "questao")}
    n = catalogue.item_rule_flags(spark, str(tmp_path)).where("code = 'formatacao_quebrada' AND item_id = 1").count()
    assert n == 2  # the control character and the length
