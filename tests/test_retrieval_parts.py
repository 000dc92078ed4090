"""Scores of terms that many documents have, met with their queries in parts; terms that no query has go no further."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quizmill.functions import text as T
from quizmill.operators import retrieval


@pytest.mark.parametrize("part", [1, 3, 10_000])
def test_bm25_by_parts(spark, monkeypatch, part):
    monkeypatch.setattr(retrieval, "PART", part)
    docs = [(i, "comum " * (1 + i % 3) + f"raro{i % 7} outro{i}") for i in range(25)] + [(99, None)]
    queries = [("a", "comum raro3"), ("b", "comum outro4 raro5 nenhum"), ("c", "nada")]
    got = {(r["q"], r["d"]): (round(r["bm25"], 9), r["n_common"]) for r in retrieval.bm25(spark.createDataFrame(docs, "d int, t string"), "d", F.col("t"), spark.createDataFrame(queries, "q string, t string"), "q", F.col("t"), {}, []).collect()}
    cut = lambda t: (u := (t or "").split()) + [f"{a}__{b}" for a, b in zip(u, u[1:], strict=False)]
    tf = {i: Counter(cut(t)) for i, t in docs}
    n, avg, want = len(docs), sum(sum(c.values()) for c in tf.values()) / len(docs), {}
    for q, t in queries:
        for i, c in tf.items():
            terms = set(cut(t)) & set(c)
            df = {w: sum(w in x for x in tf.values()) for w in terms}
            if terms:
                want[q, i] = (round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * max(sum(c.values()), 1) / avg)) for w in terms), 9), len(terms))
    assert got == want


def test_terms_that_no_query_has_are_left_out(spark):
    terms = spark.range(5000).select(F.concat(F.lit("t"), "id").alias("term"))
    wanted = spark.range(100).select(F.concat(F.lit("t"), "id").alias("term"))
    left = {r["term"] for r in terms.where(retrieval.may_be_in(F.col("term"), wanted)).collect()}
    assert {f"t{i}" for i in range(100)} <= left and len(left) < 200
    assert terms.where(retrieval.may_be_in(F.col("term"), wanted.where("false"))).count() == 0


def test_aliases_between_other_characters(spark):
    names = {"rede": ["sub-rede", "sub-redes"], "fim": ["a b"], "tls": ["c+"]}
    texts = ["sub-rede", "x_sub-rede sub-redes, sub-redez", "a b a b\t\n a  b ", "(a b)a b", "c+ c++ xc+", "\x0b a \x0c b", "sub-sub-rede", None]

    def plain(t):
        t = (t or "").lower()
        for alias, name in sorted(((a, k) for k, v in names.items() for a in v), key=lambda p: -len(p[0])):
            t = re.sub(rf"(?<![a-z0-9_]){re.escape(alias)}(?![a-z0-9_])", name, t)
        return re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ")

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.canonical(F.col("t"), names).alias("c")).collect()
    assert {r["i"]: r["c"] for r in got} == {i: plain(t) for i, t in enumerate(texts)}
