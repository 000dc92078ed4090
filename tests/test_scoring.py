"""Searches against plain Python, by blocks and parts of any size; no pair of record and specification is written."""

import math
import random
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizmill.operators import retrieval, scoring

RECORD = "id string, texto string, area string, objeto_conhecimento string, curso string, componente string, exame string"
SPEC = "spec_id long, query string, objeto string, curso string, componente string, exame string"
HINTS = {"Redes": ["pacote", "roteador"], "Dados": ["tabela", "indice"]}
WORDS = "pacote pacotes roteador roteadores tabela tabelas indice indices chave chaves enlace enlaces memoria memorial telepacote fila pilha grafo".split()


def some(seed, n_docs, n_specs):
    r = random.Random(seed)
    text = lambda a, b: " ".join(r.choices(WORDS, k=r.randint(a, b)))
    docs = [(f"d{i}", text(0, 30), r.choice(["Redes", "Dados", "redes antigas", "", None]), r.choice([text(1, 2), "", None]), r.choice(["c1", "C2", "", None]), r.choice(["x", None]), r.choice(["ENADE", "ENEM", "LOCAL"])) for i in range(n_docs)]
    specs = [(i, r.choice([text(1, 6), text(1, 6), None]), r.choice([text(1, 3), "", None]), r.choice(["c1", "c2", "", None, None]), None, r.choice(["ENADE", "", None])) for i in range(n_specs)]
    return docs, specs


def brute(docs, specs, k, min_score, fuzzy):
    cut = lambda t: (t or "").lower().split()
    bag = lambda u: u + [f"{a}__{b}" for a, b in zip(u, u[1:], strict=False)]
    flat = {d[0]: " ".join(cut(" ".join(x or "" for x in (d[2], d[3], d[1])))) for d in docs}
    uni = {i: t.split() for i, t in flat.items()}
    tf = {i: Counter(bag(u)) for i, u in uni.items()}
    df, avg, low = Counter(t for c in tf.values() for t in c), sum(sum(c.values()) for c in tf.values()) / len(docs), lambda x: (x or "").lower()
    out = {}
    for s, query, objeto, curso, componente, exame in specs:
        q, focus, rows = cut(query), set(cut(objeto)), []
        n, want = max((len((set(q) | focus) & set(w)), a) for a, w in HINTS.items())
        want = want if n else None
        for i, _, area, obj, d_curso, d_componente, d_exame in docs:
            common = set(bag(q)) & set(tf[i])
            length = max(sum(tf[i].values()), 1)
            bm25 = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[i][t] * 2.2 / (tf[i][t] + 1.2 * (0.25 + 0.75 * length / avg)) for t in common)
            like = []
            for a in set(q) - set(uni[i]):
                near = [SequenceMatcher(None, a, b).ratio() for b in set(uni[i]) if min(len(a), len(b)) >= 5 and a[:2] == b[:2] and abs(len(a) - len(b)) <= 3]
                like += [x for x in [max(near, default=0)] if x >= 0.88]
            bonus = 0.35 * sum(sorted(like)[-4:]) if fuzzy else 0.0
            clash = any(x and y and low(x) != low(y) for x, y in ((curso, d_curso), (componente, d_componente))) or (exame and d_exame in ("ENADE", "ENEM") and exame != d_exame)
            if clash or not (common or bonus):
                continue
            plus = 0.0 if want is None or not area else 2.25 if low(area) == low(want) else 0.75 if low(want) in low(area) else 0.0
            hits = len(focus & set(uni[i]))
            coverage = hits / max(1, len(focus))
            if focus and coverage < 0.3 and hits < 2 and plus < 2:
                continue
            o = " ".join(cut(obj))
            named = len(o) >= 5 and (hits > 0 or o in " ".join(sorted(set(q))) or any(t in flat[i] for t in focus))
            phrase = 0.45 * hits + 0.35 * named
            score = float(Decimal(repr(bm25 + phrase + plus + bonus)).quantize(Decimal("0.000001"), ROUND_HALF_UP))
            if score >= min_score:
                rows.append((-score, i, round(phrase, 9), plus, round(bonus, 9), round(coverage, 9), want is None or not area or low(area) == low(want)))
        rows.sort()
        best = -rows[0][0] if rows else 0
        good = [x for j, x in enumerate(rows) if -x[0] >= 0.42 * best and (j == 0 or x[-1])][:k]
        out |= {(s, j + 1): (i, round(-x, 5), *rest[:-1]) for j, (x, i, *rest) in enumerate(good)}
        out |= {(s, "trace"): [i for _, i, *_ in rows[:8]], (s, "n"): len(rows)}
    return out


@pytest.mark.parametrize(("block", "cells", "rows", "fuzzy"), [(None, None, None, True), (9, 1, 1, True), (40, 200, 30, False)])
def test_search_against_plain_python(spark, monkeypatch, block, cells, rows, fuzzy):
    if block:
        monkeypatch.setattr(retrieval, "BLOCK", block)
        monkeypatch.setattr(scoring, "CELLS", cells)
        monkeypatch.setattr(scoring, "ROWS", rows)
    docs, specs = some(7, 70, 14)
    want = brute(docs, specs, 3, 1.1, fuzzy)
    d, s = spark.createDataFrame(docs, RECORD).repartition(3), spark.createDataFrame(specs, SPEC)
    got = retrieval.hybrid(d, s, {}, [], HINTS, fuzzy=fuzzy).collect()
    number = lambda v: round(v, 9)
    assert {(r["spec_id"], r["rank"]): (r["id"], round(r["score"], 5), number(r["phrase"]), r["area_bonus"], number(r["fuzzy_bonus"]), number(r["coverage"])) for r in got} == {k: v for k, v in want.items() if isinstance(k[1], int)}
    ranked = retrieval.trace(d, s, {}, [], HINTS, fuzzy=fuzzy).orderBy("spec_id", "rank").groupBy("spec_id").agg(F.collect_list(F.struct("rank", "id")).alias("r")).collect()
    assert {r["spec_id"]: [x["id"] for x in sorted(r["r"])] for r in ranked} == {k[0]: v for k, v in want.items() if k[1] == "trace" and v}
    told = {r["spec_id"]: (r["candidatas"], [x["id"] for x in r["ranking"] or []]) for r in retrieval.references(d, s, {}, [], HINTS, fuzzy=fuzzy).collect()}
    assert told == {i: (want[i, "n"], want[i, "trace"]) for i, *_ in specs}


def test_no_pair_is_written(spark, monkeypatch):
    """400 records and 50 specifications share a term each: 20,000 relevant pairs, of which neither a table nor a shuffle may hold many."""
    written, put = [], retrieval.stage
    monkeypatch.setattr(retrieval, "stage", lambda df, name: [x := put(df, name), written.append((x.count(), name))][0])
    docs = spark.createDataFrame([(f"d{i}", f"comum pacote raro{i}") for i in range(400)], "id string, texto string")
    specs = spark.createDataFrame([(i, f"comum pacote outro{i}", "pacote", None, None, None) for i in range(50)], SPEC)
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = sent()
    got = retrieval.hybrid(docs, specs, {}, [], {}, fuzzy=True, k=2, min_score=0.0).collect()
    assert len(got) == 100 and max(written)[0] < 2_000
    assert sent() - before < 400_000


def test_references_shuffle_picked_texts_alone(spark):
    letters = random.Random(1).choices("abcdefghijklmnopqrstuvwxyz ", k=3_000_000)
    docs = spark.createDataFrame([(f"d{i}", f"{'comum pacote' if i < 5 else 'nada'} {''.join(letters[i * 10_000:(i + 1) * 10_000])}") for i in range(300)], "id string, texto string")
    specs = spark.createDataFrame([(1, "comum pacote", "pacote", None, None, None)], SPEC)
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = sent()
    r = retrieval.references(docs, specs, {}, [], {}, fuzzy=False, min_score=0.0).collect()[0]
    assert len(r["fontes"]) == 3 and r["candidatas"] == 5 and len(r["texto"]) > 30_000 and r["fontes"][0]["termos"] == ["comum", "comum__pacote", "pacote"]
    assert sent() - before < 500_000  # of 3 MB


def test_scores_are_rounded_as_by_spark(spark):
    x = np.r_[np.random.default_rng(3).random(3000) * 40, 1.0000005, 2.0000015, 0.1234565, 7.0, 0.0, 3.0000004999999]
    want = [r["y"] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").withColumn("y", F.round("x", 6)).orderBy("i").collect()]
    assert scoring.rounded(x).tolist() == want


@pytest.fixture
def written(spark, monkeypatch):
    """Rows of each table that is staged for 400 records and 50 specifications, all pairs of which are relevant."""
    rows, put = [], retrieval.stage
    monkeypatch.setattr(retrieval, "stage", lambda df, name: [x := put(df, name), rows.append((x.count(), name))][0])
    docs = spark.createDataFrame([(f"d{i:03}", f"comum pacote raro{i:03}") for i in range(400)], "id string, texto string")
    return docs, spark.createDataFrame([(i, f"comum pacote outro{i}", "pacote", None, None, None) for i in range(50)], SPEC), rows


def test_lexical_search_writes_no_pairs(written):
    docs, specs, rows = written
    got = retrieval.hybrid(docs, specs, {}, [], {}, fuzzy=False, k=2, min_score=0.0).collect()
    assert {(r["id"], r["rank"]) for r in got} == {("d000", 1), ("d001", 2)} and len(got) == 100 and max(rows)[0] < 2_000


def test_trace_writes_no_pairs(written):
    docs, specs, rows = written
    got = retrieval.trace(docs, specs, {}, [], {}, fuzzy=False, min_score=0.0).collect()
    assert {(r["id"], r["rank"]) for r in got} == {(f"d00{i}", i + 1) for i in range(8)} and len(got) == 400 and max(rows)[0] < 5_000
