"""Conversation repair, personal data and spelling variants against brute force, SQL and made labels, with nulls, ties, empty and very long inputs."""

import hashlib
import heapq
import os
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from quizmill.llm import personal, taggers, turns, variants

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


# ---------------------------------------------------------------- conversations


def repaired_plainly(rows):
    """(cost, audit, lines) of rows (role, text, fault): uniform-cost search over places, states and letters put down so far."""
    heap = [(0, "", 0, 0, ())]
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit, lines
        to = turns.NEXT[state]
        if cost <= 200:
            heapq.heappush(heap, (cost + 5, audit + "I", i, to, (*lines, f"{turns.NAMES[to]}:")))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
        if fault in (0, 3):
            more = 5 if fault == 3 else 0
            heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, to, (*lines, f"{turns.NAMES[to]}:{text}")))
            legal = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
            if (role[:1], state) in legal:
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, legal[role[:1], state], (*lines, f"{role}:{text}")))


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append((role, text, 1 if not said else 2 if (role, text) in seen else 0 if said[-1] in ".!?" else 3))
        seen.add((role, text))
    return out


def test_repair_against_search(spark):
    rnd = random.Random(11)
    talk, want = [], {}
    for conv in range(120):
        rows = [(rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rnd.choice(["Yes.", "No", "", " \n", "Oh! ", "Why?\t", None, f"t{rnd.randint(0, 9)}."])) for _ in range(rnd.randint(1, 6))]
        at = [*sorted(rnd.sample(range(9), len(rows) - 1))]
        talk += [(conv, t, r, x) for t, (r, x) in zip([None, *at], rows, strict=True)]
        plain = faults_of([(" " if r is None else r, " " if x is None else x) for r, x in rows])
        cost, audit, lines = repaired_plainly(plain)
        initials = [r[:1] for r, _, _ in plain]
        gaps = max(at) - min(at) + 1 - len(at) if at else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        want[conv] = (gaps, *(sum(f == k for *_, f in plain) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    rnd.shuffle(talk)
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("x")).withColumn("digest", F.lit(1)).repartition(5)
    got = turns.repaired(df)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    lines = turns.rebuilt(df, turns.audits(df)).orderBy("conv_id", "place").collect()
    for conv in want:
        text = "\n".join(f"{r['role']}:{r['text']}" for r in lines if r["conv_id"] == conv)
        assert hashlib.sha256(text.encode()).hexdigest() == want[conv][-1]


def test_damage_nulls_dropped_and_empty(spark):
    rows = [(c, t, "user", f"Hello {c} {t}.") for c in [None, *range(40)] for t in [None, 0, 1]]
    out = turns.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = Counter((r["conv_id"], r["turn"]) for r in out)
    for c, t, _, text in rows:
        act = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        mine = [r for r in out if (r["conv_id"], r["turn"]) == (c, t)]
        assert by[c, t] == (2 if act == 3 else 1) and all(r["gone"] == (act == 0) for r in mine)
        assert mine[0]["text"] == ("" if act in (0, 1) else text.replace(".", "") if act == 2 else text)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.repaired(turns.damage(empty)).count() == 0
    gone = spark.createDataFrame([(7, 1, "user", "Hi.", True)], "conv_id long, turn long, role string, text string, gone boolean")
    assert tuple(turns.repaired(gone).first()) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_a_very_long_conversation_and_a_null_one(spark):
    n = 30_000
    df = spark.range(n).select(F.lit(None).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.expr("if(id % 2 = 0, 'user', 'assistant')").alias("role"), F.concat(F.lit("t"), "id", F.lit(".")).alias("text"))
    same = spark.range(500).select(F.lit(1).cast("long").alias("conv_id"), F.lit(3).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("One?").alias("text"))
    got = {r[0]: r for r in turns.repaired(df.unionByName(same)).collect()}
    assert got[None]["cost"] == 0 and got[None]["audit"] == "K" * n and got[None]["gaps"] == 0
    assert got[1]["duplicate"] == 499 and got[1]["cost"] == 499 * 2 + 2 and got[1]["audit"] == "D" * 500


# ---------------------------------------------------------------- personal data

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def holds(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == 1:
        return all(int(p) <= 255 for p in s.split("."))
    if kind == 2:
        return 14 <= len(d) <= 19 and sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0
    return kind == 0 or 10 <= len(d) <= 15


def test_base_patterns_against_plain_ones():
    rnd = random.Random(2)
    bits = ["a", "b.c", "@", "@x.de", ".", "-", " ", "1", "25", "300", "0001", "+", "+4", "(", ")", "é", "4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "a@b.c", "+1 (017) 555-7713", "_", "%", "\n"]
    for _ in range(4000):
        text = "".join(rnd.choices(bits, k=rnd.randint(0, 14)))
        want = sorted((m.start(), m.end(), k) for k, p in enumerate(PLAIN) for m in re.finditer(p, text) if holds(k, m.group()))
        assert sorted(x[:3] for x in personal.matches(text) if x[3]) == want, text


def test_gradients_of_the_tagger():
    rng = np.random.default_rng(1)
    m = taggers.Model(*(rng.normal(0, 0.3, s) for s in ((2, taggers.SYMBOLS, 4 * taggers.HIDDEN), (2, taggers.HIDDEN, 4 * taggers.HIDDEN), (2 * taggers.HIDDEN, taggers.TAGS), (taggers.TAGS,), (taggers.TAGS, taggers.TAGS))))
    ids, y = rng.integers(0, taggers.SYMBOLS, (3, 6)).astype(np.uint8), rng.integers(0, taggers.TAGS, (3, 6))
    _, grads = taggers._gradients(m, ids, y)
    for k, g in enumerate(grads):
        for at in [tuple(int(rng.integers(0, n)) for n in g.shape) for _ in range(4)] + [np.unravel_index(np.abs(g).argmax(), g.shape)]:
            side = []
            for eps in (-1e-2, 1e-2):
                w = [v.copy() for v in m]
                w[k][at] += eps
                side.append(taggers._gradients(taggers.Model(*w), ids, y)[0])
            assert abs((side[1] - side[0]) / 2e-2 - g[at]) < 2e-2 * max(0.2, abs(g[at]))


def test_decoding_is_the_best_path():
    rng = np.random.default_rng(4)
    m = taggers.trained()
    ids = rng.integers(32, 127, (2, 4)).astype(np.uint8)
    tags, _ = taggers.decode(m, ids)
    e = taggers.emissions(m, ids)
    for n in range(2):
        score = lambda p: sum(e[t, n, v] for t, v in enumerate(p)) + sum(m.trans[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = max(np.ndindex(*(taggers.TAGS,) * 4), key=score)
        assert abs(score(best) - score(tags[n])) < 1e-3


def test_held_out_spans_of_the_model():
    m, hit, said, true = taggers.trained(), 0, 0, 0
    for seed in range(500, 520):  # none of which training saw
        text, spans = taggers.labelled(60, seed)
        got = set(personal.model_spans([text], m)[0])
        hit, said, true = hit + len(got & set(spans)), said + len(got), true + len(spans)
    assert hit / said > 0.85 and hit / true > 0.85, (hit, said, true)
    told = [x for x in taggers.KINDS]
    found = personal.spans_of(["write to anna.meier [at] mail [dot] org or call (030) 555-1234 today"], m)[0]
    assert {personal.KINDS[k] for _, k, _ in found} == {"email_like", "phone_like"} and told


def test_reconciling_against_all_subsets():
    rnd = random.Random(8)
    for _ in range(300):
        spans = []
        for _ in range(rnd.randint(0, 7)):
            a = rnd.randint(0, 20)
            spans.append((a, a + rnd.randint(1, 8), rnd.randint(0, 1), float(rnd.randint(1, 9)), False))
        got = personal.reconciled(spans)
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))
        gain = {}
        for a, b, k, g, _ in spans:
            gain[a, b, k] = max(g, gain.get((a, b, k), g))
        best = max(sum(gain[s] for s in c) for n in range(len(gain) + 1) for c in combinations(gain, n) if all(x[1] <= y[0] or y[1] <= x[0] for x, y in combinations(c, 2)))
        assert sum(gain[s] for s in got) == best
    assert personal.reconciled([(0, 96, 1, 5.0, True), (48, 144, 1, 6.0, True), (96, 130, 1, 4.0, True)]) == [(0, 144, 1)]


def test_windows_read_all_that_is_told():
    rng = np.random.default_rng(3)
    for n in (0, 1, 47, 48, 49, 96, 97, 500):
        told = rng.random(n) < 0.01
        starts = personal.windows(np.zeros(n, np.uint8), told)
        for at in np.flatnonzero(told):
            around = [s for s in range(0, max(1, n - 48), 48) if s <= at < s + 96]
            assert around and set(around) <= set(starts.tolist())


def test_scan_of_odd_rows(spark):
    text = "mail a.b@c-d.org, é " * 3
    rows = [(1, None, 1, "a", "b"), (2, "", 1, "a", "b"), (3, text, 1, "a", "b"), (3, text, 1, "a", "b"), (None, "x" * 200_000 + " 10.0.0.1 " + "9" * 200_000, 1, "a", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_spans int, row string, scanned string")
    got = sorted((r["row"]["doc_id"] or 0, [tuple(s) for s in r["pii_spans"] if s["kind"] < 4]) for r in personal.scan(df).collect())
    want = [(m.start(), 0, m.end()) for m in re.finditer(PLAIN[0], text)]
    assert got == [(0, [(200_001, 1, 200_009)]), (1, []), (2, []), (3, want), (3, want)]
    clean = {r["doc_id"]: r["text"] for r in personal.masked(df).collect()}
    assert clean[3] == "mail [email], é " * 3 and clean[1] is None and clean[2] == "" and personal.masked(df).columns == df.columns
    assert personal.scan(df.limit(0)).count() == 0


# ---------------------------------------------------------------- spelling variants


def variants_plainly(rows):
    counts = Counter()
    for i, text in rows:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    vocab = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    by = {w: [v for v in vocab if near(w, v)] for w in vocab}
    form = {}
    for w in vocab:
        best = min(by[w], key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if best is not None and vocab[best] >= 2 * vocab[w] else None
    out = set()
    for w in vocab:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, vocab[w], len(by[w]), vocab.get(form[w])))
    return out


@pytest.mark.parametrize("bits", [1 << 10, 1 << 20], ids=["crowded filter", "roomy filter"])
def test_variants_against_brute_force(spark, bits):
    rnd = random.Random(6)
    rows = []
    for i in range(400):
        words = ["".join(rnd.choices("abé", k=rnd.randint(4, 7))) for _ in range(rnd.randint(1, 12))] + ["aaaaa"] * rnd.randint(0, 3)
        rows.append((i, rnd.choice([" ", "-", "1 "]).join(rnd.choice([w, w.upper(), w]) for w in words)))
    rows += [(None, "aaaaab aaaaab aaaaab ÿÿÿÿÿ ÿÿÿÿÿ ÿÿÿÿÿ"), (5, None), (6, ""), (7, rows[3][1]), (7, rows[3][1]), (8, "bbbba " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).repartition(4)
    got = [tuple(r) for r in variants.variants(df, bits).collect()]
    want = variants_plainly(rows)
    assert len(got) == len(want) and set(got) == want and len({r for _, f, r, *_ in want if f}) > 3
    assert max(n for *_, n, _ in want) > 5


def test_variants_of_nothing(spark):
    assert variants.variants(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 0
    assert variants.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_neighbourhood_is_whole_and_distinct(spark):
    word, letters = "aabé", "abcé"
    got = [r["candidate"] for r in variants.neighbourhood(spark.createDataFrame([(word, 1)], "word string, n long"), letters).collect()]
    want = {word[:i] + word[i + 1 :] for i in range(4)} | {word[:i] + c + word[i + 1 :] for i in range(4) for c in letters} | {word[:i] + c + word[i:] for i in range(5) for c in letters}
    assert sorted(got) == sorted(want - {word})


# ---------------------------------------------------------------- SQL


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_spelling_variants"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    from quizmill.llm import queries

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    cur = con.execute(queries.oracle_sql()[name])
    assert [c[0] for c in cur.description] == df.columns
    want = Counter(cur.fetchall())
    assert want and Counter(tuple(r) for r in df.collect()) == want
