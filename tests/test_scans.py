"""Scans by range against plain Python and numpy: replay, quantiles, numbers, with hot groups, nulls and ties; the stream gives the batch's rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from quizmill.operators import campaign, retrieval, scans
from quizmill.operators.lifecycle import EDGES, STATES
from quizmill.streaming.guard import guarded

GRAPH = set(EDGES)


@pytest.fixture(autouse=True)
def several_ranges(spark):
    """Small ranges are not put together here, so that groups lie over several."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def replayed_plainly(rows, lenient):
    now, n, out = {}, {}, []
    for key, at, to in rows:
        state = now.get(key)
        n[key] = n.get(key, 0) + 1
        if lenient and state is not None and to == state:
            continue
        ok = to == "REQUESTED" if state is None else (state, to) in GRAPH
        out.append((key, at, n[key], state, to, ok))
        now[key] = to if ok else state
    return out


def events(n, seed, hot=0.6):
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < hot else rnd.choice([None, "a", "b", "c"]), i, rnd.choice([*STATES[:6], "REQUESTED", "unheard of", None])) for i in range(n)]


@pytest.mark.parametrize("lenient", [False, True])
def test_replay_against_plain_python(spark, lenient):
    rows = events(3000, 1)
    shuffled = random.Random(2).sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "rid string, at long, state string").repartition(6)
    got = sorted((tuple(r) for r in scans.replay(df, "rid", ["at"], lenient=lenient).collect()), key=lambda r: r[1])
    assert got == replayed_plainly(rows, lenient)
    assert {r[0] for r in got} == {None, "hot", "a", "b", "c"}


def test_a_hot_request_is_many_ranges(spark):
    df = spark.createDataFrame(events(3000, 3, hot=1.0), "rid string, at long, state string")
    x = scans.ranges(df, ["rid"], ["at"])
    sizes = [r["count"] for r in x.groupBy("_part").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 2000
    assert scans.replay(df.limit(0), "rid", ["at"]).count() == 0
    last = {r[0]: tuple(r) for r in scans.final_states(df, "rid", ["at"]).collect()}
    want = replayed_plainly(sorted((tuple(r) for r in df.collect()), key=lambda r: r[1]), False)
    state = [t if ok else f for *_, f, t, ok in want][-1]
    assert last == {"hot": ("hot", state, sum(r[-1] for r in want), sum(not r[-1] for r in want))}


def test_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    rows = [r for r in events(600, 5) if r[0] is not None and r[2] is not None]
    n, seqs = {}, []
    for key, _, state in rows:
        n[key] = n.get(key, 0) + 1
        seqs.append((key, n[key], state))
    for k in range(3):  # three batches, in order
        spark.createDataFrame(seqs[k * 200 : (k + 1) * 200], "rid string, seq long, state string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("rid string, seq long, state string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = guarded(stream).writeStream.format("memory").queryName("judged").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = scans.replay(spark.createDataFrame(seqs, "rid string, seq long, state string").withColumnRenamed("seq", "at"), "rid", ["at"])
    cols = ["rid", "seq", "from_state", "to_state", "accepted"]
    assert sorted(map(str, spark.table("judged").select(cols).collect())) == sorted(map(str, batch.select(cols).collect()))


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(4)
    groups = {"hot": rng.normal(0, 50, 20_000), "ties": rng.integers(0, 4, 3_000) * 1.0, "one": np.array([7.5]), None: rng.random(11), "two": np.array([1.0, 2.0]), "same": np.full(500, 3.25)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None), ("hot", None), ("one", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"low": 0.0, "p1": 0.01, "mid": 0.5, "p95": 0.95, "p999": 0.999, "high": 1.0}
    got = {r["g"]: r for r in scans.quantiles(df, ["g"], "v", shares, accuracy=100).collect()}
    assert set(got) == {*groups, "none"}
    assert all(got["none"][n] is None for n in shares)
    for g, vs in groups.items():
        for n, p in shares.items():
            assert got[g][n] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-12), (g, n)
    whole = scans.quantiles(df, [], "v", {"mid": 0.5}).first()
    assert whole["mid"] == pytest.approx(np.quantile(np.concatenate(list(groups.values())), 0.5))
    assert scans.quantiles(df.limit(0), ["g"], "v", shares).count() == 0


def test_summaries_use_them(spark):
    df = spark.createDataFrame([("a", float(v), v % 3 > 0, v) for v in range(101)], "g string, s double, ok boolean, tokens long")
    row = campaign.summary(df, ["g"], F.col("ok"), "s", "tokens").first()
    good = [v for v in range(101) if v % 3 > 0]
    assert (row["median_seconds"], row["p95_seconds"]) == (np.quantile(good, 0.5), round(float(np.quantile(good, 0.95)), 6))
    assert campaign.describe(df, ["g"], "s").first()["median"] == 50.0


def test_numbers_by_range(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(["hot", "hot", "hot", None, "b"]), i) for i in range(2500)]
    got = {r["i"]: (r["g"], r["repetition"], r["case_id"]) for r in campaign.numbered(spark.createDataFrame(rows, "g string, i long").repartition(5), "g", "i").collect()}
    n = {}
    for g, i in rows:
        n[g] = n.get(g, 0) + 1
        assert got[i][:2] == (g, n[g]) and got[i][2] == (f"{n[g]:03d}" if g is None else f"{g}-{n[g]:03d}")


@pytest.mark.parametrize("few", [0, 20, 100_000])
def test_greedy_dedupe_with_null_keys_and_chains(spark, monkeypatch, few):
    monkeypatch.setattr(retrieval, "FEW", few)
    rnd = random.Random(7)
    rows = [(i, rnd.choice([None, *"abcdefghijklmnop"]) if rnd.random() < 0.8 else f"u{i}", rnd.choice([None, *range(12)]) if rnd.random() < 0.7 else 100 + i) for i in range(120)]
    seen_a, seen_b, want = set(), set(), []
    for i, a, b in rows:
        if (a is None or a not in seen_a) and (b is None or b not in seen_b):
            want.append(i)
            seen_a |= {a} - {None}
            seen_b |= {b} - {None}
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "i long, a string, b long").repartition(4)
    assert sorted(r["i"] for r in retrieval.greedy_dedupe(df, "i", ("a", "b")).collect()) == want
    none = spark.createDataFrame([(1, None, None), (2, None, None), (3, None, 5), (4, None, 5)], "i long, a string, b long")
    assert sorted(r["i"] for r in retrieval.greedy_dedupe(none, "i", ("a", "b")).collect()) == [1, 2, 3]


def test_greedy_dedupe_ends_a_long_chain(spark):
    # each row waits for the one before: (a0,b0) (a1,b0) (a1,b1) (a2,b1) ...
    rows = [(i, (i + 1) // 2, i // 2) for i in range(20_000)]
    got = sorted(r["i"] for r in retrieval.greedy_dedupe(spark.createDataFrame(rows, "i long, a long, b long"), "i", ("a", "b")).collect())
    assert got == [*range(0, 20_000, 2)]
