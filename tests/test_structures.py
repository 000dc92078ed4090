"""The keyed store, appends that can be repeated, versions by time, canonical profiles and histories."""

import datetime as dt
import json
import random
from contextlib import redirect_stdout
from io import StringIO
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from quizmill.operators import registry
from quizmill.sources import store


def data_files(path):
    return {str(p) for p in Path(path).rglob("*.parquet")}


def test_an_upsert_writes_the_buckets_it_touches(spark, tmp_path):
    path = f"{tmp_path}/s"
    df = spark.range(2000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    store.create(df, path, "k", 16)
    before, first = data_files(path), store.manifest(spark, path)
    new = spark.createDataFrame([(5, "new"), (5000, "more"), (None, "null key")], "k long, v string")
    assert store.upsert(new, path) == 2
    touched = {str(r[0]) for r in new.select(store.bucket_of("k", 16)).distinct().collect()}
    second = store.manifest(spark, path)
    changed = {b for b in second["buckets"] if first["buckets"].get(b) != second["buckets"][b]}
    assert changed == touched and len(touched) < 4
    assert before < data_files(path) and len(data_files(path) - before) == len(touched)
    got = {r["k"]: r["v"] for r in store.read(spark, path).collect()}
    assert len(got) == 2002 and got[5] == "new" and got[5000] == "more" and got[None] == "null key" and got[6] == "old"
    old = {r["k"]: r["v"] for r in store.read(spark, path, 1).collect()}  # the snapshot from before
    assert len(old) == 2000 and set(old.values()) == {"old"}
    store.upsert(spark.createDataFrame([(None, "again"), (7, "x"), (7, "x")], "k long, v string"), path)
    now = [tuple(r) for r in store.read(spark, path).where("k is null or k = 7").collect()]
    assert sorted(now, key=str) == [(7, "x"), (None, "again")] and store.versions(spark, path) == [1, 2, 3]
    assert store.upsert(new.limit(0), path) == 3


def test_one_of_two_writers_wins(spark, tmp_path):
    path = f"{tmp_path}/s"
    store.create(spark.range(10).withColumnRenamed("id", "k"), path, "k", 4)
    m = store.manifest(spark, path)
    store._publish(spark, path, 2, m)
    with pytest.raises(store.Conflict):
        store._publish(spark, path, 2, m)
    assert store.versions(spark, path) == [1, 2] and not list(Path(path).rglob(".draft*.json"))
    empty = f"{tmp_path}/e"
    store.create(spark.range(0).withColumnRenamed("id", "k"), empty, "k")
    assert store.read(spark, empty).count() == 0
    store.upsert(spark.range(3).withColumnRenamed("id", "k"), empty)
    assert store.read(spark, empty).count() == 3


def test_a_batch_run_twice_leaves_one_copy(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "k long"
    spark.range(50).selectExpr("id AS k").coalesce(1).write.parquet(source)
    run = lambda n: store.append_once(spark, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), path, f"{tmp_path}/ck{n}").awaitTermination()
    rows = lambda: sorted(r["k"] for r in store.appended(spark, path, schema).collect())
    assert rows() == []
    run(0)
    assert rows() == [*range(50)]
    run(1)  # without its checkpoint the batch comes again
    assert rows() == [*range(50)]
    spark.range(50, 60).selectExpr("id AS k").coalesce(1).write.mode("append").parquet(source)
    run(0)
    assert rows() == [*range(60)]
    # a batch that was cut off before it got into the ledger is not read, and is written over
    (Path(path) / "ledger" / f"{1:012d}").unlink()
    assert rows() == [*range(50)]


def test_versions_by_time_against_plain_python(spark):
    rnd = random.Random(3)
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    changes = [(rnd.choice(["hot", "hot", "hot", "b"]), t(rnd.randint(0, 9000)), i) for i in range(120)] + [("hot", t(500), 500), ("hot", t(500), 501)]
    uses = [(i, rnd.choice(["hot", "b", "none", None]), t(rnd.randint(-50, 12000))) for i in range(500)] + [(500, "hot", t(500)), (501, "hot", None)]
    c = spark.createDataFrame(changes, "k string, at timestamp, id long")
    u = spark.createDataFrame(uses, "use long, k string, at timestamp")
    for width in ("1 hour", "1 day", "3 week"):
        got = {r["use"]: r["version"] for r in registry.version_at(u, registry.intervals(c, "k", "at", "id"), "k", "at", width).collect()}
        assert len(got) == len(uses)
        for i, k, at in uses:
            n = sum(a == k and at is not None and b <= at for a, b, _ in changes)
            assert got[i] == (n or None), (width, i)
    assert registry.version_at(u.limit(0), registry.intervals(c, "k", "at", "id"), "k", "at").count() == 0


def test_canonical_profiles(spark):
    rnd = random.Random(5)

    def shuffled(v):
        if isinstance(v, dict):
            return {k: shuffled(v[k]) for k in rnd.sample([*v], len(v))}
        return [shuffled(x) for x in v] if isinstance(v, list) else v

    profile = {"b": {"z": 1, "a": [1, {"q": 2, "p": None}], "é": "x\"y"}, "a": True, "list": [3, 1, 2]}
    rows = [(json.dumps(shuffled(profile), indent=rnd.choice([None, 1, 4]), ensure_ascii=rnd.random() < 0.5),) for _ in range(20)]
    df = spark.createDataFrame(rows, "j string")
    assert df.select(registry.profile_key(F.col("j"))).distinct().count() == 1
    others = [({**profile, "list": [1, 2, 3]},), ({**profile, "a": "true"},), ({**profile, "c": None},), (profile,)]
    df = spark.createDataFrame([(json.dumps(o),) for (o,) in others] + [("{broken",), (None,)], "j string")
    keys = [r[0] for r in df.select(registry.profile_key(F.col("j"))).collect()]
    assert len(set(keys[:4])) == 4 and keys[4:] == [None, None]


def test_histories_take_one_shuffle(spark):
    req = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n"), (4, "d")], "request_id long, name string")
    kids = {n: spark.createDataFrame([(1, 3, f"{n}3"), (1, 1, f"{n}1"), (9, 1, "lost"), (None, 5, "null")] if n != "f" else [], "request_id long, id long, v string") for n in "abcdef"}
    df = registry.histories(req, kids)
    rows = {r["request_id"]: r for r in df.collect()}
    assert set(rows) == {1, 2, None, 4}
    assert [tuple(x) for x in rows[1]["a"]] == [(1, "a1"), (3, "a3")] and rows[2]["c"] == [] and rows[1]["f"] == [] and [tuple(x) for x in rows[None]["e"]] == [(5, "null")]
    out = StringIO()
    with redirect_stdout(out):
        registry.histories(req, kids).explain()
    assert out.getvalue().count("Exchange hashpartitioning") == 1 and "Join" not in out.getvalue()
