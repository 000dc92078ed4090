"""Work in order without a task for each group: running sums, numbers and exact quantiles over ranges of rows, and the
replay of guarded state machines as a scan.

Rows are dealt out by range of group and order, so that a group with most of all rows is many tasks' work. What a range
has to know of those before it concerns the group it begins with alone: a row for each range, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from quizmill.operators.lifecycle import EDGES, STATES
from quizmill.sources.staging import stage


def ranges(df: DataFrame, keys: list[str], order: list[str], name: str = "ranges") -> DataFrame:
    """df in order of keys and order, staged, with the number _part of the range and the place _pos, which grows in that order."""
    x = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_pos", F.monotonically_increasing_id())
    return stage(x.withColumn("_part", F.shiftright("_pos", 33).cast("int")), name)


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda p, q: p & q, (a[n].eqNullSafe(b[n]) for n in names))


def running(df: DataFrame, keys: list[str], order: list[str], weight: Column, out: str = "before") -> DataFrame:
    """df with the sum of the weights of the rows before each in its group; null keys are a group of their own.

    Rows that are alike in keys and order stand in one range, in no fixed order among themselves.
    """
    x = ranges(df.withColumn("_w", weight), keys, order)
    pieces = x.groupBy("_part", *keys).agg(F.sum("_w").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.withColumn("_c", F.sum("_n").over(w)).where("_c is not null").drop("_n")  # the first group of a range at most: a row a range
    inner = F.sum("_w").over(Window.partitionBy("_part", *keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_i", F.coalesce(inner, F.lit(0)))
    joined = x.join(F.broadcast(carried), _same(x, carried, ["_part", *keys]), "left")
    return joined.select(*(x[c] for c in df.columns), (x["_i"] + F.coalesce(carried["_c"], F.lit(0))).alias(out))


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], accuracy: int = 1000) -> DataFrame:
    """by and, for each name in shares, the exact quantile of the values (doubles, nulls left out) by linear interpolation.

    A sketch of fixed size gives, for each group and share, two values that the wanted ranks lie between, off by two of its
    errors on either side. One pass counts what is below and takes the distinct values in between with their counts; their
    exact ranks come from running sums over ranges. So no task holds the values of a group, nor orders them. Of groups of fewer
    than 2 * accuracy values all are ranked. Groups without a value have nulls.
    """
    names = list(shares)
    eps = 2.0 / accuracy
    x = df.select(*by, F.col(value).cast("double").alias("_v"))
    edges = sorted({round(min(1.0, max(0.0, p + d)), 12) for p in shares.values() for d in (-eps, eps)})
    per = x.groupBy(*by).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", F.array(*map(F.lit, edges)), F.lit(accuracy)).alias("_q"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    # a rank and the next of it are a sketch's error and two places off at most, which is less than eps in all but small groups
    at = lambda p, d, end: F.col(end) if not 0 < p + d < 1 else F.when(F.col("_n") < 4 / eps, F.col(end)).otherwise(F.col("_q")[edges.index(round(p + d, 12))])
    wanted = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(p).alias("p"), at(p, -eps, "_low").alias("low"), at(p, eps, "_high").alias("high")) for n, p in shares.items()))
    per = stage(per.select(*by, "_n", wanted.alias("_wanted")), "sketches")
    inside = x.where("_v is not null").join(per, _same(x, per, by)) if by else x.where("_v is not null").crossJoin(F.broadcast(per))  # one row without groups
    inside = inside.select(*(x[c] for c in by), "_v", F.explode("_wanted").alias("_s")).where("_v <= _s.high")
    # what lies below the range is one number for each group and share
    counted = inside.select(*by, F.col("_s.name").alias("_name"), F.when(F.col("_v") >= F.col("_s.low"), F.col("_v")).alias("_v")).groupBy(*by, "_name", "_v").agg(F.count("*").alias("_c"))
    ranked = running(counted, [*by, "_name"], ["_v"], F.col("_c"), "_b")  # null, the values below, stands first
    rows = per.select(*by, "_n", F.explode("_wanted").alias("_s")).select(*by, "_n", F.col("_s.name").alias("_name"), ((F.col("_n") - 1) * F.col("_s.p")).alias("_h"))
    ranks = rows.select("*", F.explode(F.array(F.struct(F.floor("_h").alias("r"), (1 - (F.col("_h") - F.floor("_h"))).alias("w")), F.struct((F.floor("_h") + 1).alias("r"), (F.col("_h") - F.floor("_h")).alias("w")))).alias("_r"))
    hit = ranked.join(ranks, _same(ranked, ranks, [*by, "_name"])).where("_v is not null and _b <= _r.r and _r.r < _b + _c")
    found = hit.groupBy(*(ranks[c] for c in by)).agg(*(F.sum(F.when(ranks["_name"] == n, F.col("_v") * F.col("_r.w"))).alias(n) for n in names))
    all_ = per.select(*by)
    if not by:
        return found.select(*names)
    return all_.join(found, _same(all_, found, by), "left").select(*(all_[c] for c in by), *names)


def with_quantiles(groups: DataFrame, df: DataFrame, by: list[str], value: str, shares: dict[str, float], digits: int = 6) -> DataFrame:
    """groups (one row for each by) with the rounded quantiles of df's values."""
    q = quantiles(df, by, value, shares).select(*by, *(F.round(n, digits).alias(n) for n in shares))
    joined = groups.join(q, _same(groups, q, by), "left") if by else groups.crossJoin(F.broadcast(q))  # one row each
    return joined.select(*(groups[c] for c in groups.columns), *(q[n] for n in shares))


# ---------------------------------------------------------------- replay

NONE, UNKNOWN = 0, len(STATES) + 1  # before the first event; a state outside the graph


def transition(now: int, to: int) -> int:
    """The state after an event: the first must be REQUESTED, later ones follow the graph; what is not allowed leaves the state as it is."""
    if now == NONE:
        return to if to == 1 else now
    return to if to != UNKNOWN and (STATES[now - 1], STATES[to - 1]) in _GRAPH else now


_GRAPH = set(EDGES)
TABLE = [[transition(a, b) for b in range(UNKNOWN + 1)] for a in range(UNKNOWN)]


def accepted(now: int, to: int) -> bool:
    return to == 1 if now == NONE else to != UNKNOWN and (STATES[now - 1], STATES[to - 1]) in _GRAPH


OK = [[accepted(a, b) for b in range(UNKNOWN + 1)] for a in range(UNKNOWN)]


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range: its number, whether one request fills it, rows of and function over states of its first request, and those of its last."""
    same = list(range(UNKNOWN))
    part, runs = None, []  # of a range the first and the latest run: [key, rows, function]

    def done() -> pa.RecordBatch:
        first, last = runs[0], runs[-1]
        return pa.RecordBatch.from_pylist([{"part": part, "one": len(runs) == 1, "first": first[2], "n_first": first[1], "last": last[2], "n_last": last[1]}], schema=_COMPOSED)

    for b in batches:
        for p, key, to in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if p != part:
                if runs:
                    yield done()
                part, runs = p, []
            if not runs or runs[-1][0] != key:
                runs = [*runs[:1], [key, 0, same]]
            run = runs[-1]
            run[1] += 1
            row = [t[to] for t in TABLE]
            run[2] = [row[s] for s in run[2]]
    if runs:
        yield done()


_COMPOSED = pa.schema([("part", pa.int32()), ("one", pa.bool_()), ("first", pa.list_(pa.int32())), ("n_first", pa.int64()), ("last", pa.list_(pa.int32())), ("n_last", pa.int64())])


def replay(log: DataFrame, key: str, order: list[str], state: str = "state", lenient: bool = False) -> DataFrame:
    """key, order, seq, from_state, to_state, accepted: every event of every request, judged in order.

    A rejected event leaves the state as it is. lenient: an event that repeats the present state is none, and is left out.
    seq numbers a request's events from 1, those left out too. order tells a request's events apart; ties go by state.
    Null keys are one request, null states and states outside the graph are rejected.

    An event is a function over the ten states, and functions compose: a first pass composes each range of rows, the
    functions of the ranges (one row each) are applied one after another, and a second pass replays each range from the
    state that its first request has by then. A request with most of all events is many ranges.
    """
    code = F.coalesce(F.expr(f"element_at(map({', '.join(f'{s!r}, {i}' for i, s in enumerate(STATES, 1))}), to_state)"), F.lit(UNKNOWN)).cast("int")
    x = ranges(log.select(key, *order, F.col(state).alias("to_state")).withColumn("_code", code), [key], [*order, "to_state"], "log")
    again = x.repartition("_part").sortWithinPartitions("_part", "_pos")
    pieces = sorted(again.select("_part", key, "_code").mapInArrow(_compose, "part int, one boolean, first array<int>, n_first long, last array<int>, n_last long").collect(), key=lambda r: r["part"])  # a row a range
    begins = {r["_part"]: r["k"] for r in x.groupBy("_part").agg(F.struct(F.min_by(key, "_pos").alias("a"), F.max_by(key, "_pos").alias("b")).alias("k")).collect()}
    start, before = {}, None
    for r in pieces:
        first, last = begins[r["part"]]
        now, n = before[1:] if before is not None and before[0] == first else (NONE, 0)
        start[r["part"]] = now, n
        before = (last, r["first"][now], n + r["n_first"]) if r["one"] else (last, r["last"][NONE], r["n_last"])
    kept = [log.schema[key], *(log.schema[c] for c in order)]
    out = StructType([*kept, StructField("seq", LongType()), StructField("from_state", StringType()), StructField("to_state", StringType()), StructField("accepted", BooleanType())])
    names = [None, *STATES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, now, n = None, object(), NONE, 0
        for b in batches:
            rows, seqs, froms, oks = [], [], [], []
            for i, (p, k, to) in enumerate(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_part", key, "_code")), strict=True)):
                if p != part:
                    part, at, (now, n) = p, k, start[p]
                elif k != at:
                    at, now, n = k, NONE, 0
                n += 1
                if lenient and to == now:
                    continue
                rows.append(i)
                seqs.append(n)
                froms.append(names[now])
                oks.append(OK[now][to])
                now = TABLE[now][to]
            some = b.take(pa.array(rows, pa.int64()))
            given = [some.column(b.schema.get_field_index(c.name)) for c in kept]
            yield pa.RecordBatch.from_arrays([*given, pa.array(seqs, pa.int64()), pa.array(froms, pa.string()), some.column(b.schema.get_field_index("to_state")), pa.array(oks, pa.bool_())], names=out.names)

    return again.select("_part", key, *order, "_code", "to_state").mapInArrow(run, out)


def final_states(log: DataFrame, key: str, order: list[str], state: str = "state") -> DataFrame:
    """key, state, accepted, rejected: where the replay leaves each request (null: nowhere), and how many events were taken or not."""
    r = replay(log, key, order, state)
    last = F.max_by(F.when(F.col("accepted"), F.col("to_state")).otherwise(F.col("from_state")), "seq")
    return r.groupBy(key).agg(last.alias("state"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


def numbered(df: DataFrame, group: str, order: str, out: str = "repetition") -> DataFrame:
    """df with a running number from 1 in its group, by range."""
    return running(df, [group], [order], F.lit(1), out).withColumn(out, F.col(out) + 1)


