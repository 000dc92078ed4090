"""Versions by time: validity intervals from changes, joins by time of use; canonical profiles; histories by one shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intervals(changes: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """changes with version (from 1), valid_from and valid_to: each holds until the next of its key, the last without end (null).

    Changes of one time are versions in order of tie; all but the last of them hold for no time.
    """
    w = Window.partitionBy(key).orderBy(at, tie)
    return changes.withColumn("version", F.row_number().over(w).cast("long")).withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(w))


def version_at(uses: DataFrame, versions: DataFrame, key: str, at: str, width: str = "1 day") -> DataFrame:
    """uses with the version that held at their time, null where none did.

    A range join by bins of time: an interval is a row in each bin of `width` that it lies in, up to the last use, a use in
    one; both meet by key and bin, so neither a key with many versions nor one with many uses is one task's pairs.
    Intervals that hold for no time are left out.
    """
    bin_of = lambda c: F.floor(F.unix_micros(c) / (_seconds(width) * 1_000_000)).cast("long")
    end = uses.agg(F.max(at).alias("_end"))  # one row
    v = versions.where("valid_to is null or valid_to > valid_from").crossJoin(F.broadcast(end)).where(F.col("valid_from") <= F.col("_end"))
    last = F.least(F.coalesce("valid_to", "_end"), "_end")
    v = v.select(F.col(key).alias("_key"), "version", "valid_from", "valid_to", F.explode(F.sequence(bin_of(F.col("valid_from")), bin_of(last))).alias("_bin"))
    u = uses.withColumn("_ubin", bin_of(F.col(at)))
    holds = (u[key] == v["_key"]) & (u["_ubin"] == v["_bin"]) & (v["valid_from"] <= u[at]) & (v["valid_to"].isNull() | (u[at] < v["valid_to"]))
    return u.join(v, holds, "left").select(*(u[c] for c in uses.columns), "version")


def _seconds(width: str) -> int:
    n, unit = width.split()
    return int(n) * {"hour": 3600, "day": 86400, "week": 604800}[unit.rstrip("s")]


def canonical(json: Column) -> Column:
    """Nested JSON in one form: keys of objects in order at all depths, no space, numbers without needless zeros; null where it is no JSON.

    A variant keeps an object's keys sorted; order in arrays stays, as it tells. Numbers with an exponent are floating ones and unlike
    whole ones of the same value.
    """
    return F.to_json(F.try_parse_json(json))


def profile_key(json: Column) -> Column:
    """A digest of a profile that is the same for equal profiles, however their keys are ordered; null for what is no JSON."""
    return F.sha2(canonical(json).cast("binary"), 256)


def reusable(reports: DataFrame, wanted: DataFrame, key: str, profile: str, at: str, tie: str) -> DataFrame:
    """wanted (key, profile) with the newest report made for its key under an equal profile; those without one are left out."""
    new = reports.withColumn("_p", profile_key(F.col(profile))).where("_p is not null")
    rest = [c for c in reports.columns if c not in (key, profile)]
    newest = new.groupBy(key, "_p").agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("_r"))
    return wanted.withColumn("_p", profile_key(F.col(profile))).join(newest, [key, "_p"]).select(key, profile, "_r.*")


def histories(requests: DataFrame, children: dict[str, DataFrame], key: str = "request_id", order: str = "id") -> DataFrame:
    """requests (key and more) with an array for each child table, of structs of its columns but the key, in order of `order`.

    Requests and all children are one tagged union, dealt out once by key; rows of children without a request are left
    out, requests without children have empty arrays. A null key is a request like others.
    """
    own = F.struct(*requests.columns)
    parts = [requests.select(F.col(key).alias("_key"), own.alias("_request"))]
    for name, df in children.items():
        rest = [c for c in df.columns if c not in (key, order)]
        parts.append(df.select(F.col(key).alias("_key"), F.struct(order, *rest).alias(name)))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    lists = [F.array_sort(F.collect_list(n)).alias(n) for n in children]  # nulls of other tables are not collected
    x = union.groupBy("_key").agg(F.first("_request", ignorenulls=True).alias("_request"), *lists).where("_request is not null")
    return x.select("_request.*", *children)
