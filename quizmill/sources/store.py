"""A keyed store of rows with copy on write: data in buckets of the key, manifests that name each bucket's folder.

An upsert reads and writes the buckets that its keys fall into, and no others; the new version is one manifest, moved into
place in one step that fails if another writer was first. Older manifests and their folders stay, so a reader keeps its
snapshot while the store is written.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer made this version."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a store, oldest first."""
    _, p, fs = _fs(spark, f"{path}/manifests")
    return sorted(int(s.getPath().getName()[1:-5]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v")) if fs.exists(p) else []


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """A version's key, schema and folders by bucket; the newest if none is named."""
    jvm, p, fs = _fs(spark, f"{path}/manifests/v{(versions(spark, path)[-1] if version is None else version):08d}.json")
    stream = fs.open(p)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, version: int, content: dict) -> None:
    jvm, draft, fs = _fs(spark, f"{path}/manifests/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(content | {"version": version}).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/v{version:08d}.json")
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(draft, target, options)  # fails where the target is there
    except Exception as e:
        fs.delete(draft, False)
        raise Conflict(f"version {version} of {path} was written meanwhile") from e


def _write(df: DataFrame, path: str, key: str, buckets: int) -> dict[str, str]:
    """Rows in a new folder for each bucket; which folder each bucket with rows has."""
    folder = f"data/{uuid.uuid4().hex}"
    x = df.withColumn("_bucket", bucket_of(key, buckets))
    x.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    _, p, fs = _fs(df.sparkSession, f"{path}/{folder}")
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith("_bucket=")}


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def create(df: DataFrame, path: str, key: str, buckets: int = 64) -> int:
    """A store of the rows of df, whose keys are unique; its first version."""
    _publish(df.sparkSession, path, 1, {"key": key, "n": buckets, "schema": df.schema.json(), "buckets": _write(df, path, key, buckets)})
    return 1


def read(spark: SparkSession, path: str, version: int | None = None, only: list[str] | None = None) -> DataFrame:
    """The rows of a version, the newest if none is named; of some buckets, if they are named."""
    from pyspark.sql.types import StructType

    m = manifest(spark, path, version)
    folders = [f"{path}/{f}" for b, f in sorted(m["buckets"].items()) if only is None or b in only]
    schema = StructType.fromJson(json.loads(m["schema"]))
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert(df: DataFrame, path: str) -> int:
    """The next version: rows of df in place of those with their keys, and beside the others. Of rows of df with one key any may stay."""
    spark = df.sparkSession
    last = versions(spark, path)[-1]
    m = manifest(spark, path, last)
    key, n = m["key"], m["n"]
    touched = [str(r[0]) for r in df.select(bucket_of(key, n)).distinct().collect()]  # n at most
    if not touched:
        return last
    new = df.select(*read(spark, path, last, []).columns).dropDuplicates([key])
    kept = read(spark, path, last, touched).join(new.select(F.col(key).alias("_new")), F.col(key).eqNullSafe(F.col("_new")), "left_anti")
    written = _write(kept.unionByName(new), path, key, n)
    _publish(spark, path, last + 1, m | {"buckets": m["buckets"] | written})
    return last + 1


def append_once(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream batch by batch so that a batch that runs again leaves one copy; the started query.

    A batch's number names its folder and its line in the ledger: a batch in the ledger is passed over, one that stopped
    before it got there is written over. `appended` reads what the ledger holds.
    """

    def run(batch: DataFrame, number: int) -> None:
        _, line, fs = _fs(spark, f"{path}/ledger/{number:012d}")
        if fs.exists(line):
            return
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={number:012d}")
        fs.create(line, True).close()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all batches in the ledger; folders of batches that never ended are not read."""
    _, p, fs = _fs(spark, f"{path}/ledger")
    names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
    return spark.read.schema(schema).parquet(*(f"{path}/data/batch={n}" for n in names)) if names else spark.createDataFrame([], schema)
