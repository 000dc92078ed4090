"""Intermediate tables in the folder that driver and executors share, so that a lost executor costs no recomputation."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

_left: list[str] = []
_tables: dict[str, DataFrame] = {}  # those in the catalog, by folder


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, in local mode alone, a folder below the warehouse where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return folder.rstrip("/")


def _delete(jvm, conf, path: str) -> None:
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file system layer."""
    _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop_left, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
    _left.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """A DataFrame written as Parquet to the shared folder and read back: its lineage ends there. What is left when the driver ends is deleted then."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Like `stage`, with rows of equal keys in one bucket: joins on just these keys read them where they are, without a shuffle.

    The table is in the session's catalog until it is dropped, which should be done as soon as nothing reads it.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    folder = path.rsplit("/", 1)[1]
    table = folder.replace("-", "_")
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).format("parquet").option("path", path).saveAsTable(table)
    _tables[folder] = spark.table(table)
    return _tables[folder]


def drop(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 2)[1] for f in df.inputFiles()} | {k for k, x in _tables.items() if x is df}:
        if _tables.pop(name, None) is not None:
            spark.sql(f"DROP TABLE `{name.replace('-', '_')}`")
        for path in [p for p in _left if p.endswith(f"/{name}")]:
            drop_folder(spark, path)
            _left.remove(path)


def _drop_left(jvm, conf, path: str) -> None:
    if path in _left:
        _left.remove(path)
        with contextlib.suppress(Exception):  # the JVM may have ended before
            _delete(jvm, conf, path)
