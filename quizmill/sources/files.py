"""Sources and sinks: JSON lines with line numbers, run files, CSV, pairs of files, reports."""

from __future__ import annotations

import contextlib
import hashlib
import json
import sqlite3

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, lines counted from 1 in each file, blank ones counted but left out.

    Files are read in splits. Ids that rise by one within a split give each line its place there; the splits' line
    counts, summed in order of their offsets, give what comes before. Only that table of splits is shuffled.
    """
    x = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"), "value")
    splits = x.groupBy("file", "at").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    y = x.join(splits, ["file", "at"]).select("file", (F.col("before") + F.col("i") - F.col("first") + 1).cast("long").alias("line"), "value")
    return y.where(F.trim("value") != "")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Rows of JSON lines with file and line. strict: an invalid line raises with its number; else it is kept with json_invalid set."""
    x = read_lines(spark, path).withColumn("r", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r._bad").isNotNull() | F.col("r").isNull()
    if strict:
        x = x.withColumn("r", F.when(bad, F.raise_error(F.concat(F.lit("invalid JSON in line "), F.col("line").cast("string"))).cast(x.schema["r"].dataType)).otherwise(F.col("r")))
    names = [f.name for f in x.schema["r"].dataType.fields if f.name != "_bad"]
    return x.select("file", "line", *(F.col(f"r.{n}").alias(n) for n in names), *([] if strict else [bad.alias("json_invalid")]))


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_run(spark: SparkSession, path: str, items: str = "items") -> DataFrame:
    """The items of nested run files, one row each, with the file they are from."""
    x = spark.read.option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    return x.select("file", F.explode(items).alias("item")).select("file", "item.*")


def read_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """CSV as text columns; a byte order mark at the start is dropped."""
    df = spark.read.csv(path, header=header, quote='"', escape='"', multiLine=True)
    return df.toDF(*(c.lstrip("﻿") if header else f"c{i}" for i, c in enumerate(df.columns)))


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Header in order of `columns` (all by default); fields are quoted where they hold quotes, commas or newlines."""
    df.select(*(columns or df.columns)).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def union_of_columns(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns in order of first appearance, missing ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def file_pairs(spark: SparkSession, path: str, left: str, right: str) -> DataFrame:
    """(stem, left_file, right_file) of files that differ in their suffix only; content is not read."""
    files = spark.read.format("binaryFile").load(path).select("path")
    side = lambda s, n: files.where(F.col("path").endswith(s)).select(F.expr(f"left(path, length(path) - {len(s)})").alias("stem"), F.col("path").alias(n))
    return side(left, "left_file").join(side(right, "right_file"), "stem", "left")


def content_hash(spark: SparkSession, path: str) -> DataFrame:
    """(path, md5, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def jsonl_digest(df: DataFrame, order: str) -> str:
    """SHA-256 of a table as JSON lines in an order, streamed partition by partition."""
    h = hashlib.sha256()
    for r in df.orderBy(order).select(F.to_json(F.struct(*df.columns)).alias("j")).toLocalIterator():
        h.update((r["j"] + "\n").encode())
    return h.hexdigest()


def write_jsonl_digested(df: DataFrame, path: str, order: str) -> str:
    """One file of JSON lines in an order, and the SHA-256 of its bytes; for sets that one file can hold."""
    df.orderBy(order).select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return content_hash(df.sparkSession, f"{path}/part-*").first()["sha256"]


def as_pinned(spark: SparkSession, path: str, md5: str) -> bool:
    """Whether a file has the digest it is pinned to; a caller may warn if not."""
    return all(r["md5"] == md5.lower() for r in content_hash(spark, path).select("md5").collect())


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str, parts: int = 8) -> DataFrame:
    """A table of an SQLite file that driver and executors can open, read in ranges of rowid; columns by name."""
    names = [f.name for f in T._parse_datatype_string(schema)]
    quoted = ", ".join(f'"{n}"' for n in names)
    with contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
        lo, hi = con.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{table}"').fetchone()
    step = max(1, -(-(hi - lo + 1) // parts))

    def read(frames):
        for frame in frames:
            with contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
                for a in frame["id"]:
                    yield pd.DataFrame(con.execute(f'SELECT {quoted} FROM "{table}" WHERE rowid >= ? AND rowid < ? ORDER BY rowid', (int(a), int(a) + step)).fetchall(), columns=names)

    return spark.range(lo, hi + 1, step, parts).mapInPandas(read, schema)


def objects(df: DataFrame, key: str, wanted: list | None = None) -> DataFrame:
    """List (no keys) or get (some keys) of an object table, the last by `updated_at` of each key."""
    w = Window.partitionBy(key).orderBy(F.desc("updated_at"))
    some = df if wanted is None else df.where(F.col(key).isin(wanted))
    return some.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def json_report(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small table as indented JSON; over `most` rows it is refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a report")
    return json.dumps({"title": title, "rows": [r.asDict(recursive=True) for r in rows]}, ensure_ascii=False, indent=2, default=str)


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, page, text) of PDF files, where pdfplumber is installed on the executors; else give extracted text to the exam operators."""

    def read(frames):
        import io

        import pdfplumber

        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with pdfplumber.open(io.BytesIO(content)) as pdf:
                    yield pd.DataFrame([(name, i + 1, p.extract_text() or "") for i, p in enumerate(pdf.pages)], columns=["file", "page", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "file string, page long, text string")


def quarantine(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """(id, reason) of a quarantine list; entries without both are refused."""
    if any(not r.get("id") or not r.get("motivo", r.get("reason")) for r in rows):
        raise ValueError("a quarantine entry needs an id and a reason")
    return spark.createDataFrame([(r["id"], r.get("motivo", r.get("reason"))) for r in rows], "id string, reason string")


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small table as Markdown; over `most` rows it is refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a report")
    line = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in xs) + " |"
    return "\n".join([f"# {title}", "", line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in rows)]) + "\n"


STORE = {
    "requests": "id string, solicitante_id string, state string, specification_json string, max_attempts int, max_distractor_attempts int, attempts int, stem_attempts int, distractor_attempts int, created_at string, updated_at string",
    "versions": "id string, request_id string, version_number int, question_json string, provenance_json string, created_at string",
    "artifacts": "id long, request_id string, kind string, payload_json string, provenance_json string, created_at string",
    "red_flags": "id long, request_id string, code string, stage string, field string, evidence string, repair_target string, created_at string",
    "events": "id long, request_id string, version_id string, from_state string, to_state string, component string, reason string, evidence_json string, created_at string",
    "reviews": "id string, request_id string, version_id string, reviewer_role string, reviewer_name string, reviewer_kind string, decision string, audit_percentage int, comments string, red_flags_json string, model string, created_at string",
}


def store_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(T._parse_datatype_string(STORE[name])).parquet(f"{root}/{name}")


def store_append(df: DataFrame, root: str, name: str) -> None:
    """Appends rows to a table of the event store; columns are put in its order."""
    kinds = T._parse_datatype_string(STORE[name])
    df.select(*(F.col(f.name).cast(f.dataType) for f in kinds)).write.mode("append").parquet(f"{root}/{name}")
