"""WARC archives: written with an index, read by coalesced byte ranges.

Writing decides for each payload digest which page is the response and which ones revisit it; each task writes its
records to a file of its own, one gzip member a record, and gives the index: file, offset, length, url, digest.
The name of a file holds a fresh id, so what a lost or repeated task left behind is in no index. Reading takes index
rows, sorts them by file and offset, and joins neighbouring ranges into reads of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmill.llm.textkit import shared_folder, small_batches, stage

GAP, READ = 64 << 10, 4 << 20  # ranges at most so far apart are read at once, up to so many bytes
ROLL = 256 << 20
DATE = datetime(2020, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


SALT = 16  # parts that the pages of one payload are dealt to


def _salt():
    return F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, payload_digest: str, refers_to, revisit: bool) -> bytes:
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        "Content-Type: text/html;charset=utf-8",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder with the scheme of the file system that Spark takes it for."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:")


INDEX = T.StructType([T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("url", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("page_id", T.LongType())])


def _write(folder: str):
    """An archive's index is given only once the archive is closed; at ROLL bytes the next one begins."""

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(_uri(folder))
        fs.create_dir(root, recursive=True)
        out, rows, at = None, [], 0

        def index():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=[f.name for f in INDEX])

        for batch in batches:
            for p, url, html, dg, ref, again in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "revisit")), strict=True):
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                raw = pack.compress(record(p, url, (html or "").encode(), dg, ref, again)) + pack.flush()
                if out is None:
                    path, rows, at = f"{root}/{uuid.uuid4().hex}.warc.gz", [], 0
                    out = fs.open_output_stream(path, compression=None)
                out.write(raw)
                rows.append((path, at, len(raw), url, dg, p))
                at += len(raw)
                if at > ROLL:
                    yield index()
                    out = None
        if out is not None:
            yield index()

    return run


def write_warc(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes a record for each row of (page_id, url, html) below `folder` and returns the index, itself stored.

    Of rows with equal payloads of at least `least` bytes the one with the largest page_id is the response; null ids
    come before all others, and rows that repeat the largest id are responses too. Null html is an empty payload; an empty
    table gives an empty index. A page of any length is one record, written and read whole.
    """
    small_batches(pages.sparkSession)
    folder = qualified(pages.sparkSession, folder)

    @F.pandas_udf("string")
    def digests(html):
        return html.map(lambda x: digest((x or "").encode()))

    # digests and decisions travel without the pages; the pages are dealt out once, by id, with their decision
    key = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    marks = stage(key.select("page_id", digests("html").alias("digest"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes")).where(F.col("bytes") >= least), "digests")
    best = marks.groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1")
    # a payload that a third of all pages have is dealt to SALT tasks
    every = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    again = marks.withColumn("salt", _salt()).join(best.select("*", every), ["digest", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("best"))).select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "best").distinct()
    x = key.withColumn("digest", digests("html"))
    both = x.join(again, x["page_id"].eqNullSafe(again["again_id"]) & (x["digest"] == again["again_digest"]), "left")
    ready = both.select("page_id", "url", "html", "digest", F.col("best").alias("refers_to"), F.col("again_digest").isNotNull().alias("revisit"))
    return stage(ready.mapInArrow(_write(folder), INDEX), "warcindex")


READ_OUT = "page_id long, url string, payload binary, payload_digest string, record_type string, refers_to long"


def _read(folder: str):
    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(_uri(folder))
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            k = 0
            while k < len(rows):
                j, (file, start, length) = k, rows[k]
                end = start + length
                while j + 1 < len(rows) and rows[j + 1][0] == file and 0 <= rows[j + 1][1] - end <= GAP and rows[j + 1][1] + rows[j + 1][2] - start <= READ:
                    j += 1
                    end = rows[j][1] + rows[j][2]
                with fs.open_input_file(file) as f:
                    raw = f.read_at(end - start, start)
                out = []
                for _, o, n in rows[k : j + 1]:
                    h, payload = parse(zlib.decompress(raw[o - start : o - start + n], 31))
                    name = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
                    response = h["WARC-Type"] == "response"
                    out.append((name(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), payload if response else None, digest(payload) if response else h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"], None if response else name(h["WARC-Refers-To"])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "url", "payload", "payload_digest", "record_type", "refers_to"])
                k = j + 1

    return run


def read_warc(index: DataFrame, folder: str) -> DataFrame:
    """The records of index rows (all, or those selected by url, digest and so on) from their archives; a revisit's payload is null."""
    # ranges of 64 MB of a file: hot files are split, and each range is read in order
    folder = qualified(index.sparkSession, folder)
    near = index.select("file", "offset", "length", F.expr("offset div 67108864").alias("block"))
    return near.repartition("file", "block").sortWithinPartitions("file", "offset").mapInArrow(_read(folder), READ_OUT)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    got = read_warc(write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder), folder)
    facts = stage(got.select("page_id", F.octet_length("payload").cast("long").alias("own"), "payload_digest", "record_type", "refers_to"), "records")
    # a revisit has the size of the response with its digest
    sizes = facts.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("dg")).agg(F.max("own").alias("size"))
    revisits = facts.where("record_type = 'revisit'")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part")
    revisits, sizes = revisits.withColumn("salt", _salt()), sizes.select("*", every)
    full = revisits.join(sizes, (revisits["payload_digest"] == sizes["dg"]) & (F.col("salt") == F.col("part"))).select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return facts.where("record_type = 'response'").select("page_id", F.col("own").alias("payload_bytes"), "payload_digest", "record_type", "refers_to").unionByName(full)


SQL = r"""
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), best AS (SELECT hex, max(page_id) AS best FROM p GROUP BY hex
), digits AS (
  SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> (15 - 5 * (j % 4))) & 31 AS INTEGER) + 1, 1), '' ORDER BY j) AS payload_digest
  FROM (SELECT hex, j, CAST('0x' || substr(hex, CAST(5 * (j // 4) + 1 AS BIGINT), 5) AS BIGINT) AS v FROM best, range(32) t(j)) GROUP BY hex
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM p JOIN best USING (hex) JOIN digits USING (hex)
"""
