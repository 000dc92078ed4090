"""Exact Jaccard self-join on word shingles by vertical partitioning.

1. Each text becomes its set of shingle hashes (64 bits). Texts with equal sets form a class, named by a 64-bit sum
   over the set; from here on only classes take part, so exact copies cost nothing.
2. The global order of shingles puts those known to be frequent last (counted within each task's stretch of rows and
   summed, at most HOT of them: any fixed set gives a valid order, so the bound costs speed at most) and the others by
   their hash. Two sets with similarity t share a shingle among the first n - ceil(t n) + 1 of each.
3. Those prefixes travel as packed arrays, cut by shingle into buckets. Shingles with several classes give candidates:
   first stars (each class with one centre of the list), later, once components are known, the pairs of a list that
   lie in different components. Pairs within a component need no test, so a group of copies is never expanded; and a
   shared shingle counts only where its ranks in both sets leave room for the overlap needed, so sets with many
   shingles of their own (which come first) meet no frequent ones.
4. The order is cut into FRAGMENTS. Of the FIRST ones each class has a sketch, 16 bits a shingle; two sketches bound the
   overlap there from above, and pairs that cannot reach the threshold, whatever the other fragments hold, go no further.
   For the others the overlap is counted in each fragment by itself, from the two sets' whole parts in it, and the
   partial counts are summed per pair and held against the threshold; pairs that cannot reach it any more after HALF of
   the fragments go no further. So what travels for most candidate pairs is short.
5. Components of the links, then the smallest doc_id of each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.llm.graph import components
from quizmill.llm.textkit import LOWER, U, distinct_in_rows, drop, find_words, mix, prefix_hash, release, small_batches, span_hash, stage, stage_by, text_chunks

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
WORDS, PERCENT = 5, 75
HOT = 200_000  # frequent shingles that the order knows; 16 bytes each go to every task
LOCAL = 3  # a shingle is reported when a stretch of rows has it this often
STRETCH = 1_000_000  # shingles that a task holds at once
PER_BUCKET = 300_000
FRAGMENTS, FIRST, HALF = 8, 2, 4  # sketches of the first fragments judge all candidates; the first half is counted for those left, the others for those that can still reach the threshold
BITS = 26  # the filter on classes that have a candidate has 2**BITS bits, whatever the input
ROW = np.dtype([("c", "<u8"), ("t", "u1", (5,)), ("r", "<u2")])  # a class, 40 bits of a shingle beyond those of its bucket (alike ones give a candidate too many at most), its rank in the set
STARS = 1  # rounds of stars before all remaining pairs between components


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), sorted and distinct: the shingles of each text; a text with fewer words has one, all its words."""
    low = LOWER[data]
    s, e, row = find_words(low, offs, NOT_SPACE)
    w = span_hash(prefix_hash(low), s, e)
    m = len(w)
    factor = [U(pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64)) for j in range(words)]
    full = np.zeros(max(0, m - words + 1), U)
    for j in range(words):
        full += w[j : j + len(full)] * factor[j]
    same = row[: len(full)] == row[words - 1 :] if len(full) else np.zeros(0, bool)
    full, at = mix(full[same]), row[: len(full)][same]
    count = np.bincount(row, minlength=len(offs) - 1)
    few = np.flatnonzero((count > 0) & (count < words))
    if len(few):
        first = np.searchsorted(row, few)
        part = count[few].astype(U) * U(0x165667B19E3779F9)
        for j in range(words - 1):
            ok = count[few] > j
            part[ok] += w[first[ok] + j] * factor[j]
        full, at = np.concatenate([full, mix(part)]), np.concatenate([at, few])
    return distinct_in_rows(at, full)


def classes(row: np.ndarray, h: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Set sizes and class names (int64) of the rows."""
    n = np.bincount(row, minlength=n_rows)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(mix(h ^ U(0x27D4EB2F165667C5)), out=total[1:])
    ends = np.cumsum(n)
    name = mix(total[ends] - total[ends - n] + n.astype(U) * U(0x85EBCA77C2B2AE63))
    return n, name.view(np.int64)


def _sizes(words: int):
    def run(batches):
        held: list[np.ndarray] = []

        def hot():
            v, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            v, c = v[c >= LOCAL], c[c >= LOCAL]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(v), bool)), pa.array(v.view(np.int64)), pa.array(c.astype(np.int64)), pa.nulls(len(v), pa.int64()), pa.nulls(len(v), pa.int64())], names=["hot", "id", "n", "cls", "text_key"])

        for batch in batches:
            ids, keys = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text_key"))
            for i, j, data, offs in text_chunks(batch):
                row, h = shingle_sets(data, offs, words)
                n, name = classes(row, h, j - i)
                held.append(h)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(j - i, bool)), ids.slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(name), keys.slice(i, j - i)], names=["hot", "id", "n", "cls", "text_key"])
                if sum(map(len, held)) > STRETCH:
                    yield hot()
        if held:
            yield hot()

    return run


@dataclass
class Order:
    """The global order: hot shingles last, by count; the others by hash."""

    token: np.ndarray
    count: np.ndarray

    def weight(self, h: np.ndarray) -> np.ndarray:
        if not len(self.token):
            return np.zeros(len(h), np.int64)
        k = np.minimum(np.searchsorted(self.token, h), len(self.token) - 1)
        return np.where(self.token[k] == h, self.count[k], 0)


def _prefixes(order: Order, words: int, percent: int, bits: int):
    def run(batches):
        held: list[np.ndarray] = []

        def flush():
            t, c, r = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((c, t))
            t, c, r = t[order], c[order], r[order]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])  # copies within the stretch fall together
            t, c, r = t[new], c[new], r[new]
            bucket = (t >> U(64 - bits)).astype(np.int64)
            x = np.empty(len(t), ROW)
            x["c"], x["r"] = c, r
            x["t"] = (t << U(bits) >> U(24)).view(np.uint8).reshape(-1, 8)[:, :5]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(x)]])
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]]), pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["bucket", "rows"])

        for batch in batches:
            for i, j, data, offs in text_chunks(batch):
                row, h = shingle_sets(data, offs, words)
                if not len(h):
                    continue
                n, name = classes(row, h, j - i)
                weight = order.weight(h)
                if weight.any():
                    k = np.lexsort((weight, row))
                    row, h = row[k], h[k]
                rank = np.arange(len(h)) - (np.cumsum(n) - n)[row]
                keep = rank < (n - (percent * n + 99) // 100 + 1)[row]
                held.append((h[keep], name.view(U)[row[keep]], np.minimum(rank[keep], 65535).astype(np.uint16)))
                if sum(len(x[0]) for x in held) > STRETCH // 2:  # sorted and packed, they take several times their room
                    yield flush()
        if held:
            yield flush()

    return run


def _lists(batches):
    """Of each bucket, the shingles that several classes have: (token, cls, rank)."""
    now, held = None, []

    def done():
        x = np.concatenate(held)
        wide = np.zeros((len(x), 8), np.uint8)
        wide[:, :5] = x["t"]
        t = wide.view("<u8").ravel()
        order = np.lexsort((x["r"], x["c"], t))
        t, c, r = t[order], x["c"][order], x["r"][order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
        t, c, r = t[new], c[new], r[new]
        run = np.cumsum(np.concatenate([[True], t[1:] != t[:-1]])) - 1
        many = np.bincount(run)[run] > 1
        token = (t[many] | U(now % (1 << 23)) << U(40)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(c[many].view(np.int64)), pa.array(r[many].astype(np.int32))], names=["token", "cls", "rank"])

    for batch in batches:
        for bucket, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if held and bucket != now:
                yield done()
                held.clear()
            now = bucket
            held.append(np.frombuffer(rows.as_buffer(), ROW))
    if held:
        yield done()


def _sketch(h: np.ndarray) -> np.ndarray:
    """The distinct 16-bit ends of hashes, as int16."""
    return np.unique(h.astype(np.uint16)).view(np.int16)


def _segments(order: Order, words: int, bitmap: np.ndarray, sketch: bool):
    """For classes that the filter lets through, (cls, part, tokens) of each fragment, empty ones too, or (cls, m, marks), size and sketch of the first fragments together; a stretch of rows gives each class once."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for i, j, data, offs in text_chunks(batch):
                row, h = shingle_sets(data, offs, words)
                n, name = classes(row, h, j - i)
                bit = name & ((1 << BITS) - 1)
                want = (n > 0) & ((bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)
                part = np.where(order.weight(h) > 0, FRAGMENTS - 1, (h >> U(32)) * U(FRAGMENTS - 1) >> U(32)).astype(np.int64)
                ends = np.cumsum(n)
                cls, second, third = [], [], []
                for d in np.flatnonzero(want).tolist():
                    c = int(name[d])
                    if c in seen:
                        continue
                    seen.add(c)
                    a, b = ends[d] - n[d], ends[d]
                    if sketch:
                        own = h[a:b][part[a:b] < FIRST]
                        cls.append(c)
                        second.append(len(own))
                        third.append(_sketch(own))
                        continue
                    for p in range(FRAGMENTS):
                        cls.append(c)
                        second.append(p)
                        third.append(h[a:b][part[a:b] == p].view(np.int64))
                if len(seen) > 1_000_000:
                    seen.clear()
                if cls:
                    kind, names = (pa.int16(), ["cls", "m", "marks"]) if sketch else (pa.int64(), ["cls", "part", "tokens"])
                    yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(second, pa.int32()), pa.array(third, pa.list_(kind))], names=names)

    return run


def _filter(classes_: DataFrame) -> np.ndarray:
    """A bitmap of 2**BITS bits with those of the classes (column cls) set: what goes to the tasks never grows."""
    words = classes_.select(F.expr(f"shiftright(cls & {(1 << BITS) - 1}, 5)").alias("w"), F.expr("shiftleft(1L, cast(cls & 31 as int))").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v")).toPandas()
    bitmap = np.zeros(1 << BITS - 5, "<u4")
    bitmap[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64)
    return bitmap.view(np.uint8)


def _linked(shared: Column, percent: int) -> Column:
    """Whether so large an overlap of a and b links them: shared >= percent * union is (100 + percent) * shared >= percent * (na + nb)."""
    return (100 + percent) * shared >= percent * (F.col("na") + F.col("nb"))


def _reaching(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose overlap can reach the threshold, judged by the sketches of the first fragments.

    Shingles of a set that share a mark number its size less its marks; no more can be missed among the common marks.
    """
    left = sketches.select(F.col("cls").alias("a"), F.col("m").alias("ma"), F.col("marks").alias("ka"))
    right = sketches.select(F.col("cls").alias("b"), F.col("m").alias("mb"), F.col("marks").alias("kb"))
    most = F.size(F.array_intersect("ka", "kb")) + F.least(F.col("ma") - F.size("ka"), F.col("mb") - F.size("kb"))
    reach = most + F.least(F.col("na") - F.col("ma"), F.col("nb") - F.col("mb"))
    return pairs.join(left, "a").join(right, "b").where(_linked(reach, percent)).select(*pairs.columns)


def _overlaps(pairs: DataFrame, segments: DataFrame, first: int, last: int) -> DataFrame:
    """pairs with shared, seen_a, seen_b: overlap and sizes summed over the fragments first..last, each counted by itself."""
    parts = pairs.withColumn("part", F.explode(F.sequence(F.lit(first), F.lit(last))))
    left = segments.select(F.col("cls").alias("a"), "part", F.col("tokens").alias("ta"))
    right = segments.select(F.col("cls").alias("b"), "part", F.col("tokens").alias("tb"))
    one = parts.join(left, ["a", "part"]).join(right, ["b", "part"]).withColumn("shared", F.size(F.array_intersect("ta", "tb")))
    return one.groupBy(*pairs.columns).agg(F.sum("shared").alias("shared"), F.sum(F.size("ta")).alias("seen_a"), F.sum(F.size("tb")).alias("seen_b"))


def _candidates(lists: DataFrame, percent: int, salt: int | None) -> DataFrame:
    """Pairs (a < b) of classes in one list and in different components `comp`, sizes permitting.

    salt: only pairs with one centre of each list, another for each salt and class of shingles. None: all of them.
    """
    x = lists.select("token", "cls", "n", "rank", "comp", "share")
    if salt is None:
        y = x.select(F.col("token"), F.col("cls").alias("cls2"), F.col("n").alias("n2"), F.col("rank").alias("rank2"), F.col("comp").alias("comp2"))
        p = x.join(y, "token").where("cls < cls2")
    else:
        # what is central has few shingles of its own: a large part of its prefix is in lists; later rounds take more of those alike
        weight = F.floor(F.col("share") * (64 >> 2 * salt))
        centre = x.groupBy("token").agg(F.max_by(F.struct("cls", "n", "rank", "comp"), F.struct(weight, F.xxhash64("cls", F.pmod("token", F.lit(4)), F.lit(salt)))).alias("m"))
        p = x.join(centre, "token").select("token", "cls", "n", "rank", "comp", F.col("m.cls").alias("cls2"), F.col("m.n").alias("n2"), F.col("m.rank").alias("rank2"), F.col("m.comp").alias("comp2")).where("cls <> cls2")
    # the first shingle that linked sets share leaves room for the overlap they need after it, in both of them
    need = F.ceil(percent * (F.col("n") + F.col("n2")) / (100 + percent) - 1e-9)
    room = (F.col("rank") + need <= F.col("n")) & (F.col("rank2") + need <= F.col("n2"))
    p = p.where(room & (F.col("comp") != F.col("comp2")) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")))
    less = F.col("cls") < F.col("cls2")
    return p.select(F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b"), F.when(less, F.col("n")).otherwise(F.col("n2")).alias("na"), F.when(less, F.col("n2")).otherwise(F.col("n")).alias("nb")).distinct()


def _with_components(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Lists with a component for each class, without the lists that lie in one component."""
    if labels is None:
        return lists.withColumn("comp", F.col("cls"))
    x = lists.join(labels.select(F.col("node").alias("cls"), "component"), "cls", "left").select("token", "cls", "n", "rank", "share", F.coalesce("component", "cls").alias("comp"))
    many = x.groupBy("token").agg((F.min("comp") != F.max("comp")).alias("many")).where("many").select("token")
    return x.join(many, "token", "left_semi")


def similar_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, class_id, group_id (of the component, whatever ids repeat), text_key.

    Null, empty and wordless texts have no shingles and form a component of their own (their doc_id). Rows that repeat a
    doc_id are rows of their own; they share whatever components their texts are in. A null doc_id stays null and never
    names a component unless no other id is in it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sizes = stage(text.withColumn("text_key", F.xxhash64("text")).mapInArrow(_sizes(words), "hot boolean, id long, n long, cls long, text_key long"), "sizes")
    hot = sizes.where("hot").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(HOT).toPandas()
    token = hot["id"].to_numpy(np.int64).view(U)
    k = np.argsort(token)
    order = Order(token[k], hot["n"].to_numpy(np.int64)[k])
    docs_ = sizes.where("not hot").select(F.col("id").alias("doc_id"), "n", "cls", "text_key")
    total = docs_.agg(F.sum("n")).first()[0] or 0
    bits = max(6, int(total * (100 - percent) / 100 / PER_BUCKET).bit_length() + 1)
    packed = text.mapInArrow(_prefixes(order, words, percent, bits), "bucket long, rows binary")
    shared = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_lists, "token long, cls long, rank int")
    shared = stage(shared, "shared")
    del packed
    release(spark)
    one = docs_.where("n > 0").groupBy("cls").agg(F.min("n").alias("n")).join(shared.groupBy("cls").agg(F.count("*").alias("m")), "cls")
    # share: of the shingles in a class's prefix, those that other classes have too
    one = one.select("cls", "n", (F.col("m") / (F.floor(F.col("n") * (100 - percent) / 100) + 1)).alias("share"))
    # all that is done with lists goes by shingle: they lie in buckets of it, and so do sketches and sets by their class
    lists = stage_by(shared.join(one, "cls").repartition("token"), "lists", "token")
    drop(shared)
    release(spark)

    def parts(classes_: DataFrame, sketch: bool) -> DataFrame:
        # a class can come from several tasks; copies count once
        kind = "cls long, m int, marks array<short>" if sketch else "cls long, part int, tokens array<long>"
        return text.mapInArrow(_segments(order, words, _filter(classes_), sketch), kind).dropDuplicates(["cls"] if sketch else ["cls", "part"])

    sketches = stage_by(parts(lists, True), "sketches", "cls")
    release(spark)
    links, labels = None, None
    for salt in [*range(STARS), None]:
        pairs = stage(_reaching(_candidates(_with_components(lists, labels), percent, salt), sketches, percent), "pairs")
        release(spark)
        whole = stage_by(parts(pairs.select(F.explode(F.array("a", "b")).alias("cls")), False), "whole", "cls", "part")
        release(spark)
        some = _overlaps(pairs, whole, 0, HALF - 1)
        reach = F.col("shared") + F.least(F.col("na") - F.col("seen_a"), F.col("nb") - F.col("seen_b"))
        left = stage(some.where(_linked(reach, percent)).select("a", "b", "na", "nb", F.col("shared").alias("before")), "left")
        found = stage(_overlaps(left, whole, HALF, FRAGMENTS - 1).where(_linked(F.col("shared") + F.col("before"), percent)).select("a", "b"), "links")
        drop(whole)
        drop(pairs)
        drop(left)
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        release(spark)
    drop(lists)
    drop(sketches)
    named = docs_.join(labels.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("group", F.coalesce("component", "cls"))
    least = named.where("n > 0").groupBy("group").agg(F.min("doc_id").alias("least"))
    out = named.join(least, "group", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), F.col("cls").alias("class_id"), F.col("group").alias("group_id"), "text_key")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates the document with the smallest doc_id stays, once (of alike ids one text). Texts without words are in no group and all stay."""
    g = similar_groups(docs).where("n_shingles > 0")
    stay = g.groupBy("group_id").agg(F.min(F.struct("doc_id", "text_key")).alias("one")).select(F.col("one.doc_id").alias("stay_id"), F.col("one.text_key").alias("stay_key"))
    worded = F.coalesce(docs["text"], F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    some = docs.where(worded)
    kept = some.join(stay, some["doc_id"].cast("long").eqNullSafe(stay["stay_id"]) & (F.xxhash64(some["text"]) == stay["stay_key"]), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where(~worded))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 75 * (p.n + q.n - shared)
), reach AS (
  SELECT x, x AS y FROM (SELECT DISTINCT x FROM links)
  UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
), least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT words.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, words.doc_id) AS component_id
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""
