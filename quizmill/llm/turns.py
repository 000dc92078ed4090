"""Repair of conversations: the cheapest edits that make the roles alternate, by a walk over costs to go.

Two streams over sorted rows. The first sees a code for each turn (initial of the role, fault) and no text: a backward
pass gives for each turn and state of the grammar the cost of all that is to come, then a forward walk takes, among the
edits that keep that cost, the one with the least letter. The second stream gets each conversation's letters before its
turns and rebuilds them turn by turn. So texts are shuffled once, are never gathered, and a task holds four bytes for
each turn of the conversation at hand; the audit, one letter a turn in one cell, bounds a conversation's turns anyway,
and a digest over its turns in order has to come from one task. Costs to go are kept less their least; few such vectors
exist, so each step is looked up.

Grammar of role initials: nothing, or an s at most, then ua once or more. States: 0 nothing yet, 1 after s, 2 after u,
3 after a. Rows of one conversation are ordered by turn (nulls first), ties by role, then by the first 64 code points of
the text, then by its MD5; equal rows of one turn stand together. A role that is null is one space, like a null text;
an empty role has no initial and cannot be kept.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NAMES = {2: "user", 3: "assistant"}
#: The state that a put-in or renamed turn leads to, and those that a kept turn leads to, by its initial.
NEXT = (2, 2, 3, 2)
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "": {}}
INITIALS = ("", "s", "u", "a")
LEGAL = {(1, 2), (2, 3), (3, 2)}
END = (0, INSERT * 2, INSERT, 0)
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
ORDER = ["turn", "role", "head", "digest"]


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: turns spoilt by the crc32 of `conv_id:turn` modulo 20 (nulls: one space); dropped ones stay as rows marked gone."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    act = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    x = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), act.alias("act"))
    text = F.when(F.col("act").isin(0, 1), "").when(F.col("act") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    x = x.select("conv_id", "turn", F.when(F.col("act") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("act") == 0).alias("gone"), F.explode(F.expr("if(act = 3, array(1, 2), array(1))")).alias("copy"))
    return x.drop("copy")


def _rows(turns: DataFrame) -> DataFrame:
    """Turns with what orders them; gone is false where there is no such column."""
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    x = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), gone.alias("gone"))
    return x.select("*", F.substring("text", 1, 64).alias("head"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"))


def step(after: tuple, code: int) -> tuple[int, tuple, str]:
    """One turn backwards: (least cost, costs to go less the least, letter by state) from the costs after it."""
    initial, fault = INITIALS[code // 4], code % 4
    more = TRUNCATED if fault == 3 else 0
    ways = []
    for s in range(4):
        w = {"D": DELETE + after[s]}
        if fault in (0, 3):
            if s in KEPT[initial]:
                w["K"] = KEEP + more + after[KEPT[initial][s]]
            w["R"] = REROLE + more + after[NEXT[s]]
        ways.append(w)
    cost = [min(w.values()) for w in ways]
    for _ in range(2):  # two turns put in lead back to the same state, so two are enough
        cost = [min(c, INSERT + cost[NEXT[s]]) for s, c in enumerate(cost)]
    for s, w in enumerate(ways):
        w["I"] = INSERT + cost[NEXT[s]]
    letters = "".join(min(k for k, v in w.items() if v == cost[s]) for s, w in enumerate(ways))
    least = min(cost)
    return least, tuple(c - least for c in cost), letters


class Walk:
    """The audit of one conversation from the codes of its turns; steps are remembered by (costs, code)."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.steps: list[tuple[int, tuple, str]] = []

    def run(self, codes: bytes | bytearray) -> tuple[int, str]:
        """(cost, letters) for codes in order."""
        costs, total, chosen = END, 0, array("I", bytes(4 * len(codes)))
        for i in range(len(codes) - 1, -1, -1):
            key = (costs, codes[i])
            at = self.number.get(key)
            if at is None:
                at = self.number[key] = len(self.steps)
                self.steps.append(step(costs, codes[i]))
            chosen[i] = at
            least, costs, _ = self.steps[at]
            total += least
        total += costs[0]
        state, out = 0, bytearray()
        for i, at in enumerate(chosen):
            letters = self.steps[at][2]
            while letters[state] == "I":
                out += b"I"
                state = NEXT[state]
            letter = letters[state]
            out += letter.encode()
            state = moved(state, letter, INITIALS[codes[i] // 4])
        while END[state]:
            out += b"I"
            state = NEXT[state]
        return total, out.decode()


def moved(state: int, letter: str, initial: str) -> int:
    """The state after an edit of a turn with this initial."""
    return state if letter == "D" else KEPT[initial][state] if letter == "K" else NEXT[state]


def audits(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation of turns (conv_id, turn, role, text and, if there is one, gone)."""
    x = _rows(turns)
    initial = F.substring("role", 1, 1)
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    x = x.select("conv_id", *ORDER, "gone", F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0).alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"))
    # rows of a conversation come together once; both orders below are sorts within that
    x = x.repartition("conv_id").withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "role", "digest", "gone").orderBy("turn")))
    fault = F.when(F.col("blank"), 1).when(F.col("nth") > 1, 2).when(F.col("open"), 3).otherwise(0)
    x = x.withColumn("code", F.when(F.col("gone"), -1).otherwise(F.col("initial") * 4 + fault)).sortWithinPartitions("conv_id", *ORDER, "nth").select("conv_id", "turn", "code")
    kind = turns.schema["conv_id"].dataType
    out = StructType([StructField("conv_id", kind), *(StructField(c, LongType()) for c in COUNTS), StructField("audit", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, now, begun = Walk(), None, False
        codes, turn_of = bytearray(), [None, None, 0]  # least and greatest turn, how many

        def done() -> tuple:
            low, high, n = turn_of
            cost, audit = walk.run(codes)
            initials = [c // 4 for c in codes]
            faults = [sum(c % 4 == k for c in codes) for k in (1, 2, 3)]
            return now, (high - low + 1 - n if n else 0), *faults, sum(p not in LEGAL for p in zip(initials, initials[1:])), cost, audit

        for b in batches:
            made = []
            for conv, turn, code in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if not begun or conv != now:
                    if begun:
                        made.append(done())
                    now, begun, codes, turn_of = conv, True, bytearray(), [None, None, 0]
                if code < 0:
                    continue
                codes.append(code)
                if turn is not None and turn != turn_of[1]:
                    turn_of = [turn if turn_of[0] is None else turn_of[0], turn, turn_of[2] + 1]
            if made:
                yield _batch(made, out)
        if begun:
            yield _batch([done()], out)

    return x.mapInArrow(run, out)


def _batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def _together(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit row, then its turns in order, within one partition."""
    rows = _rows(turns).where(~F.col("gone")).drop("gone").withColumn("kind", F.lit(1))
    heads = found.withColumn("kind", F.lit(0))
    both = heads.unionByName(rows, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER).select("conv_id", "kind", *COUNTS, "audit", "turn", "role", "text")


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """("begin", audit row), then ("turn", letter, turn, role, text) for each letter of the audit, conversation by conversation; None after each batch."""
    letters, at, state = "", 0, 0

    def put_in():
        nonlocal at, state
        while at < len(letters) and letters[at] == "I":
            at, state = at + 1, NEXT[state]
            yield "turn", "I", None, NAMES[state], ""

    for b in batches:
        cols = [b.column(i) for i in range(b.num_columns)]
        head = [c.to_pylist() for c in cols[: 3 + len(COUNTS)]]
        for i, (turn, role, text) in enumerate(zip(*(c.to_pylist() for c in cols[3 + len(COUNTS) :]), strict=True)):
            if head[1][i] == 0:
                yield from put_in()
                letters, at, state = head[-1][i], 0, 0
                yield "begin", tuple(c[i] for c in (head[0], *head[2:]))
                continue
            yield from put_in()
            letter = letters[at]
            at, state = at + 1, moved(state, letter, role[:1] if role[:1] in KEPT else "")
            yield "turn", letter, turn, NAMES[state] if letter == "R" else role, text
        yield None
    yield from put_in()


def rebuilt(turns: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, turn (null if put in), role, text: the repaired conversations, from turns and their `audits`."""
    out = StructType([turns.schema["conv_id"], StructField("place", LongType()), StructField("edit", StringType()), turns.schema["turn"], StructField("role", StringType()), StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place, made = None, 0, []
        for x in _edits(batches):
            if x is None:
                if made:
                    yield _batch(made, out)
                made = []
            elif x[0] == "begin":
                conv, place = x[1][0], 0
            elif x[1] != "D":
                made.append((conv, place, *x[1:]))
                place += 1
        if made:
            yield _batch(made, out)

    return _together(turns, found).mapInArrow(run, out)


def repaired(turns: DataFrame) -> DataFrame:
    """The `audits` of all conversations with repaired_sha256, the digest of the repaired turns as `role:text`, newline-joined.

    Null turns stand first and count for no gap, null roles and texts are one space; repeated rows are duplicates after the
    first; a conversation without turns has zeros, an empty audit and the digest of nothing; an empty table gives no rows;
    other columns are not read; texts of any length are digested as they pass.
    """
    found = audits(turns)
    out = StructType([*found.schema.fields, StructField("repaired_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, digest, first, made = None, hashlib.sha256(), True, []
        for x in _edits(batches):
            if x is None:
                if made:
                    yield _batch(made, out)
                made = []
            elif x[0] == "begin":
                if row is not None:
                    made.append((*row, digest.hexdigest()))
                row, digest, first = x[1], hashlib.sha256(), True
            elif x[1] != "D":
                digest.update(f"{'' if first else chr(10)}{x[3]}:{x[4]}".encode())
                first = False
        if row is not None:
            yield _batch([*made, (*row, digest.hexdigest())], out)

    return _together(turns, found).mapInArrow(run, out)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


_LEAST = lambda s, *ways: f"list_min([w FOR w IN [{', '.join(ways)}] IF w IS NOT NULL]) AS b{s}"
_WAY = lambda add, letter, of, line="''": f"{{'c': {add} + {of}.c, 'a': '{letter}' || {of}.a, 't': {line} || {of}.t}}"
_DROP = lambda s: _WAY(2, "D", f"s{s}")
_STAY = lambda initial, of: f"CASE WHEN fault IN (0, 3) AND ini = '{initial}' THEN {_WAY('more', 'K', f's{of}', 'chr(10) || role || chr(58) || text')} END"
_NAMED = lambda of: f"CASE WHEN fault IN (0, 3) THEN {_WAY('1 + more', 'R', f's{of}', f'chr(10) || {chr(39)}{NAMES[of]}:{chr(39)} || text')} END"
_PUT = lambda of, line: _WAY(5, "I", of, f"chr(10) || '{line}:'")
#: The backward pass with whole audits and texts in place of letters by state; crc32 byte by byte over a table made by the rule.
SQL = rf"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c FROM range(256) r(b))),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
acts AS (SELECT raw.*, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT)), lambda c, v: xor(c >> 8, t[1 + (xor(c, v) & 255)]), 4294967295), 4294967295) % 20 AS act FROM raw, tab),
spoilt AS (SELECT conv_id, turn, CASE WHEN act = 4 THEN 'user' ELSE role END AS role, CASE WHEN act = 1 THEN '' WHEN act = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN act = 3 THEN [1, 2] ELSE [1] END) AS copy FROM acts WHERE act <> 0),
told AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS last FROM spoilt),
rows AS MATERIALIZED (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text[1:64], md5(text), nth) AS i,
  CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE '' END AS ini, CASE WHEN last = '' THEN 1 WHEN nth > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, CASE WHEN last NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS more FROM told),
pairs AS (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS was FROM rows),
counts AS MATERIALIZED (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (was IS NOT NULL AND was || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id),
dp(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, n, {{'c': 0, 'a': '', 't': ''}}, {{'c': 10, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}}, {{'c': 5, 'a': 'I', 't': chr(10) || 'assistant:'}}, {{'c': 0, 'a': '', 't': ''}} FROM counts
  UNION ALL
  SELECT conv_id, i - 1, least(b0, {_PUT(_PUT("b3", "assistant"), "user")}, {_PUT("b2", "user")}), least(b1, {_PUT(_PUT("b3", "assistant"), "user")}, {_PUT("b2", "user")}), least(b2, {_PUT("b3", "assistant")}), least(b3, {_PUT("b2", "user")})
  FROM (SELECT dp.conv_id, dp.i,
    {_LEAST(0, _DROP(0), _STAY("s", 1), _STAY("u", 2), _NAMED(2))}, {_LEAST(1, _DROP(1), _STAY("u", 2), _NAMED(2))}, {_LEAST(2, _DROP(2), _STAY("a", 3), _NAMED(3))}, {_LEAST(3, _DROP(3), _STAY("u", 2), _NAMED(2))}
    FROM dp JOIN rows ON rows.conv_id IS NOT DISTINCT FROM dp.conv_id AND rows.i = dp.i)),
best AS (SELECT conv_id, s0.c AS cost, s0.a AS audit, sha256(substr(s0.t, 2)) AS repaired_sha256 FROM dp WHERE i = 0)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id"""
