"""Secret scans with built-in functions only.

Base patterns give spans by kind. On top, strings of 20 and more characters are scored by two character Markov models,
of random strings and of ordinary identifiers: the log-likelihood ratio of the first symbol and of the transitions
decides. Both models are trained from labelled samples: random strings made from hashes in several alphabets; and, as
ordinary ones, the words of a bounded sample of documents outside base matches, identifiers in the usual styles (camel
case, snake case, paths, dates, versions) made of those words and of a list of words, rulers, alphabets and numbers. What a model has not
seen of a symbol it takes from the symbol's kind.

Spans are counted in code points. `split` and `regexp_extract_all` walk over the same matches, so the lengths of what
they give, summed, are the positions.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds, in listed order; what must hold of a match is part of the pattern, or in KEEP.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
ASSIGN_LEAST = 6
#: Strings that the models judge.
OTHER = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "random"]

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SAMPLE = 500  # documents that the identifiers are taken from, about
BACK_OFF = 20.0
#: Labelled by hand: words of ordinary identifiers.
ORDINARY = (
    "user name file path config service client server request response event handler target factory repository manager builder default value index count table column "
    "query result error message format version update create delete select insert backup archive image video audio button window frame layout color border width height "
    "string number integer boolean object array list map set queue stack node tree graph vertex edge http xml json html css url uri api sdk app web page site home login "
    "logout session cookie header footer body title content type date time zone start stop begin end first last next previous parent child example test sample demo data "
    "base model view controller adapter wrapper helper utility common core main module package library plugin extension internationalization configuration authentication"
)
RANDOM = 2000  # random strings made
BITS = 12.0  # a string is random if its ratio is at least so many bits, and one bit for each four characters
MARK = "[secret]"
STEP, BLOCK = 64, 4096  # numbers summed as one; code points of a block of text


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """body with a name for a value that it uses more than once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _before(values: str, first: str = "0", join: str = "{} + {}") -> str:
    """For each of an array of numbers, at least one, the sum (or another join) of those before it.

    Blocks of STEP numbers are summed, then the blocks before each, then the numbers before each in its block: no array
    grows step by step, so time is linear up to some hundred thousand numbers.
    """
    add = lambda x: f"(s, j) -> {join.format('s', x)}"
    blocks = f"transform(sequence(0, cast((size(v) - 1) div {STEP} as int)), b -> aggregate(sequence(b * {STEP}, least((b + 1) * {STEP}, size(v)) - 1), {first}, {add('v[j]')}))"
    tops = f"transform(t, (x, b) -> if(b = 0, {first}, aggregate(sequence(0, b - 1), {first}, {add('t[j]')})))"
    inner = f"if(i % {STEP} = 0, {first}, aggregate(sequence(i - i % {STEP}, i - 1), {first}, {add('v[j]')}))"
    return _let("v", values, _let("t", blocks, _let("o", tops, f"transform(v, (x, i) -> {join.format(f'o[cast(i div {STEP} as int)]', inner)})")))


def _spans(kind: int, pattern: str, keep: str = "true", group: int = 0, text: str = "scanned") -> Column:
    """Spans (start, kind, end) of one kind; in `keep`, m is the match and g[i] its group."""
    p = _quoted(pattern)
    none = "cast(array() as array<struct<start:int,kind:int,end:int>>)"
    span = f"named_struct('start', at[i] + length(p[i]), 'kind', {kind}, 'end', at[i] + length(p[i]) + length(m))"
    kept = f"filter(transform(f, (m, i) -> if({keep}, {span}, null)), x -> x is not null)"
    lengths = "transform(f, (m, i) -> length(p[i]) + length(m))"
    walk = _let("f", f"regexp_extract_all({text}, {p}, 0)", _let("g", f"regexp_extract_all({text}, {p}, {group})", _let("p", f"split({text}, {p}, -1)", _let("at", _before(lengths), kept))))
    return F.expr(f"case when {text} rlike {p} then {walk} else {none} end")


def base_spans(text: str = "scanned") -> list[Column]:
    return [_spans(0, ASSIGN, f"length(g[i]) >= {ASSIGN_LEAST}", 2, text), _spans(1, ACCESS, text=text), _spans(2, HEX, text=text)]


def _transitions(strings: DataFrame, label: int) -> DataFrame:
    """Counts of the transitions of the strings of column s, as numbers into a square table; the start is row size."""
    size = len(ALPHABET)
    x = strings.select(F.expr(f"transform(split(s, ''), c -> instr('{ALPHABET}', c) - 1)").alias("c")).select(F.expr(f"concat(array({size}), filter(c, v -> v >= 0))").alias("c"))
    pairs = x.select(F.explode(F.expr(f"filter(transform(c, (v, i) -> v * {size} + coalesce(try_element_at(c, i + 2), -1000000)), v -> v >= 0)")).alias("pair"))
    return pairs.groupBy("pair").agg(F.count("*").alias("n")).withColumn("label", F.lit(label))


def identifiers(words: str = "w") -> Column:
    """Ordinary identifiers in eight styles made of the words in an array column, each from the next three words."""
    h = "xxhash64(a, b, i)"
    two = lambda n, k: f"lpad(pmod(shiftright({h}, {k}), {n}) + 1, 2, '0')"
    styles = [
        "lower(concat(a, '_', b, '_', c))", "concat(lower(a), initcap(b), initcap(c))", "concat(initcap(a), initcap(b), initcap(c))", "lower(concat(a, '-', b, '-', c))",
        "concat(lower(a), '/', lower(b), '/', initcap(a), initcap(c))", "upper(concat(a, '_', b, '_', c))", f"concat(lower(a), initcap(b), pmod({h}, 100))",
        f"concat(2000 + pmod({h}, 30), '-', {two(12, 5)}, '-', {two(28, 9)}, 'T', {two(23, 13)}, '-', {two(59, 17)}, '-', {two(59, 23)}, '_', lower(a), '_v', pmod({h}, 10))",
    ]
    case = " ".join(f"when {k} then {x}" for k, x in enumerate(styles))
    three = f"named_struct('a', element_at({words}, i), 'b', element_at({words}, i + 1), 'c', element_at({words}, i + 2), 'i', i)"
    made = f"case pmod(xxhash64(x.i, x.a), {len(styles)}) {case} end"
    for v in ("a", "b", "c", "i"):
        made = re.sub(rf"(?<![\w.'])\b{v}\b(?=[,)])", f"x.{v}", made)
    return F.expr(f"case when size({words}) > 2 then transform(transform(sequence(1, size({words}) - 2), i -> {three}), x -> {made}) end")


def training_sample(docs: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """The labelled strings (column s): random ones and ordinary ones."""
    spark, n = docs.sparkSession, docs.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("secrets")), F.lit(1 << 30)) / float(1 << 30)
    plain = docs.where(F.col("text").isNotNull() & (draw <= (min(1.0, sample / n) if n else 1.0))).select("text")
    for p in (ASSIGN, ACCESS, HEX):
        plain = plain.withColumn("text", F.regexp_replace("text", p, " "))
    told = spark.range(0, 40, 1, 1).select(F.expr(f"transform(array_sort(transform(split('{ORDINARY}', ' '), v -> named_struct('k', xxhash64(v, id), 'v', v))), x -> x.v)").alias("w"))
    words = plain.select(F.expr("regexp_extract_all(text, '[A-Za-z]{2,}', 0)").alias("w"))
    ruler = spark.range(0, 200, 1, 1).select(F.expr("repeat(element_at(array('=', '-', '_', '/', '+', '0', 'x', 'a', '*='), cast(id % 9 + 1 as int)), cast(20 + id % 23 as int))").alias("s"))
    rows = spark.range(0, 200, 1, 1).select(F.expr(f"substring(repeat(element_at(array('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz', '0123456789'), cast(id % 3 + 1 as int)), 4), cast(1 + id % 7 as int), cast(20 + id % 13 as int))").alias("s"))
    numbers = spark.range(0, 300, 1, 1).select(F.expr("substring(concat(abs(xxhash64(id, 1)), abs(xxhash64(id, 2))), 1, cast(12 + id % 20 as int))").alias("s"))
    ruler = ruler.unionByName(rows).unionByName(numbers)
    ordinary = plain.select(F.explode(F.expr("regexp_extract_all(text, '[A-Za-z0-9_-]{3,}', 0)")).alias("s"))
    ordinary = ordinary.unionByName(words.unionByName(told).select(F.explode(identifiers()).alias("s"))).unionByName(ruler)
    h = spark.range(0, RANDOM, 1, 4).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("h"))
    b64 = F.base64(F.unhex("h"))
    forms = [F.col("h"), b64, F.translate(b64, "+/=", "-_"), F.translate(b64, "+/=", ""), F.upper(F.concat(F.conv(F.substring("h", 1, 15), 16, 36), F.conv(F.substring("h", 16, 15), 16, 36))), F.lower(F.concat(F.conv(F.substring("h", 1, 15), 16, 36), F.conv(F.substring("h", 16, 15), 16, 36)))]
    return h.select(F.explode(F.array(*forms)).alias("s")), ordinary


def kind_of(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in "_-" else 4


def log_probabilities(counts: list[float]) -> list[float]:
    """log2 P(next | symbol), and of the first symbol in the last row, from counts of transitions.

    A symbol that was seen BACK_OFF times weighs its own counts half; the rest is the transition between the kinds of the
    two symbols (letters of either case, digits, joints, others) times the share of the next symbol in its kind.
    """
    size, kinds = len(ALPHABET), [kind_of(c) for c in ALPHABET] + [5]
    single = [1.0] * size
    between = [[0.5] * 5 for _ in range(6)]
    for k, v in enumerate(counts):
        single[k % size] += v
        between[kinds[k // size]][kinds[k % size]] += v
    in_kind = [sum(single[k] for k in range(size) if kinds[k] == c) for c in range(5)]
    out = []
    for a in range(size + 1):
        row = counts[a * size : (a + 1) * size]
        n, go = sum(row), between[kinds[a]]
        out += [math.log2((row[b] + BACK_OFF * go[kinds[b]] / sum(go) * single[b] / in_kind[kinds[b]]) / (n + BACK_OFF)) for b in range(size)]
    return out


def train(docs: DataFrame, sample: int = SAMPLE) -> list[float]:
    """Log-likelihood ratios in bits of all transitions and of first symbols, random against ordinary. The table has a fixed size."""
    size = len(ALPHABET)
    table = [[0.0] * ((size + 1) * size) for _ in range(2)]
    made, ordinary = training_sample(docs, sample)
    for r in _transitions(made, 1).unionByName(_transitions(ordinary, 0)).collect():
        table[r["label"]][r["pair"]] += r["n"]
    plain, odd = (log_probabilities(t) for t in table)
    return [b - a for a, b in zip(plain, odd, strict=True)]


def random_spans(text: str = "scanned", table: str = "llr") -> Column:
    """Spans of the strings that the models (column `table`) call random."""
    size = len(ALPHABET)
    symbols = f"transform(split(m, ''), c -> instr('{ALPHABET}', c))"
    step = f"(s, c) -> named_struct('was', c, 'sum', s.sum + element_at({table}, (s.was - 1) * {size} + c))"
    ratio = f"aggregate({symbols}, named_struct('was', {size + 1}, 'sum', cast(0 as double)), {step}, s -> s.sum)"
    return _spans(3, OTHER, f"{ratio} >= {BITS} + length(m) / 4", text=text)


def scan(docs: DataFrame, model: list[float]) -> DataFrame:
    """Each row of docs as a struct `row`, and secret_spans: all spans (start, kind, end), by start, then kind.

    Null is like an empty text: no spans. Repeated rows give repeated rows, an empty table none; docs may have columns of
    any name. A text of any length is scanned whole, in one row's expression, in time linear in its length and in the
    length of each string in it.
    """
    numbers = ",".join(repr(round(v, 6)) for v in model)
    x = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("scanned"), F.expr(f"cast(split('{numbers}', ',') as array<double>)").alias("llr"))
    return x.select("row", F.array_sort(F.concat(*base_spans(), random_spans())).alias("secret_spans"))


def _named(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(element_at(array({names}), x.kind + 1), ':', x.start, ':', x.end)), ',')"


def redacted() -> Column:
    """The text with each run of overlapping or touching secret_spans replaced by MARK; as it was if there are none.

    The text is cut into blocks once, so that no piece is looked for from the start of the text.
    """
    reach = _before("transform(secret_spans, x -> x.end)", "-1", "greatest({}, {})")  # the furthest end before each span
    first = "filter(transform(secret_spans, (x, i) -> if(x.start > r[i], named_struct('start', x.start, 'i', i), null)), x -> x is not null)"
    end = "if(i = 0, 0, r[h[i].i])"  # of the run before run i
    piece = lambda a, b: f"array_join(if({a} < {b}, transform(sequence(cast({a} div {BLOCK} as int), cast(({b} - 1) div {BLOCK} as int)), k -> substring(w[k], greatest({a} - k * {BLOCK}, 0) + 1, {b} - greatest({a}, k * {BLOCK}))), array()), '')"
    last, size = "array_max(transform(secret_spans, x -> x.end))", "length(row.text)"
    parts = f"concat(array_join(transform(h, (x, i) -> concat({piece(end, 'x.start')}, '{MARK}')), ''), {piece(last, size)})"
    whole = _let("r", reach, _let("h", first, _let("w", f"regexp_extract_all(row.text, '(?s).{{1,{BLOCK}}}', 0)", parts)))
    return F.expr(f"case when size(secret_spans) > 0 then {whole} else row.text end")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    x = scan(docs, train(docs))
    count = lambda k: F.expr(f"cast(size(filter(secret_spans, x -> x.kind = {k})) as bigint)")
    return x.select(
        F.col("row.doc_id").cast("long").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.expr(_named("filter(secret_spans, x -> x.kind < 3)")), 256).alias("base_sha256"), F.expr(_named("secret_spans")).alias("spans"),
    )


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents with their columns, secrets replaced by MARK; n_chars, where there is one, follows a changed text.

    Null and empty texts stay as they are; repeated rows are each treated alike; an empty table stays empty.
    """
    x = scan(docs, train(docs)).withColumn("clean", redacted())
    new = {"text": F.col("clean"), "n_chars": F.when(F.size("secret_spans") > 0, F.length("clean")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("clean")}
    return x.select(*(new.get(c, F.col("row").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
