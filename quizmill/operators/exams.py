"""Questions from exam text: blocks by header, options by a fold over lines, answer keys, hard and soft reasons.

All of it is built-in functions on one row's text. The options of a block are the last marks A to E in order at the begin
of lines; a fold over the marks keeps, for each letter, the latest start that has reached it, so one walk finds them,
whatever the number of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Headers, section titles, marks, noise lines, what a figure is called by, what an option is cut at.
HEADER = r"(?imd)^\s*QUEST[ÃA]O\s+(\d{1,2})\s*$"
DISCURSIVE = r"(?i)QUEST[ÃA]O\s+DISCURSIVA"
SECTION = r"(?md)^\s*COMPONENTE ESPEC[ÍI]FICO\s*$"
OPTION = r"^\s*\(?([A-E])\s*[\)\.\-–]?\s+(\S.*)$"
NOISE = r"(?i)^\s*(\*[A-Z0-9]+\*|[ÁA]REA LIVRE|RASCUNHO|ENADE\s*\d{4}|\d{1,2}\s*$|P[ÁA]GINA\s+\d+|CI[ÊE]NCIA DA COMPUTA[ÇC][ÃA]O.*BACHARELADO|ENGENHARIA DE COMPUTA[ÇC][ÃA]O\s*$|SISTEMAS DE INFORMA[ÇC][ÃA]O\s*$)"
VISUAL = r"(?i)\b(figura|imagem|gr[aá]fico|diagrama|esquema a seguir|tabela a seguir|ilustra)"
CUT = r"(?i)\s(?:QUEST[ÃA]O\s+\d|[ÁA]REA LIVRE|RASCUNHO|\*[A-Z]\d|[–-]\s*DISCURSIVA)"
WATERMARK = r"(?<!\S)\S*(?:VALID|INEP20\d\d)\S*"
KEY = r"(?<!DISCURSIVA )\b(\d{1,2})\s*[-–:]?\s*(ANULADA|[A-E])\b"
UNREAD = "�"
#: The first question of the specific part where no title tells; shortest sure stem; longest sure option.
FIRST, SHORT, LONG = 9, 60, 400

BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
PUNCTUATION = r"[.;?!)]"
#: A line that is a letter alone belongs to the next line.
LONE = r"(?md)^[^\S\n]*(\(?[A-E]\)?)[^\S\n]*\n[^\S\n]*([^\n]*)"
CHAIN = "array<int>"


def _strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def exam_blocks(exams: DataFrame, exam: str, text: str) -> DataFrame:
    """(exam, number, body, first) of exam texts: a row for each numbered header, its first place counts; first is the number that the specific part begins with.

    A body ends at the next header or where a discursive question begins. Null texts and texts without headers give no rows.
    """
    # few texts have a mark
    plain = F.when(F.col(text).contains("VALID") | F.col(text).contains("INEP20"), F.regexp_replace(text, WATERMARK, "")).otherwise(F.col(text))
    x = exams.select(exam, plain.alias("_t"))
    # the header that follows the first title of the specific part
    tail = F.element_at(F.split("_t", SECTION, 2), 2)
    after = F.when(F.size(F.split("_t", SECTION, 2)) > 1, F.nullif(F.regexp_extract(tail, HEADER, 1), F.lit("")).cast("int"))
    heads, parts = F.regexp_extract_all("_t", F.lit(HEADER), F.lit(1)), F.split("_t", HEADER, -1)
    x = x.select(exam, F.coalesce(after, F.lit(FIRST)).alias("first"), F.posexplode(F.arrays_zip(heads.alias("number"), F.slice(parts, 2, F.size(parts)).alias("body"))).alias("_at", "_x"))
    x = x.select(exam, "first", "_at", F.col("_x.number").cast("int").alias("number"), F.element_at(F.split("_x.body", DISCURSIVE, 2), 1).alias("body"))
    return x.groupBy(exam, "number").agg(F.min_by("body", "_at").alias("body"), F.first("first").alias("first"))


def clean_lines(body: Column) -> Column:
    """The lines of a block without blank and noise lines; a lone letter stands before the text of the next line."""
    kept = F.filter(F.transform(F.split(body, BREAK), lambda v: F.regexp_replace(v, r"(?U)\s+$", "")), lambda v: (v != "") & ~v.rlike(NOISE))
    return F.split(F.regexp_replace(F.array_join(kept, "\n"), LONE, "$1 $2"), "\n")


def last_run(lines: Column) -> Column:
    """Places (from 0) of the last A that B, C, D and E follow in this order, and of the first of each after it; null if there is none."""
    marks = F.filter(F.transform(lines, lambda v, i: F.struct(i.alias("i"), F.regexp_extract(v, OPTION, 1).alias("l"))), lambda m: m["l"] != "")
    none = F.lit(None).cast(CHAIN)
    start = F.struct(*(none.alias(f"c{k}") for k in range(1, 6)))

    def step(s: Column, m: Column) -> Column:
        out = [F.when(m["l"] == "A", F.array(m["i"])).otherwise(s["c1"])]
        for k in range(2, 6):
            was, have = s[f"c{k - 1}"], s[f"c{k}"]
            further = was.isNotNull() & (have.isNull() | (was[0] > have[0]))
            out.append(F.when((m["l"] == "ABCDE"[k - 1]) & further, F.concat(was, F.array(m["i"]))).otherwise(have))
        return F.struct(*(c.alias(f"c{k}") for k, c in enumerate(out, 1)))

    return F.aggregate(marks, start, step, lambda s: s["c5"])


def split_options(body: Column) -> Column:
    """struct(stem, options) of a block, null without a run of marks A to E."""

    def of(lines: Column, at: Column) -> Column:
        joined = lambda a, n: F.array_join(F.transform(F.slice(lines, a, n), _strip), " ")
        first = lambda k: F.regexp_extract(F.element_at(lines, at[k] + 1), OPTION, 2)
        raw = []
        for k in range(5):
            end = at[k + 1] if k < 4 else F.size(lines)
            rest = joined(at[k] + 2, end - at[k] - 1)
            raw.append(_strip(F.when(end - at[k] > 1, F.concat_ws(" ", first(k), rest)).otherwise(first(k))))
        stem = F.when(at[0] > 0, _strip(F.regexp_replace(joined(F.lit(1), at[0]), r"\s+", " "))).otherwise("")
        return F.struct(stem.alias("stem"), F.array(*raw).alias("raw"))

    let = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  one name for what is used often
    parts = let(clean_lines(body), lambda lines: let(last_run(lines), lambda at: F.when(at.isNotNull(), of(lines, at))))
    return let(parts, lambda p: F.when(p.isNotNull(), F.struct(p["stem"].alias("stem"), _without_tails(p["raw"]).alias("options"))))


def _without_tails(raw: Column) -> Column:
    """Options without headers and footers that stuck to their ends: from a fixed word on; and where three or more end in punctuation, up to four words after the last."""
    pointed = F.size(F.filter(raw, lambda o: _strip(o).rlike(PUNCTUATION + "$"))) >= 3
    cut = F.transform(raw, lambda o: _strip(F.element_at(F.split(o, CUT, 2), 1)))
    tail = r"(?<=[.;?!)])\s+[^\s.;?!)]+(?:\s+[^\s.;?!)]+){0,3}$"
    return F.when(pointed, F.transform(cut, lambda o: F.regexp_replace(o, tail, ""))).otherwise(cut)


def answer_keys(keys: DataFrame, exam: str, text: str) -> DataFrame:
    """(exam, number, letter, conflicts) from the text of answer keys: the first letter of a number counts, conflicts are later ones that differ."""
    up = F.upper(text)
    x = keys.select(exam, F.posexplode(F.arrays_zip(F.regexp_extract_all(up, F.lit(KEY), F.lit(1)).alias("n"), F.regexp_extract_all(up, F.lit(KEY), F.lit(2)).alias("l"))).alias("_at", "_x"))
    x = x.select(exam, "_at", F.col("_x.n").cast("int").alias("number"), F.col("_x.l").alias("letter"))
    first = x.groupBy(exam, "number").agg(F.min_by("letter", "_at").alias("letter"), F.collect_set("letter").alias("_all"), F.count("*").alias("_n"))
    other = x.join(first.select(F.col(exam).alias("_e"), F.col("number").alias("_m"), F.col("letter").alias("_l")), (F.col(exam) == F.col("_e")) & (F.col("number") == F.col("_m")) & (F.col("letter") != F.col("_l"))).groupBy(exam, "number").agg(F.count("*").alias("conflicts"))
    return first.drop("_all", "_n").join(other, [exam, "number"], "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0)))


def extracted(blocks: DataFrame, keys: DataFrame, exam: str, general: bool = False) -> DataFrame:
    """(exam, number, stem, options, correct, visual, status, review) of blocks and keys (exam, number, letter).

    status: `accepted`, `annulled` (says nothing more), `excluded` with the hard reason in review. review of accepted ones
    holds the soft reasons, joined by `; `. Questions before the specific part are left out unless general.
    """
    b = blocks if general else blocks.where("number >= first")
    x = b.join(keys.select(exam, "number", "letter"), [exam, "number"], "left").withColumn("o", split_options(F.col("body")))
    whole = F.concat(F.col("o.stem"), F.array_join("o.options", ""))
    status = F.when(F.col("o").isNull(), "excluded").when(F.col("letter") == "ANULADA", "annulled").when(F.coalesce(~F.col("letter").rlike("^[A-E]$"), F.lit(True)) | whole.contains(UNREAD), "excluded").otherwise("accepted")
    hard = F.when(F.col("o").isNull(), "alternativas A-E não encontradas").when(F.coalesce(~F.col("letter").rlike("^[A-E]$"), F.lit(True)), "gabarito ausente").otherwise("caracteres não recuperados (excluída)")
    visual = F.col("o.stem").rlike(VISUAL)
    soft = F.array_join(F.array_compact(F.array(F.when(F.length("o.stem") < SHORT, "enunciado curto: pode ter sido cortado"), F.when(F.exists("o.options", lambda v: F.length(v) > LONG), "alternativa muito longa: pode ter misturado colunas"), F.when(visual, "menciona figura/tabela"))), "; ")
    x = x.withColumn("status", status)
    accepted = lambda c: F.when(F.col("status") == "accepted", c)
    return x.select(exam, "number", accepted(F.col("o.stem")).alias("stem"), accepted(F.col("o.options")).alias("options"), accepted(F.instr(F.lit("ABCDE"), F.col("letter")) - 1).alias("correct"), accepted(visual).alias("visual"), "status", F.when(F.col("status") == "excluded", hard).when(F.col("status") == "accepted", soft).otherwise("").alias("review"))
