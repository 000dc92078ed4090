"""Training-set build: filter chains with reasons, deterministic split, repetition, quality metrics of generated options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill.functions import text as T
from quizmill.functions.similarity import bag_f1
from quizmill.operators.exams import split_options
from quizmill.operators.rules import family, key_of, others

VISUAL = r"(?iu)\b(figura|imagem|gráfico|grafico|diagrama abaixo|tabela abaixo|ilustra)"


def length_ratio(answer: Column, rest: Column) -> Column:
    """Words of the key over the median of the others (a median of 0 counts as 1, one of a half as it is)."""
    s = F.array_sort(F.transform(rest, lambda x: F.size(T.words(x))))
    n = F.size(s)
    mid = (F.try_element_at(s, (F.floor((n + 1) / 2)).cast("int")) + F.try_element_at(s, (F.floor(n / 2) + 1).cast("int"))) / 2
    return F.size(T.words(answer)) / F.when(mid > 0, mid).otherwise(1.0)


def reason(max_ratio: float = 2.5, closed: bool = True, words_of_images: bool = True) -> Column:
    """Why a question (enunciado, alternativas, correta, tem_imagem) is no training example: the first reason that holds, null if none does.

    Closed formats and words that name an image are no reasons if told so; then later reasons still may hold.
    """
    stem, o, c = F.trim(F.coalesce("enunciado", F.lit(""))), F.transform("alternativas", lambda x: F.trim(F.coalesce(x, F.lit("")))), F.col("correta")
    key = key_of(o, c)
    fam = family(key, stem)
    return (
        F.when(~stem.rlike(r"[^\p{Zs}]"), "enunciado_vazio")
        .when((F.size(o) != 5) | F.exists(o, lambda x: x == ""), "nao_tem_5_alternativas")
        .when(c.isNull() | (c < 0) | (c >= 5), "gabarito_invalido")
        .when(F.size(F.array_distinct(F.transform(o, T.words_folded))) != 5, "alternativas_duplicadas")
        .when(F.coalesce("tem_imagem", F.lit(False)) | (stem.rlike(VISUAL) if words_of_images else F.lit(False)), "depende_de_recurso_visual")
        .when(fam.isin("combinacao_itens", "assercoes") if closed else F.lit(False), F.concat(F.lit("formato_fechado_"), fam))
        .when(length_ratio(key, others(o, c)) > max_ratio, "gabarito_destoa_em_extensao")
    )


def partition_of(key: Column, validation: float = 0.2) -> Column:
    return F.when(T.half_split(key) < validation * 10_000, "validacao").otherwise("treino")


def examples(questions: DataFrame, max_ratio: float = 2.5, validation: float = 0.2) -> DataFrame:
    """Questions with reason; those without one get a partition and a completion. Repeated stems keep the first by id."""
    x = questions.withColumn("reason", reason(max_ratio)).withColumn("k", T.words_folded(F.col("enunciado")))
    first = x.where("reason is null").groupBy("k").agg(F.min("id").alias("first_id"))
    x = x.join(first, "k", "left").withColumn("reason", F.when(F.col("reason").isNull() & (F.col("id") != F.col("first_id")), "repetida").otherwise(F.col("reason")))
    return x.withColumn("partition", F.when(F.col("reason").isNull(), partition_of(F.col("id").cast("string"), validation))).withColumn("completion", F.when(F.col("reason").isNull(), F.to_json(F.struct(others(F.col("alternativas"), F.col("correta")).alias("distratores"))))).drop("k", "first_id")


def repeated(df: DataFrame, key: str, times: int) -> DataFrame:
    """df and times - 1 more copies of each row, their ids marked."""
    return df.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn(key, F.when(F.col("_i") == 1, F.col(key).cast("string")).otherwise(F.concat(F.col(key), F.lit("#rep"), F.col("_i")))).drop("_i")


#: The mark before an option, the area that is left out, the reasons in their order.
OPTION_MARK = r"^\s*\(?[a-eA-E]\s*[\)\.\-–]\s*"
MATHS = "Matemática"
VOID, UNREADABLE, NOT_FIVE, IS_MATHS = "anulada_ou_sem_gabarito", "opcoes_ilegiveis", "nao_tem_5_alternativas", "matematica"

_LITERAL = r"""(?:'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|-?[0-9]++(?:\.[0-9]++)?+|True|False|None)"""
_ODD = r"(?<!\\)((?:\\\\)*+)"  # before a sign that a backslash may have taken


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def literal_list(c: Column) -> Column:
    """The members, as texts, of a list or tuple of quoted strings and plain numbers as Python writes it; null for anything else.

    Each member is made a JSON string, and the JSON reader undoes the escapes both languages share; of those of Python
    alone, quotes and codes of two hex digits are known. One pass for each step, whatever the length.
    """
    whole = rf"^\s*+(?:\[\s*+(?:{_LITERAL}\s*+,\s*+)*+(?:{_LITERAL}\s*+)?+\]|\(\s*+(?:{_LITERAL}\s*+,\s*+)++(?:{_LITERAL}\s*+)?+\)|\(\s*+\))\s*+\z"

    def as_json(x: Column) -> Column:
        inner = F.when(F.left(x, F.lit(1)).isin("'", '"'), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)
        plain = F.regexp_replace(inner, _ODD + r"""\\(['"])""", "$1$2")
        quoted = F.regexp_replace(plain, _ODD + '"', '$1\\\\"')
        return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(quoted, "\t", r"\\t"), _ODD + r"\\x([0-9a-fA-F]{2})", r"$1\\u00$2"), F.lit('"'))

    members = F.transform(F.regexp_extract_all(c, F.lit(_LITERAL), F.lit(0)), as_json)
    return F.when(c.rlike(whole), F.from_json(F.concat(F.lit("["), F.array_join(members, ","), F.lit("]")), "array<string>"))


def csv_question(options: Column, letter: Column, area: Column | None = None, with_maths: bool = False) -> Column:
    """struct(reason, options, correct) of an exam row whose options are a Python list in text.

    The first that holds is the reason: maths (unless asked for), a key that is no letter A to E (null is none), options
    that cannot be read (null too), not five of them. reason is null for rows that stay; correct counts from 0.
    """
    clean = F.transform(literal_list(options), lambda x: _stripped(F.regexp_replace(x, OPTION_MARK, "")))
    key = F.upper(_stripped(F.coalesce(letter, F.lit(""))))
    maths = F.lit(False) if area is None or with_maths else F.coalesce(_stripped(area) == MATHS, F.lit(False))
    why = F.when(maths, IS_MATHS).when(~key.rlike(r"^[A-E]\z"), VOID).when(clean.isNull(), UNREADABLE).when(F.size(clean) != 5, NOT_FIVE)
    return F.struct(why.alias("reason"), clean.alias("options"), F.when(key.rlike(r"^[A-E]\z"), F.instr(F.lit("ABCDE"), key) - 1).alias("correct"))


def option_quality(df: DataFrame, key: str) -> DataFrame:
    """Of key, answer, generated, real (arrays): valid, four distinct, copies the key, length ratio, mean best overlap with the real ones."""
    g = F.col("generated")
    norm = F.transform(g, T.accented_key)
    base = df.select(key, (F.size(g) > 0).alias("valid"), ((F.size(g) == 4) & (F.size(F.array_distinct(norm)) == 4)).alias("four_distinct"), F.array_contains(norm, T.accented_key(F.col("answer"))).alias("copies_key"), F.round(length_ratio(F.col("answer"), g), 3).alias("length_ratio"))
    pairs = df.select(key, F.posexplode("generated").alias("i", "x"), F.col("real")).select(key, "i", "x", F.posexplode("real").alias("j", "y")).withColumn("pair", F.concat_ws("|", key, "i", "j"))
    best = pairs.join(bag_f1(pairs, "x", "y", "pair"), "pair").groupBy(key, "i").agg(F.max("f1").alias("f1")).groupBy(key).agg(F.round(F.avg("f1"), 3).alias("overlap"))
    return base.join(best, key, "left")


# ---------------------------------------------------------------- exam text


def exam_blocks(text: Column) -> Column:
    """Array of struct(number, body) from exam text: parts that begin with `QUESTÃO n`, cut at a discursive section, without noise lines."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?ius)quest[aã]o discursiva.*?(?=quest[aã]o\s+\d)", "")
    body = F.regexp_replace(body, r"(?ium)^\s*(?:rascunho|área livre|\*[A-Z0-9]+\*|\d{1,3})\s*$", "")
    parts = F.split(body, r"(?iu)(?=\bquest[aã]o\s+\d{1,3}\b)")
    made = F.transform(parts, lambda p: F.struct(F.nullif(F.regexp_extract(p, r"(?iu)^quest[aã]o\s+(\d{1,3})\b", 1), F.lit("")).cast("int").alias("number"), F.trim(F.regexp_replace(p, r"(?iu)^quest[aã]o\s+\d{1,3}\b", "")).alias("body")))
    return F.filter(made, lambda x: x["number"].isNotNull())


def exam_options(body: Column) -> Column:
    """struct(stem, options) of a block: the options are what follows the last run of marks A to E."""
    return split_options(body)


def answer_keys(rows: DataFrame) -> DataFrame:
    """(number, letter) from key rows (c0, c1): those whose first cell is digits."""
    return rows.where(F.col("c0").rlike(r"^\d+$")).select(F.col("c0").cast("int").alias("number"), F.upper(F.trim("c1")).alias("letter"))


def exam_items(blocks: DataFrame, keys: DataFrame) -> DataFrame:
    """blocks (exam, number, body) with their keys (exam, number, letter): options, correct index, reason or null."""
    x = blocks.join(keys, ["exam", "number"], "left").withColumn("o", exam_options(F.col("body")))
    why = F.when(F.col("letter").isNull(), "sem_gabarito").when(~F.col("letter").rlike("^[A-E]$"), "anulada").when(F.col("o").isNull(), "alternativas_nao_encontradas").when(F.col("body").rlike(r"\(cid:\d+\)"), "texto_ilegivel")
    return x.select("exam", "number", F.col("o.stem").alias("enunciado"), F.col("o.options").alias("alternativas"), (F.instr(F.lit("ABCDE"), F.col("letter")) - 1).alias("correta"), why.alias("reason"))
