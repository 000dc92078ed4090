"""Views on the driver's tables that the queries run on, in DataFrames and in SQL: items, request logs, votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.functions.text import MARKS, fold_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_fold(x: str) -> str:
    """`functions.text.fold` in SQL, from the same table."""
    a, b, many = fold_table()
    x = f"lower({x})"
    for c, plain in many:
        if c in "ßﬁﬂ½¼¾…ﬀ":
            x = f"replace({x}, '{c}', '{plain}')"
    return f"regexp_replace(translate({x}, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}'), '{MARKS}', '', 'g')"


def sql_words_folded(x: str) -> str:
    return rf"trim(regexp_replace({sql_fold(x)}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def sql_spaces_folded(x: str) -> str:
    return rf"trim(regexp_replace({sql_fold(x)}, '\s+', ' ', 'g'))"


#: What is put after the stem, and what stands as the key, of documents whose id is divisible by a number: so that each rule has hits and misses.
TAILS = [
    (7, " Qual alternativa sempre vale?"), (8, " geralmente ____ ocorre"), (9, " Assinale o item exceto este"), (10, " rascunho"), (12, " A rede 10.0.0.0/24 deve subdividir em quatro sub-redes iguais"),
    (19, " Considere A) um e B) dois"), (23, " Os campos xmin e xmax"), (29, " Quais são os mecanismos?"), (31, " Qual protocolo entrega?"), (37, " O sistema deve registrar em 2 segundos: funcional ou não funcional?"),
    (41, " Um requisito não funcional: REQ1: responder em 2 segundos; REQ2: segurança do acesso; REQ3: cor azul. Qual vale?"), (43, r" enderecamento com roteamento\n e \n fim"),
]
KEYS = [(31, "TCP"), (37, "não funcional"), (41, "REQ1"), (43, "/27 com rota ospf"), (24, "/26"), (12, "/27")]
#: Options put in by id: (place, number, text); in {} the option as it was.
OPTIONS = [(1, 13, "{} <NAME>"), (1, 17, "Nenhuma das alternativas"), (2, 47, "B) {}"), (3, 53, "Questao 12"), (2, 59, "I e I")]
MASKS = ["255.255.255.224", "255.0.255.0"]  # the two options after the key, where it is a prefix


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple-choice items cut from documents with words; markers put in by doc_id so that each rule has hits and misses.

    The first words of a text are the options, the text after them as it stands is the stem. referencia is the whole text
    that an item was cut from; the SQL view has no such column.
    """
    head = F.regexp_extract("text", r"^(?:[^\p{L}\p{N}]*+[\p{L}\p{N}]++){1,34}+", 0)  # no column below but the stem needs words after the 33rd
    d = table(spark, sf_dir, "documents").withColumn("head", head).where("head <> ''").withColumn("tok", F.regexp_extract_all("head", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    k = F.col("doc_id")
    sizes = [1 + k % 4, *(2 + (k + i) % 3 for i in range(1, 5))]
    starts = [F.lit(1)]
    for s in sizes[:-1]:
        starts.append(starts[-1] + s)
    cut = lambda a, n: F.array_join(F.slice("tok", a.cast("int"), n.cast("int")), " ")
    o = [cut(a, n) for a, n in zip(starts, sizes, strict=True)]
    o[4] = F.when(k % 11 == 0, o[3]).otherwise(o[4])
    for place, n, text in reversed(OPTIONS):
        before, _, after = text.partition("{}")
        o[place] = F.when(k % n == 0, F.concat(F.lit(before), o[place], F.lit(after)) if "{}" in text else F.lit(text)).otherwise(o[place])
    correct = (k % 5).cast("int")
    key = F.lit(None).cast("string")
    for n, text in reversed(KEYS):
        key = F.when(k % n == 0, text).otherwise(key)
    net = (k % 12 == 0) & key.startswith("/")
    for i in range(5):
        for j, mask in enumerate(MASKS):
            o[i] = F.when(net & ((correct + 1 + j) % 5 == i), mask).otherwise(o[i])
        o[i] = F.when((correct == i) & key.isNotNull(), key).otherwise(o[i])
    used = (starts[-1] + sizes[-1] - 1).cast("string")
    # possessive: the words of the options, or all there are
    rest = F.trim(F.substring(F.col("text"), F.length(F.regexp_substr("head", F.concat(F.lit(r"^(?:[^\p{L}\p{N}]*+[\p{L}\p{N}]++){0,"), used, F.lit("}+")))) + 1, F.length("text")))
    x = d.withColumn("alternativas", F.array(*o)).withColumn("correta", correct).withColumn("resposta_correta", F.try_element_at("alternativas", F.col("correta") + 1))
    tail = F.concat(*(F.when(k % n == 0, text).otherwise("") for n, text in TAILS), F.when(k % 6 == 0, F.concat(F.lit(" "), F.col("resposta_correta"))).otherwise(""))
    return x.select(
        k.alias("item_id"), F.concat(rest, tail).alias("enunciado"), "alternativas", "correta", "resposta_correta",
        F.array_join(F.slice("tok", 5, 12), " ").alias("explicacao"), F.col("lang").alias("competencia"), F.when(k % 14 == 0, "").otherwise(F.col("source")).alias("habilidade"),
        F.array_join(F.slice("tok", 1, 3), " ").alias("objeto_conhecimento"), (k % 15 == 0).alias("tem_imagem"), F.when(k % 30 == 0, F.lit("x")).alias("recurso_visual"),
        F.filter("alternativas", lambda v, i: i != F.col("correta")).alias("distratores"), F.array_join(F.slice("tok", 30, 4), " ").alias("spec_objetivo"), F.array_join(F.slice("tok", 2, 3), " ").alias("spec_objeto"),
        F.col("text").alias("referencia"),
    )


_S = ["1", *(" + ".join(["1 + 1 + doc_id % 4", *(f"2 + (doc_id + {j}) % 3" for j in range(1, i))]) for i in range(1, 5))]
_N = ["1 + doc_id % 4", *(f"2 + (doc_id + {i}) % 3" for i in range(1, 5))]
_O = [f"array_to_string(tok[{s} : {s} + {n} - 1], ' ')" for s, n in zip(_S, _N, strict=True)]
_O[4] = f"CASE WHEN doc_id % 11 = 0 THEN {_O[3]} ELSE {_O[4]} END"
for _place, _n, _text in reversed(OPTIONS):
    _new = " || ".join([f"'{_text.partition('{}')[0]}'", _O[_place], f"'{_text.partition('{}')[2]}'"]) if "{}" in _text else f"'{_text}'"
    _O[_place] = f"CASE WHEN doc_id % {_n} = 0 THEN {_new} ELSE {_O[_place]} END"
_KEY = f"CASE {' '.join(f'WHEN doc_id % {n} = 0 THEN {t!r}' for n, t in KEYS)} END"
_MASKED = lambda i: " ".join(f"WHEN doc_id % 12 = 0 AND starts_with(keyed, '/') AND (doc_id % 5 + {j + 1}) % 5 = {i} THEN {m!r}" for j, m in reversed([*enumerate(MASKS)]))
_O = [f"CASE WHEN doc_id % 5 = {i} AND keyed IS NOT NULL THEN keyed {_MASKED(i)} ELSE {o} END" for i, o in enumerate(_O)]
ITEMS = rf"""
cut AS (SELECT *, regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}]+') AS tok, regexp_split_to_array(coalesce(text, ''), '[\p{{L}}\p{{N}}]+') AS seps, {' + '.join(_N)} AS n_used, {_KEY} AS keyed FROM documents),
opt AS MATERIALIZED (SELECT *, [{', '.join(_O)}] AS alternativas, CAST(doc_id % 5 AS INTEGER) AS correta FROM cut WHERE len(tok) > 0),
items AS MATERIALIZED (
  SELECT doc_id AS item_id, trim(text[1 + coalesce(list_sum(list_transform(tok[1 : n_used], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(seps[1 : least(n_used, len(tok))], lambda x: length(x))), 0) :], ' ')
    || {' || '.join(f"CASE WHEN doc_id % {n} = 0 THEN '{t}' ELSE '' END" for n, t in TAILS)} || CASE WHEN doc_id % 6 = 0 THEN ' ' || alternativas[correta + 1] ELSE '' END AS enunciado,
    alternativas, correta, alternativas[correta + 1] AS resposta_correta, array_to_string(tok[5:16], ' ') AS explicacao, lang AS competencia,
    CASE WHEN doc_id % 14 = 0 THEN '' ELSE source END AS habilidade, array_to_string(tok[1:3], ' ') AS objeto_conhecimento,
    doc_id % 15 = 0 AS tem_imagem, CASE WHEN doc_id % 30 = 0 THEN 'x' END AS recurso_visual,
    list_filter(alternativas, lambda v, i: i <> correta + 1) AS distratores, array_to_string(tok[30:33], ' ') AS spec_objetivo, array_to_string(tok[2:4], ' ') AS spec_objeto
  FROM opt)"""

STATE_OF = {"signup": "REQUESTED", "view": "REFERENCE_RETRIEVED", "click": "STEM_GENERATED", "purchase": "GENERATION_COMPLETED", "error": "BLOCKED_BY_RED_FLAGS"}


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a request log: rid, seq (rank of time and id within the request), state, ts, tokens, value."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    state = F.lit(None).cast("string")
    for k, v in STATE_OF.items():
        state = F.when(F.col("event_type") == k, v).otherwise(state)
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("rid"), seq.cast("long").alias("seq"), state.alias("state"), "ts", "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("tokens"))


REQLOG = f"""
reqlog AS (
  SELECT user_id AS rid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
    CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in STATE_OF.items())} END AS state, ts, event_id, event_type, value,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens
  FROM events)"""
