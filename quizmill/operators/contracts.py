"""Validation, registries, resumption and the batch pool loop."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizmill.functions import text as T
from quizmill.operators.generators import promote, split_pool
from quizmill.sources.staging import stage

#: Words that say nothing about what an objective is for.
GENERIC = [
    "analisar", "analise", "compreender", "entender", "saber", "responder",
    "conteudo", "assunto", "tema", "questao", "detalhadamente", "completa",
    "completo", "o", "a", "de", "do", "da", "e", "um", "uma",
]


def generic_objective(c: Column, words: list[str] | None = None) -> Column:
    """Whether an objective has no word outside a generic set."""
    found = F.regexp_extract_all(T.plain_folded(c), F.lit("[a-z]+"), F.lit(0))
    return F.forall(found, lambda w: w.isin(*(words or GENERIC)))


def request_errors(df: DataFrame) -> DataFrame:
    """df with errors (array): exam, difficulty, attempts and objective of a request (exame, dificuldade, max_attempts, max_distractor_attempts, objetivo_pedagogico)."""
    between = lambda c, lo, hi: F.col(c).isNull() | F.col(c).between(lo, hi)
    e = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("exame"), F.lit("ENADE")).isin("ENADE", "POSCOMP", "ENEM"), F.lit("exame")),
        F.when(~between("dificuldade", 1, 5), F.lit("dificuldade")), F.when(~between("max_attempts", 1, 10), F.lit("max_attempts")),
        F.when(~between("max_distractor_attempts", 1, 10), F.lit("max_distractor_attempts")), F.when(generic_objective(F.coalesce("objetivo_pedagogico", F.lit(""))), F.lit("objetivo_generico")),
    ))
    return df.withColumn("errors", e)


def question_error(options: Column, correct: Column, *required: Column) -> Column:
    """First fault of an ablation question: a missing field, not five options, an index out of range, options alike without case; null if sound."""
    missing = F.lit(False)
    for c in required:
        missing = missing | (F.trim(F.coalesce(c, F.lit(""))) == "")
    same = F.transform(options, lambda x: F.lower(F.trim(x)))
    return F.when(missing, "campo_ausente").when(F.size(options) != 5, "alternativas").when(correct.isNull() | ~correct.between(0, 4), "correta").when(F.size(F.array_distinct(same)) != 5, "repetidas")


FORBIDDEN = ["alternativas", "distratores", "opcoes", "options"]


def forbidden_keys(json: Column) -> Column:
    """Keys of a JSON object that a stem must not have."""
    return F.array_intersect(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*map(F.lit, FORBIDDEN)))


def outer_json(c: Column) -> Column:
    """What stands between the first { and the last }, if it is JSON; else null."""
    found = F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def named_objects(json: Column, value: str, *names: str) -> Column:
    """map(name, value field) from `{"name": {...}}` or from a list of objects that carry their name under one of several keys."""
    as_map = F.from_json(json, f"map<string,struct<{value}:string>>")
    fields = ",".join(f"{n}:string" for n in names)
    as_list = F.from_json(json, f"array<struct<{fields},{value}:string>>")
    pairs = F.filter(F.transform(as_list, lambda x: F.struct(F.coalesce(*(x[n] for n in names)).alias("k"), x[value].alias("v"))), lambda p: p["k"].isNotNull())
    return F.when(F.trim(json).startswith("["), F.map_from_entries(pairs)).otherwise(F.transform_values(as_map, lambda k, v: v[value]))


def legacy_record(df: DataFrame) -> DataFrame:
    """Old records (enunciado, distratores, regeneracoes array of struct with distratores): the last regeneration's distractors win."""
    last = F.try_element_at("regeneracoes", F.lit(-1))["distratores"]
    return df.withColumn("distratores", F.coalesce(F.when(F.size(last) > 0, last), F.col("distratores"))).drop("regeneracoes")


def stage_of(events: DataFrame) -> DataFrame:
    """Per request the stage that its latest event's reason tells."""
    r = F.lower(F.coalesce("reason", F.lit("")))
    x = events.groupBy("request_id").agg(F.max_by("reason", "id").alias("reason"))
    return x.withColumn("stage", F.when(r.contains("distrator"), "distratores").when(r.contains("núcleo") | r.contains("nucleo") | r.contains("enunciado"), "enunciado").when(r.contains("refer"), "referencia").otherwise("solicitacao"))


def attempts(events: DataFrame) -> DataFrame:
    """Per request how often each kind of step was begun."""
    return events.groupBy("request_id").agg(F.count_if(F.col("to_state") == "STEM_GENERATED").alias("stem_attempts"), F.count_if(F.col("to_state") == "DISTRACTORS_GENERATED").alias("distractor_attempts"), F.count_if(F.col("to_state") == "BLOCKED_BY_RED_FLAGS").alias("blocks"))


def resume_point(artifacts: DataFrame) -> DataFrame:
    """Per request the checkpoints that exist and the step to go on with."""
    has = lambda k: F.bool_or(F.col("kind") == k)
    x = artifacts.groupBy("request_id").agg(has("REFERENCE").alias("reference"), has("STEM_CHECKPOINT").alias("stem"), has("DISTRACTOR_POOL_CHECKPOINT").alias("pool"))
    return x.withColumn("next_step", F.when(~F.col("reference"), "reference").when(~F.col("stem"), "stem").when(~F.col("pool"), "candidates").otherwise("gate"))


def pending(cases: DataFrame, done: DataFrame, key: str, ok: Column | None = None) -> DataFrame:
    return cases.join((done if ok is None else done.where(ok)).select(key), key, "left_anti")


def new_flag_version(registry: DataFrame, flags: DataFrame) -> DataFrame:
    """registry (red_flag_id, version, active, ...) with new flags appended as the next version, older versions of the same id inactive."""
    last = registry.groupBy("red_flag_id").agg(F.max("version").alias("_last"))
    new = flags.join(last, "red_flag_id", "left").withColumn("version", F.coalesce("_last", F.lit(0)) + 1).withColumn("active", F.lit(True)).drop("_last")
    old = registry.join(flags.select("red_flag_id").withColumn("_new", F.lit(True)).distinct(), "red_flag_id", "left")
    return old.withColumn("active", F.col("active") & F.col("_new").isNull()).drop("_new").unionByName(new, allowMissingColumns=True)


def reusable_reports(reports: DataFrame, wanted: DataFrame) -> DataFrame:
    """The newest report of each wanted (version_id, profile) made under an identical profile."""
    key = lambda df: df.withColumn("_p", F.sha2(F.to_json("profile"), 256))
    w = Window.partitionBy("version_id", "_p").orderBy(F.desc("created_at"))
    newest = key(reports).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "profile")
    return key(wanted).join(newest, ["version_id", "_p"]).drop("_p")


def grow_pools(requests: DataFrame, propose: Callable[[DataFrame, int], DataFrame], reject: Callable[[DataFrame], DataFrame], want: int = 4, bank: int = 6, stuck: int = 2) -> DataFrame:
    """Pools of candidates for many requests at once.

    Each round asks for candidates (request_id, text) of the requests still short, takes those that are new by their
    folded text and not rejected, up to `bank` a request, and stops asking a request after `stuck` rounds without
    progress; so every request ends, after want * stuck rounds at most, and none is left short while it grows. Result:
    request_id, text, place, role. Each round's pools are written to the shared folder.
    """
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    spark = requests.sparkSession
    pool = spark.createDataFrame([], StructType([StructField("request_id", requests.schema["request_id"].dataType), StructField("text", StringType()), StructField("seq", LongType())]))
    idle = requests.select("request_id", F.lit(0).alias("idle"))
    for k in count():
        have = pool.groupBy("request_id").agg(F.count("*").alias("n"))
        open_ = requests.join(have, "request_id", "left").join(idle, "request_id").where((F.coalesce("n", F.lit(0)) < want) & (F.col("idle") < stuck)).select(*requests.columns)
        if not open_.limit(1).count():
            break
        made = reject(propose(open_, k)).withColumn("key", T.short_key(F.col("text"))).dropDuplicates(["request_id", "key"])
        new = made.join(pool.withColumn("key", T.short_key(F.col("text"))).select("request_id", "key"), ["request_id", "key"], "left_anti").drop("key")
        both = pool.unionByName(new.select("request_id", "text", F.lit(k + 1).cast("long").alias("seq")))
        w = Window.partitionBy("request_id").orderBy("seq", "text")
        grown = both.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= bank).drop("_r")
        grown = stage(grown, "pools")
        progress = grown.where(F.col("seq") == k + 1).select("request_id").distinct().withColumn("_moved", F.lit(True))
        asked = open_.select("request_id").withColumn("_asked", F.lit(True))
        idle = idle.join(progress, "request_id", "left").join(asked, "request_id", "left").select("request_id", F.when(F.col("_moved").isNotNull(), 0).when(F.col("_asked").isNotNull(), F.col("idle") + 1).otherwise(F.col("idle")).alias("idle"))
        idle = stage(idle, "idle")
        pool = grown
    order = Window.partitionBy("request_id").orderBy("seq", "text")
    return split_pool(pool.withColumn("i", F.row_number().over(order)), "request_id", "i", want).select("request_id", "i", "text", "place", "role")


def gate(pool: DataFrame, verdicts: DataFrame, budget: int = 3, want: int = 4) -> DataFrame:
    """A pool after its verdicts (request_id, i, valid, reason): the first verdict of a place counts, unknown reasons become `implausivel`, at most `budget` rejections a request; reserves move up."""
    known = ["implausivel", "parcialmente_correto", "fora_do_tema", "equivalente_ao_gabarito", "repetido"]
    v = verdicts.join(pool.select("request_id", "i"), ["request_id", "i"]).where("not valid").withColumn("reason", F.when(F.col("reason").isin(*known), F.left("reason", F.lit(500))).otherwise("implausivel")).dropDuplicates(["request_id", "i"])
    w = Window.partitionBy("request_id").orderBy("i")
    bad = v.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= budget)
    return promote(pool, bad, "request_id", "i", want)
