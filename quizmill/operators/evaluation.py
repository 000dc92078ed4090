"""Rates and counts over evaluated outputs: validation rates, best model, component passes, strata, coverage, dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizmill.functions import text as T
from quizmill.operators.scans import with_quantiles

C = F.col


def validation_rates(df: DataFrame, by: list[str]) -> DataFrame:
    """Of valid, four_distinct, copies_key (boolean), length_ratio and overlap (null where there was no output): rates and medians by group, three digits."""
    rate = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 3)
    x = df.groupBy(*by).agg(
        F.count("*").alias("items"), rate(C("valid")).alias("valid_rate"), rate(C("four_distinct")).alias("four_distinct_rate"), rate(C("copies_key")).alias("copy_rate"),
        F.round(F.avg((C("length_ratio") > 1.5).cast("double")), 3).alias("long_rate"), F.round(F.avg("overlap"), 3).alias("mean_overlap"),
    )
    return with_quantiles(x, df, by, "length_ratio", {"median_length_ratio": 0.5}, 3).select(*by, "items", "valid_rate", "four_distinct_rate", "copy_rate", "median_length_ratio", "long_rate", "mean_overlap")


def best_model(rates: DataFrame, name: str) -> DataFrame:
    """The row of the best model: most usable outputs (two digits), fewest copies, fewest long keys (none at all counts as all, as does no measurement), most overlap, then the first name."""
    long_ = F.coalesce(F.nullif("long_rate", F.lit(0.0)), F.lit(1.0))
    score = F.struct(F.round(C("valid_rate") * C("four_distinct_rate"), 2).alias("usable"), (-C("copy_rate")).alias("copies"), (-long_).alias("long"), F.coalesce("mean_overlap", F.lit(0.0)).alias("overlap"))
    best = rates.agg(F.max(score).alias("s"))
    x = rates.withColumn("s", score).join(best, "s", "left_semi")
    return x.agg(F.min(name).alias(name), F.max("s.usable").alias("usable"))


def structure_checks(items: DataFrame) -> DataFrame:
    """items with the checks of an assembled question: five options, options unlike without case, index in range, all of it with stem and explanation."""
    o, c = F.coalesce("alternativas", F.array().cast("array<string>")), C("correta")
    given = lambda k: F.trim(F.coalesce(k, F.lit(""))) != ""
    same = F.transform(o, lambda x: F.lower(F.trim(x)))
    x = items.withColumn("five", F.size(o) == 5).withColumn("unlike", F.size(F.array_distinct(same)) == F.size(o)).withColumn("in_range", F.coalesce((c >= 0) & (c < F.size(o)), F.lit(False)))
    return x.withColumn("passes", C("five") & C("unlike") & C("in_range") & given("enunciado") & given("explicacao"))


def pass_counts(df: DataFrame, by: str, checks: list[str]) -> DataFrame:
    """Per group: rows, and how many pass each check."""
    return df.groupBy(by).agg(F.count("*").alias("n"), *(F.count_if(c).alias(f"n_{c}") for c in checks))


def strata(df: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, n): counts of each value of each column, in one pass; null is `n/d`."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.coalesce(C(c).cast("string"), F.lit("n/d")).alias("value")) for c in columns)))
    return df.select(pairs.alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def coverage(df: DataFrame, area: str) -> DataFrame:
    """(area, n, place): records of each area, most first, ties by name."""
    n = df.groupBy(F.coalesce(area, F.lit("n/d")).alias("area")).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "area")))  # one row an area


def occurrences(df: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """(term, n): how often each of a few terms stands in a text column, without case, overlaps counted once."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda t: F.regexp_count(low, F.lit("\\Q" + t.lower() + "\\E"))
    return df.select(F.explode(F.array(*(F.struct(F.lit(t).alias("term"), count(t).alias("n")) for t in terms))).alias("x")).groupBy("x.term").agg(F.sum("x.n").alias("n"))


def eligible(states: DataFrame, questions: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of states (key, state) that are completed, have a question and are not yet judged."""
    ready = states.where("state = 'GENERATION_COMPLETED'").join(questions.select(key), key, "left_semi")
    return ready.join(done.select(key), key, "left_anti")


def token_split(artifacts: DataFrame, by: list[str], provenance: str) -> DataFrame:
    """Sums of remote and local token usage in provenance JSON (token_usage_remote, token_usage_local); what is missing counts 0."""
    get = lambda side, *names: F.coalesce(*(F.get_json_object(provenance, f"$.token_usage_{side}.{n}").cast("long") for n in names), F.lit(0))
    total = lambda c, n: F.sum(c).cast("long").alias(n)
    return artifacts.groupBy(*by).agg(
        total(get("remote", "prompt_tokens", "input_tokens"), "remote_in"), total(get("remote", "completion_tokens", "output_tokens"), "remote_out"), total(get("remote", "total_tokens"), "remote_total"),
        total(get("local", "input_tokens", "prompt_tokens"), "local_in"), total(get("local", "output_tokens", "completion_tokens"), "local_out"), total(get("local", "total_tokens"), "local_total"),
    )


def criteria(df: DataFrame, names: list[str], lowest: Column) -> DataFrame:
    """(criterion, mean, n_lowest): means without nulls, and how often each criterion is the lowest."""
    per = F.explode(F.array(*(F.struct(F.lit(n).alias("criterion"), C(n).cast("double").alias("v"), (lowest == n).alias("low")) for n in names)))
    return df.select(per.alias("x")).groupBy("x.criterion").agg(F.round(F.avg("x.v"), 6).alias("mean"), F.count_if("x.low").alias("n_lowest"))


def dashboard(records: DataFrame) -> DataFrame:
    """One row of records (state, final_flags, treated, seconds): all, completed, and of the completed flags, treated flags and mean seconds of finite values."""
    done = C("state") == "GENERATION_COMPLETED"
    finite = done & C("seconds").isNotNull() & ~F.isnan(C("seconds").cast("double")) & (F.abs(C("seconds").cast("double")) < float("inf"))
    return records.agg(
        F.count("*").alias("total"), F.count_if(done).alias("completed"), F.coalesce(F.sum(F.when(done, C("final_flags"))), F.lit(0)).cast("long").alias("final_flags"),
        F.coalesce(F.sum(F.when(done, C("treated"))), F.lit(0)).cast("long").alias("treated"), F.round(F.avg(F.when(finite, C("seconds"))), 1).alias("mean_seconds"),
    )


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def source_of(model: Column, strategy: Column) -> Column:
    """Where options come from: curated memory, a deterministic rule, a tuned model, a base model, another named one, unknown."""
    m = F.coalesce(model, F.lit(""))
    curated = F.coalesce(strategy == "familia_conceitual_curada", F.lit(False)) | m.contains("memory-curated")
    return F.when(curated, "memoria_curada").when(m.startswith("deterministic"), "regra_deterministica").when(m.contains("LoRA"), "slm_ajustada").when(m.endswith(":base"), "slm_base").when(m != "", F.concat(F.lit("slm("), m, F.lit(")"))).otherwise("desconhecida")


def source_counts(attempts: DataFrame, key: str, order: str, source: str, done: str) -> DataFrame:
    """(source, n_attempts, n_final): over all attempts, and over the last one of each completed item."""
    w = F.max(order).over(Window.partitionBy(key))
    x = attempts.withColumn("_last", C(order) == w)
    return x.groupBy(source).agg(F.count("*").alias("n_attempts"), F.count_if(C("_last") & C(done)).alias("n_final"))


def harmonised_flag(flag: Column) -> Column:
    """struct(code, stage, field, evidence, repair_target) of a flag in JSON, under names of either language, the first that is not empty; what is no object is an alert with itself as evidence."""
    get = lambda *names: F.coalesce(*(F.nullif(F.get_json_object(flag, f"$.{n}"), F.lit("")) for n in names))
    found = F.coalesce(F.trim(flag).startswith("{") & F.try_parse_json(flag).isNotNull(), F.lit(False))
    one = lambda default, *names: F.when(found, F.coalesce(get(*names), F.lit(default))).otherwise(default)
    return F.struct(
        one("alerta", "codigo", "code").alias("code"), one("QUALIDADE", "etapa", "stage").alias("stage"), one("", "campo", "field").alias("field"),
        F.when(found, F.coalesce(get("evidencia", "evidence"), F.lit(""))).otherwise(F.coalesce(flag, F.lit("None"))).alias("evidence"), one("", "reparo", "repair_target").alias("repair_target"),
    )


def repeats_within(options: Column) -> Column:
    """How many options of an item repeat an earlier one of it, by their normalised text."""
    same = F.transform(options, lambda x: T.words_folded(x))
    return F.size(same) - F.size(F.array_distinct(same))


def latest_decision(reviews: DataFrame, key: str, order: str, decision: str) -> DataFrame:
    """(key, decision) of each item's last review, in the words of the studio."""
    d = F.max_by(decision, order)
    return reviews.groupBy(key).agg(F.when(d == "APROVAR", "Usaria").when(d == "REJEITAR", "Não usaria").otherwise(d).alias("decision"))
