"""Campaign analytics: usage, routes, rates, percentiles, paired comparison, duplicates, jury votes and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizmill.operators import scans
from quizmill.operators.scans import with_quantiles

PRICE_IN, PRICE_OUT = 0.15, 0.60  # US$ a million tokens


def cost(tokens_in: Column, tokens_out: Column, price_in: float = PRICE_IN, price_out: float = PRICE_OUT) -> Column:
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where there is nothing."""
    return F.coalesce(100 * part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def route(model: Column) -> Column:
    m = F.coalesce(model, F.lit(""))
    return F.when(m.startswith("slm-memory-curated"), "memoria_curada").when(m.startswith("deterministic-"), "deterministico").when(m.contains("Qwen") | m.contains("qwen"), "qwen_lora").otherwise(F.when(m == "", "").otherwise("outro"))


def tokens_of(json: Column, *names: str) -> Column:
    """The first of several JSON fields that is there, as a number; 0 if none is."""
    return F.coalesce(*(F.get_json_object(json, f"$.{n}").cast("long") for n in names), F.lit(0))


def summary(runs: DataFrame, by: list[str], ok: Column, seconds: str, tokens: str) -> DataFrame:
    """Per group: runs, successes, rate, mean, median and p95 of seconds over successes, tokens, tokens a success."""
    runs = runs.withColumn("_s", F.when(ok, F.col(seconds)))
    x = runs.groupBy(*by).agg(
        F.count("*").alias("n_runs"), F.count_if(ok).alias("n_ok"), F.round(percent(F.count_if(ok), F.count("*")), 6).alias("ok_percent"), F.round(F.avg("_s"), 6).alias("mean_seconds"),
        F.sum(tokens).cast("long").alias("tokens"), F.round(F.sum(tokens) / F.nullif(F.count_if(ok), F.lit(0)), 2).alias("tokens_per_ok"),
    )
    x = with_quantiles(x, runs, by, "_s", {"median_seconds": 0.5, "p95_seconds": 0.95})
    return x.select(*by, "n_runs", "n_ok", "ok_percent", "mean_seconds", "median_seconds", "p95_seconds", "tokens", "tokens_per_ok")


def paired(a: DataFrame, b: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Inner join of the last row of each key on both sides, with differences of the values."""
    last = lambda df, tag: df.groupBy(key).agg(*(F.max_by(v, order).alias(f"{v}_{tag}") for v in values))
    both = last(a, "a").join(last(b, "b"), key)
    return both.select(key, *(c for v in values for c in (f"{v}_a", f"{v}_b")), *((F.col(f"{v}_b") - F.col(f"{v}_a")).alias(f"{v}_diff") for v in values))


def lowest_criterion(names: list[str]) -> Column:
    """Name of the smallest of several columns (ties: the first in order); nulls are left out."""
    per = F.array(*(F.when(F.col(n).isNotNull(), F.struct(F.col(n).cast("double").alias("p"), F.lit(i).alias("i"), F.lit(n).alias("name"))) for i, n in enumerate(names)))
    return F.array_min(F.array_compact(per))["name"]


def decision(p: Column, pass_at: float | None, review_at: float | None = None) -> Column:
    """OBSERVE without a threshold, else PASS, REVIEW or FAIL."""
    if pass_at is None:
        return F.lit("OBSERVE")
    out = F.when(p >= pass_at, "PASS")
    return (out if review_at is None else out.when(p >= review_at, "REVIEW")).otherwise("FAIL")


def duplicate_rate(df: DataFrame, key: Column) -> DataFrame:
    """One row: total, repeats beyond the first of each key, rate."""
    g = df.groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("total"), F.sum(F.col("n") - 1).alias("repeats"), F.round(F.sum(F.col("n") - 1) / F.sum("n"), 6).alias("rate"))


def distribution(flags: DataFrame, code: str, item: str, n_items: int | None = None) -> DataFrame:
    """Per code: occurrences, distinct items, and their rate among n_items if given."""
    out = flags.groupBy(code).agg(F.count("*").alias("occurrences"), F.countDistinct(item).alias("items"))
    return out if n_items is None else out.withColumn("rate", F.round(F.col("items") / n_items, 6))


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    v = F.col(value).cast("double")
    x = df.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.min(v), 6).alias("min"), F.round(F.max(v), 6).alias("max"), F.round(F.stddev_samp(v), 6).alias("stdev"))
    return with_quantiles(x, df, by, value, {"median": 0.5}).select(*by, "n", "mean", "median", "min", "max", "stdev")


def numbered(df: DataFrame, group: str, order: str) -> DataFrame:
    """repetition: running number in its group; case_id: group and number, of three digits at least (lpad alone would cut longer ones).

    Numbers come by range of group and order, so a group with most of the rows is many tasks' work.
    """
    n = F.col("repetition").cast("string")
    return scans.numbered(df, group, order).withColumn("case_id", F.concat_ws("-", group, F.lpad(n, F.greatest(F.lit(3), F.length(n)), F.lit("0"))))


def audit_sample(df: DataFrame, group: str, order: str, share: int) -> DataFrame:
    """audited: all at 100, every other one at 50, else none."""
    i = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return df.withColumn("audited", F.lit(True) if share == 100 else (F.pmod(i, F.lit(2)) == 0) if share == 50 else F.lit(False))


# ---------------------------------------------------------------- jury


def judge_weights(judges: DataFrame, llm: int = 70, human: int = 30) -> DataFrame:
    """judges (judge_id, type, enabled) with a weight: the group's share, split among its active judges."""
    active = judges.where(F.coalesce("enabled", F.lit(True)))
    n = F.count("*").over(Window.partitionBy("type"))
    return active.withColumn("weight", F.when(F.col("type") == "LLM", F.lit(llm)).otherwise(F.lit(human)) / 100 / n)


def votes(findings: DataFrame, weights: DataFrame, selection: DataFrame) -> DataFrame:
    """Per subject and flag: weighted score, detected, disputed, judges for and against.

    findings: subject, judge_id, flag, detected. selection: flag, threshold, blocking, action. Weights and selection are
    tables of a few rows; Spark broadcasts them below its threshold.
    """
    x = findings.join(weights.select("judge_id", "weight"), "judge_id", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("judge_id")))), ",")
    g = x.groupBy("subject", "flag").agg(F.round(F.sum(F.when(F.col("detected"), F.col("weight")).otherwise(0.0)), 6).alias("score"), names(F.col("detected")).alias("supporting"), names(~F.col("detected")).alias("opposing"))
    g = g.join(selection, "flag").withColumn("detected", F.col("score") + 1e-12 >= F.col("threshold"))
    return g.withColumn("disputed", (F.col("score") > 0) & ~F.col("detected"))


def verdicts(findings: DataFrame, reports: DataFrame, judges: DataFrame, selection: DataFrame, require_complete: bool = True, llm: int = 70, human: int = 30) -> DataFrame:
    """Per subject: status and final action. Errors and missing LLM reports come first, then missing human ones, then incomplete reports, then the vote."""
    weights = judge_weights(judges, llm, human)
    active = weights.select("judge_id", "type")
    subjects = reports.select("subject").distinct()
    n_llm = active.where("type = 'LLM'").count()
    n_human = active.where("type <> 'LLM'").count()
    n_flags = selection.count()  # tables of a few rows
    r = reports.join(active, "judge_id")
    per = r.groupBy("subject").agg(F.count_if(F.col("type") == "LLM").alias("have_llm"), F.count_if(F.col("type") != "LLM").alias("have_human"), F.count_if(F.col("status") == "error").alias("errors"))
    full = findings.join(selection.select("flag"), "flag", "left_semi").groupBy("subject", "judge_id").agg(F.countDistinct("flag").alias("n"), F.count("*").alias("m"))
    short = reports.where("status = 'completed'").join(full, ["subject", "judge_id"], "left").groupBy("subject").agg(F.count_if((F.coalesce("n", F.lit(0)) != n_flags) | (F.coalesce("m", F.lit(0)) != n_flags)).alias("incomplete"))
    v = votes(findings, weights, selection)
    blocking = F.col("blocking") | (F.col("action") == "BLOQUEADA")
    vote = v.groupBy("subject").agg(F.count_if(F.col("detected") & blocking).alias("blocked"), F.count_if(F.col("detected")).alias("found"), F.count_if(F.col("disputed") & blocking).alias("critical"))
    x = subjects.join(per, "subject", "left").join(short, "subject", "left").join(vote, "subject", "left").na.fill(0)
    process = (F.col("errors") > 0) | (F.col("have_llm") < n_llm)
    waiting = (F.col("have_human") < n_human) & F.lit(require_complete)
    status = F.when(process, "PROCESS_ERROR").when(waiting, "WAITING_HUMAN").when(F.col("incomplete") > 0, "PROCESS_ERROR").otherwise("COMPLETED")
    action = F.when(process, "FALHA_DE_PROCESSO").when(waiting, "AGUARDANDO_JUIZ_HUMANO").when(F.col("incomplete") > 0, "FALHA_DE_PROCESSO").when(F.col("blocked") > 0, "BLOQUEADA").when((F.col("found") > 0) | (F.col("critical") > 0), "REGENERAR").otherwise("APROVADA")
    return x.select("subject", status.alias("status"), action.alias("final_action"))


def agreement(findings: DataFrame, a: str, b: str) -> DataFrame:
    """One row: subjects that both judges saw, agreements, rate."""
    side = lambda j, n: findings.where(F.col("judge_id") == j).select("subject", "flag", F.col("detected").alias(n))
    both = side(a, "x").join(side(b, "y"), ["subject", "flag"])
    return both.agg(F.count("*").alias("pairs"), F.count_if(F.col("x") == F.col("y")).alias("agreements"), F.round(F.avg((F.col("x") == F.col("y")).cast("double")), 6).alias("rate"))


def disagreements(findings: DataFrame, a: str, b: str) -> DataFrame:
    """(subject, flag, first_detected, second_detected) of what two judges see differently."""
    side = lambda j, n: findings.where(F.col("judge_id") == j).select("subject", "flag", F.col("detected").alias(n))
    return side(a, "first_detected").join(side(b, "second_detected"), ["subject", "flag"]).where("first_detected <> second_detected")
