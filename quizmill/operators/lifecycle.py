"""The event store: state machine, histories, audits, latest artifacts and versions, quality trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Allowed transitions.
EDGES = [
    ("REQUESTED", "REFERENCE_RETRIEVED"), ("REQUESTED", "GENERATION_FAILED"),
    ("REFERENCE_RETRIEVED", "STEM_GENERATED"), ("REFERENCE_RETRIEVED", "BLOCKED_BY_RED_FLAGS"), ("REFERENCE_RETRIEVED", "GENERATION_FAILED"),
    ("STEM_GENERATED", "DISTRACTORS_GENERATED"), ("STEM_GENERATED", "BLOCKED_BY_RED_FLAGS"), ("STEM_GENERATED", "GENERATION_FAILED"),
    ("DISTRACTORS_GENERATED", "ITEM_ASSEMBLED"), ("DISTRACTORS_GENERATED", "BLOCKED_BY_RED_FLAGS"), ("DISTRACTORS_GENERATED", "GENERATION_FAILED"),
    ("ITEM_ASSEMBLED", "BLOCKED_BY_RED_FLAGS"), ("ITEM_ASSEMBLED", "GENERATION_COMPLETED"), ("ITEM_ASSEMBLED", "GENERATION_FAILED"),
    ("BLOCKED_BY_RED_FLAGS", "BLOCKED_BY_RED_FLAGS"), ("BLOCKED_BY_RED_FLAGS", "REFERENCE_RETRIEVED"), ("BLOCKED_BY_RED_FLAGS", "STEM_GENERATED"),
    ("BLOCKED_BY_RED_FLAGS", "DISTRACTORS_GENERATED"), ("BLOCKED_BY_RED_FLAGS", "ATTEMPTS_EXHAUSTED"), ("BLOCKED_BY_RED_FLAGS", "GENERATION_FAILED"),
]
STATES = ["REQUESTED", "REFERENCE_RETRIEVED", "STEM_GENERATED", "DISTRACTORS_GENERATED", "ITEM_ASSEMBLED", "BLOCKED_BY_RED_FLAGS", "GENERATION_COMPLETED", "ATTEMPTS_EXHAUSTED", "GENERATION_FAILED"]
TERMINAL = [s for s in STATES if s not in {a for a, _ in EDGES}]


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "from_state string, to_state string")


def allowed(a: Column, b: Column) -> Column:
    """Whether a transition is in the graph: twenty constants, no join."""
    return F.concat_ws(">", a, b).isin(*(f"{x}>{y}" for x, y in EDGES))


def transitions(log: DataFrame) -> DataFrame:
    """log (rid, seq, state) with the state before; a history begins with null."""
    w = Window.partitionBy("rid").orderBy("seq")
    return log.withColumn("from_state", F.lag("state").over(w)).withColumnRenamed("state", "to_state")


def transition_counts(log: DataFrame) -> DataFrame:
    t = transitions(log).where("from_state is not null")
    return t.groupBy("from_state", "to_state").agg(F.count("*").alias("n"), F.first(allowed(F.col("from_state"), F.col("to_state"))).alias("allowed"))


def invalid_transitions(log: DataFrame) -> DataFrame:
    return transitions(log).where("from_state is not null").where(~allowed(F.col("from_state"), F.col("to_state")))


def audit(log: DataFrame, needed: list[str] | None = None) -> DataFrame:
    """A row for each request: number of events, first and last state, invalid transitions, issues (array), conforming."""
    t = transitions(log)
    bad = F.col("from_state").isNotNull() & ~allowed(F.col("from_state"), F.col("to_state"))
    after_end = F.col("from_state").isin(*TERMINAL)
    x = t.groupBy("rid").agg(F.count("*").alias("n_events"), F.min_by("to_state", "seq").alias("first_state"), F.max_by("to_state", "seq").alias("last_state"), F.count_if(bad).alias("n_invalid"), F.count_if(after_end).alias("n_after_end"), F.collect_set("to_state").alias("seen"))
    lacks = [F.when((F.col("last_state") == "GENERATION_COMPLETED") & ~F.array_contains("seen", s), F.lit(f"missing:{s}")) for s in (needed or [])]
    issues = F.array_compact(F.array(F.when(F.col("first_state") != "REQUESTED", F.lit("first_event_not_requested")), F.when(F.col("n_invalid") > 0, F.lit("invalid_transition")), F.when(F.col("n_after_end") > 0, F.lit("event_after_terminal_state")), F.when(~F.col("last_state").isin(*TERMINAL), F.lit("not_terminal")), *lacks))
    return x.withColumn("issues", F.array_join(issues, ";")).withColumn("conforming", F.col("issues") == "").drop("seen")


def reachable(graph: DataFrame, start: str) -> DataFrame:
    """States reachable from one, itself included; the frontier is joined until it is empty (a graph of a few states)."""
    spark = graph.sparkSession
    seen = spark.createDataFrame([(start,)], "state string")
    size = 1
    while True:
        seen = seen.unionByName(graph.join(seen, graph["from_state"] == seen["state"], "left_semi").select(F.col("to_state").alias("state"))).distinct()
        seen = spark.createDataFrame(seen.collect(), "state string")  # nine states at most
        now = seen.count()
        if now == size:
            return seen
        size = now


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each group."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def prefer_success(df: DataFrame, keys: list[str], order: str, ok: Column) -> DataFrame:
    """The first row of each group, unless it failed and a later one did not."""
    w = Window.partitionBy(*keys).orderBy(F.desc(ok.cast("int")), order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def last_success(df: DataFrame, keys: list[str], order: str, ok: Column) -> DataFrame:
    return latest(df.where(ok), keys, order)


def next_version(df: DataFrame, key: str, version: str) -> DataFrame:
    return df.groupBy(key).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new put in, replacing those with their key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def quality_trace(artifacts: DataFrame) -> DataFrame:
    """Per request: counts by artifact kind and the span of timestamps. artifacts: request_id, kind, created_at (timestamp), payload (JSON)."""
    of = lambda *k: F.count_if(F.col("kind").isin(*k))
    batch = F.coalesce(F.expr("json_array_length(get_json_object(payload, '$.candidatos'))"), F.lit(0))
    t = F.unix_micros("created_at")
    return artifacts.groupBy("request_id").agg(
        F.sum(F.when(F.col("kind") == "DISTRACTOR_BATCH", batch).otherwise(0)).alias("candidates_generated"),
        of("DISTRACTOR_BATCH").alias("batches"), of("DISTRACTOR_CANDIDATE_REJECTED").alias("structural_rejections"),
        of("DISTRACTOR_CANDIDATE_REJECTED_QUALITY", "DISTRACTOR_CANDIDATE_REJECTED_SEMANTIC").alias("quality_rejections"),
        of("DISTRACTOR_RESERVE_PROMOTED").alias("promotions"), of("QUALITY_SUMMARY").alias("summaries"),
        F.round((F.max(t) - F.min(t)) / 1e6, 2).alias("duration_seconds"),
    )


def history(requests: DataFrame, **children: DataFrame) -> DataFrame:
    """One row a request with an array of structs for each child table, in order of its id. Each child is grouped before it is joined."""
    out = requests
    for name, df in children.items():
        rows = df.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in df.columns if c not in ("id", "request_id")]))).alias(name))
        out = out.join(rows.withColumnRenamed("request_id", f"_{name}"), out["id"] == F.col(f"_{name}"), "left").drop(f"_{name}")
    return out
