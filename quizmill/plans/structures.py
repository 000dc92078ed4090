"""Queries on exam text, stores, registries, histories and tables as functions, registered beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.functions import text as T
from quizmill.operators import campaign, dataset, exams, generators, registry, tables
from quizmill.plans.catalogue import query
from quizmill.plans.views import ITEMS, items, sql_fold, table
from quizmill.sources import files, store
from quizmill.sources.staging import scratch

# ---------------------------------------------------------------- exam text


def exam_texts(spark: SparkSession, d: str) -> DataFrame:
    """(exam, text, answers): each document as an exam of blocks of seven of its sentences, two of the stem and five options, with its own line breaks.

    What a sentence is like tells the answer, and whether it is annulled, missing, or the last option has no mark.
    """
    x = table(spark, d, "documents").where("doc_id is not null").select(F.col("doc_id").alias("exam"), F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+").alias("s")).where("size(s) >= 7")
    at = "element_at(s, cast(7 * k + {} as int))"
    number = "(9 + k % 91)"
    options = ", ".join(f"'\\n{c}) ', {at.format(3 + i)}" if c != "E" else f"if(length({at.format(7)}) % 6 = 0, '\\n', '\\nE) '), {at.format(7)}" for i, c in enumerate("ABCDE"))
    blocks = f"transform(sequence(0, cast(size(s) div 7 - 1 as int)), k -> concat('\\nQUESTÃO ', {number}, '\\n', {at.format(1)}, '\\n', {at.format(2)}, {options}))"
    size = f"length({at.format(1)})"
    letters = f"transform(sequence(0, cast(size(s) div 7 - 1 as int)), k -> case when {size} % 11 = 0 then concat({number}, ' ANULADA') when {size} % 7 = 0 then '' else concat({number}, ' ', substring('ABCDE', cast({size} % 5 + 1 as int), 1)) end)"
    return x.select("exam", F.expr(f"array_join({blocks}, '')").alias("text"), F.expr(f"array_join({letters}, '  ')").alias("answers"))


@query()
def exam_items(spark: SparkSession, d: str) -> DataFrame:
    """The questions of all exams with hard and soft reasons; tests hold it against plain Python."""
    raw = exam_texts(spark, d)
    keys = exams.answer_keys(raw, "exam", "answers")
    return exams.extracted(exams.exam_blocks(raw, "exam", "text"), keys, "exam")


# ---------------------------------------------------------------- stores


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def stored_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders put in a store by key, dear ones put in anew with another status; read back."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = scratch(spark, "orders_store")
    store.create(o, path, "o_orderkey")
    store.upsert(o.where("o_totalprice > 200000").withColumn("o_orderstatus", F.lit("X")), path)
    return store.read(spark, path)


def _weighed(reports: DataFrame) -> DataFrame:
    """(subject, score, verdict) of reports (subject, quality, toxic)."""
    score = F.round(F.when(F.col("quality") == 0, 0.7).otherwise(0.0) + F.when(F.col("toxic") == 1, 0.3).otherwise(0.0), 6)
    return reports.select("subject", score.alias("score"), campaign.decision(1 - score, 0.9, 0.5).alias("verdict"))


@query("""WITH r AS (SELECT doc_id AS subject, quality, CASE WHEN quality = 0 THEN 0 ELSE toxic END AS toxic FROM labels),
s AS (SELECT subject, round(CASE WHEN quality = 0 THEN 0.7 ELSE 0.0 END + CASE WHEN toxic = 1 THEN 0.3 ELSE 0.0 END, 6) AS score FROM r)
SELECT subject, CAST(score AS DOUBLE) AS score, CASE WHEN 1 - score >= 0.9 THEN 'PASS' WHEN 1 - score >= 0.5 THEN 'REVIEW' ELSE 'FAIL' END AS verdict FROM s""")
def replaced_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Reports in a store, those of poor quality replaced by ones that find nothing toxic; verdicts of the subjects concerned are worked out anew and put in theirs."""
    reports = table(spark, d, "labels").select(F.col("doc_id").alias("subject"), "quality", "toxic")
    given, made = scratch(spark, "reports_store"), scratch(spark, "verdicts_store")
    store.create(reports, given, "subject")
    store.create(_weighed(store.read(spark, given)), made, "subject")
    again = reports.where("quality = 0").withColumn("toxic", F.lit(0).cast(reports.schema["toxic"].dataType))
    store.upsert(again, given)
    store.upsert(_weighed(store.read(spark, given).join(again.select("subject"), "subject", "left_semi")), made)
    return store.read(spark, made)


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type")
def appended_once(spark: SparkSession, d: str) -> DataFrame:
    """The events appended as a stream, then all again as after a lost checkpoint: one copy stays."""
    path = scratch(spark, "appended")
    schema = table(spark, d, "events").schema
    for k in range(2):
        stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
        store.append_once(spark, stream, path, scratch(spark, f"checkpoint{k}")).awaitTermination()
    return store.appended(spark, path, schema).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


# ---------------------------------------------------------------- registries, profiles, histories


@query("""SELECT u.event_id, u.user_id, nullif(count(c.event_id), 0) AS version FROM (SELECT * FROM events WHERE event_type = 'purchase') u
LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') c ON c.user_id = u.user_id AND c.ts <= u.ts GROUP BY ALL""")
def version_at_use(spark: SparkSession, d: str) -> DataFrame:
    """Which version of a user's registry held at each purchase; each error of the user makes the next version."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    versions = registry.intervals(e.where("event_type = 'error'").drop("event_type"), "user_id", "ts", "event_id")
    return registry.version_at(e.where("event_type = 'purchase'").drop("event_type"), versions, "user_id", "ts").select("event_id", "user_id", "version")


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query(f"""WITH r AS (SELECT user_id, {_K} % 3 AS m, {_K} % 2 AS t, event_id FROM events WHERE event_type <> 'view'), w AS (SELECT DISTINCT user_id, {_K} % 3 AS m, {_K} % 2 AS t FROM events WHERE event_type = 'view')
SELECT user_id, m, t, max(event_id) AS report FROM w JOIN r USING (user_id, m, t) GROUP BY ALL""")
def reused_reports(spark: SparkSession, d: str) -> DataFrame:
    """The newest report made under an equal profile, for each profile that views ask for with its keys in another order and spaces elsewhere."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", (k % 3).alias("m"), (k % 2).alias("t"))
    given = F.format_string('{"judge": {"model": "m%d", "temperature": %d.50}, "flags": ["a", "b"]}', "m", "t")
    asked = F.format_string('{"flags":["a","b"],"judge":{"temperature":%d.5,"model":"m%d"}}', "t", "m")
    reports = e.where("event_type <> 'view'").select("user_id", given.alias("profile"), "event_id", "ts")
    wanted = e.where("event_type = 'view'").select("user_id", asked.alias("profile"), "m", "t").distinct()
    found = registry.reusable(reports, wanted.drop("m", "t"), "user_id", "profile", "ts", "event_id")
    return found.join(wanted, ["user_id", "profile"]).select("user_id", "m", "t", F.col("event_id").alias("report"))


@query("""WITH e AS (SELECT user_id AS k, string_agg(event_type, ',' ORDER BY event_id) AS events FROM events GROUP BY 1), l AS (SELECT doc_id AS k, string_agg(quality || '/' || toxic, ',' ORDER BY doc_id) AS labels FROM labels GROUP BY 1),
c AS (SELECT conv_id AS k, string_agg(turn || ':' || role, ',' ORDER BY turn) AS turns FROM conversations GROUP BY 1)
SELECT c_custkey AS request_id, c_mktsegment, coalesce(events, '') AS events, coalesce(labels, '') AS labels, coalesce(turns, '') AS turns FROM customer LEFT JOIN e ON e.k = c_custkey LEFT JOIN l ON l.k = c_custkey LEFT JOIN c ON c.k = c_custkey""")
def request_history(spark: SparkSession, d: str) -> DataFrame:
    """Customers as requests, with their events, labels and turns in order."""
    requests = table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), "c_mktsegment")
    children = {
        "events": table(spark, d, "events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("id"), "event_type"),
        "labels": table(spark, d, "labels").select(F.col("doc_id").alias("request_id"), F.col("doc_id").alias("id"), "quality", "toxic"),
        "turns": table(spark, d, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("id"), "role"),
    }
    said = {"events": lambda x: x["event_type"], "labels": lambda x: F.concat_ws("/", x["quality"], x["toxic"]), "turns": lambda x: F.concat_ws(":", x["id"], x["role"])}
    x = registry.histories(requests, children)
    return x.select("request_id", "c_mktsegment", *(F.array_join(F.transform(n, f), ",").alias(n) for n, f in said.items()))


# ---------------------------------------------------------------- table functions

_NUMERALS = ", ".join(f"'{n}'" for n in generators.NUMERALS)
_SETS = [[n for i, n in enumerate(generators.NUMERALS) if k >> i & 1] for k in range(1, 32)]
_SAID = ", ".join(f"'{text}'" for text, _ in generators.ASSERTIONS)


@query(f"""WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n, CAST(o_orderpriority[1] AS INTEGER) AS v FROM orders),
x AS (SELECT o_orderkey, v, n // 32 % 31 + 1 AS p, list_filter([{_NUMERALS}], lambda m, i: n >> (i - 1) & 1 = 1) AS r FROM o),
s AS (SELECT o_orderkey, m, len(list_filter(m, lambda y: NOT list_contains(r, y))) + len(list_filter(r, lambda y: NOT list_contains(m, y))) AS dist, abs(len(m) - len(r)) AS gap FROM x, (SELECT unnest({_SETS}) AS m) WHERE len(r) > 0),
made AS (SELECT o_orderkey, 'prefix' AS kind, CASE WHEN p <= 30 THEN list_transform(list_filter(list_transform([-1, 1, -2, 2, -3, 3, -4, 4, -5, 5], lambda y: p + y), lambda y: y BETWEEN 1 AND 30)[1:4], lambda y: '/' || y) ELSE [] END AS options FROM x
  UNION ALL SELECT o_orderkey, 'set', list(array_to_string(m, ',') ORDER BY dist, gap, m)[1:4] FROM s WHERE dist > 0 GROUP BY 1
  UNION ALL SELECT o_orderkey, 'count', list_transform(list_sort(list_transform(list_filter([1, 2, 3, 4, 5], lambda y: y <> v), lambda y: [abs(y - v), y])), lambda y: CAST(y[2] AS VARCHAR)) FROM x
  UNION ALL SELECT o_orderkey, 'assertion', list_filter([{_SAID}], lambda y: y <> [{_SAID}][v])[1:4] FROM x)
SELECT o_orderkey, kind, CAST(i AS INTEGER) AS place, options[i] AS option FROM made, range(1, 5) t(i) WHERE i <= len(options)""")
def option_functions(spark: SparkSession, d: str) -> DataFrame:
    """Options made beside each order by table functions in SQL text: what they start from lies in its price and priority."""
    tables.register(spark)
    sides = [("prefix", "neighbour_prefixes(p, false)"), ("set", "neighbour_sets(r)"), ("count", "neighbour_counts(v)"), ("assertion", "other_assertions(a)")]
    made = " UNION ALL ".join(f"SELECT o_orderkey, '{kind}' AS kind, f.place, f.option FROM x, LATERAL {call} AS f" for kind, call in sides)
    return spark.sql(
        f"""WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n, CAST(left(o_orderpriority, 1) AS INT) AS v FROM {{orders}}),
        x AS (SELECT o_orderkey, v, CAST(n div 32 % 31 + 1 AS INT) AS p, filter(array({_NUMERALS}), (m, i) -> shiftright(n, i) & 1 = 1) AS r, element_at(array({_SAID}), v) AS a FROM o) {made}""",
        orders=table(spark, d, "orders"),
    )


_PLAIN = lambda x: f"regexp_extract_all({sql_fold(x)}, '[a-z0-9]+')"


@query(f"""WITH {ITEMS}, c AS (SELECT item_id, i - 1 AS i, {_PLAIN('distratores[i]')} AS t, greatest(len({_PLAIN('resposta_correta')}), 1) AS want FROM items, range(1, 5) r(i) WHERE i <= len(distratores)),
p AS (SELECT item_id, i, row_number() OVER (PARTITION BY item_id ORDER BY abs(greatest(len(t), 1) - want) / want, -len(list_distinct(t)) / greatest(len(t), 1), i) AS place FROM c)
SELECT item_id, i, place FROM p WHERE place <= 3""")
def pool_function(spark: SparkSession, d: str) -> DataFrame:
    """The pool of each item by a table function over a partitioned table, which holds three candidates at a time."""
    tables.register(spark)
    x = items(spark, d).select(F.col("item_id").alias("key"), F.size(T.plain_tokens(F.col("resposta_correta"))).alias("wanted"), F.posexplode("distratores").alias("index", "t"))
    x = x.withColumn("t", T.plain_tokens(F.col("t"))).select("key", "index", "wanted", F.size("t").alias("n_words"), F.size(F.array_distinct("t")).alias("n_different"))
    return spark.sql("SELECT key AS item_id, CAST(index AS BIGINT) AS i, CAST(place AS BIGINT) AS place FROM best_candidates(TABLE(SELECT * FROM {x}) PARTITION BY (key), 3)", x=x)


# ---------------------------------------------------------------- files written and read back

_EVENT = "event_id long, user_id long, event_type string, value double, props string"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props")


@query("SELECT event_id, user_id, event_type, value, props FROM events")
def events_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """The events as JSON lines, read in splits; a line that is no record would end the query with its number."""
    path = scratch(spark, "events_jsonl")
    files.append_jsonl(_events(spark, d), path)
    return files.read_jsonl(spark, path, _EVENT).drop("file", "line")


@query("""SELECT CASE WHEN event_type <> 'error' THEN event_type END AS event_type, coalesce(event_type = 'error', false) AS json_invalid, count(*) AS n, round(sum(CASE WHEN event_type = 'error' THEN NULL ELSE value END), 4) AS value FROM events GROUP BY 1, 2""")
def events_jsonl_tolerant(spark: SparkSession, d: str) -> DataFrame:
    """The same with the lines of errors cut in half, which are kept and marked."""
    path = scratch(spark, "events_jsonl")
    line = F.to_json(F.struct("*"))
    _events(spark, d).select(F.when(F.col("event_type") == "error", F.left(line, (F.length(line) / 2).cast("int"))).otherwise(line).alias("value")).write.text(path)
    x = files.read_jsonl(spark, path, _EVENT, strict=False)
    return x.groupBy(F.when(~F.col("json_invalid"), F.col("event_type")).alias("event_type"), "json_invalid").agg(F.count("*").alias("n"), F.round(F.sum(F.when(~F.col("json_invalid"), F.col("value"))), 4).alias("value"))


@query("SELECT event_id, props, user_id, value FROM events")
def events_csv(spark: SparkSession, d: str) -> DataFrame:
    """The events as CSV with a fixed header, fields with quotes and commas among them, read back."""
    path = scratch(spark, "events_csv")
    files.write_csv(_events(spark, d), path, ["event_id", "props", "user_id", "value"])
    x = files.read_csv(spark, path)
    return x.select(F.col("event_id").cast("long").alias("event_id"), "props", F.col("user_id").cast("long").alias("user_id"), F.col("value").cast("double").alias("value"))


_MARK = dataset.OPTION_MARK.replace("^", "", 1)


@query(rf"""WITH {ITEMS}, x AS (SELECT *, list_transform(alternativas, lambda v: trim(regexp_replace(v, '^{_MARK}', ''))) AS o FROM items)
SELECT item_id, CASE WHEN competencia = 'en' THEN '{dataset.IS_MATHS}' WHEN habilidade = '' THEN '{dataset.VOID}' WHEN length(enunciado) % 7 = 0 THEN '{dataset.UNREADABLE}' WHEN len(list_filter(alternativas, lambda v: v IS NOT NULL AND v <> '')) <> 5 THEN '{dataset.NOT_FIVE}' END AS reason,
  CASE WHEN length(enunciado) % 7 > 0 THEN array_to_string(list_filter(o, lambda v, i: alternativas[i] <> ''), '|') END AS options, CASE WHEN habilidade <> '' THEN correta END AS correct FROM x""")
def csv_questions(spark: SparkSession, d: str) -> DataFrame:
    """The items as rows of an exam table, options as a list in text, through CSV and the chain of reasons.

    A list loses its end where the stem's length says so, empty options are left out, and items without a skill have no key.
    """
    quoted = lambda v: F.concat(F.lit("'"), F.regexp_replace(v, r"([\\'])", r"\\$1"), F.lit("'"))
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.filter("alternativas", lambda v: v != ""), quoted), ", "), F.when(F.length("enunciado") % 7 > 0, "]").otherwise(""))
    x = items(spark, d).select("item_id", listed.alias("options"), F.when(F.col("habilidade") != "", F.substring(F.lit("ABCDE"), F.col("correta") + 1, F.lit(1))).otherwise("*").alias("key"), F.when(F.col("competencia") == "en", dataset.MATHS).otherwise(F.col("competencia")).alias("knowledge_area"))
    path = scratch(spark, "exam_csv")
    files.write_csv(x, path)
    q = dataset.csv_question(F.col("options"), F.col("key"), F.col("knowledge_area"))
    y = files.read_csv(spark, path).select(F.col("item_id").cast("long").alias("item_id"), q.alias("q"))
    return y.select("item_id", "q.reason", F.array_join("q.options", "|").alias("options"), "q.correct")
