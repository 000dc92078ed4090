"""Queries on evaluation, prompts and sets, registered beside those of the catalogue."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.functions.rounding import half_even
from quizmill.operators import campaign, evaluation, generators
from quizmill.plans import ablation
from quizmill.plans.catalogue import _JURY, _jury, long, query
from quizmill.plans.views import ITEMS, REQLOG, items, request_log, sql_words_folded, table

_OUTPUTS = "(SELECT event_type AS model, value > 10 AS valid, value > 20 AS four_distinct, event_id % 5 = 0 AS copies_key, CASE WHEN event_id % 3 > 0 THEN value / 50 END AS length_ratio, CASE WHEN event_id % 4 > 0 THEN event_id % 7 / 7.0 END AS overlap FROM events)"
_RATES = f"""SELECT model, count(*) AS items, round(avg(CAST(valid AS INTEGER)), 3) AS valid_rate, round(avg(CAST(four_distinct AS INTEGER)), 3) AS four_distinct_rate, round(avg(CAST(copies_key AS INTEGER)), 3) AS copy_rate,
  round(quantile_cont(length_ratio, 0.5), 3) AS median_length_ratio, round(avg(CAST(length_ratio > 1.5 AS INTEGER)), 3) AS long_rate, CAST(round(avg(overlap), 3) AS DOUBLE) AS mean_overlap FROM {_OUTPUTS} GROUP BY model"""


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select(F.col("event_type").alias("model"), (F.col("value") > 10).alias("valid"), (F.col("value") > 20).alias("four_distinct"), (i % 5 == 0).alias("copies_key"), F.when(i % 3 > 0, F.col("value") / 50).alias("length_ratio"), F.when(i % 4 > 0, i % 7 / 7.0).alias("overlap"))


@query(_RATES)
def validation_rates(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.validation_rates(_outputs(spark, d), ["model"])


@query(f"""WITH r AS ({_RATES}), s AS (SELECT model, round(valid_rate * four_distinct_rate, 2) AS usable, -copy_rate AS a, -coalesce(nullif(long_rate, 0), 1) AS b, coalesce(mean_overlap, 0) AS c FROM r)
SELECT model, usable FROM s ORDER BY usable DESC, a DESC, b DESC, c DESC, model LIMIT 1""")
def best_model(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.best_model(evaluation.validation_rates(_outputs(spark, d), ["model"]), "model")


@query(rf"""WITH {ITEMS}, c AS (SELECT competencia, len(alternativas) = 5 AS five, len(list_distinct(list_transform(alternativas, lambda x: lower(trim(x, ' '))))) = len(alternativas) AS unlike,
  correta >= 0 AND correta < len(alternativas) AS in_range, trim(enunciado, ' ') <> '' AND trim(explicacao, ' ') <> '' AS said FROM items)
SELECT competencia, count(*) AS n, CAST(count(*) FILTER (five) AS BIGINT) AS n_five, CAST(count(*) FILTER (unlike) AS BIGINT) AS n_unlike, CAST(count(*) FILTER (in_range) AS BIGINT) AS n_in_range, CAST(count(*) FILTER (five AND unlike AND in_range AND said) AS BIGINT) AS n_passes FROM c GROUP BY competencia""")
def component_passes(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.pass_counts(evaluation.structure_checks(items(spark, d)), "competencia", ["five", "unlike", "in_range", "passes"])


@query("""SELECT 'lang' AS dimension, coalesce(lang, 'n/d') AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, 'n/d'), count(*) FROM documents GROUP BY 2""")
def stratified_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.strata(table(spark, d, "documents"), ["lang", "source"])


@query("SELECT area, n, row_number() OVER (ORDER BY n DESC, area) AS place FROM (SELECT coalesce(source, 'n/d') AS area, count(*) AS n FROM documents GROUP BY 1)")
def corpus_coverage(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.coverage(table(spark, d, "documents"), "source").withColumn("place", long("place"))


_SOUGHT = ["the", "de la", "tion", "copyright"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS term, CAST(sum((length(x) - length(replace(x, '{t}', ''))) // {len(t)}) AS BIGINT) AS n FROM (SELECT lower(coalesce(text, '')) AS x FROM documents)" for t in _SOUGHT))
def term_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.occurrences(table(spark, d, "documents"), "text", _SOUGHT)


@query(f"""WITH {REQLOG}, last AS (SELECT rid, arg_max(state, seq) AS state FROM reqlog GROUP BY rid)
SELECT rid FROM last WHERE state = 'GENERATION_COMPLETED' AND rid IN (SELECT rid FROM reqlog WHERE event_type = 'click') AND rid NOT IN (SELECT rid FROM reqlog WHERE event_type = 'error' AND value > 90)""")
def eligible_for_judge(spark: SparkSession, d: str) -> DataFrame:
    r = request_log(spark, d)
    return evaluation.eligible(r.groupBy("rid").agg(F.max_by("state", "seq").alias("state")), r.where("event_type = 'click'"), r.where("event_type = 'error' AND value > 90"), "rid").select("rid")


@query(f"""WITH {REQLOG} SELECT rid, CAST(sum(tokens) FILTER (event_type <> 'error') AS BIGINT) AS remote_in, CAST(sum(tokens + 1) FILTER (event_type <> 'error') AS BIGINT) AS remote_out, CAST(sum(2 * tokens + 1) FILTER (event_type <> 'error') AS BIGINT) AS remote_total,
  CAST(count(*) AS BIGINT) AS local_in, CAST(2 * count(*) AS BIGINT) AS local_out, CAST(0 AS BIGINT) AS local_total FROM reqlog GROUP BY rid""".replace("AS BIGINT) AS remote", "AS BIGINT), 0) AS remote").replace("CAST(sum(", "coalesce(CAST(sum("))
def token_sides(spark: SparkSession, d: str) -> DataFrame:
    r = request_log(spark, d)
    remote = F.when(F.col("event_type") != "error", F.struct(F.col("tokens").alias("prompt_tokens"), (F.col("tokens") + 1).alias("output_tokens"), (2 * F.col("tokens") + 1).alias("total_tokens")))
    made = F.to_json(F.struct(remote.alias("token_usage_remote"), F.struct(F.lit(1).alias("input_tokens"), F.lit(2).alias("completion_tokens")).alias("token_usage_local")))
    return evaluation.token_split(r.withColumn("provenance", made), ["rid"], "provenance")


@query("""WITH x AS (SELECT l_quantity / 50 AS a, l_discount * 10 AS b, l_tax * 12 AS c FROM lineitem), y AS (SELECT *, CASE WHEN a <= least(b, c) THEN 'quantity' WHEN b <= c THEN 'discount' ELSE 'tax' END AS low FROM x)
SELECT 'quantity' AS criterion, round(avg(a), 6) AS mean, CAST(count(*) FILTER (low = 'quantity') AS BIGINT) AS n_lowest FROM y UNION ALL SELECT 'discount', round(avg(b), 6), count(*) FILTER (low = 'discount') FROM y UNION ALL SELECT 'tax', round(avg(c), 6), count(*) FILTER (low = 'tax') FROM y""")
def criterion_summary(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("quantity"), (F.col("l_discount") * 10).alias("discount"), (F.col("l_tax") * 12).alias("tax"))
    names = ["quantity", "discount", "tax"]
    return evaluation.criteria(x, names, campaign.lowest_criterion(names))


@query(f"WITH {_JURY} SELECT subject, flag, q AS first_detected, t AS second_detected FROM findings WHERE q <> t")
def jury_disagreements(spark: SparkSession, d: str) -> DataFrame:
    return campaign.disagreements(_jury(spark, d)[0], "quality", "toxic")


@query(f"""WITH {REQLOG}, r AS (SELECT rid, arg_max(state, seq) AS state, count(*) FILTER (event_type = 'error') AS flags, count(*) FILTER (event_type = 'click') AS treated, CASE WHEN rid % 3 > 0 THEN sum(value) END AS seconds FROM reqlog GROUP BY rid)
SELECT count(*) AS total, CAST(count(*) FILTER (state = 'GENERATION_COMPLETED') AS BIGINT) AS completed, CAST(coalesce(sum(flags) FILTER (state = 'GENERATION_COMPLETED'), 0) AS BIGINT) AS final_flags, CAST(coalesce(sum(treated) FILTER (state = 'GENERATION_COMPLETED'), 0) AS BIGINT) AS treated, round(avg(seconds) FILTER (state = 'GENERATION_COMPLETED'), 1) AS mean_seconds FROM r""")
def session_dashboard(spark: SparkSession, d: str) -> DataFrame:
    r = request_log(spark, d).groupBy("rid").agg(F.max_by("state", "seq").alias("state"), F.count_if(F.col("event_type") == "error").alias("final_flags"), F.count_if(F.col("event_type") == "click").alias("treated"), F.sum("value").alias("s"))
    return evaluation.dashboard(r.withColumn("seconds", F.when(F.col("rid") % 3 > 0, F.col("s"))))


@query("SELECT doc_id AS subject, quality = toxic AS same, toxic <= quality AS part FROM labels")
def set_relations(spark: SparkSession, d: str) -> DataFrame:
    s = lambda c: F.filter(F.array(F.lit("a"), F.lit("b")), lambda v: (v == "a") | (F.col(c) == 1))
    x = table(spark, d, "labels").select(F.col("doc_id").alias("subject"), s("quality").alias("x"), s("toxic").alias("y"))
    return x.select("subject", evaluation.same_set(F.col("x"), F.col("y")).alias("same"), evaluation.subset(F.col("y"), F.col("x")).alias("part"))


@query(r"WITH " + ITEMS + r" SELECT item_id, length('### Enunciado:') + 1 + length(trim(enunciado, ' ')) + 2 + length('### Resposta correta:') + 1 + length(trim(resposta_correta, ' ')) + 2 + length('### Saida:') + 1 AS size, trim(resposta_correta, ' ') AS answer FROM items")
def prompt_round_trip(spark: SparkSession, d: str) -> DataFrame:
    x = items(spark, d).select("item_id", generators.option_prompt(F.col("enunciado"), F.col("resposta_correta")).alias("p"))
    return x.select("item_id", F.length("p").cast("long").alias("size"), generators.prompt_answer(F.col("p")).alias("answer"))


@query("SELECT doc_id, list_transform(list_sort(list_transform(list_filter([1, 2, 3, 4, 5], lambda v: v <> doc_id % 5 + 1), lambda v: abs(v - (doc_id % 5 + 1)) * 10 + v)), lambda k: CAST(k % 10 AS INTEGER)) AS counts FROM documents")
def combination_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", generators.count_options((F.col("doc_id") % 5 + 1).cast("int")).alias("counts"))


_FAMILY = " UNION ALL ".join(f"SELECT {i} AS family, {j} AS at, '{x}' AS term, {[y for y in m if y != x]} AS options" for i, m in enumerate(generators.FAMILIES) for j, x in enumerate(m))
_ANSWERS = sorted({x for m in generators.FAMILIES for x in m})
_ANSWER = f"{_ANSWERS}[CAST(doc_id % {len(_ANSWERS)} + 1 AS INTEGER)]"


@query(f"WITH f AS ({_FAMILY}), last AS (SELECT term, arg_max(options, family) AS options FROM f GROUP BY term), d AS (SELECT doc_id, {_ANSWER} AS term FROM documents) SELECT doc_id, term, options FROM d JOIN last USING (term)")
def curated_families(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, _ANSWERS))
    pick = F.element_at(names, (F.col("doc_id") % len(_ANSWERS) + 1).cast("int"))
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat(F.upper(pick), F.lit(" pois sim"))).otherwise(pick)
    return generators.curated(table(spark, d, "documents").select("doc_id", answer.alias("a")), "doc_id", "a", generators.families(spark))


@query()
def rounded_half_even(spark: SparkSession, d: str) -> DataFrame:
    """Rounding of the binary value, halves to even; engines round the decimal text, so this has no SQL."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", half_even(F.col("l_extendedprice") * F.col("l_discount") / 8, F.lit(2)).alias("rounded"))


def _scripted(prompt: str) -> str:
    """A model that answers by the number of its specification: sound, alike options, four options, no JSON, an error."""
    spec = json.loads(prompt)["solicitacao"]
    kind = spec["spec_id"] % 5
    if kind == 4:
        raise RuntimeError("429 rate limit")
    if kind == 3:
        return "no question"
    options = ["a", "b", "c", "d", "A " if kind == 1 else "e"][: 4 if kind == 2 else 5]
    return json.dumps({"enunciado": spec["query"], "alternativas": options, "correta": 0, "explicacao": "x", "competencia": "x", "habilidade": "x", "objeto_conhecimento": spec["objeto"]})


@query("""SELECT 'C1_LLM' AS condition, item_id AS spec_id, CASE item_id % 5 WHEN 0 THEN 'COMPLETED' ELSE 'FAILED' END AS state, CASE item_id % 5 WHEN 1 THEN 'repetidas' WHEN 2 THEN 'alternativas' WHEN 3 THEN 'campo_ausente' WHEN 4 THEN 'erro_do_modelo' END AS reason FROM benchmark""")
def ablation_states(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    specs = table(spark, d, "benchmark").select(F.col("item_id").alias("spec_id"), F.col("text").alias("query"), F.lit("objeto").alias("objeto"), none.alias("curso"), none.alias("componente"), none.alias("exame"))
    return ablation.run("C1_LLM", specs, lambda: _scripted).select("condition", "spec_id", "state", "reason")


_MADE_BY = "CASE event_type WHEN 'view' THEN 'slm-memory-curated-v1' WHEN 'click' THEN 'deterministic-pool' WHEN 'purchase' THEN 'Qwen-LoRA' WHEN 'error' THEN 'qwen:base' WHEN 'signup' THEN 'other' END"
_STRATEGY = "CASE WHEN value > 95 THEN 'familia_conceitual_curada' END"


@query(f"""WITH {REQLOG}, a AS (SELECT rid, seq, {_MADE_BY} AS m, {_STRATEGY} AS st, seq = max(seq) OVER (PARTITION BY rid) AS last, rid % 2 = 0 AS done FROM reqlog),
s AS (SELECT *, CASE WHEN st = 'familia_conceitual_curada' OR contains(m, 'memory-curated') THEN 'memoria_curada' WHEN starts_with(m, 'deterministic') THEN 'regra_deterministica' WHEN contains(m, 'LoRA') THEN 'slm_ajustada' WHEN suffix(m, ':base') THEN 'slm_base' WHEN m <> '' THEN 'slm(' || m || ')' ELSE 'desconhecida' END AS source FROM a)
SELECT source, count(*) AS n_attempts, CAST(count(*) FILTER (last AND done) AS BIGINT) AS n_final FROM s GROUP BY source""")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    r = request_log(spark, d).withColumn("source", evaluation.source_of(F.expr(_MADE_BY), F.expr(_STRATEGY))).withColumn("done", F.col("rid") % 2 == 0)
    return evaluation.source_counts(r, "rid", "seq", "source", "done")


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'RF1' WHEN 'click' THEN 'RF2' ELSE 'alerta' END AS code, CASE event_type WHEN 'view' THEN 'NUCLEO' ELSE 'QUALIDADE' END AS stage, CASE event_type WHEN 'click' THEN 'campo' ELSE '' END AS field,
  CASE event_type WHEN 'view' THEN 'e' WHEN 'click' THEN '' WHEN 'error' THEN 'None' ELSE 'plain text' END AS evidence, '' AS repair_target FROM events""")
def harmonised_flags(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("""CASE event_type WHEN 'view' THEN '{"codigo": "RF1", "code": "x", "etapa": "NUCLEO", "evidence": "e"}' WHEN 'click' THEN '{"codigo": "", "code": "RF2", "campo": "campo"}' WHEN 'error' THEN NULL ELSE 'plain text' END""")
    return table(spark, d, "events").select("event_id", evaluation.harmonised_flag(raw).alias("f")).select("event_id", "f.*")


@query(f"WITH {ITEMS} SELECT item_id, len(alternativas) - len(list_distinct(list_transform(alternativas, lambda x: {sql_words_folded('x')}))) AS repeats FROM items")
def repeats_within(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("item_id", long(evaluation.repeats_within(F.col("alternativas"))).alias("repeats"))


_DECISION = "CASE event_type WHEN 'purchase' THEN 'APROVAR' WHEN 'error' THEN 'REJEITAR' ELSE upper(event_type) END"


@query(f"WITH {REQLOG}, r AS (SELECT rid, arg_max({_DECISION}, seq) AS d FROM reqlog GROUP BY rid) SELECT rid, CASE d WHEN 'APROVAR' THEN 'Usaria' WHEN 'REJEITAR' THEN 'Não usaria' ELSE d END AS decision FROM r")
def latest_decision(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.latest_decision(request_log(spark, d).withColumn("decision", F.expr(_DECISION)), "rid", "seq", "decision")
