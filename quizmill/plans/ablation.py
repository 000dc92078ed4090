"""Ablation conditions as plans over specifications: one model alone, with retrieval, with retrieval and an option model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.operators import contracts, generators, retrieval
from quizmill.sources import providers

QUESTION = "enunciado string, alternativas array<string>, correta int, explicacao string, competencia string, habilidade string, objeto_conhecimento string"
NUCLEUS = "enunciado string, resposta_correta string, explicacao string, competencia string, habilidade string, objeto_conhecimento string"
FIELDS = ["enunciado", "explicacao", "competencia", "habilidade", "objeto_conhecimento"]
CONDITIONS = {"C1_LLM": (False, False), "C2_RAG_LLM": (True, False), "C3_RAG_LLM_SLM": (True, True)}  # retrieval, option model


def run(condition: str, specs: DataFrame, model: Callable[[], providers.Provider], docs: DataFrame | None = None, options: Callable[[], providers.Provider] | None = None, **search) -> DataFrame:
    """specs (spec_id, query, objeto, curso, componente, exame) with state, reason and the question's fields.

    The prompt is a JSON object with the specification and the best record found (null in C1). In C1 and C2 the model
    gives whole questions; in C3 it gives a nucleus, another model its options (the first four count), and item and key
    are put together in seeded order. A question that breaks its contract, or a model's error, is its row's reason.
    """
    search_first, two_models = CONDITIONS[condition]
    x = specs
    if search_first:
        if docs is None:
            raise ValueError(f"{condition} needs records to retrieve")
        best = retrieval.hybrid(docs, specs, k=1, **search).select("spec_id", F.col("id").alias("reference_id"))
        x = x.join(best, "spec_id", "left").join(docs.select(F.col("id").alias("reference_id"), F.col("texto").alias("reference")), "reference_id", "left")
    else:
        x = x.withColumn("reference_id", F.lit(None).cast("string")).withColumn("reference", F.lit(None).cast("string"))
    x = x.withColumn("prompt", F.to_json(F.struct(F.struct(*specs.columns).alias("solicitacao"), F.col("reference").alias("referencia")), {"ignoreNullFields": "false"}))
    x = providers.call(x, "prompt", model)
    keep = ["spec_id", "reference_id"]
    if not two_models:
        q = x.select(*keep, "error", F.from_json("response", QUESTION).alias("q")).select(*keep, "error", "q.*")
    else:
        if options is None:
            raise ValueError(f"{condition} needs an option model")
        n = x.select(*keep, F.col("error").alias("first_error"), F.from_json("response", NUCLEUS).alias("q")).select(*keep, "first_error", "q.*")
        n = n.withColumn("prompt", generators.option_prompt(F.col("enunciado"), F.col("resposta_correta")))
        made = providers.call(n, "prompt", options).withColumn("o", F.slice(generators.parse_options("response")["options"], 1, 4))
        item = generators.assemble("resposta_correta", "o", F.col("spec_id").cast("string"))
        q = made.withColumn("item", item).select(*keep, F.coalesce("first_error", "error").alias("error"), *FIELDS, "item.alternativas", "item.correta")
    wrong = contracts.question_error(F.col("alternativas"), F.col("correta"), *map(F.col, FIELDS))
    missing = F.when(F.col("reference_id").isNull(), "sem_referencia") if search_first else F.lit(None).cast("string")
    reason = F.coalesce(missing, F.when(F.col("error").isNotNull(), "erro_do_modelo"), wrong)
    return q.select(F.lit(condition).alias("condition"), *keep, *FIELDS, "alternativas", "correta", reason.alias("reason")).withColumn("state", F.when(F.col("reason").isNull(), "COMPLETED").otherwise("FAILED"))
