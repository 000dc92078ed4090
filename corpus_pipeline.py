"""A training corpus from raw documents, in five stages.

Each stage gets what the one before kept, written as Parquet and read again, and takes its decisions: documents whose
language cannot be told go; one document of each group of near duplicates stays; documents contaminated by the benchmark
go; secrets are replaced; what is left is encoded. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quizmill.llm import bpecodec, decontaminate, jaccard, langid, secrets
from quizmill.llm.textkit import drop, stage

STAGES = [
    ("language_id", langid.identified),
    ("near_duplicates", jaccard.one_of_each),
    ("decontamination", decontaminate.clean),
    ("secrets", secrets.without_secrets),
    ("encoding", bpecodec.tokenise),
]

#: The first stage learns a model and the fourth too; SQL cannot say them. Tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, f) in enumerate(STAGES):
        kept = stage(f(spark, docs, sf_dir), name)
        if k:
            drop(docs)  # written and read by now
        docs = kept
    return docs
