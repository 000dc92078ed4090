"""Language models behind one interface: a column of prompts in, a column of JSON out."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


class Provider(Protocol):
    def __call__(self, prompt: str) -> str: ...


TRANSIENT = r"(?i)\b(429|5\d\d|timeout|timed out|rate limit|temporar|connection)"


def error_kind(message):
    """transient or terminal, from an error message column; null without one."""
    return F.when(message.isNull(), None).when(message.rlike(TRANSIENT), "transient").otherwise("terminal")


def call(df: DataFrame, prompt: str, make: Callable[[], Provider], retries: int = 2, pause: float = 0.0) -> DataFrame:
    """df with response and error. `make` runs once a task, so a model is loaded once; failures stay in their row."""
    schema = StructType([*df.schema.fields, StructField("response", StringType()), StructField("error", StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for f in frames:
            out, errors = [], []
            for p in f[prompt]:
                answer = error = None
                for k in range(retries + 1):
                    try:
                        answer, error = provider(p), None
                        break
                    except Exception as e:  # noqa: BLE001  what a provider raises is its row's result
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(pause * k)
                out.append(answer)
                errors.append(error)
            yield f.assign(response=pd.Series(out, index=f.index, dtype=object), error=pd.Series(errors, index=f.index, dtype=object))

    return df.mapInPandas(run, schema)


def recorded(df: DataFrame, prompt: str, responses: DataFrame) -> DataFrame:
    """df with the responses recorded for its prompts (columns prompt, response): an equi-join on the prompt's hash and the prompt."""
    r = responses.select(F.xxhash64("prompt").alias("_h"), F.col("prompt").alias("_p"), "response")
    return df.withColumn("_h", F.xxhash64(prompt)).join(r, ["_h"], "left").where(F.col("_p").isNull() | (F.col("_p") == F.col(prompt))).drop("_h", "_p").withColumn("error", F.when(F.col("response").isNull(), "no recorded response"))
