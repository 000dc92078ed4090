"""Similarities: sequence ratio, bags of words, vectors, BLEU."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quizmill.functions import sequences
from quizmill.functions.text import words
from quizmill.sources.staging import stage


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings, in this order; null if one is null. Apply it after blocking on a prefix or length."""
    return pd.Series([None if x is None or y is None else sequences.ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def sequence_ratio_from(a: Column | str, b: Column | str, least: float) -> Column:
    """The ratio where it is at least so much, else null: texts that cannot be so like are told by bounds."""

    @F.pandas_udf(DoubleType())
    def reached(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else sequences.reached(p, q, least) for p, q in zip(x, y, strict=True)], dtype="float64")

    return reached(a, b)


def may_reach(a: str, b: str, ratio: float) -> Column:
    """Whether two strings can have this sequence ratio at all: matching blocks are a common subsequence, so the edit distance is at most (1 - ratio) times both lengths. A built-in test before the UDF."""
    return F.levenshtein(a, b) <= F.floor((1 - ratio) * (F.length(a) + F.length(b)) + 1e-9)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def bag_f1(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """(key, f1) of two texts as multisets of lower-cased words."""
    bag = lambda c, n: df.select(key, F.explode(words(F.lower(F.col(c)))).alias("w")).groupBy(key, "w").agg(F.count("*").alias(n))
    both = bag(a, "x").join(bag(b, "y"), [key, "w"], "full").groupBy(key).agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.least(F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0)))).alias("m"))
    return both.select(key, F.coalesce(2.0 * F.col("m") / (F.coalesce("x", F.lit(0)) + F.coalesce("y", F.lit(0))), F.lit(0.0)).alias("f1"))


def ngrams(tokens: Column, n: int) -> Column:
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def self_bleu(df: DataFrame, key: str, text: str, n: int = 4) -> DataFrame:
    """(key, self_bleu): BLEU-n of each row against all other rows, with add-one smoothing above unigrams and no penalty for short rows.

    Clipping needs the largest count of an n-gram among the *other* rows: the two largest counts of each n-gram are
    enough, so nothing is joined row by row.
    """
    t = df.select(key, words(F.lower(F.col(text))).alias("t")).where(F.size("t") > 0)
    named = lambda k: F.transform(ngrams(F.col("t"), k), lambda g: F.struct(F.lit(k).alias("n"), g.alias("g")))
    grams = t.select(key, F.explode(F.flatten(F.array(*map(named, range(1, n + 1))))).alias("x")).groupBy(key, "x.n", "x.g").agg(F.count("*").alias("c"))
    top = grams.groupBy("n", "g").agg(F.max("c").alias("m1"))
    with_top = grams.join(top, ["n", "g"])
    second = with_top.where(F.col("c") < F.col("m1")).groupBy("n", "g").agg(F.max("c").alias("m2"))
    holders = with_top.where(F.col("c") == F.col("m1")).groupBy("n", "g").agg(F.count("*").alias("holders"))
    x = with_top.join(second, ["n", "g"], "left").join(holders, ["n", "g"])
    other = F.when((F.col("c") < F.col("m1")) | (F.col("holders") > 1), F.col("m1")).otherwise(F.coalesce("m2", F.lit(0)))
    per = x.groupBy(key, "n").agg(F.sum(F.least("c", other)).alias("hit"), F.sum("c").alias("all"))
    p = F.when(F.col("n") == 1, F.col("hit") / F.col("all")).otherwise((F.col("hit") + 1) / (F.col("all") + 1))
    score = per.groupBy(key).agg(F.sum(F.when(p > 0, F.log(p)).otherwise(F.lit(-1e9))).alias("_s"), F.count("*").alias("_n"))
    return score.select(key, F.when(F.col("_s") < -1e8, 0.0).otherwise(F.exp(F.col("_s") / F.col("_n"))).alias("self_bleu"))


def average_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the average rank of a column: ties share the mean of their places.

    Ranks come from counts per value. Values are dealt out by range; running sums within each range, and what the ranges
    before it hold, give the places, so that no task orders all values.
    """
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    ranges = stage(counts.repartitionByRange(column).withColumn("_p", F.spark_partition_id()), "ranges")
    before = ranges.groupBy("_p").agg(F.sum("n").alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row a range
    inner = F.sum("n").over(Window.partitionBy("_p").orderBy(column))
    ranked = ranges.withColumn("_s", inner).join(F.broadcast(before), "_p").select(column, (F.col("_s") + F.col("_b") - (F.col("n") - 1) / 2).alias(out))
    return df.join(ranked, column)


def correlations(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: pearson and spearman of two columns, rows with a null left out."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    r = average_rank(average_rank(x, "a", "ra"), "b", "rb")
    return r.agg(F.corr("a", "b").alias("pearson"), F.corr("ra", "rb").alias("spearman"))
