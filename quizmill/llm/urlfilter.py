"""URL filter: fixed rules first, else logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.llm.textkit import prefix_hash, span_hash

#: Fixed rules: (host, path, verdict). A rule fits its host and all subdomains if the url's path starts with its path.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

#: The labelled urls that the model learns from (1: block).
LABELLED = [
    ("https://docs.example.net/en/guide/install", 0), ("https://www.university.example.net/library/catalogue", 0),
    ("http://news.example.com/en/science/2021/07/telescope", 0), ("https://blog.example.net/en/cooking/bread", 0),
    ("https://museum.example.com/en/collections/maps", 0), ("https://wiki.example.net/history/railways", 0),
    ("http://forum.example.net/en/gardening/thread/118", 0), ("https://m.weather.example.net/en/forecast", 0),
    ("https://research.example.com/en/papers/graph-theory.html", 0), ("https://www.townhall.example.net/es/servicios", 0),
    ("https://school.example.net/de/fahrplan", 0), ("http://books.example.com/en/authors/a", 0),
    ("https://health.example.net/en/nutrition", 0), ("https://data.example.net/en/statistics/census", 0),
    ("https://open.example.com/en/source/license", 0), ("https://code.example.net/en/reference/api", 0),
    ("https://radio.example.net/fr/emissions", 0), ("https://law.example.com/en/cases/1998", 0),
    ("https://theatre.example.net/en/season", 0), ("https://maps.example.net/en/826", 0),
    ("https://en.example.net/articles/25", 0), ("https://archive.example.com/en/770", 0),
    ("http://casino-bonus.example.net/free-spins/win", 1), ("https://xxx-tube.example.com/porn/video", 1),
    ("http://cheap-pills.example.net/viagra/buy-now", 1), ("http://login-verify.example.com/bank/password-reset.php", 1),
    ("https://torrent.example.net/crack/keygen/serial", 1), ("http://win-prize.example.com/claim?lottery=1", 1),
    ("http://free-money.example.net/click/earn-fast", 1), ("http://adult-dating.example.com/hot/sexy-singles", 1),
    ("https://poker-slots.example.net/jackpot/bet", 1), ("http://malware.example.com/setup.exe", 1),
    ("http://warez.example.net/full/download/cracked.zip", 1), ("https://replica-watches.example.com/cheap/outlet", 1),
    ("http://payday-loans.example.net/fast-cash/apply", 1), ("http://track.example.com/ads/click/banner/popup", 1),
    ("http://spam.example.net/seo/backlinks/buy", 1), ("https://escort.example.com/nude/cams", 1),
    ("http://bet365-mirror.example.net/odds/free-bet", 1), ("http://crypto-doubler.example.com/invest/bonus", 1),
    ("http://phish.example.net/account/verify/signin", 1), ("http://xxx.example.net/sex/porn/free", 1),
    ("http://miracle-diet.example.com/pills/order", 1), ("http://hack.example.net/cheats/generator", 1),
]

SIZES, BUCKETS = (3, 4, 5), 1 << 14
LOWER = {c: c + 32 for c in range(65, 91)}
STEPS, RATE, DECAY = 400, 4.0, 1e-4


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z in lower case; empty for null or without ://."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=None) -> Column:
    """The longest rule that fits, as host and path, and its verdict: struct(rule, verdict) or null. Of rules of equal length the last given counts."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(RULES if rules is None else rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight) of the n-grams; a row's weights have unit length if no bucket repeats."""
    raw = [f"^{h}\x01{p}$".encode() for h, p in zip(hosts, paths, strict=True)]
    offs = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    cum, ends = prefix_hash(data), np.repeat(offs[1:], np.diff(offs))
    rows, buckets = [], []
    for n in SIZES:
        at = np.flatnonzero(np.arange(len(data)) + n <= ends)
        rows.append(np.searchsorted(offs, at, "right") - 1)
        buckets.append((span_hash(cum, at, at + n) % np.uint64(BUCKETS)).astype(np.int64))
    row, bucket = np.concatenate(rows), np.concatenate(buckets)
    return row, bucket, 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(raw))))[row]


def split_url(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    tail = rest[cut:]
    return rest[:cut].translate(LOWER), tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]


def train(labelled=None) -> np.ndarray:
    """Weights of the buckets, the last one the intercept, by gradient descent with decay on the labelled table."""
    table = LABELLED if labelled is None else labelled
    y = np.array([b for _, b in table], float)
    row, bucket, x = features(*zip(*(split_url(u) for u, _ in table), strict=True))
    w = np.zeros(BUCKETS + 1)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(np.bincount(row, x * w[bucket], len(y)) + w[-1])))
        w[:-1] -= RATE * (np.bincount(bucket, x * (p - y)[row], BUCKETS) / len(y) * 10 + DECAY * w[:-1])
        w[-1] -= RATE * (p - y).mean()
    return w


def blocked_probability(w: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    row, bucket, x = features(hosts, paths)
    return 1 / (1 + np.exp(-(np.bincount(row, x * w[bucket], len(hosts)) + w[-1])))


def filter_urls(pages: DataFrame, rules=None, labelled=None) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block for each row; repeated rows give repeated rows, an empty table none.

    Null urls and urls without :// have an empty host and path and are judged like any other; urls of any length are
    looked at whole. p_block of 0.5 is block. rules and labelled: the module's own if None; no rules at all if empty.
    """
    w = train(labelled)

    @F.pandas_udf("double")
    def p_block(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series(blocked_probability(w, host.tolist(), path.tolist()))

    x = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    x = x.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("p_block", p_block("host", "path"))
    return x.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"), "p_block")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that a rule decides."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    x = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("hit", rule_of(F.col("host"), F.col("path")))
    return x.where("hit is not null").select("page_id", "host", "path", "hit.rule", "hit.verdict")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_FITS = [(f"(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
SQL = rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)\A.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE {' '.join(f"WHEN {c} THEN '{r}'" for c, r, _ in _FITS)} END AS rule FROM u)
SELECT *, CASE rule {' '.join(f"WHEN '{r}' THEN '{v}'" for _, r, v in _FITS)} END AS verdict FROM r WHERE rule IS NOT NULL
"""
