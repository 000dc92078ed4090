"""Table functions for SQL: options in closed form beside each row (lateral joins), and the best candidates of each part of a table.

`register` gives them their SQL names. Each says the same as the Column form in `operators.generators`; null or unfit
arguments give no rows. They hold one row's options, or the best few candidates of a part, whatever the part's size.
Rows go one by one and unwrapped: with Arrow, Spark makes a table of its own of the few options of each row.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from heapq import heappush, heapreplace
from itertools import combinations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quizmill.operators.generators import ASSERTIONS, NUMERALS


class NeighbourPrefixes:
    """(place, option) of the prefixes nearest to one of 1 to 30, as /n or with their mask."""

    def eval(self, prefix, dotted):
        if prefix is None or not 1 <= prefix <= 30:
            return
        near = [p for step in range(1, 6) for p in (prefix - step, prefix + step) if 1 <= p <= 30]
        for place, p in enumerate(near[:4], 1):
            bits = (1 << 32) - (1 << 32 - p)
            yield place, f"Máscara /{p} ({'.'.join(str(bits >> s & 255) for s in (24, 16, 8, 0))})" if dotted else f"/{p}"


SETS = [c for n in range(1, len(NUMERALS) + 1) for c in combinations(NUMERALS, n)]


@lru_cache(4096)
def nearest_sets(right: tuple[str, ...]) -> list[str]:
    """The four options beside a set; there are few sets, so each is ordered once."""
    mine = set(right)
    if not mine or not mine <= set(NUMERALS):
        return []
    others = sorted((len(mine ^ set(c)), abs(len(c) - len(right)), c) for c in SETS if set(c) != mine)
    return [",".join(c) for _, _, c in others[:4]]


@lru_cache(4096)
def other_sentences(answer: str) -> list[str]:
    """The four sentences beside an answer."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", answer.lower()) if not unicodedata.combining(c))
    plain = re.sub(r"\s+", " ", plain).strip()
    first, second = (not re.search(f"{word}[ao].{{0,35}}fals", plain) for word in ("primeir", "segund"))
    justifies = str(not re.search("nao justifica|nao e justificativa", plain)).lower() if first and second else ""
    key = "false,false," if "duas" in plain and "fals" in plain else f"{first},{second},{justifies}".lower()
    return [text for text, k in ASSERTIONS if k != key][:4]


class NeighbourSets:
    """(place, option) of the sets of numerals nearest to the right one: by members that differ, by size, then by members."""

    def eval(self, right):
        yield from enumerate(nearest_sets(tuple(v or "" for v in right or ())), 1)


class NeighbourCounts:
    """(place, option) of the numbers 1 to 5 but the right one, nearest first, the smaller of two first."""

    def eval(self, right):
        if right is None or not 1 <= right <= 5:
            return
        for place, v in enumerate(sorted((v for v in range(1, 6) if v != right), key=lambda v: (abs(v - right), v)), 1):
            yield place, str(v)


class OtherAssertions:
    """(place, option) of the sentences on two assertions that say something else than the answer."""

    def eval(self, answer):
        yield from enumerate(other_sentences(answer or ""), 1)


class BestCandidates:
    """(key, index, place) of the k candidates of each part nearest to the wanted number of words, then with most different words in share, then first.

    A part has columns key, index, n_words, n_different and wanted; k of them are held at a time.
    """

    def __init__(self):
        self.key, self.best = None, []

    def eval(self, row, k):
        self.key = row["key"]
        n, want = max(row["n_words"], 1), max(row["wanted"], 1)
        worst_first = (-abs(n - want) / want, row["n_different"] / n, -row["index"])
        if len(self.best) < k:
            heappush(self.best, worst_first)
        elif worst_first > self.best[0]:
            heapreplace(self.best, worst_first)

    def terminate(self):
        for place, (_, _, i) in enumerate(sorted(self.best, reverse=True), 1):
            yield self.key, -i, place


FUNCTIONS = {
    "neighbour_prefixes": (NeighbourPrefixes, "place int, option string"),
    "neighbour_sets": (NeighbourSets, "place int, option string"),
    "neighbour_counts": (NeighbourCounts, "place int, option string"),
    "other_assertions": (OtherAssertions, "place int, option string"),
    "best_candidates": (BestCandidates, "key long, index int, place int"),
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    for name, (f, kind) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(f, returnType=kind, useArrow=False))
