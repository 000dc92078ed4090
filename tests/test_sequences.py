"""Matching blocks against difflib, bounds that never cut what is like enough, and time on long strings."""

import random
import time
from difflib import SequenceMatcher

import pytest
from quizmill.functions import sequences as Q
from quizmill.functions.similarity import sequence_ratio, sequence_ratio_from


def edited(rnd, s, n, letters):
    s = list(s)
    for _ in range(n):
        i = rnd.randrange(len(s) + 1)
        kind = rnd.random()
        if kind < 0.4:
            s[i : i + rnd.randint(1, 5)] = []
        elif kind < 0.8:
            s[i:i] = rnd.choices(letters, k=rnd.randint(1, 5))
        else:
            j = rnd.randrange(len(s) + 1)
            s[i:i] = s[j : j + rnd.randint(1, 60)]
    return "".join(s)


@pytest.mark.parametrize("name", ["prose", "few", "rare", "mixed", "capitals"])
def test_matched_is_that_of_difflib(name):
    rnd = random.Random(name)
    letters = {"prose": "eeeeeaaaaiiioootttnnnssrrhldcumfpgwybvk   ,.", "few": "ab", "rare": "".join(map(chr, range(0x4E00, 0x4E00 + 400))), "mixed": "ab" * 40 + "".join(map(chr, range(200, 260))), "capitals": "e" * 30 + "ABCDEFGH \n"}[name]
    for _ in range(250):
        a = "".join(rnd.choices(letters, k=rnd.choice([0, 5, 150, 199, 200, 201, 400, 900])))
        b = edited(rnd, a, rnd.randint(0, 30), letters) if rnd.random() < 0.7 else "".join(rnd.choices(letters, k=rnd.choice([0, 60, 210, 700])))
        if rnd.random() < 0.3:
            a, b = b, a
        want = SequenceMatcher(None, a, b).ratio()
        assert Q.ratio(a, b) == want, (a, b)
        for least in (0.3, 0.82, 0.95):
            assert Q.reached(a, b, least) == (want if want >= least else None)


def test_time_on_long_strings():
    rnd = random.Random(1)
    words = ["".join(rnd.choices("etaoinshrdlu", k=rnd.randint(2, 9))).capitalize() if rnd.random() < 0.1 else "".join(rnd.choices("etaoinshrdlu", k=rnd.randint(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    a, other = text(18_000), text(18_000)
    assert len(a) > 100_000
    began = time.time()
    assert Q.reached(a, other, 0.82) is None  # by the bound
    near = edited(rnd, a, 60, "etaoin")
    assert 0 < Q.ratio(a, near) < 1 and Q.can_reach(a, near, 0.82)
    assert Q.reached(a, a + other[:200], 0.82) > 0.99
    assert time.time() - began < 30
    small = a[: 10_000], edited(rnd, a[:10_000], 10, "etaoin")
    assert Q.ratio(*small) == SequenceMatcher(None, *small).ratio()


def test_columns(spark):
    df = spark.createDataFrame([("abcd", "bcde"), (None, "x"), ("", ""), ("x" * 300, "x" * 300), ("abcd", "wxyz")], "a string, b string")
    rows = df.select(sequence_ratio("a", "b").alias("r"), sequence_ratio_from("a", "b", 0.7).alias("f")).collect()
    assert [r["r"] for r in rows] == [0.75, None, 1.0, 1.0, 0.0] and [r["f"] for r in rows] == [0.75, None, 1.0, 1.0, None]


def test_shared_pieces_spare_the_look_at_every_run(monkeypatch):
    import random

    from quizmill.functions import sequences

    r = random.Random(3)
    words = ["".join(r.choices("etaoinshrdlucmqz7", k=r.randint(2, 8))) for _ in range(300)]
    b = " ".join(f"{w}{i:04d}" if i % 40 == 0 else w for i, w in enumerate(r.choices(words, k=3000)))  # figures are rare
    a = b[200:] + " qual vale"
    want = sequences.ratio(a, b)
    monkeypatch.setattr(sequences, "_alike", lambda *_: 1 / 0)
    assert sequences.reached(a, b, 0.82) == want > 0.9


def test_pieces_end_where_strings_differ():
    from quizmill.functions.sequences import _common

    for n in (0, 1, 15, 16, 17, 40, 100):
        a, b = "x" * n + "a" + "y" * n, "x" * n + "b" + "y" * n
        assert _common(a, 0, b, 0, len(a)) == n == _common(a, len(a), b, len(b), len(a), back=True)
        assert _common(a, 0, b, 0, n // 2) == n // 2


def test_fold_of_latin_texts_is_that_of_single_steps(spark):
    from pyspark.sql import functions as F

    from quizmill.functions import text as T

    rows = [(c + tail,) for c in map(chr, range(1, 0x530)) if not 0xD800 <= ord(c) < 0xE000 for tail in ("", "Ж")]  # the second sends the first the longer way
    x = spark.createDataFrame(rows, "x string").select("x", T.fold(F.col("x")).alias("f")).collect()
    found = {r["x"]: r["f"] for r in x}
    assert all(found[c] + "ж" == found[c + "Ж"] for c in found if c + "Ж" in found and c != "Ж")
