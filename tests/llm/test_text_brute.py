"""Fingerprints, code lengths, the url model and archive reads against plain Python."""

import math
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from quizmill.llm import imatch, langid, urlfilter, warc
from quizmill.llm.textkit import prefix_hash, span_hash

M = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def hash_of(b: bytes) -> int:
    d = np.frombuffer(b, np.uint8)
    return int(span_hash(prefix_hash(d), np.array([0]), np.array([len(d)]))[0])


def term_set(text):
    import re

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return {hash_of(w.encode()) for w in re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)}


SEEDS = [mix(k * 0x9E3779B97F4A7C15 & M) for k in range(1, imatch.SUBSETS + 1)]


def fingerprint(text, lex):
    """(level, hashes of two levels) or the hash of all terms."""
    every = term_set(text)
    mine = every & lex
    if not mine:
        return sum(map(mix, every)) & M
    level = math.floor(math.log2(len(mine))) + 1
    out = []
    for k in (0, 1):
        for s in SEEDS:
            picked = [u for u in (mix(h ^ s) for h in mine) if u < 1 << 63 - min(level + k - 1, 62)]
            out.append(mix(sum(mix(u + 1 & M) for u in picked) & M) >> 40 | 1 if picked else 0)
    return level, out


def likeness(a, b):
    if isinstance(a, int) or isinstance(b, int):
        return float(isinstance(a, int) and isinstance(b, int) and a == b)
    if a == b:
        return 1.0
    equal = either = 0
    for x in (0, 1):
        for y in (0, 1):
            if a[0] + x == b[0] + y:
                for p, q in zip(a[1][x * imatch.SUBSETS :][: imatch.SUBSETS], b[1][y * imatch.SUBSETS :][: imatch.SUBSETS], strict=True):
                    equal += p == q > 0
                    either += p > 0 or q > 0
    return equal / either if either else 0.0


def test_op5_against_plain_python(spark):
    import random

    rnd = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["été", "ñandú", "中文"]
    texts = [" ".join(rnd.choices(words, k=rnd.choice([0, 1, 5, 40, 300, 900]))) for _ in range(120)] + ["", None, "!!", "W1 w1. W2", "only-here unseen"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = [t or "" for t in texts]
    n = Counter(h for t in plain for h in term_set(t))
    want = {h for h, c in n.items() if max(2.0, 0.02 * len(texts)) <= c <= max(2.0, 0.3 * len(texts))}
    lex = imatch.lexicon(df, 0.02, 0.3)
    assert set(lex.tolist()) == want and want
    got = imatch.fingerprints(df.repartition(7), lex).orderBy("doc_id").collect()
    prints = [fingerprint(t, want) for t in plain]
    after = [*plain[1:], plain[0]]
    edited = [fingerprint(imatch.edited(t, x), want) for t, x in zip(plain, after, strict=True)]
    name = lambda f: f"all:{f:016x}" if isinstance(f, int) else f"{f[0]}:" + "".join(f"{x:06x}" for x in f[1])
    assert [r["fingerprint"] for r in got] == list(map(name, prints)) and [r["edited_fingerprint"] for r in got] == list(map(name, edited))
    assert [r["near_edited"] for r in got] == pytest.approx([likeness(a, b) for a, b in zip(prints, edited, strict=True)])
    assert [r["near_next"] for r in got] == pytest.approx([likeness(a, b) for a, b in zip(prints, [*prints[1:], prints[0]], strict=True)])
    long_ = [r for r, t in zip(got, plain, strict=True) if len(t.split()) >= 40]
    assert np.mean([r["near_edited"] >= 0.2 for r in long_]) > np.mean([r["near_next"] >= 0.2 for r in long_])


def code_length(train, text):
    """Bits of a text: escapes with exclusion over contexts of 3, 2, 1 and 0 bytes, counted on training texts, then 1/256."""
    seen = [defaultdict(Counter) for _ in range(langid.ORDER + 1)]
    low = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
    for t in train:
        x = bytes(langid.ORDER) + low(t)
        for i in range(langid.ORDER, len(x)):
            for k in range(langid.ORDER + 1):
                seen[k][x[i - k : i]][x[i]] += 1

    def p(ctx, b, k):
        if k < 0:
            return 1 / 256
        c = seen[k].get(ctx[len(ctx) - k :])
        if not c:
            return p(ctx, b, k - 1)
        n, d = sum(c.values()), len(c)
        if b in c:
            return c[b] / (n + d if d < 256 else n)
        return d / (n + d) / max(1 - sum(p(ctx, s, k - 1) for s in c), 1e-12) * p(ctx, b, k - 1)

    x = bytes(langid.ORDER) + low(text)
    return -sum(math.log2(p(x[i - langid.ORDER : i], x[i], langid.ORDER)) for i in range(langid.ORDER, len(x)))


def test_op6_code_lengths_against_plain_python(spark):
    train = {"aa": ["abca abba Cab", "bac caba", "zz"], "bb": ["été über näh", "ñu ñandú", "abba"]}
    rows = [(i, t, k) for k, ts in train.items() for i, t in enumerate(ts * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = langid.held_in(df).collect()
    model = langid.fit(df, sample=10_000)
    texts = ["abba cab", "über Été", "", "zzz zz", "中 q"]
    raw = [t.encode() for t in texts]
    got = langid.code_lengths(model, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert model.langs == ["aa", "bb"]
    for k, lang in enumerate(model.langs):
        mine = [r["text"] for r in kept if r["lang"] == lang]
        assert got[:, k].tolist() == pytest.approx([code_length(mine, t) for t in texts], rel=1e-6)


def test_op6_sample_is_bounded(spark):
    df = spark.createDataFrame([(i, f"{i:05}" * 200, "aa") for i in range(200)] + [(1000 + i, "q" * 5000, "bb") for i in range(40)], "doc_id long, text string, lang string")
    model = langid.fit(df, sample=10_000, sample_bytes=3000)
    total = lambda t: sum(np.round(np.exp2(-t.bits[0]) * 1e9))
    assert model.langs == ["aa", "bb"] and all(total(t) > 0 for t in model.tables)
    assert len(model.tables[0].runs[3]) < 200  # three texts at most


def test_op6_equal_code_lengths_go_to_the_first_name():
    lang, score = langid.judge(np.array([[5.0, 5.0]]), ["aa", "bb"], np.array([True]), np.array([4]))
    assert lang == ["aa"] and score[0] == 0.5


def grams(url):
    host, path = urlfilter.split_url(url)
    raw = f"^{host}\x01{path}$".encode()
    return [hash_of(raw[i : i + n]) % urlfilter.BUCKETS for n in urlfilter.SIZES for i in range(len(raw) - n + 1)]


def test_op9_model_against_plain_python(spark):
    data = [(grams(u), y) for u, y in urlfilter.LABELLED]
    w, bias = defaultdict(float), 0.0
    for _ in range(urlfilter.STEPS):
        step, shift = defaultdict(float), 0.0
        for g, y in data:
            x = 1 / math.sqrt(len(g))
            p = 1 / (1 + math.exp(-(sum(w[b] for b in g) * x + bias)))
            shift += (p - y) / len(data)
            for b in g:
                step[b] += x * (p - y)
        for b in {*w, *step}:
            w[b] -= urlfilter.RATE * (step[b] / len(data) * 10 + urlfilter.DECAY * w[b])
        bias -= urlfilter.RATE * shift
    urls = ["http://casino.example.net/win", "https://docs.example.net/en/guide", "x://Ü/ü?q", "a://b"]
    want = []
    for u in urls:
        g = grams(u)
        want.append(1 / (1 + math.exp(-(sum(w[b] for b in g) / math.sqrt(max(1, len(g))) + bias))))
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert [r["p_block"] for r in urlfilter.filter_urls(df).orderBy("page_id").collect()] == pytest.approx(want, abs=1e-9)


def test_op9_no_rules_and_ties(spark):
    df = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert urlfilter.filter_urls(df, rules=[]).first()["rule"] is None
    assert urlfilter.filter_urls(df, rules=[("org", "/", "allow"), ("org", "/", "block")]).first()["verdict"] == "block"


def test_op4_reads_are_joined(tmp_path, monkeypatch, spark):
    """Neighbouring ranges are one read, however many records they hold; far ones are not."""
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 50) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    index = warc.write_warc(pages, str(tmp_path)).orderBy("file", "offset").collect()
    calls, real = [], warc.pafs.FileSystem.from_uri

    class Counting:
        def __init__(self, fs):
            self.fs = fs

        def open_input_file(self, path):
            f = self.fs.open_input_file(path)

            class File:
                __enter__ = lambda s: s
                __exit__ = lambda s, *a: f.close()

                def read_at(s, n, at):
                    calls.append(n)
                    return f.read_at(n, at)

            return File()

    monkeypatch.setattr(warc, "pafs", SimpleNamespace(FileSystem=SimpleNamespace(from_uri=lambda u: (Counting(real(u)[0]), real(u)[1]))))
    batch = lambda rows: pa.RecordBatch.from_pydict({c: [r[c] for r in rows] for c in ("file", "offset", "length")})
    files = len({r["file"] for r in index})
    got = sum(b.num_rows for b in warc._read(str(tmp_path))([batch(index)]))
    assert got == 60 and len(calls) == files
    calls.clear()
    monkeypatch.setattr(warc, "GAP", 0)
    list(warc._read(str(tmp_path))([batch(index[::2])]))
    assert len(calls) == 30


def scored_plainly(text, llr):
    """Spans of strings that the table of ratios calls random, symbol by symbol."""
    from quizmill.llm import secrets as S

    size, out = len(S.ALPHABET), []
    for m in re.finditer(S.OTHER, text or ""):
        at = [S.ALPHABET.index(c) for c in m.group()]
        ratio = llr[size * size + at[0]] + sum(llr[a * size + b] for a, b in zip(at, at[1:]))
        if ratio >= S.BITS + len(at) / 4:
            out.append((m.start(), 3, m.end()))
    return out


def masked_plainly(text, spans):
    covered = [False] * len(text)
    for a, _, b in spans:
        covered[a:b] = [True] * (b - a)
    return "".join("[secret]" if c and not (i and covered[i - 1]) else "" if c else t for i, (t, c) in enumerate(zip(text, covered, strict=True)))


def test_scored_secrets_and_masks_against_plain_python(spark):
    import base64
    import random
    import time

    from quizmill.llm import secrets as S

    rnd = random.Random(9)
    b64 = lambda n: base64.b64encode(rnd.randbytes(n)).decode()
    word = lambda: rnd.choice(["internationalization_config", "backup", "x" * 25, "1" * 24, b64(18), b64(40), rnd.randbytes(20).hex(), f'token = "{b64(15)}"', "AKIA" + "Q7" * 9, "é😀", "src/main/java/Widget/Factory", f"secret:{b64(30)}{b64(9)}"])
    texts = [None, "", *(rnd.choice([" ", "\n", "", ", "]).join(word() for _ in range(rnd.randint(1, 400))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = S.train(df)
    out = {r["row"]["doc_id"]: r for r in S.scan(df, model).withColumn("clean", S.redacted()).collect()}
    rounded = [round(v, 6) for v in model]
    for i, t in enumerate(texts):
        spans = [tuple(x) for x in out[i]["secret_spans"]]
        assert [x for x in spans if x[1] == 3] == scored_plainly(t, rounded)
        assert spans == sorted(spans) and out[i]["clean"] == (None if t is None else masked_plainly(t, spans))
    assert sum(x[1] == 3 for r in out.values() for x in r["secret_spans"]) > 500
    long_ = spark.createDataFrame([(1, b64(750_000)), (2, " ".join(f'token = "{b64(30)}"' for _ in range(18_000)))], "doc_id long, text string").cache()
    long_.count()
    began = time.time()
    got = S.scan(long_, model).withColumn("clean", S.redacted()).select("clean", "secret_spans").collect()
    assert time.time() - began < 30  # over an hour, when each symbol was looked for from the start of its string
    assert got[0]["clean"] == "[secret]" and len(got[1]["secret_spans"]) >= 18_000
