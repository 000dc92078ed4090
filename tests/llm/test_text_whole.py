"""The text operators do the whole job, whatever else stands in a batch."""

import os
import random
import re
import tracemalloc

import numpy as np
import pytest
from quizmill.llm import bpecodec, decontaminate, imatch, jaccard, langid, tokencount

PHRASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"


def test_op10_near_does_not_depend_on_the_batch(spark):
    rows = [(1, PHRASE.replace("kappa", "other")), (2, "x y z"), (3, PHRASE.split(" ", 1)[1]), (4, "kappa lambda nu " * 50), (5, None), (6, PHRASE.replace("lambda", "one two"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(5, PHRASE)], "item_id long, text string")
    near = lambda n: {r["doc_id"]: r["near"] for r in decontaminate.match(docs.repartition(n), bench).collect()}
    # the rarest of all documents are alpha, beta, gamma, delta, epsilon; four of them are enough
    assert near(1) == near(6) == {1: ["5"], 2: [], 3: ["5"], 4: [], 5: [], 6: ["5"]}
    alone = spark.createDataFrame(rows[:1], "doc_id long, text string")
    assert [r["near"] for r in decontaminate.match(alone, bench).collect()] == [["5"]]


def test_op10_near_item_goes_to_its_own_document(spark):
    rows = [(1, "x y z"), (2, PHRASE.split(" ", 1)[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(5, PHRASE)], "item_id long, text string")
    assert {r["doc_id"]: r["near"] for r in decontaminate.match(docs, bench).collect()} == {1: [], 2: ["5"]}


def near_plainly(words, item, often, width=13, slop=3, k=5):
    """Whether a window of an item stands in a document by the rule of proximity, word by word."""
    w = min(width, len(item))
    lack = decontaminate.misses(w)
    places = lambda t, spot: any(0 <= p < len(words) and words[p] == t for p in range(spot - slop, spot + slop + 1))
    for b in range(len(item) - w + 1):
        window = item[b : b + w]
        rank = sorted(range(w), key=lambda i: (often.get(window[i]) or 1 << 60, i))[:k]
        for a in rank[: lack + 1]:
            for at in (p for p, t in enumerate(words) if t == window[a]):
                if sum(places(window[i], at - a + i) for i in rank) >= len(rank) - lack:
                    return True
    return False


def test_op10_near_against_plain_python(spark):
    from collections import Counter

    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(90)]
    word = lambda: vocabulary[min(89, int(rnd.expovariate(0.05)))]
    texts = [[word() for _ in range(rnd.randint(0, 60))] for _ in range(60)]
    items = [[word() for _ in range(rnd.randint(0, 20))] for _ in range(40)]
    for i in range(30):  # pieces of documents with a few changes
        t = rnd.choice([x for x in texts if len(x) > 16])
        a = rnd.randint(0, len(t) - 15)
        piece = t[a : a + rnd.randint(2, 15)]
        for _ in range(rnd.randint(0, 3)):
            j = rnd.randrange(len(piece))
            piece = rnd.choice([piece[:j] + [word()] + piece[j:], piece[:j] + [word()] + piece[j + 1 :], piece[:j] + piece[j + 1 :] or piece])
        items.append(piece)
    often = Counter(w for t in texts for w in t)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(str(i), " ".join(t)) for i, t in enumerate(items)], "item_id string, text string")
    for r in decontaminate.match(docs, bench).collect():
        assert r["near"] == sorted(str(i) for i, t in enumerate(items) if t and near_plainly(texts[r["doc_id"]], t, often)), r["doc_id"]
        assert set(r["items"]) <= set(r["near"])


def changed_passages(texts, per, seed):
    """(kind, place, document, words): passages of 13 words of the texts with a word replaced, put in or left out, at every place."""
    import re

    rnd = random.Random(seed)
    words = [(i, w) for i, t in texts if len(w := re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x7f" else c for c in t or ""))) >= 13]
    for kind in ("replaced", "put in", "left out"):
        for place in range(13):
            for _ in range(per):
                i, w = rnd.choice(words)
                a = rnd.randint(0, len(w) - 13)
                new = rnd.choice(rnd.choice(words)[1])  # a word that stands in some document
                p = w[a : a + 13]
                yield kind, place, i, p[:place] + ([] if kind == "left out" else [new]) + p[place + (kind != "put in") :]


def near_recall(spark, docs, per=12, seed=7):
    """Recall of proximity matches for each kind of change at each place."""
    from collections import Counter

    asked = list(changed_passages([tuple(r) for r in docs.select("doc_id", "text").collect()], per, seed))
    bench = spark.createDataFrame([(str(n), " ".join(p)) for n, (*_, p) in enumerate(asked)], "item_id string, text string")
    found = {(r["doc_id"], n) for r in decontaminate.match(docs, bench).select("doc_id", "near").collect() for n in r["near"]}
    hit, of = Counter(), Counter()
    for n, (kind, place, i, _) in enumerate(asked):
        of[kind, place] += 1
        hit[kind, place] += (i, str(n)) in found
    return {k: hit[k] / of[k] for k in of}


def test_op10_near_recall_for_every_change_at_every_place(spark):
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    recall = near_recall(spark, spark.read.parquet(f"{d}/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"]))
    assert len(recall) == 39 and min(recall.values()) >= 0.9, recall


def test_op10_answers_from_stored_postings(spark, monkeypatch):
    stored, keep = [], decontaminate.stage
    monkeypatch.setattr(decontaminate, "stage", lambda df, name: stored.append(keep(df, name)) or stored[-1])
    docs = spark.createDataFrame([(1, PHRASE + " nu"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, PHRASE)], "item_id long, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.match(docs, bench).collect()} == {1: 13, 2: 0}
    assert {r["doc_id"]: (r["n_words"], sum(r["counts"]), sorted(r["positions"])) for r in stored[0].collect()} == {1: (14, 14, [*range(14)]), 2: (0, 0, [])}


def test_op10_near_is_a_query(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    got = entry.queries()["op10_near"](spark, d).collect()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count() and all(r["n_near"] >= r["n_items"] for r in got)


def test_op7_fit_stops_inside_words():
    from tokenizers import Tokenizer

    lib, c, rnd = Tokenizer.from_file(tokencount.vocabulary()), tokencount.counter(tokencount.vocabulary()), random.Random(6)
    n = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    parts = [*"aabcdeimnorst  \n\t'.,!?éß中文字0123ABC", "<|endoftext|>", "'re", "   ", "====", "identifier", "中文"]
    for t in ["".join(rnd.choices(parts, k=rnd.randint(1, 30))) for _ in range(300)] + ["文字" * 30, "abcdefghij" * 12]:
        for budget in (1, 5):
            best = max(i for i in range(len(t) + 1) if n(t[:i]) <= budget)
            assert c.fit(t, budget) == len(t[:best].encode()), (t, budget)


def test_op7_a_long_text_without_spaces_fits_in_part(spark):
    df = spark.createDataFrame([(1, "中文字" * 3000)], "doc_id long, text string")
    r = tokencount.count_tokens(df, tokencount.vocabulary()).first()
    assert r["over_limit"] and r["fit_bytes"] > 0
    c = tokencount.counter(tokencount.vocabulary())
    assert c.at("中文字" * 3000, r["fit_bytes"]) <= 1024 < c.at("中文字" * 3000, r["fit_bytes"] + 3)


def test_op7_cuts_are_looked_up(monkeypatch):
    c = tokencount.PrefixCounts(tokencount.vocabulary())
    t = "some identifier_" + "x" * 700 + " and words"
    table = c.table(t)
    want = [c.at(t, i) for i in range(len(t) + 1)]
    monkeypatch.setattr(c, "word", None)
    c.words.clear()
    assert [c.at(t, i, table) for i in range(17, 700)] == want[17:700]


def test_op7_words_of_later_texts_are_remembered(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokencount, "KEPT_WORDS", 100)
    monkeypatch.setattr(tokencount, "KEPT_PIECES", 100)
    lib, c = Tokenizer.from_file(tokencount.vocabulary()), tokencount.PrefixCounts(tokencount.vocabulary())
    n = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    early = " ".join("".join(chr(97 + i * k % 26) for k in range(1, 9)) + chr(97 + i // 26 % 26) for i in range(600))
    late = "quixotic zanzibars, zanzibarians\nand <|endoftext|>zanz " + "x" * 300
    assert (c.total(early), c.total(late)) == (n(early), n(late))
    for name in ("word", "_learn"):
        monkeypatch.setattr(c, name, None, raising=False)
    assert c.total(late) == n(late)


def test_op7_fit_passes_over_pieces():
    from tokenizers import Tokenizer

    lib, c, rnd = Tokenizer.from_file(tokencount.vocabulary()), tokencount.PrefixCounts(tokencount.vocabulary()), random.Random(8)
    n = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    for gaps in ([" "], [" ", "\n", " ", "  ", "\n ", "'ll ", " 're"]):
        for _ in range(40):
            t = "".join(rnd.choice(["the", "zanzi", "été", "中文", "<|endoftext|>", "a.b", "=="]) + rnd.choice(gaps) for _ in range(60))
            best = max(i for i in range(len(t) + 1) if n(t[:i]) <= 40)
            assert c.fit(t, 40) == len(t[:best].encode()), t


def test_op6_learns_every_label(spark):
    rows = [(i * 300 + k, f"{chr(0x4E00 + k) * 9} {chr(0x4E00 + k)}", f"l{k:03}") for k in range(230) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert len(model.langs) == 230
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, model).collect()}
    assert np.mean([got[i] == k for i, _, k in rows]) > 0.99


def test_op6_tells_rare_bytes_apart():
    letters = "".join(map(chr, range(0x21, 0x7F)))
    text = lambda c: np.frombuffer((letters + c * 4).encode(), np.uint8)
    grams = lambda c: np.unique(np.convolve(np.concatenate([[0] * 3, langid.LOWER[text(c)]]).astype(np.int64), [1, 1 << 8, 1 << 16, 1 << 24])[3:-3], return_counts=True)
    model = langid.Model(["a", "b"], [langid._learn(*grams("é")), langid._learn(*grams("è"))])
    data = np.concatenate([text("é"), text("è")])
    bits = langid.code_lengths(model, data, np.array([0, len(text("é")), len(data)]))
    assert bits.argmin(1).tolist() == [0, 1]
    for cost in model.cost:
        assert np.allclose(np.exp2(-cost.reshape(-1, 256)).sum(1), 1)


def test_op3_sets_are_not_shuffled_for_overlaps(spark, monkeypatch):
    plans, real = [], jaccard._overlaps

    def watched(pairs, segments, first, last):
        out = real(pairs, segments, first, last)
        plans.append(1)
        ready = out._jdf.queryExecution().executedPlan().toString()
        # between the scan of the sets (tokens) and the join there is no exchange
        moved = [line for line in re.findall(r"Exchange hashpartitioning[^\n]*\n((?:(?!Exchange|Join)[^\n]*\n)*?[^\n]*FileScan parquet[^\n]*)", ready) if "tokens" in line]
        assert "FileScan parquet" in ready and not moved, ready
        return out

    monkeypatch.setattr(jaccard, "_overlaps", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = ["a b c d e f g h i j k l m n o p q r s t u v w x y z", "a b c d e f g h i j k l m n o p q r s t u v w x y zz", "one two three four five six", None]
        rows = jaccard.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        assert {r["doc_id"]: r["component_id"] for r in rows} == {0: 0, 1: 0, 2: 2, 3: 3}
        none = spark.createDataFrame([], "doc_id long, text string")
        assert jaccard.similar_groups(none).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) == 8
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(("firsts_", "rest_"))]


def test_op5_hashes_only_the_terms_that_a_subset_keeps(monkeypatch):
    words = [f"word{k}" for k in range(300)]
    _, h = imatch.terms(np.frombuffer(" ".join(words).encode(), np.uint8), np.array([0, len(" ".join(words))]))
    done, real = [], imatch.mix
    monkeypatch.setattr(imatch, "mix", lambda x: done.append(x.size) or real(x))
    p = imatch.Prints(np.sort(h), [" ".join(words)] * 50)
    assert sum(done) < 100_000  # all 24 subsets of 15,000 terms would be 360,000
    u = real(h[:, None] ^ imatch.SEEDS[None, :])
    for k in (0, 1):
        kept = u < np.uint64(1) << np.uint64(63 - (int(p.level[0]) + k - 1))
        total = np.where(kept, real(u + np.uint64(1)), np.uint64(0)).sum(0, dtype=np.uint64)
        want = np.where(kept.any(0), (real(total) >> np.uint64(40)).astype(np.int64) | 1, 0)
        assert (p.hash[:, k] == want).all()


def test_op3_pairs_that_share_little_are_not_counted(spark, monkeypatch):
    rnd, counted, real = random.Random(8), [], jaccard._overlaps

    def watched(pairs, segments, first, last):
        counted.append(pairs.count())
        return real(pairs, segments, first, last)

    monkeypatch.setattr(jaccard, "_overlaps", watched)
    texts = []
    for k in range(40):  # the two texts of a pair share a passage, an eighth of their shingles
        passage = [f"p{k // 2}x{j}" for j in range(12)]
        texts.append(" ".join([f"w{rnd.random()}" for _ in range(56)] + passage))
    near = [f"n{j}" for j in range(80)]
    texts += [" ".join(near), " ".join([*near[:-1], "other"])]
    rows = jaccard.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {k: min(k, 40) for k in range(42)}
    assert sum(counted) == 2  # the near copies, in two halves


def test_op3_sketches_miss_no_shingle(spark):
    rnd = np.random.default_rng(5)
    full = np.unique(rnd.integers(0, 1 << 16, 3000, np.uint64) | rnd.integers(0, 1 << 40, 3000, np.uint64) << np.uint64(16))
    marks = jaccard._sketch(full)
    assert marks.dtype == np.int16 and len(marks) < len(full)  # some shingles share a mark
    n = len(full)
    sketches = spark.createDataFrame([(1, n, marks.tolist()), (2, n, marks.tolist()), (3, n, [])], "cls long, m int, marks array<short>")
    pairs = spark.createDataFrame([(1, 2, n, n), (1, 3, n, n)], "a long, b long, na long, nb long")
    assert [(r["a"], r["b"]) for r in jaccard._reaching(pairs, sketches, 100).collect()] == [(1, 2)]


def test_op8_needs_little_memory():
    tracemalloc.start()
    try:
        kind = bpecodec.kinds()
        assert tracemalloc.get_traced_memory()[1] < 24 << 20  # 1.1 million code points, and what is searched for them
        assert kind[ord("a")] == bpecodec.LETTER and kind[0x10FFFF] == bpecodec.OTHER and kind[bpecodec.MARKS] == bpecodec.MARK
    finally:
        tracemalloc.stop()
    lib_words = " ".join(f"word{k % 997}" for k in range(150_000))
    texts = [lib_words[k : k + 50_000] for k in range(0, len(lib_words), 50_000)]
    c = bpecodec.codec(bpecodec.vocabulary())
    c.encode_texts(texts[:1])
    tracemalloc.start()
    try:
        out = [len(ids) for ids, _ in c.encode_texts(texts)]
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()
    assert out == [len(c.encode(t)) for t in texts]
