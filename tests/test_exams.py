"""Exam extraction against plain Python, on made text and on documents cut into blocks, and its time on long blocks."""

import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F
from quizmill.operators import exams

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PY = {k: re.compile(re.sub(r"^\(\?([a-z]+)\)", lambda m: "(?" + m.group(1).replace("d", "") + ")", getattr(exams, k))) for k in ("HEADER", "DISCURSIVE", "OPTION", "NOISE", "CUT")}


def lines_of(body):
    kept = [v.rstrip() for v in body.splitlines() if v.strip() and not PY["NOISE"].match(v)]
    out = []
    for v in kept:
        if out and re.fullmatch(r"\s*\(?[A-E]\)?\s*", out[-1]):
            out[-1] = f"{out[-1].strip()} {v.strip()}"
        else:
            out.append(v)
    return out


def plain_options(body):
    """The last A with B to E after it, looked for from every A."""
    lines = lines_of(body)
    marks = [(i, m.group(1)) for i, v in enumerate(lines) if (m := PY["OPTION"].match(v))]
    best = None
    for s, (_, letter) in enumerate(marks):
        if letter != "A":
            continue
        run = []
        for i, found in marks[s:]:
            if len(run) < 5 and found == "ABCDE"[len(run)]:
                run.append(i)
        best = run if len(run) == 5 else best
    if best is None:
        return None
    raw = []
    for k, i in enumerate(best):
        end = best[k + 1] if k < 4 else len(lines)
        raw.append(" ".join([PY["OPTION"].match(lines[i]).group(2), *(v.strip() for v in lines[i + 1 : end])]).strip())
    pointed = sum(o.strip()[-1:] in tuple(".;?!)") for o in raw if o.strip()) >= 3
    out = []
    for o in raw:
        o = PY["CUT"].split(o)[0].strip()
        at = max((o.rfind(c) for c in ".;?!)"), default=-1)
        tail = o[at + 1 :]
        if pointed and at >= 0 and tail[:1].isspace() and 1 <= len(tail.split()) <= 4:
            o = o[: at + 1]
        out.append(o)
    return re.sub(r"\s+", " ", " ".join(v.strip() for v in lines[: best[0]])).strip(), out


def got_options(spark, bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "i long, body string")
    return {r["i"]: None if r["o"] is None else (r["o"]["stem"], list(r["o"]["options"])) for r in df.select("i", exams.split_options(F.col("body")).alias("o")).collect()}


def test_options_against_plain_python(spark):
    rnd = random.Random(3)
    bits = ["A", "(B)", "C", "D", "E", "A) um dois.", "B. tres;", "(C) quatro", "D - cinco?", "E – seis! a b c", "A outra linha", "texto comum.", "RASCUNHO", "12", "", "  ", "B) x (fim) tres palavras mais", "E) y. QUESTÃO 4", "C) z; um dois tres quatro cinco", "D) w) cauda", "ÁREA LIVRE", "\tA)  com espaços"]
    bodies = ["\n".join(rnd.choices(bits, k=rnd.randint(0, 30))) for _ in range(1500)]
    bodies += ["\n".join([f"{c}) linha {c}.", "mais"][: rnd.randint(1, 2)] + []) for c in "ABCDE"]
    bodies += ["\n".join(x for c in "AABCABCDE" for x in (f"{c}) opção {c}.", *rnd.choices(bits, k=rnd.randint(0, 3)))) for _ in range(300)]
    got = got_options(spark, bodies)
    found = 0
    for i, b in enumerate(bodies):
        want = plain_options(b)
        assert got[i] == want, (b, got[i], want)
        found += want is not None
    assert 300 < found < len(bodies)


def test_documents_cut_into_blocks(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    from quizmill.plans import structures

    raw = structures.exam_texts(spark, SF).collect()
    out = {(r["exam"], r["number"]): r for r in structures.exam_items(spark, SF).collect()}
    want = {}
    for r in raw:
        heads = list(PY["HEADER"].finditer(r["text"]))
        for h, nxt in zip(heads, [*heads[1:], None]):
            body = PY["DISCURSIVE"].split(r["text"][h.end() : nxt.start() if nxt else None])[0]
            want.setdefault((r["exam"], int(h.group(1))), plain_options(body))
    assert set(out) == set(want)
    for k, w in want.items():
        r = out[k]
        if w is None:
            assert (r["status"], r["review"]) == ("excluded", "alternativas A-E não encontradas")
        elif r["status"] == "accepted":
            assert (r["stem"], list(r["options"])) == w
            soft = [t for t, c in (("enunciado curto: pode ter sido cortado", len(w[0]) < 60), ("alternativa muito longa: pode ter misturado colunas", any(len(o) > 400 for o in w[1])), ("menciona figura/tabela", re.search(exams.VISUAL, w[0]))) if c]
            assert r["review"] == "; ".join(soft)
    assert {r["status"] for r in out.values()} == {"accepted", "annulled", "excluded"}
    assert any(r["review"] for r in out.values() if r["status"] == "accepted") and any(not r["review"] for r in out.values() if r["status"] == "accepted")


def test_blocks_keys_and_sections(spark):
    text = "capa INEP2023abc\nQUESTÃO 3\ngeral\nCOMPONENTE ESPECÍFICO\n QUESTAO 10 \num\nQUESTÃO DISCURSIVA 4\nnada\nQUESTÃO 11\ndois\nQUESTÃO 10\noutra vez"
    b = {r["number"]: (r["body"], r["first"]) for r in exams.exam_blocks(spark.createDataFrame([("x", text), ("y", None), ("z", "sem nada")], "exam string, t string"), "exam", "t").collect()}
    assert b == {3: ("\ngeral\nCOMPONENTE ESPECÍFICO", 10), 10: ("\num\n", 10), 11: ("\ndois", 10)} or {k: (v[0].strip(), v[1]) for k, v in b.items()} == {3: ("geral\nCOMPONENTE ESPECÍFICO", 10), 10: ("um", 10), 11: ("dois", 10)}
    k = exams.answer_keys(spark.createDataFrame([("x", "9 A 10-b 11: anulada DISCURSIVA 4 A 10 C 12 F")], "exam string, t string"), "exam", "t")
    assert sorted(map(tuple, k.collect())) == [("x", 9, "A", 0), ("x", 10, "B", 1), ("x", 11, "ANULADA", 0)]


def test_time_is_linear_in_the_block(spark):
    def took(n):
        body = "\n".join(f"{'ABCD'[i % 4]}) linha {i} com algum texto." for i in range(n)) + "\nA) a.\nB) b.\nC) c.\nD) d.\nE) e."
        df = spark.createDataFrame([(body,)], "body string").cache()
        df.count()
        began = time.time()
        o = df.select(exams.split_options(F.col("body")).alias("o")).first()["o"]
        assert list(o["options"]) == ["a.", "b.", "c.", "d.", "e."]
        return time.time() - began

    took(10)
    assert took(32_000) < 15  # over 1 MB


def test_watermarks_and_long_words(spark):
    texts = ["QUESTÃO 9\nxVALIDy fim aINEP2024VALID", "QUESTÃO 9\n" + "x" * 200_000 + " fim", "QUESTÃO 9\n" + "x" * 200_000 + " VALID fim", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "exam int, text string")
    began = time.time()
    got = {r["exam"]: r["body"].split() for r in exams.exam_blocks(df, "exam", "text").collect()}
    assert got == {0: ["fim"], 1: ["x" * 200_000, "fim"], 2: ["x" * 200_000, "fim"]} and time.time() - began < 30  # the square of a word's length before
