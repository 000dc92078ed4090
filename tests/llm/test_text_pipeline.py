"""The pipeline on a small corpus: what each stage must drop, replace and keep."""

import hashlib

import numpy as np
from pyspark.sql import functions as F


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from quizmill.llm import bpecodec

    words = [f"word{i}" for i in range(400)]
    base = lambda k, n=60: " ".join(words[(k * 37 + i * (k % 7 + 1)) % 400] for i in range(n))
    bench = " ".join(f"test{i}" for i in range(30))
    rows = [(i, base(i), "en", "s") for i in range(12)]
    rows += [(100, None, "en", "s"), (101, "", "en", "s"), (102, "12 34 ...", "en", "s"), (103, base(3), "en", "s"), (104, base(4) + " extra", "fr", "s"), (105, bench, "en", "s"), (106, base(20) + " password = hunter22x", "en", "s"), (107, base(21, 900) + " " + bench[:60], "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, str(tmp_path)).cache()
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "encoding":
            assert docs.columns == df.columns and [t for _, t in docs.dtypes] == [t for _, t in df.dtypes]
    assert set(seen["language_id"]) == {*range(12), 103, 104, 105, 106, 107}
    assert set(seen["near_duplicates"]) == {*range(12), 105, 106, 107}
    assert set(seen["decontamination"]) == set(seen["secrets"]) == set(seen["encoding"]) == {*range(12), 106, 107}
    assert seen["secrets"][106]["text"] == base(20) + " [secret]" and seen["secrets"][106]["n_chars"] == len(base(20)) + 9
    assert seen["secrets"][1]["text"] == base(1)
    lib = Tokenizer.from_file(bpecodec.vocabulary())
    for k, r in seen["encoding"].items():
        ids = lib.encode(seen["secrets"][k]["text"], add_special_tokens=False).ids
        assert r["ids"] == ids and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"]: r["ids_sha256"] for r in whole.collect()} == {k: r["ids_sha256"] for k, r in seen["encoding"].items()}
