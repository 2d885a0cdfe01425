"""The pipeline: each stage acts on the one before, and what comes out is packed whole."""

import zlib

import numpy as np

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(3)
    words = [f"word{chr(97 + i // 25)}{chr(97 + i % 25)}" for i in range(500)]
    rows = [(i, " ".join(rng.choice(words, 90)) + "\n" + "the same long boilerplate line in all of the documents", "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s0", 0), (101, " ".join(rows[1][1].split()[:-1]), "en", "s1", 0), (102, "*** $$$ &&& " * 60, "en", "s2", 0), (103, None, None, None, None), (104, "short", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id for r in out.select("doc_id").collect()})
    assert seen[0] == {*range(60), 100, 101}
    assert 100 not in seen[1] and set(range(60)) <= seen[1]
    assert 101 not in seen[2] and set(range(60)) <= seen[2]
    assert seen[3] <= seen[2] and seen[4] == seen[3]
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in again.collect()} == seen[4] and zlib.crc32(b"") == 0
