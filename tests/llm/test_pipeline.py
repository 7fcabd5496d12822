"""The stages of the pipeline over a small table, each held against a plain version."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from test_operators import plain_classes, plain_targets, prose, words

import corpus_pipeline


def write(spark, make, at):
    r = random.Random(6)
    item = prose(999, 25, 4000)
    docs = []
    for i in range(300):
        own = prose(i, 40 + i % 20, 3000).translate(str.maketrans("0123456789", "aeioubcdfg")).split()
        if i % 5 == 0:
            own.insert(10, "vilest")
        docs.append((i, " ".join(own), f"s{i % 4}"))
    docs += [(400, docs[7][1], "s1"), (401, docs[8][1], "s2"), (402, prose(1234, 20) + " " + item, "s3"), (403, None, "s0"), (404, "", None)]
    make(docs).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return docs


def test_stages(spark, make, tmp_path):
    docs = write(spark, make, tmp_path)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = df
        df = stage(spark, df, str(tmp_path)).cache()
        seen.append((before.select("doc_id", "text", "source").collect(), df.collect()))
        if name != "sharding":
            assert df.columns == before.columns
    ids = lambda x: sorted(r["doc_id"] for r in x)
    toxic, near, leak, mix, shard = seen
    assert ids(toxic[1]) == [i for i, t, _ in docs if not (t and "vilest" in t)]
    classes = plain_classes([(r["doc_id"], r["text"]) for r in near[0]])
    assert ids(near[1]) == sorted({c for _, _, c in classes})
    assert ids(leak[1]) == [i for i in ids(near[1]) if i != 402]
    size, got = {}, {}
    for r in mix[0]:
        size[r["source"]] = size.get(r["source"], 0) + len(words(r["text"]))
    for r in mix[1]:
        got[r["source"]] = got.get(r["source"], 0) + len(words(r["text"]))
    assert {s: n for s, n in got.items() if n} == {s: int(t + 1e-6) for s, t in plain_targets(size).items() if t}
    assert sorted((r["doc_id"], r["text"] or "") for r in shard[0]) == sorted((r["doc_id"], r["text"] or "") for r in shard[1])
    counts = [sum(r["shard"] == k for r in shard[1]) for k in range(24)]
    assert max(counts) - min(counts) <= 1


def test_run_equals_its_stages(spark, make, tmp_path):
    write(spark, make, tmp_path)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path))
    key = lambda r: repr(tuple(r))
    assert sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=key) == sorted(df.collect(), key=key)


def test_stages_without_labels_items_or_rows(spark, make, tmp_path):
    odd = [(None, None, None), (None, "a b", "s"), (1, "a b", "s"), (1, "a b", "s"), (2, "", "t")]
    for name, rows in (("rows", odd), ("none", [])):
        at = tmp_path / name
        make(rows).withColumn("shard", F.lit("mine")).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        out = corpus_pipeline.run(spark, str(at))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
        got = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert set(got) == ({(1, "a b"), (2, "")} if rows else set())
