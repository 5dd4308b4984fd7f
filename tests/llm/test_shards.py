import random
import zlib

import pytest
from pyspark.sql import functions as F

from labelmill.llm import queries, shards


def check(rows, n, sizes):
    """Every row once, slots gapless, no sum further from the mean than the largest row."""
    assert sorted(r["size"] for r in rows) == sorted(sizes)
    held, slots = dict.fromkeys(range(n), 0), {}
    for r in rows:
        held[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(abs(x - sum(sizes) / n) for x in held.values()) <= max(sizes, default=0)


def test_query(spark, folder):
    out = queries.queries()["op5_sampled_shards"](spark, folder).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    check(out, queries.SHARDS, [len((t or "").encode()) + 8 for t in docs.values()])
    assert sorted(r["doc_id"] for r in out) == sorted(docs)
    assert all(r["text_crc32"] == zlib.crc32(docs[r["doc_id"]].encode()) and r["law"] == "bytes" and r["grown_shard"] is None for r in out)


@pytest.mark.parametrize("n", [1, 3, 7])
def test_hot_key_and_order(spark, n):
    draw = random.Random(n)
    rows = [(i, 42 if i % 3 else draw.randrange(-1000, 1000), draw.choice([0, 1, 5, 400])) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, key long, size int").repartition(5)
    out = shards.assign(df.withColumnRenamed("size", "w"), n, F.col("w"), F.col("key"), "doc_id").collect()
    check(out, n, [r[2] for r in rows])
    spans = {}
    for r in out:
        if r["key"] != 42:
            spans.setdefault(r["shard"], []).append(r["key"])
    ordered = [spans[s] for s in sorted(spans)]
    assert all(max(a) <= min(b) for a, b in zip(ordered, ordered[1:]))


def test_edges(spark, clash):
    df = clash([(1, "a"), (1, "a"), (None, None), (2, ""), (3, "x" * 300_000)])
    out = shards.assign(df, 4, F.octet_length("text") + 8, F.xxhash64("text"), "doc_id")
    assert [c for c in out.columns if c not in ("shard", "slot", "size")] == [c for c in df.columns if c not in ("shard", "slot", "size")]
    check(out.collect(), 4, [9, 9, 0, 8, 300_008])
    nulls = spark.createDataFrame([(None, None)] * 5 + [(3, 1)], "key long, w long")
    check(shards.assign(nulls, 2, F.col("w"), F.col("key")).collect(), 2, [0, 0, 0, 0, 0, 1])
    zero = spark.createDataFrame([(i,) for i in range(9)], "key long")
    counts = shards.assign(zero, 3, F.lit(0), F.col("key")).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in counts) == [3, 3, 3]
    assert shards.assign(df.where("doc_id = 99"), 4, F.lit(1), F.lit(1)).collect() == []
    with pytest.raises(ValueError):
        shards.assign(df, 0, F.lit(1), F.lit(1))


def test_written_files(spark, tmp_path):
    df = spark.createDataFrame([(i, "t" * (i % 50)) for i in range(500)], "doc_id long, text string")
    out = shards.assign(df, 5, F.length("text"), F.xxhash64("text"), "doc_id")
    shards.write(out, str(tmp_path / "out"), 5, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    want = sorted((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in out.collect())
    assert sorted((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in back.collect()) == want
