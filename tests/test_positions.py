import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from labelmill.operators import positions as po


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(po, "CELL_ROWS", 7)


def test_running_totals_over_many_cells(frame, small_cells):
    rows = [(i, "ab"[i % 3 == 0], i % 5) for i in range(100)] + [(100, None, 3), (101, None, 4)]
    out = po.running(frame(rows, "row_id long, g string, v long"), "row_id", {"s": F.col("v")}, {"m": F.col("v")}, ["g"])
    total, high = {}, {}
    for row in sorted(out.collect(), key=lambda row: row["row_id"]):
        total[row["g"]] = total.get(row["g"], 0) + row["v"]
        high[row["g"]] = max(high.get(row["g"], 0), row["v"])
        assert (row["s"], row["m"]) == (total[row["g"]], high[row["g"]])
    assert out.count() == 102 and out.columns == ["row_id", "g", "v", "s", "m"]


def test_running_treats_null_values_as_nothing(frame, small_cells):
    out = po.running(frame([(i, None if i < 9 else i) for i in range(20)], "row_id long, v long"), "row_id", {"s": F.col("v")}, {"m": F.col("v")})
    rows = {row["row_id"]: row for row in out.collect()}
    assert (rows[3]["s"], rows[3]["m"]) == (0, None)
    assert (rows[19]["s"], rows[19]["m"]) == (sum(range(9, 20)), 19)


def test_row_ids(frame):
    values = random.Random(1).sample(range(1000), 200)
    out = po.row_ids(frame([(value,) for value in values], "v long", 8), [F.desc("v")])
    assert [row["v"] for row in sorted(out.collect(), key=lambda row: row["row_id"])] == sorted(values, reverse=True)
    assert sorted(row["row_id"] for row in out.collect()) == list(range(200))


def test_slices(spark):
    df = spark.range(11).withColumnRenamed("id", "row_id")

    def ids(part):
        return sorted(row["row_id"] for row in part.collect())

    assert ids(po.take_slice(df, 3, 5)) == [3, 4]
    assert ids(po.take_slice(df, 9)) == [9, 10]
    assert ids(po.head_rows(df, 2)) == [0, 1]
    assert ids(po.head_share(df, 0.3)) == [0, 1, 2]
    assert ids(po.head_share(df, 1)) == list(range(11))
    assert ids(po.head_share(df, 0)) == []
    assert ids(po.last_row(df)) == [10]


def test_concat_ranges(spark):
    df = spark.range(10).select(F.col("id").alias("row_id"), F.col("id").alias("old"))
    out = po.concat_ranges(df, [(4, 6), (0, 2), (5, None)])
    assert [row["old"] for row in sorted(out.collect(), key=lambda row: row["row_id"])] == [4, 5, 0, 1, 5, 6, 7, 8, 9]


def plain_batches(n, qc, qc_size, other_size, k):
    control, others = list(range(n))[:qc], list(range(n))[qc:]
    batches = [control[i * qc_size : (i + 1) * qc_size] + others[i * other_size : (i + 1) * other_size] for i in range(k - 1)]
    return batches + [control[(k - 1) * qc_size :] + others[(k - 1) * other_size :]]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 60), st.integers(0, 20), st.integers(1, 6), st.integers(1, 12), st.integers(1, 5))
def test_batches_and_back(spark, n, qc, qc_size, other_size, k):
    df = spark.range(n).withColumnRenamed("id", "row_id")
    dealt = po.qc_batches(df, qc, qc_size, other_size, k)
    rows = dealt.collect()
    found = [
        [row["row_id"] for row in sorted((r for r in rows if r["batch"] == b), key=lambda r: r["batch_pos"])] for b in range(k)
    ]
    assert found == plain_batches(n, qc, qc_size, other_size, k)
    assert all(sorted(r["batch_pos"] for r in rows if r["batch"] == b) == list(range(len(found[b]))) for b in range(k))
    back = po.restore_batches(dealt.withColumnRenamed("row_id", "was"), qc, qc_size, other_size, k)
    assert all(row["row_id"] == row["was"] for row in back.collect())


@pytest.mark.parametrize("n, k, sizes", [(11, 5, [2, 2, 2, 2, 3]), (10, 5, [2] * 5), (3, 5, [0, 0, 0, 0, 3]), (1, 1, [1])])
def test_chunks(spark, n, k, sizes):
    df = spark.range(-1, n).withColumnRenamed("id", "conv_no")
    out = po.chunk_dialogues(df, k)
    counts = {row["chunk"]: row["count"] for row in out.groupBy("chunk").count().collect()}
    assert [counts.get(i, 0) for i in range(k)] == sizes


def test_relabel(spark):
    def part(name, n):
        return po.chunk_dialogues(spark.range(n).withColumnRenamed("id", "conv_no"), 2).withColumn("source", F.lit(name))

    out = po.relabel_dialogues(part("E", 5).unionByName(part("D", 4)))
    order = sorted(out.collect(), key=lambda row: row["new_conv_no"])
    assert [(row["chunk"], row["source"], row["conv_no"]) for row in order] == [
        (0, "D", 0), (0, "D", 1), (0, "E", 0), (0, "E", 1), (1, "D", 2), (1, "D", 3), (1, "E", 2), (1, "E", 3), (1, "E", 4)
    ]
    assert [row["new_conv_no"] for row in order] == list(range(9))


def test_running_over_sparse_ids(frame):
    """64-bit ids give every row a cell of its own; sums and maxima hold, also by group and before the own row."""
    import random

    draw = random.Random(3)
    rows = [(draw.randrange(-(2**62), 2**62), "ab"[i % 2], draw.randrange(100)) for i in range(500)]
    df = frame(rows, "row_id long, g string, v long")
    for own in (True, False):
        out = po.running(df, "row_id", {"s": F.col("v")}, {"m": F.col("v")}, ["g"], own=own).collect()
        for r in out:
            before = [v for i, g, v in rows if g == r["g"] and (i < r["row_id"] or own and i == r["row_id"])]
            assert (r["s"], r["m"]) == (sum(before), max(before, default=None))
        assert len(out) == 500
