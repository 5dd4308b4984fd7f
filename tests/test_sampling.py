import hashlib
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from labelmill import settle
from labelmill.operators import positions as po, sampling as sa


def key(row_id, seed):
    return hashlib.md5(f"{row_id}-{seed}".encode()).hexdigest(), row_id


@pytest.fixture
def classes(frame):
    rows = [(i, "big" if i % 10 else ("mid" if i % 20 else "rare")) for i in range(400)]
    return frame(rows, "row_id long, label string", 5), rows


def splits(df):
    return {row["row_id"]: row["split"] for row in df.collect()}


def test_stratified_split(classes):
    df, rows = classes
    found = splits(sa.stratified_split(df, "label", 0.7))
    assert sorted(found) == list(range(400))
    trained = [row_id for row_id, split in found.items() if split == "train"]
    assert len(trained) == 400 - 280
    for label, share in (("big", 108), ("mid", 6), ("rare", 6)):
        mine = sorted((row_id for row_id, name in rows if name == label), key=lambda row_id: key(row_id, 88))
        assert {row_id for row_id in trained if dict(rows)[row_id] == label} == set(mine[:share])
    assert splits(sa.stratified_split(df.repartition(2), "label", 0.7)) == found


@pytest.mark.parametrize("test, trained", [(0, 400), (1, 0), (0.999, 0)])
def test_extreme_shares(classes, test, trained):
    assert list(splits(sa.stratified_split(classes[0], "label", test, min_class=0)).values()).count("train") == trained


def test_equal_remainders_and_single_rows(frame):
    df = frame([(i, f"c{i // 3}") for i in range(12)], "row_id long, label string")
    out = sa.stratified_split(df, "label", 0.5)
    counts = {row["label"]: row["count"] for row in out.where("split = 'train'").groupBy("label").count().collect()}
    assert counts == {"c0": 2, "c1": 2, "c2": 1, "c3": 1}
    lonely = frame([(0, "a"), (1, "a"), (2, "b")], "row_id long, label string")
    with pytest.raises(ValueError):
        sa.stratified_split(lonely, "label")
    assert len(splits(sa.stratified_split(lonely, "label", min_class=1))) == 3


def test_named_splits(classes):
    parts = sa.with_validation(sa.stratified_split(classes[0], "label"))
    assert list(parts) == ["train", "validation", "test"]
    assert parts["validation"].exceptAll(parts["test"]).isEmpty() and parts["train"].count() == 120


def test_many_classes_without_a_broadcast(classes, monkeypatch):
    df, _ = classes
    expected = splits(sa.stratified_split(df, "label"))
    monkeypatch.setattr(settle.lookup, "__defaults__", (*settle.lookup.__defaults__[:-1], 0))
    monkeypatch.setattr(settle.broadcast_if_small, "__defaults__", (0,))
    assert splits(sa.stratified_split(df, "label")) == expected


def test_null_class(frame):
    df = frame([(i, None if i % 2 else "a") for i in range(20)], "row_id long, label string")
    assert list(splits(sa.stratified_split(df, "label", 0.5)).values()).count("train") == 10


def test_fixed_split(classes):
    df, rows = classes
    found = splits(sa.fixed_split(df, "label", 5, 7))
    for label in ("big", "mid", "rare"):
        mine = sorted((row_id for row_id, name in rows if name == label), key=lambda row_id: key(row_id, 42))
        assert [found[row_id] for row_id in mine] == ["train"] * 5 + ["test"] * 7 + ["rest"] * (len(mine) - 12)
    with pytest.raises(ValueError):
        sa.fixed_split(df, "label", 15, 7)
    assert list(splits(sa.fixed_split(df, "label", 0, 1)).values()).count("train") == 0


def test_random_split(classes):
    found = splits(sa.random_split(classes[0], 0.15))
    order = sorted(found, key=lambda row_id: key(row_id, 42))
    assert [found[row_id] for row_id in order] == ["train"] * 340 + ["test"] * 60


def test_bootstrap(frame):
    rows = [(i, "big" if i else "one") for i in range(30)]
    out = sa.bootstrap(frame(rows, "row_id long, label string"), "label", 50).collect()
    assert sorted((row["label"], row["draw"]) for row in out) == sorted((label, i) for label in ("big", "one") for i in range(50))
    assert len({row["row_id"] for row in out if row["label"] == "big"}) < 30
    assert {row["row_id"] for row in out if row["label"] == "one"} == {0}


def test_shuffle(spark):
    df = spark.range(300).withColumnRenamed("id", "row_id")
    expected = sorted(range(300), key=lambda row_id: key(row_id, 14))
    assert [row["row_id"] for row in sa.seeded_shuffle(df).collect()] == expected
    placed = sa.shuffled_positions(df.repartition(7), 14)
    assert [row["row_id"] for row in sorted(placed.collect(), key=lambda row: row["position"])] == expected


def plain_walk(rows, quotas, cap, carried, carried_size):
    counts, size, kept = {name: carried.get(name, 0) for name in quotas}, carried_size, []
    for row_id, stratum, length in rows:
        if size >= cap or all(counts[name] >= quota for name, quota in quotas.items()):
            break
        if stratum in quotas and counts[stratum] < quotas[stratum]:
            counts[stratum] += 1
            size += length
            kept.append(row_id)
    return kept


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from("CDX"), st.integers(0, 6)), max_size=40),
    st.floats(0, 12), st.floats(0, 12), st.integers(0, 60), st.integers(0, 4), st.integers(0, 10),
)
def test_quota_walk_equals_the_plain_loop(spark, rows, c, d, cap, carried_c, carried_size):
    numbered = [(i, stratum, size) for i, (stratum, size) in enumerate(rows)]
    df = spark.createDataFrame(numbered, "row_id long, stratum string, size long")
    before = po.CELL_ROWS
    po.CELL_ROWS = 5
    try:
        out = sa.quota_sample(df, "stratum", "size", {"C": c, "D": d}, cap, carried={"C": carried_c}, carried_size=carried_size)
        found = sorted(row["row_id"] for row in out.collect())
    finally:
        po.CELL_ROWS = before
    assert found == plain_walk(numbered, {"C": c, "D": d}, cap, {"C": carried_c}, carried_size)


def test_unlimited_quota(frame):
    df = frame([(i, "C", 1) for i in range(10)], "row_id long, stratum string, size long")
    assert sa.quota_sample(df, "stratum", "size", {"C": float("inf")}, 4).count() == 4
    assert sa.quota_sample(df, "stratum", "size", {"C": 0}, 4).count() == 0


def test_quotas():
    quotas = sa.strata_quotas(3000 / (6547 / 600), {"C": 1, "D": 5})
    assert quotas["C"] == pytest.approx(46.8225, abs=1e-4) and quotas["D"] == pytest.approx(230.1126, abs=1e-4)


def test_samples_do_not_depend_on_partitions(frame):
    rows = [(i, random.Random(i).choice("ab")) for i in range(100)]
    one = sa.bootstrap(frame(rows, "row_id long, label string", 1), "label", 20)
    many = sa.bootstrap(frame(rows, "row_id long, label string", 9), "label", 20)
    assert one.exceptAll(many).isEmpty()


def test_refused_draws_and_splits(frame):
    rows = frame([(i, "ab"[i % 2]) for i in range(20)], "row_id long, label string")
    assert sa.bootstrap(rows, "label", 0).collect() == []
    with pytest.raises(ValueError):
        sa.bootstrap(rows, "label", -1)
    for share in (0.99, 0.01):
        with pytest.raises(ValueError):
            sa.stratified_split(rows, "label", share)
    assert sa.stratified_split(rows, "label", 0.99, min_class=0).count() == 20


def test_walk_reads_no_further_than_it_goes(spark, monkeypatch):
    """Rows behind the end of the walk are not looked at: there each one is an error."""
    monkeypatch.setattr(sa, "FIRST_IDS", 8)
    fatal = F.when(F.col("id") >= 56, F.raise_error(F.lit("read too far"))).otherwise(F.lit(2)).cast("long")
    df = spark.range(10_000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 2 == 0, "C").otherwise("D").alias("stratum"), fatal.alias("size"))
    by_quota = sa.quota_sample(df, "stratum", "size", {"C": 10, "D": 12}, 10**9)
    assert sorted(r["row_id"] for r in by_quota.collect()) == sorted([*range(0, 20, 2), *range(1, 24, 2)])
    by_cap = sa.quota_sample(df, "stratum", "size", {"C": float("inf"), "D": 3}, 50)
    kept = [r["row_id"] for r in by_cap.orderBy("row_id").collect()]
    assert kept == sorted([*range(1, 6, 2), *range(0, 44, 2)])
    with pytest.raises(Exception, match="read too far"):
        sa.quota_sample(df, "stratum", "size", {"C": 60, "D": 60}, 10**9).collect()


def test_large_cells_are_counted_by_further_digits(frame, monkeypatch):
    rows = frame([(i, "ab"[i % 3 == 0]) for i in range(300)], "row_id long, label string")
    want = {name: sorted(map(tuple, df.collect())) for name, df in (("b", sa.bootstrap(rows, "label", 40)), ("s", sa.stratified_split(rows, "label", 0.4)))}
    for digits, leaf in ((1, 2), (2, 1)):
        monkeypatch.setattr(sa, "KEY_DIGITS", digits)
        monkeypatch.setattr(sa, "LEAF_ROWS", leaf)
        assert sorted(map(tuple, sa.bootstrap(rows, "label", 40).collect())) == want["b"]
        assert sorted(map(tuple, sa.stratified_split(rows, "label", 0.4).collect())) == want["s"]
