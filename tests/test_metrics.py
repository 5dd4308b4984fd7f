import math
import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from labelmill.operators import metrics as me, positions as po

LABELS = ["a", "b", "c"]
value = st.sampled_from(["a", "b", "c", "x", None])


def plain_report(rows, labels):
    lines, scores = {}, []
    for label in labels:
        hits = sum(g == p == label for g, p in rows)
        said, support = sum(p == label for _, p in rows), sum(g == label for g, _ in rows)
        line = (hits / said if said else 0.0, hits / support if support else 0.0,
                2 * hits / (said + support) if said + support else 0.0, support)
        lines[label] = line
        scores.append((hits, said, support))
    hits, said, support = (sum(part) for part in zip(*scores))
    if all(g in labels and p in labels for g, p in rows):
        share = sum(g == p for g, p in rows) / len(rows)
        lines["accuracy"] = (share, share, share, support)
    else:
        lines["micro avg"] = (hits / said if said else 0.0, hits / support if support else 0.0,
                              2 * hits / (said + support) if said + support else 0.0, support)
    lines["macro avg"] = (*[sum(lines[label][i] for label in labels) / len(labels) for i in range(3)], support)
    lines["weighted avg"] = (
        *[sum(lines[label][i] * lines[label][3] for label in labels) / support if support else 0.0 for i in range(3)], support
    )
    return lines


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(value, value), min_size=1, max_size=30))
def test_report_equals_the_plain_counts(spark, rows):
    df = spark.createDataFrame(rows, "g string, p string")
    out = me.classification_report(df, "g", "p", LABELS).orderBy("ordinal").collect()
    expected = plain_report(rows, LABELS)
    assert [row["label"] for row in out] == list(expected)
    for row in out:
        assert (row["precision"], row["recall"], row["f1"], row["support"]) == pytest.approx(expected[row["label"]], abs=1e-12)
    matrix = {row["label"]: [row[label] for label in LABELS] for row in me.confusion_matrix(df, "g", "p", LABELS).collect()}
    assert matrix == {true: [rows.count((true, said)) for said in LABELS] for true in LABELS}
    assert me.accuracy(df, "g", "p").first()["accuracy"] == pytest.approx(
        sum(g == p and g is not None for g, p in rows) / len(rows)
    )


def test_report_per_run_equals_separate_reports(frame):
    rows = [(run, random.Random(i).choice("abx"), random.Random(-i).choice("abc")) for i in range(200) for run in (f"r{i % 3}",)]
    df = frame(rows, "run string, g string, p string")
    together = me.classification_report(df, "g", "p", LABELS, ["run"]).where("run = 'r1'").drop("run")
    alone = me.classification_report(df.where("run = 'r1'"), "g", "p", LABELS)
    assert together.exceptAll(alone).isEmpty() and together.count() == alone.count() == 6


def test_several_targets_at_once(frame):
    df = frame([("a", "a", "b"), ("b", "a", "b")], "g string, p string, q string")
    both = me.target_reports(df, {"first": ("g", "p", LABELS), "second": ("g", "q", ["b"])})
    for name, (pred, labels) in {"first": ("p", LABELS), "second": ("q", ["b"])}.items():
        mine = both.where(F.col("target") == name).drop("target")
        assert mine.exceptAll(me.classification_report(df, "g", pred, labels)).isEmpty()


def test_labels_seen_in_the_data(frame):
    rows = [("a", "a"), ("a", "none"), ("b", "b"), ("b", "a")]
    out = {row["label"]: row for row in me.classification_report(frame(rows, "g string, p string"), "g", "p").collect()}
    expected = plain_report(rows, ["a", "b", "none"])
    assert set(out) == set(expected)
    for label, line in expected.items():
        assert (out[label]["precision"], out[label]["recall"], out[label]["f1"], out[label]["support"]) == pytest.approx(line)


def test_number_labels_and_odd_names(frame):
    df = frame([(1, 1), (0, 1)], "`golden emotion` int, p int")
    out = {row["label"]: row for row in me.classification_report(df, "golden emotion", "p", [0, 1]).collect()}
    assert out["1"]["recall"] == 1.0 and out["accuracy"]["f1"] == 0.5
    quoted = frame([("it's \\ odd", "it's \\ odd")], "g string, p string")
    assert me.accuracy_by_label(quoted, "g", "p", ["it's \\ odd"]).first()["accuracy"] == 1.0


def test_no_rows(frame):
    out = me.classification_report(frame([], "g string, p string"), "g", "p", ["a"]).collect()
    assert [(row["label"], row["f1"], row["support"]) for row in out] == [
        ("a", 0.0, 0), ("accuracy", 0.0, 0), ("macro avg", 0.0, 0), ("weighted avg", 0.0, 0)
    ]


def test_accuracy_by_label(frame):
    df = frame([("a", "a"), ("a", None), ("b", "a"), (None, "a")], "g string, p string")
    listed = {row["label"]: row["accuracy"] for row in me.accuracy_by_label(df, "g", "p", ["a", "b", "z"]).collect()}
    assert listed == {"a": 0.5, "b": 0.0, "z": None}
    seen = {row["label"]: row["accuracy"] for row in me.accuracy_by_label(df, "g", "p").collect()}
    assert seen == {"a": 0.5, "b": 0.0}


def test_value_counts(frame):
    out = me.value_counts(frame([("b",), ("a",), ("b",), (None,), ("c",)], "v string"), "v").collect()
    assert [tuple(row) for row in out] == [("b", 2), ("a", 1), ("c", 1)]


def plain_kappa(table):
    n = sum(table[0])
    agreement = [(sum(k * k for k in row) - n) / (n * (n - 1)) for row in table]
    shares = [sum(column) / (len(table) * n) for column in zip(*table)]
    chance = sum(share * share for share in shares)
    return (sum(agreement) / len(table) - chance) / (1 - chance)


def test_kappa(frame):
    draw = random.Random(3)
    rows = [(i, *(draw.choice("abc") for _ in range(3))) for i in range(60)]
    df = frame(rows, "id long, r1 string, r2 string, r3 string")
    raters = ["r1", "r2", "r3"]
    table = [[row[1:].count(label) for label in LABELS] for row in rows]
    counted = me.rating_table(df, ["id"], raters, LABELS).orderBy("id").collect()
    assert [[row[label] for label in LABELS] for row in counted] == table
    out = me.fleiss_kappa(df, raters).first()
    assert out["kappa"] == pytest.approx(plain_kappa(table), abs=1e-12) and out["subjects"] == 60
    long = {(row["id"], row["label"]): row["n"] for row in me.rating_counts(df, "id", raters).collect()}
    assert long == {(i, label): k for i, row in enumerate(table) for label, k in zip(LABELS, row) if k}


def test_kappa_edges(frame):
    schema = "id long, r1 string, r2 string"
    assert me.fleiss_kappa(frame([(0, "a", "a"), (1, "b", "b")], schema), ["r1", "r2"]).first()["kappa"] == 1.0
    assert me.fleiss_kappa(frame([(0, "a", "a")], schema), ["r1", "r2"]).first()["kappa"] is None
    holed = me.fleiss_kappa(frame([(0, "a", "a"), (1, "b", "b"), (2, "a", None)], schema), ["r1", "r2"]).first()
    assert tuple(holed) == (2, 1, 1.0)
    with pytest.raises(ValueError):
        me.fleiss_kappa(frame([], schema), ["r1"])


@pytest.mark.parametrize("values", [[5], [1, 2], [3, 1, 2, 10], list(range(1, 400)) + [7] * 500, [0.5, -2.25, None, 8.0]])
def test_describe(frame, values):
    out = me.describe(frame([(None if v is None else float(v),) for v in values], "v double"), "v").first()
    given = sorted(float(v) for v in values if v is not None)

    def quantile(share):
        place = share * (len(given) - 1)
        low = int(place)
        return given[low] + (given[min(low + 1, len(given) - 1)] - given[low]) * (place - low)

    assert out["count"] == len(given) and (out["min"], out["max"]) == (given[0], given[-1])
    assert (out["p25"], out["p50"], out["p75"]) == pytest.approx((quantile(0.25), quantile(0.5), quantile(0.75)))
    assert out["mean"] == pytest.approx(statistics.fmean(given))
    assert out["std"] == (pytest.approx(statistics.stdev(given)) if len(given) > 1 else None)


def test_describe_whole_numbers_exactly(spark):
    values = [(i * i * 7919) % 100_000_007 for i in range(5003)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    n, total = len(values), sum(values)
    # The nearest doubles, by whole numbers.
    std = math.sqrt((n * sum(v * v for v in values) - total * total) / (n * (n - 1)))
    for parts in (1, 3, 8, 29):
        out = me.describe(df.repartition(parts), "v").first()
        assert (out["mean"], out["std"]) == (total / n, std)


def test_describe_beyond_exact_sums(frame):
    values = [2**62, -(2**62), 2**62 - 1, 5]
    out = me.describe(frame([(v,) for v in values], "v long"), "v").first()
    assert out["std"] == pytest.approx(statistics.stdev(map(float, values))) and out["mean"] == pytest.approx(statistics.fmean(values))
    single = me.describe(frame([(7,)], "v int"), "v").first()
    assert (single["mean"], single["std"]) == (7.0, None)


def test_describe_nothing(frame):
    out = me.describe(frame([], "v double"), "v").first()
    assert out["count"] == 0 and out["p50"] is None and out["mean"] is None


def test_distinct_values(frame):
    one, two = frame([("a",), ("b",)], "x string"), frame([("b",), ("c",)], "y string")
    assert sorted(row["label"] for row in me.distinct_values((one, "x"), (two, "y")).collect()) == ["a", "b", "c"]
