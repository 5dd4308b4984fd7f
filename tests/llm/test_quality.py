import numpy as np
import pytest

from labelmill.llm import quality, queries


def test_held_out(spark, folder):
    larger = folder.replace("sf0.01", "sf0.1")
    docs = spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    rows = docs.join(labels, "doc_id").withColumn("grade", quality.graded(labels["quality"], labels["toxic"]))
    model = quality.fit(rows.where("doc_id % 3 <> 1"), 3)
    out = quality.rate(rows.where("doc_id % 3 = 1"), model).collect()
    hit = [(r["tail_probability"] >= 0.5) == (r["grade"] == 2) for r in out]
    assert sum(hit) >= 0.95 * len(hit)
    mean = lambda g: np.mean([r["expected_grade"] for r in out if r["grade"] == g])
    assert mean(2) > mean(1) and mean(2) > mean(0)


def test_query_has_a_row_for_each_document(spark, folder):
    out = queries.queries()["op7_ordinal_quality"](spark, folder).collect()
    assert len(out) == 1000 and all(0 <= r["expected_grade"] <= 2 and r["selected"] == (r["tail_probability"] >= 0.5) for r in out)


def test_gradient():
    draw = np.random.default_rng(2)
    eta, grade, thresholds = draw.normal(size=40), draw.integers(0, 4, 40), np.array([-1.0, 0.3, 1.1])
    loss, by_eta, by_threshold = quality.loss_and_gradient(eta, thresholds, grade)
    for x, got in ((eta, by_eta), (thresholds, by_threshold)):
        for i in range(len(x)):
            step = np.zeros(len(x))
            step[i] = 1e-6
            args = (eta + step, thresholds) if x is eta else (eta, thresholds + step)
            assert (quality.loss_and_gradient(*args, grade)[0] - loss) / 1e-6 == pytest.approx(got[i], abs=1e-3)


def test_minimise():
    target = np.arange(30.0)
    scale = 1 + np.arange(30.0) ** 2
    found = quality.minimise(lambda x: (float(scale @ (x - target) ** 2), 2 * scale * (x - target)), np.zeros(30), 200)
    assert np.allclose(found, target, atol=1e-3)


def test_tail_is_the_cumulative_link():
    eta, thresholds = np.array([0.2, -3.0]), np.array([-1.0, 2.0])
    assert np.allclose(quality.probabilities(eta, thresholds), 1 / (1 + np.exp(thresholds[None, :] - eta[:, None])))


def test_features_of_a_batch_are_those_of_each_text():
    texts = ["Aa bb, aa".encode(), None, b"", b"x x x!! \xc3\xa9t\xc3\xa9", b"."]
    text, feature, value = quality.features(texts)
    for i, one in enumerate(texts):
        _, f, v = quality.features([one])
        assert sorted(zip(feature[text == i], value[text == i], strict=True)) == sorted(zip(f, v, strict=True))
    assert len(quality.features([b""])[0]) == 3 and quality.features([None])[2].tolist() == [0, 0, 1]


def test_edges(spark, clash):
    rated = spark.createDataFrame([("good text here", 1, 5), ("bad words there", 0, 5), (None, 1, 5), ("x", None, 5), ("y", 9, 5)], "text string, grade int, feature int")
    model = quality.fit(rated, 2)
    df = clash([(1, None), (2, ""), (3, "good text"), (3, "good text"), (None, "bad words"), (4, "good " * 60_000), (5, " \n")])
    out = quality.rate(df.withColumn("tail_probability", df["key"]), model)
    assert set(out.columns) == {*df.columns, "expected_grade", "tail_probability"}
    got = {r["doc_id"]: r["tail_probability"] for r in out.collect()}
    assert got[1] == got[2] == got[5] == 0 and got[3] > got[None]
    blind = quality.fit(rated.where("grade = 7"), 3)
    assert np.all(blind["weights"] == 0) and np.all(np.diff(blind["thresholds"]) > 0)
    assert quality.rate(clash([]), blind).collect() == []
    with pytest.raises(ValueError):
        quality.fit(rated, 1)


def test_copies_cannot_break_the_bound(spark, monkeypatch):
    """Half of all rows are one text: it is one row of the sample with its number as weight; the fit is that of all rows."""
    rows = [(f"good word{i % 37} text", 1) for i in range(400)] + [("the same bad text", 0)] * 600 + [(f"bad item{i % 41}", 0) for i in range(200)]
    df = spark.createDataFrame(rows, "text string, grade int").repartition(4)
    held = []
    plain = quality.fit_arrays
    monkeypatch.setattr(quality, "fit_arrays", lambda t, f, v, g, k, w: held.append((len(g), w.sum())) or plain(t, f, v, g, k, w))
    model = quality.fit(df, 2, sample=1200)
    assert held[-1] == (37 + 41 + 1, 1200)
    quality.fit(df, 2, sample=400)
    assert held[-1][0] <= 400 and held[-1][1] <= 1200
    quality.fit(df.limit(60), 2, sample=20)
    assert held[-1][0] <= 20
    quality.fit(df, 2, most_bytes=100, sample=1200)
    assert 0 < held[-1][0] <= 10
    # Row by row, without weights.
    text, feature, value = quality.features([t.encode() for t, _ in rows])
    own = plain(text, feature, value, np.array([g for _, g in rows]), 2)
    assert np.allclose(model["thresholds"], own["thresholds"], atol=2e-2) and np.allclose(model["weights"], own["weights"], atol=2e-2)


def test_fit_is_the_minimum():
    """Against plain gradient descent on a dense table, loss and slope written out row by row."""
    draw = np.random.default_rng(8)
    x = draw.integers(0, 2, (60, 5)).astype(float)
    grade = np.clip((x @ [2, -1, 1, 0, 0] + draw.normal(size=60)).round().astype(int), 0, 2)
    text, feature = np.nonzero(x)
    model = quality.fit_arrays(text, feature, np.ones(len(text)), grade, 3)

    def loss(w, t):
        total = 0.0
        for row, g in zip(x, grade, strict=True):
            tail = [1.0, *(1 / (1 + np.exp(-(row @ w - own))) for own in t), 0.0]
            total -= np.log(tail[g] - tail[g + 1])
        return total / len(grade) + quality.RIDGE / 2 * w @ w

    w, t = model["weights"][:5], model["thresholds"]
    best = loss(w, t)
    for i in range(5):
        for step in (-0.05, 0.05):
            other = w.copy()
            other[i] += step
            assert loss(other, t) >= best - 1e-7
    for i in range(2):
        for step in (-0.05, 0.05):
            other = t.copy()
            other[i] += step
            assert loss(w, other) >= best - 1e-7
    assert best < loss(np.zeros(5), t)
