import numpy as np
import pytest

from labelmill.llm import ann, queries


def brute(rows, k=5, every=50):
    """{query: [(vec_id, score)]} by comparing all."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = x @ x[q]
        order = [i for i in np.lexsort((ids, -np.round(score, 12))) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall(spark, folder, size):
    folder = folder.replace("sf0.01", size)
    got = by_query(queries.queries()["op2_posting_lists"](spark, folder).collect())
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute(rows)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    vectors = dict(rows)
    for q, found in list(got.items())[:40]:
        a = np.array(vectors[q], float)
        for i, score in found:
            b = np.array(vectors[i], float)
            assert score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_copies_and_blocks(spark, monkeypatch):
    """Two thirds of all rows are one vector; lists are cut into small blocks."""
    monkeypatch.setattr(ann, "_BLOCK", 16)
    monkeypatch.setattr(ann, "_QUERIES", 2)
    monkeypatch.setattr(ann, "VISIT", 9.0)
    draw = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 0.5] if i % 3 else draw.normal(size=3).round(3).tolist()) for i in range(600)]
    got = by_query(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    want = brute(rows)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]),
            (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (100, None), (150, [1e-200, 1e-200]), (10, [1e200, 1e200])]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<double>, id int, kind int, v string")
    got = by_query(ann.nearest(df).collect())
    assert set(got) == {0, 50, 150}
    assert [i for i, _ in got[0]] == [1, 2, 10, 150, 50] and got[0][-1][1] == 0
    assert [i for i, _ in got[150]] == [1, 2, 10, 0, 50] and got[150][0][1] == pytest.approx(1)
    assert ann.nearest(df.where("vec_id = 3")).collect() == []
    assert ann.nearest(df.where("vec_id = 0")).collect() == []


def test_balanced_lists_and_graph():
    draw = np.random.default_rng(4)
    x = ann._unit(np.concatenate([draw.normal(size=(4000, 16)), 0.01 * draw.normal(size=(4000, 16)) + 1]))
    centre = ann.centroids(x, 40)
    sizes = np.bincount((x @ centre.T).argmax(axis=1), minlength=len(centre))
    assert sizes.max() <= 5 * len(x) / 40
    ids, far = ann.Graph(centre).search(x[:300], 20)
    exact = np.argsort(-(x[:300] @ centre.T), axis=1)[:, :5]
    assert np.mean([set(e) <= set(i) for e, i in zip(exact, ids, strict=True)]) > 0.95
    assert (np.diff(far, axis=1) >= 0).all()
    same = ann.centroids(np.tile(x[:1], (500, 1)), 10)
    assert len(same) == 1
