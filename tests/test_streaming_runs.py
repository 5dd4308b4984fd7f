"""Runs that are scored as their files arrive."""

import shutil

from labelmill import fixed_values as fixed
from labelmill.sinks import versions
from labelmill.streaming import runs

HEAD = f"text,{fixed.SENTIMENT_COLUMN},{fixed.EMOTION_COLUMN}\n"


def gold(spark, n=3):
    rows = [("posts", i, "positive" if i < 2 else "negative", "anger") for i in range(n)]
    return spark.createDataFrame(rows, "dataset string, row_id long, voted_sentiment string, voted_emotion string")


def store(root, model, said, name="predictions.csv", dataset="posts"):
    place = root / dataset / model / "t=0"
    (place / name).parent.mkdir(parents=True, exist_ok=True)
    (place / name).write_text(HEAD + "".join(f"x,{s},anger\n" for s in said))


def accuracy(spark, path):
    rows = runs.latest_reports(spark, path).where("target = 'sentiment' and label = 'weighted avg'").collect()
    return {r["model_id"]: round(r["recall"], 3) for r in rows}


def test_late_runs_are_scored_once(spark, tmp_path):
    root, out, state = tmp_path / "runs", f"{tmp_path}/reports", f"{tmp_path}/state"
    store(root, "a", ["positive", "positive", "negative"])
    store(root, "other", ["positive"], dataset="unknown")
    runs.score_available(spark, str(root), gold(spark), out, state)
    assert accuracy(spark, out) == {"a": 1.0} and versions.versions(spark, out) == [1]
    runs.score_available(spark, str(root), gold(spark), out, state)
    assert versions.versions(spark, out) == [1]
    # A finished run is not read again, even if its file is gone.
    shutil.rmtree(root / "posts" / "a")
    store(root, "b", ["positive", "negative"])  # short: the third is wrong
    runs.score_available(spark, str(root), gold(spark), out, state)
    assert accuracy(spark, out) == {"a": 1.0, "b": 0.333} and versions.versions(spark, out) == [1, 2]


def test_changed_runs_and_repeated_batches(spark, tmp_path):
    root, out = tmp_path / "runs", f"{tmp_path}/reports"
    store(root, "a", ["negative", "negative", "negative"], "predictions.csv/part-00000-one.csv")
    runs.score_available(spark, str(root), gold(spark), out, f"{tmp_path}/state")
    # A stream that has lost its checkpoint meets the same files and adds nothing.
    runs.score_available(spark, str(root), gold(spark), out, f"{tmp_path}/other")
    assert accuracy(spark, out) == {"a": 0.333} and versions.versions(spark, out) == [1]
    (root / "posts/a/t=0/predictions.csv/part-00000-one.csv").unlink()
    store(root, "a", ["positive", "positive", "negative"], "predictions.csv/part-00000-two.csv")
    runs.score_available(spark, str(root), gold(spark), out, f"{tmp_path}/state")
    assert accuracy(spark, out) == {"a": 1.0} and versions.versions(spark, out) == [1, 2]


def test_small_batches_and_no_runs(spark, tmp_path):
    root, out = tmp_path / "runs", f"{tmp_path}/reports"
    root.mkdir()
    assert runs.latest_reports(spark, out).collect() == []
    for model in "abc":
        store(root, model, ["positive"] * 3)
    runs.score_available(spark, str(root), gold(spark), out, f"{tmp_path}/state", per_batch=1)
    assert accuracy(spark, out) == dict.fromkeys("abc", 0.667) and len(versions.versions(spark, out)) == 3
