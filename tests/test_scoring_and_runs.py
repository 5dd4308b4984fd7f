import pytest
from pyspark.sql import functions as F

from labelmill import fixed_values as fixed
from labelmill.batches import BATCH_BYTES, small_batches
from labelmill.operators import runs, scoring
from labelmill.plans.predict import predict_posts


def make_counting_scorer():
    def factory():
        sizes = []

        def score(asked):
            sizes.append(len(asked))
            return [f"{len(sizes)}:{len(asked)}:{prompt}" for prompt in asked]

        return score

    return factory


def test_batches(spark):
    df = spark.range(70).select("id", F.concat(F.lit("p"), F.col("id")).alias("prompt")).coalesce(1)
    out = scoring.batch_score(df, {"prompt": "raw"}, make_counting_scorer()).orderBy("id").collect()
    assert [row["raw"] for row in out] == [f"{i // 32 + 1}:{32 if i < 64 else 6}:p{i}" for i in range(70)]


def test_batches_are_bounded_in_bytes(spark):
    def factory():
        return lambda asked: [str(sum(map(len, asked)))] * len(asked)

    df = spark.range(3000).select("id", F.repeat(F.lit("x"), 10_000).alias("prompt")).coalesce(1)
    out = scoring.batch_score(df, {"prompt": "raw"}, factory, 10_000).select("id", F.col("raw").cast("long").alias("sent"))
    seen = out.agg(F.max("sent"), F.count("*")).first()
    assert seen[0] <= 1.1 * BATCH_BYTES and seen[1] == 3000


def test_a_smaller_limit_stays(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        for given, then in (("1m", "1m"), ("64m", str(BATCH_BYTES)), ("2000000", "2000000")):
            spark.conf.set(limit, given)
            small_batches(spark)
            assert spark.conf.get(limit) in (then, f"{then}b")
    finally:
        spark.conf.unset(limit)


def test_null_prompts_and_other_columns(frame):
    df = frame([(0, None, [1]), (1, "a", None)], "id long, prompt string, keep array<int>", 1)
    out = scoring.batch_score(df, {"prompt": "raw"}, make_counting_scorer()).orderBy("id").collect()
    assert [tuple(row) for row in out] == [(0, None, [1], None), (1, "a", None, "1:1:a")]


def test_wrong_number_of_answers(frame):
    def factory():
        return lambda asked: asked[1:]

    with pytest.raises(Exception, match="answers"):
        scoring.batch_score(frame([("a",)], "prompt string"), {"prompt": "raw"}, factory).collect()


def make_scorer(emotion, sentiment):
    def factory():
        return lambda asked: [emotion if "emotional classifier" in prompt else sentiment for prompt in asked]

    return factory


def test_predict_posts(frame):
    posts = frame([(0, "hello"), (1, "bye")], "row_id long, text string")
    out = predict_posts(posts, make_scorer("Joy? Anger.", "Fear negative"), combined=False).orderBy("row_id").collect()
    assert out[0].asDict() == {
        "row_id": 0, "text": "hello", fixed.EMOTION_RAW_COLUMN: "Joy? Anger.", fixed.SENTIMENT_RAW_COLUMN: "Fear negative",
        fixed.SENTIMENT_COLUMN: "negative", fixed.EMOTION_COLUMN: "anger",
    }
    both = predict_posts(posts, make_scorer("", "Fear negative"), roles=True, shots=1).first()
    assert (both[fixed.RAW_COLUMN], both[fixed.EMOTION_COLUMN], both[fixed.SENTIMENT_COLUMN]) == ("Fear negative", "fear", "negative")


def test_attach_keeps_the_input(frame):
    posts = frame([(0, "a", "in"), (1, "b", "in")], "row_id long, text string, kind string")
    said = frame([(1, "out", "joy"), (0, "out", "fear")], "row_id long, kind string, label string")
    out = scoring.attach(posts, said).orderBy("row_id").collect()
    assert [tuple(row) for row in out] == [(0, "a", "in", "fear"), (1, "b", "in", "joy")]


def test_grid_and_pending(spark, frame):
    grid = runs.param_grid(spark, {
        "combine_prompts": [True, False], "rep_pen": ["1.05", "1.1", "1.15", "1.2"], "max_new_tokens": [30, 50, 100],
        "temperature": ["0.01", "0.1", "0.3", "0.5"],
    })
    assert grid.count() == grid.distinct().count() == 96
    done = frame([("1.05",), ("1.05",)], "rep_pen string")
    assert runs.pending(grid, done, ["rep_pen"]).count() == 72


def test_evaluate_runs(frame):
    gold = frame([("d", 0, "joy", "positive"), ("d", 1, "fear", "negative"), ("e", 0, "joy", "neutral")],
                 "dataset string, row_id long, voted_emotion string, voted_sentiment string")
    said = frame(
        [("d", "m", "c1", 0, "joy", "positive"), ("d", "m", "c1", 1, "fear", None), ("d", "m", "c2", 0, "fear", "negative"),
         ("unknown", "m", "c1", 0, "joy", "positive")],
        f"dataset string, model_id string, generation_config string, row_id long, {fixed.EMOTION_COLUMN} string, {fixed.SENTIMENT_COLUMN} string",
    )
    targets = {
        "emotion": ("voted_emotion", fixed.EMOTION_COLUMN, ("joy", "fear")),
        "sentiment": ("voted_sentiment", fixed.SENTIMENT_COLUMN, fixed.SENTIMENTS),
    }
    out = runs.evaluate_runs(said, gold, targets)
    found = {(r["generation_config"], r["target"], r["label"]): r["f1"] for r in out.collect()}
    assert {key[:2] for key in found} == {(c, t) for c in ("c1", "c2") for t in ("emotion", "sentiment")}
    assert found["c1", "emotion", "accuracy"] == 1.0 and found["c1", "sentiment", "micro avg"] == pytest.approx(2 / 3)
    board = runs.leaderboard(out)
    assert [(r["generation_config"], r["score"]) for r in board.where("target = 'emotion'").collect()] == [("c1", 1.0), ("c2", 0.0)]
    assert board.first()["metric"] == "weighted avg_f1-score"
    assert [r["generation_config"] for r in runs.top_runs(board).collect()] == ["c1", "c1"]


def test_ties_follow_the_name(frame):
    reports = frame([("d", "m2", "c", "t", "weighted avg", 0.5), ("d", "m1", "c", "t", "weighted avg", 0.500001), ("d", "m0", "c", "t", "weighted avg", 0.6)],
                    "dataset string, model_id string, generation_config string, target string, label string, f1 double")
    assert [row["model_id"] for row in runs.leaderboard(reports).collect()] == ["m0", "m1", "m2"]


def test_known_only(frame):
    df = frame([("a", 1), ("b", 2)], "dataset string, n long")
    assert runs.known_only(df, frame([("b", "path")], "dataset string, gold string")).first().asDict() == {"dataset": "b", "n": 2, "gold": "path"}


def test_known_only_with_a_hot_dataset(spark, monkeypatch):
    from labelmill import settle

    df = spark.range(3000).selectExpr("id", "if(id % 3 < 2, 'hot', concat('d', id)) as dataset")
    known = spark.createDataFrame([("hot", 1), ("d2", 2), ("none", 3)], "dataset string, rank int")
    expected = runs.known_only(df, known)
    assert expected.count() == 2001
    monkeypatch.setattr(settle.lookup, "__defaults__", (*settle.lookup.__defaults__[:-1], 0))
    assert runs.known_only(df, known).exceptAll(expected).isEmpty() and runs.known_only(df, known).count() == 2001


def test_short_runs_are_not_perfect(frame):
    gold = frame([("d", i, "joy") for i in range(10)], "dataset string, row_id long, voted string")
    said = frame([("d", "m", "c", 0, "joy"), ("d", "m", "c", 77, "joy")], "dataset string, model_id string, generation_config string, row_id long, told string")
    targets = {"t": ("voted", "told", ["joy"])}
    out = {r["label"]: r for r in runs.evaluate_runs(said, gold, targets).collect()}
    assert out["joy"]["support"] == 10 and out["joy"]["recall"] == 0.1
    row = runs.coverage(said, gold).first()
    assert (row["gold_rows"], row["own_rows"], row["missing"], row["surplus"]) == (10, 2, 9, 1)
