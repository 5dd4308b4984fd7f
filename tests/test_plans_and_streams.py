import re

import pytest
from pyspark.sql import functions as F

from labelmill import fixed_values as fixed
from labelmill.functions import prompts, text as tx
from labelmill.operators import dialogs, metrics, positions, runs, sampling
from labelmill.plans.evaluate import evaluate_tree, store_reports, stored_reports
from labelmill.plans.flatten import sample_segments
from labelmill.plans.predict import predict_run
from labelmill.sources.readers import find_runs
from labelmill.streaming import posts as streams

RECORD = "row_id long, filename string, conversation array<struct<speaker:string,utterance:string>>"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sampled_segments(frame):
    def record(row_id, place, *texts):
        return row_id, f"{place}_{row_id}.json", [(f"u{i}", text) for i, text in enumerate(texts)]

    records = frame(
        [record(0, "singapore", "a"), record(1, "world", "b", "c\n\nd e f"), record(2, "singapore", "x"), record(4, "world", "y"),
         record(5, "world", "late")],
        RECORD,
    )
    out = sample_segments(records, {"C": 1, "D": 9}, cap=5, limit=2).orderBy(*dialogs.dialogue_order()).collect()
    assert [(r["conv_no"], r["stratum"], r["speaker"], r["text"]) for r in out] == [
        (0, "C", "Dialogue0", ""), (0, "C", "Speaker_0", "a"), (1, "D", "Dialogue1", ""), (1, "D", "Speaker_0", "b"),
        (1, "D", "Speaker_1", "c"), (1, "D", "Speaker_1", "d e f"), (4, "D", "Dialogue4", ""), (4, "D", "Speaker_0", "y"),
    ]


def test_no_python_in_expressions(frame):
    df = frame([("a",)], "text string")
    body = F.col("text")
    columns = {
        "m": tx.mask_mentions(body), "n": tx.token_count(body), "p": tx.pack_paragraphs(body), "s": tx.pack_sentences(body),
        "l": tx.first_label(body, ["a"]), **prompts.prompt_columns(body, roles=True),
    }
    plan = plan_of(df.withColumns(columns))
    assert "Python" not in plan and "Exchange hash" not in plan



def test_running_totals_window_by_cell(spark):
    out = positions.running(spark.range(100).withColumnRenamed("id", "row_id"), "row_id", {"n": F.lit(1)})
    plan = plan_of(out)
    # The only single-task exchange is the one over cell totals, which are summed and stored before, once.
    assert plan.count("Exchange SinglePartition") == 1
    above = plan.split("Exchange SinglePartition")[1].splitlines()[1]
    assert "FileScan parquet" in above and "_cell" in above and "HashAggregate" not in plan


def test_splits_do_not_move_rows(frame):
    df = frame([(i, "ab"[i % 2], "text") for i in range(40)], "row_id long, label string, text string")
    for out in (sampling.stratified_split(df, "label"), sampling.fixed_split(df, "label", 3, 3), sampling.random_split(df)):
        plan = plan_of(out)
        assert "SortMergeJoin" not in plan and "Window" not in plan
        assert not re.search(r"Exchange hashpartitioning", plan.split("BroadcastExchange")[0])


def test_reports_take_one_shuffle(frame):
    df = frame([("r", "a", "b")], "run string, g string, p string")
    plan = plan_of(metrics.classification_report(df, "g", "p", ["a", "b"], ["run"]))
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_" in plan


def test_pushed_filters_and_columns(spark, tmp_path):
    spark.range(1000).selectExpr("id as row_id", "'x' as text", "'y' as other").write.parquet(f"{tmp_path}/t")
    plan = plan_of(positions.take_slice(spark.read.parquet(f"{tmp_path}/t").select("row_id", "text"), 5, 9))
    assert "GreaterThanOrEqual(row_id,5)" in plan and "LessThan(row_id,9)" in plan
    assert "ReadSchema: struct<row_id:bigint,text:string>" in plan


def test_stream_equals_batch(spark, frame, tmp_path):
    df = frame([(i, f"@u{i} one two.\n\nthree four five {i}") for i in range(30)], "row_id long, text string")
    df.write.parquet(f"{tmp_path}/in")
    stream = streams.prepared(streams.stream_posts(spark, f"{tmp_path}/in", "row_id long, text string"), 1, limit=6)
    streams.write_available(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    batch = streams.prepared(spark.read.parquet(f"{tmp_path}/in"), 1, limit=6)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.exceptAll(batch).isEmpty() and batch.exceptAll(out).isEmpty() and out.count() == 60
    df.limit(5).withColumn("row_id", F.col("row_id") + 100).write.mode("append").parquet(f"{tmp_path}/in")
    again = streams.prepared(streams.stream_posts(spark, f"{tmp_path}/in", "row_id long, text string"), 1, limit=6)
    streams.write_available(again, f"{tmp_path}/out", f"{tmp_path}/state")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 70


@pytest.mark.parametrize("parts", [1, 7])
def test_results_do_not_depend_on_partitions(spark, parts):
    df = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("string").alias("label")).repartition(parts)
    split = sampling.stratified_split(df, "label").where("split = 'train'").agg(F.sum("row_id"), F.count("*")).first()
    assert tuple(split) == tuple(
        sampling.stratified_split(df.coalesce(1), "label").where("split = 'train'").agg(F.sum("row_id"), F.count("*")).first()
    )


def make_scorer(answers):
    def factory():
        return lambda asked: [answers[int("late" in prompt)] for prompt in asked]

    return factory


def test_from_posts_to_leaderboard(spark, tmp_path):
    """Two runs are predicted, evaluated, stored and ranked; a second round finds nothing left to do."""
    posts = 'text,id\n"so, happy",1\n"two\nlines",2\nlate,3\n'
    (tmp_path / "posts.v1.csv").write_text(posts)
    runs_root, settings = f"{tmp_path}/runs", {"max_new_toks": 30, "temp": 0.01, "combine_prompts": True}
    folders = [
        predict_run(spark, f"{tmp_path}/posts.v1.csv", "text string, id int", runs_root, model, make_scorer(answers), settings)
        for model, answers in (("good", ("Happiness positive", "anger, negative")), ("bad", ("no idea", "fear")))
    ]
    assert folders[0] == f"{runs_root}/posts/good/max_new_toks=30-temp=0.01-combine_prompts=True"
    again = predict_run(spark, f"{tmp_path}/posts.v1.csv", "text string, id int", runs_root, "good", None, settings)
    assert again == folders[0]
    raw = spark.read.options(header=True, multiLine=True, escape='"').csv(f"{folders[0]}/raw.csv")
    assert raw.columns == ["text", "id", fixed.RAW_COLUMN] and raw.where("text = 'two\nlines'").count() == 1
    gold = spark.createDataFrame(
        [("posts", 0, "happiness", "positive"), ("posts", 1, "happiness", "positive"), ("posts", 2, "anger", "negative")],
        "dataset string, row_id long, voted_emotion string, voted_sentiment string",
    )
    schema = f"text string, id int, {fixed.SENTIMENT_COLUMN} string, {fixed.EMOTION_COLUMN} string"
    assert find_runs(spark, runs_root).count() == 2
    reports = evaluate_tree(spark, runs_root, gold, schema=schema)
    store_reports(reports.where("not (model_id = 'bad' and target = 'emotion')"), f"{tmp_path}/reports")
    finished = stored_reports(spark, f"{tmp_path}/reports")
    rest = evaluate_tree(spark, runs_root, gold, finished, schema=schema)
    assert rest.select("model_id", "target").distinct().collect() == [("bad", "emotion")]
    store_reports(rest, f"{tmp_path}/reports")
    finished = stored_reports(spark, f"{tmp_path}/reports")
    assert evaluate_tree(spark, runs_root, gold, finished, schema=schema).isEmpty()
    board = runs.leaderboard(finished).collect()
    assert [(row["target"], row["model_id"], row["score"]) for row in board] == [
        ("emotion", "good", 1.0), ("emotion", "bad", 0.0), ("sentiment", "good", 1.0), ("sentiment", "bad", 0.0)
    ]
