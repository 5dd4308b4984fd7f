import glob
import json
import shutil

import pytest
from pyspark.sql import functions as F

from labelmill import fixed_values as fixed
from labelmill.operators.metrics import classification_report
from labelmill.plans.evaluate import consolidate, evaluate_tree
from labelmill.sinks import writers
from labelmill.sources import readers

AWKWARD = [
    (0, "plain", "joy"), (1, 'a "quoted", comma', "fear"), (2, "two\nlines", "joy"), (3, " spaces ", None), (4, "None", "x"),
    (5, "", "empty"), (6, "back\\slash\\", "y"), (7, '"', "z"), (8, "tab\there", ""),
]
SCHEMA = "row_id long, text string, label string"


def written(path):
    return "".join(open(name, encoding="utf-8").read() for name in sorted(glob.glob(f"{path}/part-*")))


def test_csv_round_trip(frame, spark, tmp_path):
    df = frame(AWKWARD, SCHEMA)
    writers.write_csv(df.select("text", "label", "row_id"), f"{tmp_path}/out", ["row_id"])
    back = readers.read_csv(spark, f"{tmp_path}/out", "text string, label string, was long")
    rows = [(row["row_id"], row["text"], row["label"]) for row in back.orderBy("row_id").collect()]
    # Empty fields are read as missing.
    assert [row[1:] for row in rows] == [(text or None, label or None) for _, text, label in AWKWARD]
    assert back.where("row_id <> was").isEmpty()


def test_positions_over_blocks_and_files(spark, tmp_path, monkeypatch):
    wide = spark.range(20_000).select("id", F.concat(F.lit("text number "), F.col("id")).alias("text"))
    wide.repartitionByRange(3, "id").sortWithinPartitions("id").write.options(header=True).csv(f"{tmp_path}/many")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        df = readers.read_csv(spark, f"{tmp_path}/many", "id long, text string", multiLine=False)
        assert df.rdd.getNumPartitions() > 3
        assert df.where("row_id <> id").isEmpty() and df.count() == 20_000
        # Part files of a folder go on counting; files of their own start again.
        inside = readers.read_csv(spark, f"{tmp_path}/many", "id long, text string", per_file=True, multiLine=False)
        assert inside.where("row_id <> id").isEmpty()
        for place, name in enumerate(sorted(glob.glob(f"{tmp_path}/many/part-*"))):
            shutil.copy(name, tmp_path / f"copy{place}.csv")
        inside = readers.read_csv(spark, f"{tmp_path}/copy*.csv", "id long, text string", per_file=True, multiLine=False)
        assert inside.where("row_id = 0").count() == 3 and inside.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_missing_words(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,label\nNone,joy\nx,NA\n,nan\n")
    path, schema = f"{tmp_path}/a.csv", "text string, label string"
    rows = readers.read_csv(spark, path, schema, missing=fixed.MISSING_WORDS).orderBy("row_id").collect()
    assert [(r["text"], r["label"]) for r in rows] == [(None, "joy"), ("x", None), (None, None)]
    assert readers.read_csv(spark, path, schema).where("row_id = 0").first()["text"] == "None"


def test_parquet_positions(spark, tmp_path):
    spark.range(1000).repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(f"{tmp_path}/t")
    assert readers.read_parquet(spark, f"{tmp_path}/t").where("row_id <> id").isEmpty()
    assert readers.read_parquet(spark, f"{tmp_path}/t", per_file=True).where("row_id <> id").isEmpty()


def test_invalid_bytes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"text,label\nab\xffc,joy\n")
    assert readers.read_csv(spark, f"{tmp_path}/a.csv", "text string, label string").first()["text"] == "ab�c"


def test_inferred_types_and_short_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,n\nx,1\ny\n")
    df = readers.read_csv(spark, f"{tmp_path}/a.csv")
    assert dict(df.dtypes)["n"] == "int"
    assert [(row["text"], row["n"]) for row in df.orderBy("row_id").collect()] == [("x", 1), ("y", None)]


def test_headerless_and_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('neutral,"Profit, up"\npositive,Sales\n')
    df = readers.read_headerless(spark, f"{tmp_path}/a.csv")
    assert [(r["row_id"], r["sentiment"], r["text"]) for r in df.orderBy("row_id").collect()] == [
        (0, "neutral", "Profit, up"), (1, "positive", "Sales")
    ]
    (tmp_path / "b.csv").write_text("id,text\n007,\n8,x\n")
    rows = readers.read_records(spark, f"{tmp_path}/b.csv").orderBy("row_id").collect()
    assert [(r["id"], r["text"]) for r in rows] == [("007", ""), ("8", "x")]


def test_splits(spark, tmp_path):
    for name, n in (("train", 3), ("validation", 1), ("test", 2)):
        (tmp_path / f"{name}.csv").write_text("text,label\n" + "".join(f"{name}{i},{i}\n" for i in range(n)))
    df = readers.read_splits(spark, str(tmp_path), schema="text string, label int")
    assert {(r["split"], r["row_id"], r["text"]) for r in df.collect()} == {
        (name, i, f"{name}{i}") for name, n in (("train", 3), ("validation", 1), ("test", 2)) for i in range(n)
    }


def test_conversations(spark, tmp_path):
    record = {"filename": "f", "index": "1", "conversation": [{"speaker": "a", "utterance": "hi"}]}
    empty = {"filename": "g", "index": "2", "conversation": []}
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps(record), "{}", "null", json.dumps(empty)]) + "\n")
    rows = readers.read_conversations(spark, f"{tmp_path}/a.jsonl").orderBy("row_id").collect()
    assert [(r["row_id"], r["filename"], len(r["conversation"])) for r in rows] == [(0, "f", 1), (3, "g", 0)]


def test_json_array_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"label": {"correct": "x"}}, {"label": {"correct": "y"}}], indent=2))
    rows = readers.read_json_array(spark, f"{tmp_path}/a.json").orderBy("row_id").collect()
    assert [r["label"]["correct"] for r in rows] == ["x", "y"]
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    assert [r["value"] for r in readers.read_lines(spark, f"{tmp_path}/a.txt").orderBy("row_id").collect()] == ["one", "two"]


def test_indexed_csv(frame, tmp_path):
    writers.write_indexed_csv(frame([("b", 0.5), ("a", 0.25)], "name string, score double"), f"{tmp_path}/out", ["name"])
    lines = [line for line in written(f"{tmp_path}/out").splitlines()]
    assert [line for line in lines if not line.startswith(",")] == ["0,a,0.25", "1,b,0.5"]
    assert ",name,score" in lines


def test_numbered_and_routed_outputs(frame, spark, tmp_path):
    df = frame([(i, i % 2, "CD"[i % 3 == 0]) for i in range(20)], "row_id long, batch int, stratum string")
    writers.write_split_csv(df, f"{tmp_path}/batches", "batch", ["row_id"])
    assert spark.read.csv(f"{tmp_path}/batches/batch=1", header=True).count() == 10
    writers.write_jsonl(df, f"{tmp_path}/routed", ["row_id"], part="stratum")
    assert spark.read.json(f"{tmp_path}/routed/stratum=D").count() == 7


def test_jsonl_keeps_nulls(frame, tmp_path):
    posts = frame([("hi", "joy", None, "joy", "fear", "positive")],
                  "text string, voted_emotion string, voted_sentiment string, e1 string, e2 string, s1 string")
    writers.write_jsonl(writers.annotated_posts(posts, ["e1", "e2"], ["s1"]), f"{tmp_path}/out")
    assert json.loads(written(f"{tmp_path}/out")) == {
        "text": "hi", "emotion": "joy", "sentiment": None, "annotations": {"emotion": ["joy", "fear"], "sentiment": ["positive"]}
    }


def test_raw_and_label_tables(frame, spark, tmp_path):
    scored = frame([(1, "b", "raw b", None, "joy"), (0, "a", 'say "x"', "positive", None)],
                   f"row_id long, text string, {fixed.RAW_COLUMN} string, {fixed.SENTIMENT_COLUMN} string, {fixed.EMOTION_COLUMN} string")
    writers.write_predictions(scored, f"{tmp_path}/raw", f"{tmp_path}/labels", ["text"])
    raw = readers.read_csv(spark, f"{tmp_path}/raw", f"text string, {fixed.RAW_COLUMN} string").orderBy("row_id").collect()
    assert [(r["text"], r[fixed.RAW_COLUMN]) for r in raw] == [("a", 'say "x"'), ("b", "raw b")]
    labels = spark.read.options(**readers.CSV_OPTIONS).csv(f"{tmp_path}/labels")
    assert labels.columns == ["text", fixed.SENTIMENT_COLUMN, fixed.EMOTION_COLUMN]
    assert {tuple(row) for row in labels.collect()} == {("a", "positive", None), ("b", None, "joy")}


def test_append_missing(frame, spark, tmp_path):
    path = f"{tmp_path}/table"
    writers.append_missing(frame([(1, "a"), (2, "b")], "id long, v string"), path, ["id"])
    writers.append_missing(frame([(2, "other"), (3, "c")], "id long, v string"), path, ["id"])
    assert sorted(tuple(row) for row in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b"), (3, "c")]


REPORT = {
    "joy": {"precision": 0.5, "recall": 1.0, "f1-score": 2 / 3, "support": 1.0},
    "accuracy": 0.75,
    "macro avg": {"precision": 0.25, "recall": 0.5, "f1-score": 1 / 3, "support": 4.0},
    "weighted avg": {"precision": 0.1, "recall": 0.2, "f1-score": 0.123456, "support": 4.0},
}


@pytest.fixture
def tree(tmp_path):
    """Two datasets with runs whose folder names hold equal signs, pluses and blanks."""
    for dataset, model, config, score in (
        ("posts", "m-1", "temp=0.1-few=True", 0.5), ("posts", "m+2 b", "temp=0.01", 0.7), ("other", "m-1", "temp=0.1", 0.9)
    ):
        folder = tmp_path / "runs" / dataset / model / config
        folder.mkdir(parents=True)
        report = REPORT | {"weighted avg": REPORT["weighted avg"] | {"f1-score": score}}
        (folder / "emotion_report.json").write_text(json.dumps(report, indent=2))
        (folder / "predictions.csv").write_text(
            f'text,{fixed.SENTIMENT_COLUMN},{fixed.EMOTION_COLUMN}\n"a, \n b",positive,anger\nc,,fear\n'
        )
    return str(tmp_path / "runs")


def test_stored_reports(spark, tree):
    runs = readers.find_runs(spark, tree)
    assert {(r["dataset"], r["model_id"], r["generation_config"]) for r in runs.collect()} == {
        ("posts", "m-1", "temp=0.1-few=True"), ("posts", "m+2 b", "temp=0.01"), ("other", "m-1", "temp=0.1")
    }
    lines = readers.read_reports(spark, tree).where("model_id = 'm+2 b'").orderBy("ordinal").collect()
    assert [line["label"] for line in lines] == list(REPORT)
    assert (lines[1]["f1"], lines[1]["support"]) == (0.75, None) and lines[0]["f1"] == 2 / 3
    board = consolidate(spark, tree, ["posts"], "emotion").collect()
    assert [(row["model_id"], row["score"]) for row in board] == [("m+2 b", 0.7), ("m-1", 0.5)]


def test_evaluate_tree(spark, tree, frame, tmp_path):
    gold = frame([("posts", 0, "anger", "positive"), ("posts", 1, "joy", "neutral")],
                 "dataset string, row_id long, voted_emotion string, voted_sentiment string")
    reports = evaluate_tree(spark, tree, gold)
    found = {(r["model_id"], r["target"], r["label"]): (r["f1"], r["support"]) for r in reports.collect()}
    assert {key[0] for key in found} == {"m-1", "m+2 b"}
    assert found["m-1", "emotion", "anger"] == (1.0, 1) and found["m-1", "sentiment", "micro avg"][0] == pytest.approx(2 / 3)
    done = spark.createDataFrame([("posts", "m-1", "temp=0.1-few=True", "emotion")],
                                 "dataset string, model_id string, generation_config string, target string")
    rest = evaluate_tree(spark, tree, gold, done)
    assert {(r["model_id"], r["target"]) for r in rest.collect()} == {
        ("m-1", "sentiment"), ("m+2 b", "emotion"), ("m+2 b", "sentiment")
    }


def test_report_documents(frame, spark, tmp_path):
    df = frame([("a=1", "joy", "joy"), ("a=1", "fear", "joy"), ("b", "joy", None)], "run string, g string, p string")
    reports = classification_report(df, "g", "p", ["joy", "fear"], ["run"])
    documents = {row["run"]: row["document"] for row in writers.report_documents(reports, ["run"]).collect()}
    first = json.loads(documents["a=1"])
    assert list(first) == ["joy", "fear", "accuracy", "macro avg", "weighted avg"]
    assert first["accuracy"] == 0.5 and first["joy"] == {"precision": 0.5, "recall": 1.0, "f1-score": 2 / 3, "support": 1.0}
    assert documents["a=1"] == json.dumps(first, indent=2)
    assert "micro avg" in json.loads(documents["b"])
    writers.write_documents(writers.report_documents(reports, ["run"]), f"{tmp_path}/docs")
    again = readers.read_documents(spark, f"{tmp_path}/docs", ["run"])
    columns = ["run", "label", "precision", "recall", "f1"]
    assert again.select(columns).exceptAll(reports.select(columns)).isEmpty() and again.count() == reports.count()
    back = spark.read.text(f"{tmp_path}/docs", wholetext=True)
    assert {row["run"]: row["value"].rstrip("\n") for row in back.collect()} == documents


def test_document_labels_are_escaped(frame):
    df = frame([('say "x"\n', 'say "x"\n')], "g string, p string")
    reports = classification_report(df, "g", "p", ['say "x"\n'], [])
    document = writers.report_documents(reports.withColumn("run", F.lit(1)), ["run"]).first()["document"]
    assert 'say "x"\n' in json.loads(document)


def test_spread(spark):
    assert readers.spread(spark.range(0, 10, 1, 1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 10, 1, 200)
    assert readers.spread(many, "id") is many


def test_broken_records_are_errors(spark, tmp_path):
    (tmp_path / "more.csv").write_text("text,n\nx,1\ny,2,3\n")
    (tmp_path / "type.csv").write_text("text,n\nx,1\ny,zz\n")
    (tmp_path / "short.csv").write_text("text,n\nx,1\ny\n")
    for name in ("more", "type"):
        with pytest.raises(Exception, match="too many fields|is not int"):
            readers.read_csv(spark, f"{tmp_path}/{name}.csv", "text string, n int").collect()
    rows = readers.read_csv(spark, f"{tmp_path}/short.csv", "text string, n int").orderBy("row_id").collect()
    assert [(r["text"], r["n"]) for r in rows] == [("x", 1), ("y", None)]
    (tmp_path / "b.jsonl").write_text('{"filename": "f", "conversation": []}\n{"filename": oops\n')
    with pytest.raises(Exception, match="not a record"):
        readers.read_conversations(spark, f"{tmp_path}/b.jsonl").collect()


def test_finished_and_unknown_runs_are_not_read(spark, tree, frame, tmp_path):
    gold = frame([("none of them", 0, "joy", "positive")], "dataset string, row_id long, voted_emotion string, voted_sentiment string")
    assert evaluate_tree(spark, tree, gold).where("support > 0").isEmpty()
