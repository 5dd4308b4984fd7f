import pytest
from pyspark.sql import functions as F

from labelmill import fixed_values as fixed
from labelmill.functions.prompts import task_context
from labelmill.operators import tables as ta


def test_labelled_and_training_table(frame):
    posts = frame([(0, "hi", "joy", "positive", "x")], "row_id long, text string, voted_emotion string, voted_sentiment string, more string")
    labelled = ta.labelled_table(posts)
    assert labelled.columns == ["row_id", "text", "emotion", "sentiment"]
    ready = ta.training_table(labelled, "sentiment").first()
    assert ready.asDict() == {"row_id": 0, "text": task_context("sentiment") + "<hi> =", "emotion": "joy", "label": "positive"}
    with pytest.raises(ValueError):
        ta.training_table(labelled, "emotion_and_sentiment")


def test_drop_empty_speaker_rows(frame):
    rows = [("Speaker_0", ""), ("speaker_1", None), ("SPEAKER_2", "x"), ("Dialogue0", ""), (None, ""), (None, None)]
    kept = ta.drop_empty_speaker_rows(frame(rows, "speaker string, text string")).collect()
    assert {tuple(row) for row in kept} == {("SPEAKER_2", "x"), ("Dialogue0", ""), (None, ""), (None, None)}


def test_missing_values(frame):
    df = frame([(0, None), (1, ""), (2, "x")], "id long, text string")
    assert [row["id"] for row in ta.with_text(df).orderBy("id").collect()] == [1, 2]
    assert [row["id"] for row in ta.without_rating(df, "text").collect()] == [0]
    assert ta.fill_text(df).where("id = 0").first()["text"] == " "
    assert ta.blank(df, ["text"]).where("id = 2").first()["text"] == ""


def test_before_dialogue(frame):
    df = frame([(-1,), (0,), (21,), (22,)], "conv_no long")
    assert ta.before_dialogue(df, 22).count() == 3


def test_stratum(one):
    assert one(ta.stratum_by_name(F.col("f")), f="r_singapore.json") == "C"
    assert one(ta.stratum_by_name(F.col("f")), f="world.json") == "D"


def test_map_values(one):
    column = F.col("v").cast("string")
    assert one(ta.map_values(column, fixed.EMOTION_IDS), v="fear") == 3
    assert one(ta.map_values(column, fixed.SENTIMENT_IDS), v="odd") is None
    assert one(ta.map_values(column, fixed.SENTIMENT_IDS, default=1), v="odd") == 1
    assert one(ta.map_values(column, fixed.SENTIMENT_IDS, default=1), v=None) == 1


@pytest.mark.parametrize("rows", [100_000, 0])
def test_lookup_of_a_hot_key(spark, rows):
    """A third of the rows share one key, and another third has none."""
    df = spark.range(3000).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("key"),
    )
    table = df.where("row_id % 2 = 0").select("key").distinct().withColumn("size", F.length("key"))
    out = ta.map_by_table(df, "key", table, rows=rows)
    assert out.count() == 3000 and out.columns == ["row_id", "key", "size"]
    assert out.where("key = 'hot' and size = 3").count() == 1000
    assert out.where("key is null and size is null").count() == 1000
    members = spark.createDataFrame([("hot",), ("hot",), ("1",)], "key string")
    flagged = ta.flag_members(df, "key", members, rows=rows)
    assert flagged.count() == 3000 and flagged.where("is_member").count() == 1001


def test_rows_not_in(spark):
    df = spark.range(6).withColumnRenamed("id", "row_id")
    out = ta.rows_not_in(df, [df.where("row_id < 2"), df.where("row_id = 4")])
    assert sorted(row["row_id"] for row in out.collect()) == [2, 3, 5]


def test_rows_except(frame, monkeypatch):
    monkeypatch.setattr(ta, "CELL_ROWS", 3)
    rows = [("a", 1)] * 10 + [("b", None)] * 4 + [("c", 1), (None, None)]
    other = [("a", 1)] * 2 + [("b", None)] + [("c", 1)] * 3 + [("d", 1)]
    schema = "v string, n int"
    df, minus = frame(rows, schema), frame(other, schema)
    out = ta.rows_except(df, minus)
    assert out.columns == ["v", "n"] and out.count() == 12
    assert out.exceptAll(df.exceptAll(minus)).isEmpty() and df.exceptAll(minus).exceptAll(out).isEmpty()
    assert ta.rows_except(minus, minus).isEmpty()


def test_disagreements(frame):
    schema = "row_id long, label struct<correct:string,error_type:array<string>>, note string"
    one = frame([(0, ("yes", ["e"]), "n0"), (1, ("yes", ["e"]), "n1"), (2, (None, []), "n2"), (3, ("no", []), "n3")], schema)
    two = frame([(0, ("yes", []), ""), (1, ("no", []), ""), (2, ("yes", []), ""), (3, ("yes", []), "")], schema)
    out = ta.disagreements(one, two).orderBy("row_id").collect()
    assert [(row["row_id"], row["label"]["correct"], row["label"]["error_type"], row["note"]) for row in out] == [
        (1, "", [], "n1"), (2, "", [], "n2"), (3, "", [], "n3")
    ]
    assert ta.disagreements(one, two, first=2).count() == 1


def test_checks():
    assert ta.check_text_field("emotion_prompt") == "emotion_prompt"
    assert ta.check_file_type("a/b.json") == "json"
    for call in (lambda: ta.check_text_field(""), lambda: ta.check_file_type("a.parquet"), lambda: ta.check_file_type(None),
                 lambda: ta.check_exclusive(overrides="x", name="y")):
        with pytest.raises(ValueError):
            call()
    ta.check_exclusive(overrides="x", name=None)


def test_trimmed_lower(one):
    assert one(ta.trimmed_lower(F.col("v")), v="\t Joy  \n") == "joy"
