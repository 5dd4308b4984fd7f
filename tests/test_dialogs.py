from pyspark.sql import functions as F
import pytest

from labelmill.functions import names
from labelmill.functions.text import pack_paragraphs
from labelmill.operators import dialogs as di, positions as po

SCHEMA = "row_id long, filename string, conversation array<struct<speaker:string,utterance:string>>"


@pytest.fixture
def records(frame):
    return frame(
        [
            (0, "a.json", [("zoe", "hi"), ("bob", "one\n\ntwo three"), ("zoe", "bye"), (None, "who"), ("bob", "")]),
            (1, "b.json", None),
            (2, "singapore.json", []),
            (3, "c.json", [("bob", None)]),
        ],
        SCHEMA,
    )


def lines(df):
    return [(r["conv_no"], r["turn"], r["seg"], r["speaker"], r["text"]) for r in df.orderBy(*di.dialogue_order()).collect()]


def test_utterance_rows(records):
    assert lines(di.utterance_rows(records)) == [
        (0, -1, -1, "Dialogue0", ""), (0, 0, 0, "Speaker_0", "hi"), (0, 1, 0, "Speaker_1", "one\n\ntwo three"),
        (0, 2, 0, "Speaker_0", "bye"), (0, 3, 0, "Speaker_2", "who"), (0, 4, 0, "Speaker_1", ""),
        (2, -1, -1, "Dialogue2", ""), (3, -1, -1, "Dialogue3", ""), (3, 0, 0, "Speaker_0", None),
    ]


def test_segment_rows(records):
    out = lines(di.utterance_rows(records, pack=lambda text: pack_paragraphs(text, 2), markers=False))
    assert out == [
        (0, 0, 0, "Speaker_0", "hi"), (0, 1, 0, "Speaker_1", "one"), (0, 1, 1, "Speaker_1", "two three"),
        (0, 2, 0, "Speaker_0", "bye"), (0, 3, 0, "Speaker_2", "who"), (0, 4, 0, "Speaker_1", ""), (3, 0, 0, "Speaker_0", ""),
    ]


def test_number_dialogues(frame, monkeypatch):
    monkeypatch.setattr(po, "CELL_ROWS", 3)
    speakers = ["early", "Dialogue0", "Dialogue1", "x", "y", "Dialogue5", None, "z", "z", "z"]
    df = frame(list(enumerate(speakers)), "row_id long, speaker string")
    out = di.number_dialogues(df, di.is_marker(F.col("speaker")))
    assert [(r["conv_no"], r["turn"]) for r in out.orderBy("row_id").collect()] == [
        (-1, None), (0, 0), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (2, 3), (2, 4)
    ]


def test_no_marker(frame):
    out = di.number_dialogues(frame([(0, "x")], "row_id long, speaker string"), di.is_marker(F.col("speaker")))
    assert out.first()["conv_no"] == -1


@pytest.mark.parametrize("rows", [100_000, 0])
def test_number_speakers(frame, rows):
    turns = [(0, 0, "b"), (0, 1, "a"), (0, 2, "b"), (0, 3, None), (0, 4, None), (1, 0, "a")]
    out = di.number_speakers(frame(turns, "conv_no long, turn long, speaker string"), rows=rows)
    assert [r["speaker_no"] for r in out.orderBy("conv_no", "turn").collect()] == [0, 1, 0, 2, 2, 0]


def test_speakers_of_one_long_conversation(spark, monkeypatch):
    """One conversation and one speaker hold nearly all rows; cells of the turn share them out."""
    monkeypatch.setattr(po, "CELL_ROWS", 50)
    monkeypatch.setattr(di, "CELL_ROWS", 50)
    turns = spark.range(1000).select(
        F.lit(7).alias("conv_no"), F.col("id").alias("turn"),
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("s"), F.col("id") % 70)).otherwise("host").alias("speaker"),
    )
    seen = {}
    for row in di.number_speakers(turns, rows=0).orderBy("turn").collect():
        assert row["speaker_no"] == seen.setdefault(row["speaker"], len(seen))


def test_rebuild_in_parts(spark):
    turns = spark.range(25).select(F.lit(1).alias("conv_no"), F.col("id").alias("turn"), F.col("id").cast("string").alias("text"))
    out = di.rebuild_conversations(turns, {"utterance": F.col("text")}, part_rows=10).orderBy("part").collect()
    assert [r["part"] for r in out] == [0, 1, 2]
    assert [item["utterance"] for r in out for item in r["conversation"]] == [str(i) for i in range(25)]
    whole = di.rebuild_conversations(turns, {"utterance": F.col("text")}, part_rows=10_000).collect()
    assert len(whole) == 1 and len(whole[0]["conversation"]) == 25


def test_round_trip_to_annotated_records(records, spark):
    rows = di.utterance_rows(records.where(F.size("conversation") > 0))
    table = po.row_ids(rows, di.dialogue_order()).select("row_id", "speaker", "text")
    table = table.withColumn("text", F.when(F.col("speaker") == "Speaker_0", F.col("text")).otherwise(F.lit("changed")))
    numbered = di.number_dialogues(table, di.is_marker(F.col("speaker"))).where("turn > 0")
    raters = names.annotations([F.lit("x")] * 3, [F.lit("y")] * 3)
    rebuilt = di.rebuild_conversations(numbered, {"utterance": F.col("text"), "speaker": F.col("speaker"), "annotations": raters}, part_rows=10_000)
    source = spark.createDataFrame([(0, "a.json", [("q", "hi")]), (1, "c.json", [("q", "other")]), (2, "late", [("q", "z")])], SCHEMA)
    out = {r["conv_no"]: r for r in di.annotated_records(rebuilt, source).collect()}
    assert sorted(out) == [0, 1]
    assert (out[0]["first_matches"], out[1]["first_matches"]) == (True, False)
    assert out[0]["filename"] == "a.json" and len(out[0]["conversation"]) == 5
    assert out[0]["conversation"][0]["annotations"]["emotion"] == ["x", "x", "x"]


def test_split_annotated(frame):
    df = frame([(0, "s", "a b\n\nc d", "anger", 3), (1, "s", " a ", "joy", 4), (2, "Dialogue0", "", None, 5), (3, "s", None, "x", 6)],
               "row_id long, speaker string, text string, emotion string, n int")
    out = di.split_annotated(df, lambda text: pack_paragraphs(text, 2), keep=["row_id"]).orderBy("row_id", "seg").collect()
    assert [(r["row_id"], r["seg"], r["speaker"], r["text"], r["emotion"], r["n"]) for r in out] == [
        (0, 0, "s", "a b", "", None), (0, 1, "s", "c d", "", None), (1, 0, "s", " a ", "joy", 4),
        (2, 0, "Dialogue0", "", None, 5), (3, 0, "s", None, "x", 6),
    ]


def test_strata_counts(frame):
    rows = frame([("C", 1), ("C", 1), ("C", 2), ("D", 9)], "stratum string, conv_no long")
    assert {r["stratum"]: (r["conversations"], r["utterances"]) for r in di.strata_counts(rows).collect()} == {"C": (2, 3), "D": (1, 1)}
