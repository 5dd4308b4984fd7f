"""Conversations: nested records, utterance rows, marker tables and back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from labelmill.functions.names import marker_name, speaker_name
from labelmill.operators.positions import CELL_ROWS, running
from labelmill.settle import BROADCAST_ROWS, lookup



def utterance_rows(
    df: DataFrame,
    number: str = "row_id",
    pack: Callable[[Column], Column] | None = None,
    markers: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Nested conversations to rows ``(conv_no, turn, seg, speaker, text)`` in one pass and without a shuffle.

    ``pack`` cuts an utterance into segments. Speakers are numbered by first appearance. A marker row has turn -1.
    ``conversation`` holds structs of speaker and utterance; a record without it is left out.
    """
    present = df.where(F.col("conversation").isNotNull())
    speakers = F.array_distinct(F.transform("conversation", lambda item: F.struct(item["speaker"])))
    named = present.withColumn("_speakers", speakers)

    def lines(item: Column, turn: Column) -> Column:
        place = F.array_position(F.col("_speakers"), F.struct(item["speaker"])) - 1
        segments = F.array(item["utterance"]) if pack is None else pack(F.coalesce(item["utterance"], F.lit("")))
        return F.transform(
            segments,
            lambda text, seg: F.struct(
                turn.cast("long").alias("turn"), seg.cast("long").alias("seg"), speaker_name(place).alias("speaker"),
                text.alias("text"),
            ),
        )

    body = F.flatten(F.transform("conversation", lines))
    if markers:
        marker = F.struct(
            F.lit(-1).cast("long").alias("turn"), F.lit(-1).cast("long").alias("seg"),
            marker_name(F.col(number)).alias("speaker"), F.lit("").alias("text"),
        )
        body = F.concat(F.array(marker), body)
    rows = named.select(F.col(number).alias("conv_no"), *keep, F.explode(body).alias("_line"))
    return rows.select("conv_no", *keep, "_line.*")


def dialogue_order() -> list[str]:
    return ["conv_no", "turn", "seg"]


def split_annotated(df: DataFrame, pack: Callable[[Column], Column], text: str = "text", speaker: str = "speaker",
                    keep: Sequence[str] = ()) -> DataFrame:
    """One row per segment; rows that give at most one segment stay as they are, the others lose every other column.

    ``keep`` names key columns that survive on split rows; ``seg`` numbers the segments.
    """
    segments = F.coalesce(pack(F.coalesce(F.col(text), F.lit(""))), F.expr("array('')"))
    packed = df.withColumn("_segments", segments).withColumn("_split", F.size("_segments") > 1)
    lines = packed.select("*", F.posexplode(F.when(F.col("_split"), F.col("_segments")).otherwise(F.array(F.col(text)))))
    values = {}
    for column, kind in df.dtypes:
        if column == text:
            values[column] = F.col("col")
        elif column != speaker and column not in keep:
            blank = F.lit("") if kind == "string" else F.lit(None).cast(kind)
            values[column] = F.when(F.col("_split"), blank).otherwise(F.col(column))
    return lines.withColumns(values | {"seg": F.col("pos").cast("long")}).drop("_segments", "_split", "pos", "col")


def is_marker(speaker: Column, word: str = "Dialogue") -> Column:
    return F.coalesce(speaker.startswith(word), F.lit(False))


def number_dialogues(df: DataFrame, marker: Column, row_id: str = "row_id") -> DataFrame:
    """Add ``conv_no`` (from 0; -1 before the first marker) and ``turn``, the rows since the marker (0 on it)."""
    out = running(
        df,
        row_id,
        sums={"conv_no": marker.cast("long")},
        maxes={"_marker": F.when(marker, F.col(row_id))},
    )
    return out.withColumns({"conv_no": F.col("conv_no") - 1, "turn": F.col(row_id) - F.col("_marker")}).drop("_marker")


def number_speakers(
    df: DataFrame, conv: str = "conv_no", turn: str = "turn", speaker: str = "speaker", rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Add ``speaker_no``: speakers of a conversation from 0 by first appearance.

    Only the first appearances are ranked; the numbers are looked up again from the rows.
    """
    first = df.groupBy(conv, speaker).agg(F.min(turn).alias("_first"))
    numbers = running(first, "_first", sums={"speaker_no": F.lit(1)}, by=[conv])
    numbers = numbers.select(conv, speaker, (F.col("speaker_no") - 1).alias("speaker_no"))
    return lookup(df, numbers, [conv, speaker], F.floor(F.col(turn) / CELL_ROWS), rows=rows)


def rebuild_conversations(
    df: DataFrame, fields: dict[str, Column], conv: str = "conv_no", turn: str = "turn", *, part_rows: int
) -> DataFrame:
    """Utterance rows to nested records ``(conv_no, part, conversation)``.

    A record holds at most ``part_rows`` turns, which the caller states, so a conversation of any length never has to fit into
    one task; those within the bound come out whole as part 0. The form without any bound is the rows themselves, in the order
    of ``conv`` and ``turn``.
    """
    item = F.struct(F.col(turn).alias("_turn"), *[value.alias(name) for name, value in fields.items()])
    parts = df.select(F.col(conv), F.floor(F.col(turn) / part_rows).alias("part"), item.alias("_item"))
    grouped = parts.groupBy(conv, "part").agg(F.array_sort(F.collect_list("_item")).alias("_items"))
    bare = F.transform("_items", lambda entry: F.struct(*[entry[name].alias(name) for name in fields]))
    return grouped.select(conv, "part", bare.alias("conversation"))


def annotated_records(rebuilt: DataFrame, source: DataFrame, conv: str = "conv_no", row_id: str = "row_id") -> DataFrame:
    """Rebuilt conversations joined by number to their source records, whose other fields they keep.

    ``first_matches`` says whether the first utterance is the source's first one.
    """
    first = source.withColumn("_first", F.get("conversation", F.lit(0))["utterance"]).drop("conversation")
    joined = rebuilt.join(first, rebuilt[conv] == first[row_id]).drop(first[row_id])
    own = F.get("conversation", F.lit(0))["utterance"]
    matches = F.when(F.col("part") == 0, own.eqNullSafe(F.col("_first")))
    return joined.withColumn("first_matches", matches).drop("_first")


def strata_counts(rows: DataFrame, stratum: str = "stratum", conv: str = "conv_no") -> DataFrame:
    """Conversations and utterance rows per stratum, counted per conversation first."""
    per_conversation = rows.groupBy(stratum, conv).agg(F.count("*").alias("_rows"))
    return per_conversation.groupBy(stratum).agg(
        F.count("*").alias("conversations"), F.sum("_rows").alias("utterances")
    )
