"""Column work, filters and lookups on flat tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from labelmill.functions.prompts import build_prompt, check_target, task_context
from labelmill.functions.sql_text import values
from labelmill.functions.text import strip
from labelmill.operators.positions import CELL_ROWS
from labelmill.settle import BROADCAST_ROWS, lookup, same


def labelled_table(df: DataFrame, emotion: str = "voted_emotion", sentiment: str = "voted_sentiment",
                   keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """Key columns, text and the two voted labels under their short names."""
    return df.select(*keep, "text", F.col(emotion).alias("emotion"), F.col(sentiment).alias("sentiment"))


def training_table(df: DataFrame, target: str, shots: int | bool = True) -> DataFrame:
    """The text turned into the target's prompt and the target's column renamed to ``label``."""
    check_target(target, ("emotion", "sentiment"))
    prompt = build_prompt(F.col("text"), task_context(target, shots))
    return df.withColumn("text", prompt).withColumnRenamed(target, "label")


def blank(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({column: F.lit("") for column in columns})


def with_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(F.col(text).isNotNull())


def without_rating(df: DataFrame, rating: str) -> DataFrame:
    return df.where(F.col(rating).isNull())


def drop_empty_speaker_rows(df: DataFrame, speaker: str = "speaker", text: str = "text") -> DataFrame:
    """Leave out speaker rows that have no text; rows without a speaker stay."""
    is_speaker = F.coalesce(F.lower(speaker).contains("speaker"), F.lit(False))
    return df.where(~(is_speaker & (F.coalesce(F.col(text), F.lit("")) == "")))


def before_dialogue(df: DataFrame, number: int, conv_no: str = "conv_no") -> DataFrame:
    """Rows up to, not including, the marker of dialogue ``number``."""
    return df.where(F.col(conv_no) < number)


def stratum_by_name(filename: Column, word: str = "singapore", inside: str = "C", outside: str = "D") -> Column:
    return F.when(filename.contains(word), inside).otherwise(outside)


def fill_text(df: DataFrame, text: str = "text", value: str = " ") -> DataFrame:
    return df.fillna({text: value})


def map_values(column: Column, mapping: Mapping, default=None) -> Column:
    """Value lookup in a literal map; values outside it become ``default``."""
    pairs = values(item for pair in mapping.items() for item in pair)
    known = F.try_element_at(F.expr(f"map({pairs})"), column)
    return known if default is None else F.coalesce(known, F.lit(default))


def map_by_table(df: DataFrame, key: str, table: DataFrame, row_id: str = "row_id", rows: int = BROADCAST_ROWS) -> DataFrame:
    """The same with a table that holds each ``key`` once; a hot key is spread over cells of rows."""
    return lookup(df, table, [key], F.pmod(F.xxhash64(row_id), F.lit(4096)), rows=rows)


def flag_members(df: DataFrame, key: str, members: DataFrame, flag: str = "is_member", row_id: str = "row_id",
                 rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add whether the row's key is one of the ``members`` (a table with a column of the same name)."""
    table = members.select(key).distinct().withColumn(flag, F.lit(True))
    return map_by_table(df, key, table, row_id, rows).withColumn(flag, F.coalesce(flag, F.lit(False)))


def rows_not_in(df: DataFrame, others: Sequence[DataFrame], row_id: str = "row_id") -> DataFrame:
    """Rows whose id is in none of the other tables."""
    taken = others[0].select(row_id)
    for other in others[1:]:
        taken = taken.unionByName(other.select(row_id))
    return df.join(taken, row_id, "left_anti")


def rows_except(df: DataFrame, other: DataFrame) -> DataFrame:
    """Whole-row difference that respects repeated rows.

    Equal rows are counted before they are compared, and written out again in cells, since one row may be repeated most.
    """
    columns = df.columns
    mine = df.groupBy(*columns).agg(F.count("*").alias("_mine"))
    theirs = other.select(*[F.col(name).alias(f"_their_{place}") for place, name in enumerate(other.columns)])
    theirs = theirs.groupBy(*theirs.columns).agg(F.count("*").alias("_theirs"))
    test = same(mine, theirs, {name: f"_their_{place}" for place, name in enumerate(columns)})
    left = mine.join(theirs, test, "left").withColumn("_left", F.expr("_mine - coalesce(_theirs, 0L)")).where("_left > 0")
    cells = left.select(*columns, "_left", F.expr(f"explode(sequence(0L, (_left - 1) div {CELL_ROWS})) AS _cell"))
    copies = F.least(F.col("_left") - F.col("_cell") * CELL_ROWS, F.lit(CELL_ROWS).cast("long"))
    dealt = cells.withColumn("_copies", copies).repartition(*columns, "_cell")
    return dealt.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).drop("col")


def disagreements(one: DataFrame, other: DataFrame, field: str = "correct", wipe: Mapping[str, Column] | None = None,
                  label: str = "label", row_id: str = "row_id", first: int | None = None) -> DataFrame:
    """Rows of ``one`` whose ``label.field`` differs from the same row of ``other``, with the label fields emptied.

    ``first`` compares only the leading rows.
    """
    theirs = other.select(F.col(row_id).alias("_their_id"), F.col(label)[field].alias("_theirs"))
    if first is not None:
        one = one.where(F.col(row_id) < first)
    joined = one.join(theirs, one[row_id] == theirs["_their_id"])
    differing = joined.where(~F.col(label)[field].eqNullSafe(F.col("_theirs"))).drop("_their_id", "_theirs")
    wipe = {field: F.lit(""), "error_type": F.expr("cast(array() as array<string>)")} if wipe is None else wipe
    emptied = F.col(label)
    for name, value in wipe.items():
        emptied = emptied.withField(name, value)
    return differing.withColumn(label, emptied)


def trimmed_lower(value: Column) -> Column:
    return F.lower(strip(value))


def check_text_field(text_field: str | None) -> str:
    if not text_field:
        raise ValueError("text_field cannot be empty or null")
    return text_field


def check_file_type(path: str | None, allowed: Sequence[str] = ("csv", "json", "txt")) -> str:
    kind = (path or "").rsplit(".", 1)[-1]
    if kind not in allowed:
        raise ValueError(f"{path!r} should be a {', '.join(allowed)} file")
    return kind


def check_exclusive(**options) -> None:
    """At most one of the options may be given."""
    given = [name for name, value in options.items() if value is not None]
    if len(given) > 1:
        raise ValueError(f"{' and '.join(given)} cannot be used together")
