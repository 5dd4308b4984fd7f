"""Running a caller's model over prompt columns, and putting its answers next to the input rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from labelmill import fixed_values as fixed
from labelmill.batches import small_batches
from labelmill.functions.text import first_label
from labelmill.operators.runs import pending
from labelmill.settle import land
from labelmill.sinks.versions import append, read_versions

Scorer = Callable[[list[str]], Sequence[str]]
BATCH_ROWS = 32
#: Rows whose answers are published together; a run that is ended loses no more.
COMMIT_ROWS = 1_000_000


def batch_score(
    df: DataFrame, prompts: Mapping[str, str], scorer_factory: Callable[[], Scorer], batch_size: int = BATCH_ROWS
) -> DataFrame:
    """Add one answer column per ``{prompt column: answer column}``.

    ``scorer_factory`` is called once per task and gives a function from a list of prompts to as many texts. Rows keep
    their columns, so nothing has to be joined afterwards. Null prompts are not sent and get a null answer.
    """
    pairs = list(prompts.items())

    def answer(score: Scorer, texts: list[str | None]) -> list[str | None]:
        answers: list[str | None] = []
        for start in range(0, len(texts), batch_size):
            batch = texts[start : start + batch_size]
            asked = [text for text in batch if text is not None]
            given = list(score(asked)) if asked else []
            if len(given) != len(asked):
                raise ValueError(f"the scorer gave {len(given)} answers to {len(asked)} prompts")
            rest = iter(given)
            answers += [None if text is None else next(rest) for text in batch]
        return answers

    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = None
        for batch in batches:
            score = score or scorer_factory()
            columns, names = list(batch.columns), list(batch.schema.names)
            for prompt, name in pairs:
                texts = batch.column(names.index(prompt)).to_pylist()
                columns.append(pa.array(answer(score, texts), pa.string()))
                names.append(name)
            yield pa.RecordBatch.from_arrays(columns, names)

    added = [T.StructField(name, T.StringType()) for _, name in pairs]
    small_batches(df.sparkSession)
    return df.mapInArrow(score_batches, T.StructType(df.schema.fields + added))


def score_with_log(
    df: DataFrame, log: str, prompts: Mapping[str, str], scorer_factory: Callable[[], Scorer], row_id: str = "row_id",
    commit_rows: int = COMMIT_ROWS, batch_size: int = BATCH_ROWS,
) -> DataFrame:
    """Answers as ``batch_score`` gives them, kept in a log as they come: rows are asked range by range of ``row_id``, and
    the answers of ``commit_rows`` rows are published as one version of the table at ``log`` before the next ones are asked.

    A run that was ended goes on where it stopped, and asks only for rows without an answer in the log. Batches hold
    prompts of similar length, so that short ones do not wait for long ones; the result comes with ``row_id``, which has the order. A row id
    occurs once. Null prompts count as answered, with null. Returns the rows of the log for ``df``: row_id and the answers.
    """
    spark = df.sparkSession
    names = list(prompts.values())
    kinds = T.StructType([df.schema[row_id], *(T.StructField(name, T.StringType()) for name in names)])
    like = spark.createDataFrame([], kinds)
    asked = df.select(row_id, *prompts)
    part = F.floor(F.col(row_id) / commit_rows)
    wanted = asked.select(row_id)
    open_parts = pending(wanted, read_versions(like, log), [row_id]).select(part.alias("part")).distinct()
    # One short number for each commit that is still to be made.
    for entry in open_parts.orderBy("part").toLocalIterator():
        lo = entry["part"] * commit_rows
        own = asked.where((F.col(row_id) >= lo) & (F.col(row_id) < lo + commit_rows))
        missing = land(pending(own, read_versions(like, log), [row_id]))
        size = sum((F.coalesce(F.length(F.col(name)), F.lit(0)) for name in prompts), F.lit(0))
        # As many rows for each task, of similar length.
        dealt = missing.repartitionByRange(size, F.col(row_id)).sortWithinPartitions(size, row_id)
        append(batch_score(dealt, prompts, scorer_factory, batch_size).select(row_id, *names), log, [row_id])
    return read_versions(like, log).join(wanted, row_id, "left_semi")


def extract_labels(df: DataFrame, combined: bool = True, mode: str = "word") -> DataFrame:
    """Emotion and sentiment columns read out of the raw answers."""
    emotion_raw = fixed.RAW_COLUMN if combined else fixed.EMOTION_RAW_COLUMN
    sentiment_raw = fixed.RAW_COLUMN if combined else fixed.SENTIMENT_RAW_COLUMN
    return df.withColumns(
        {
            fixed.SENTIMENT_COLUMN: first_label(F.col(sentiment_raw), fixed.SENTIMENTS, mode),
            fixed.EMOTION_COLUMN: first_label(F.col(emotion_raw), fixed.EMOTIONS, mode),
        }
    )


def attach(df: DataFrame, predictions: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Input rows with their predictions; where both have a column, the input's stays."""
    clashing = [name for name in predictions.columns if name in df.columns and name != row_id]
    return df.join(predictions.drop(*clashing), row_id)


def merge_passes(emotions: DataFrame, sentiments: DataFrame, row_id: str = "row_id") -> DataFrame:
    """The results of two separate passes over the same rows."""
    return emotions.join(sentiments, row_id)
