"""Reports for the runs of a folder tree that have none yet, and the leaderboard over stored reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelmill import fixed_values as fixed
from labelmill.operators.runs import RUN_KEYS, evaluate_runs, leaderboard, literal_table, pending
from labelmill.sinks.writers import report_documents, write_documents
from labelmill.sources.readers import read_documents, read_reports, read_runs, run_files

TARGETS = ("emotion", "sentiment")
REPORT_KEYS = (*RUN_KEYS, "target")
PREDICTIONS = f"text string, {fixed.SENTIMENT_COLUMN} string, {fixed.EMOTION_COLUMN} string"


def evaluate_tree(
    spark: SparkSession, root: str, gold: DataFrame, finished: DataFrame | None = None, file: str = "predictions.csv",
    schema: str = PREDICTIONS, missing: Sequence[str] = (), whole: bool = True,
) -> DataFrame:
    """Reports of all runs under ``root`` in one job. ``gold`` holds dataset, row_id and the voted labels; runs of
    datasets it does not have are left out. ``finished`` holds run keys and targets that have a report already.

    Files of finished runs and of other datasets are not read, and of the rest only the predicted labels. The paths of the
    runs to read pass through the driver, as every listing of files does. ``missing`` lists texts that stand for no answer. A run
    with fewer or more predictions than gold rows is an error unless ``whole`` is off; then what is missing is wrong.
    """
    runs = run_files(spark, root, file).join(gold.select("dataset").distinct(), "dataset", "left_semi")
    if finished is not None:
        wanted = runs.withColumn("target", F.explode(F.array(*map(F.lit, TARGETS))))
        runs = pending(wanted, finished, REPORT_KEYS).drop("target").distinct()
    paths = sorted(row["path"] for row in runs.select("path").collect())
    columns = [fixed.EMOTION_COLUMN, fixed.SENTIMENT_COLUMN]
    if not paths:
        kinds = ", ".join(f"`{name}` string" for name in (*RUN_KEYS, *columns)) + ", row_id long"
        return evaluate_runs(spark.createDataFrame([], kinds), gold)
    reports = evaluate_runs(read_runs(spark, paths, file, schema, columns, missing), gold, whole=whole)
    return reports if finished is None else pending(reports, finished, REPORT_KEYS)


def store_reports(reports: DataFrame, path: str) -> None:
    """Add the documents of new reports to the stored ones."""
    write_documents(report_documents(reports), path, mode="append")


def stored_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports written by :func:`store_reports`; the keys serve as ``finished`` of the next evaluation."""
    return read_documents(spark, path, REPORT_KEYS)


def consolidate(spark: SparkSession, root: str, datasets: Sequence[str], target: str | None = None) -> DataFrame:
    """The leaderboard of the stored reports of known datasets."""
    reports = read_reports(spark, root)
    if target is not None:
        reports = reports.where(F.col("target") == target)
    known = F.broadcast(literal_table(spark, {"dataset": list(dict.fromkeys(datasets))}))
    return leaderboard(reports.join(known, "dataset"))
