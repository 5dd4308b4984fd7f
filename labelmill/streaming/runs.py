"""Runs scored as their files arrive: a stream of run folders whose reports go to a table of versions.

The stream's checkpoint remembers the files it has handled, so finished runs are neither read nor compared again. Each
batch scores the runs whose files came with it and publishes their reports with the version of the run's file. A batch that
is repeated after a lost driver, or two streams over one tree, leave each report once. A run that arrives late is one more file.
A run that is written again in part files of new names (as Spark writes them) is scored again, and its latest reports count; a file
that is replaced under its own name is not noticed, as file streams know files by their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from labelmill import fixed_values as fixed
from labelmill.operators.runs import RUN_KEYS, evaluate_runs
from labelmill.plans.evaluate import PREDICTIONS
from labelmill.settle import land, lookup
from labelmill.sinks import versions
from labelmill.sources.readers import PART_FILE, read_runs, run_of

#: What a report of a stream is known by: the run, the target, its line, and when the run's file was written.
REPORT_ROW = (*RUN_KEYS, "target", "ordinal", "written")
STORED = (
    ", ".join(f"{key} string" for key in (*RUN_KEYS, "target"))
    + ", ordinal long, label string, precision double, recall double, f1 double, support long, written timestamp"
)


def arriving_runs(
    spark: SparkSession, root: str, file: str = "predictions.csv", per_batch: int | None = None,
) -> DataFrame:
    """A stream of (dataset, model_id, generation_config, path, written): one row for each file of a run, when it arrives. Only
    names and times are read, never contents. ``file`` is the name of the run's file, or of a folder of part files.
    ``per_batch`` bounds the files of one batch."""
    kinds = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(kinds)
    reader = reader if per_batch is None else reader.option("maxFilesPerTrigger", per_batch)
    found = reader.load(f"{root}/*/*/*/{file}")
    return found.select(*[value.alias(name) for name, value in run_of(F.col("path")).items()], "path", F.col("modificationTime").alias("written"))


def score_batch(
    gold: DataFrame, path: str, file: str = "predictions.csv", schema: str | T.StructType = PREDICTIONS, missing: Sequence[str] = (),
) -> Callable[[DataFrame, int], None]:
    """What a stream does with a batch of arrived files: score their runs on ``gold`` and publish the reports at ``path``.

    Runs of datasets that ``gold`` does not have are left out. A run in several part files is read whole: it is scored on
    what is there, and again when another part comes. Predictions that are not there are wrong.
    """

    def handle(batch: DataFrame, _: int) -> None:
        arrived = land(batch.groupBy(*RUN_KEYS).agg(F.max("written").alias("written"), F.collect_set("path").alias("paths")))
        known = lookup(arrived, gold.select("dataset").distinct(), ["dataset"], F.pmod(F.xxhash64(*RUN_KEYS), F.lit(64)), how="left_semi")
        whole = F.regexp_replace(F.element_at("paths", 1), PART_FILE, "")
        # One path for each run of the batch, not for each of the tree.
        places = sorted(row["path"] for row in known.select(whole.alias("path")).collect())
        if not places:
            return
        columns = [fixed.EMOTION_COLUMN, fixed.SENTIMENT_COLUMN]
        said = read_runs(batch.sparkSession, places, file, schema, columns, missing)
        reports = evaluate_runs(said, gold)
        times = arrived.select(*RUN_KEYS, "written")
        versions.append(reports.join(times, list(RUN_KEYS)), path, REPORT_ROW)

    return handle


def score_available(
    spark: SparkSession, root: str, gold: DataFrame, path: str, checkpoint: str, file: str = "predictions.csv",
    schema: str | T.StructType = PREDICTIONS, missing: Sequence[str] = (), per_batch: int | None = None,
) -> None:
    """Score every run whose file has arrived since the last call with this ``checkpoint``, once, and stop. For a stream that
    goes on, start ``arriving_runs`` with ``score_batch`` and another trigger."""
    stream = arriving_runs(spark, root, file, per_batch).writeStream.option("checkpointLocation", checkpoint)
    stream.foreachBatch(score_batch(gold, path, file, schema, missing)).trigger(availableNow=True).start().awaitTermination()


def latest_reports(spark: SparkSession, path: str) -> DataFrame:
    """The reports at ``path``, of each run those of its latest file only. Empty where there are none yet."""
    stored = versions.read_versions(spark.createDataFrame([], STORED), path)
    last = stored.groupBy(*RUN_KEYS).agg(F.max("written").alias("written"))
    return stored.join(last, [*RUN_KEYS, "written"]).drop("written")
