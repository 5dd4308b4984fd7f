"""Tables of runs: what is wanted, what is finished, how every run scored and which ones lead."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from labelmill import fixed_values as fixed
from labelmill.operators.metrics import target_reports
from labelmill.settle import broadcast_if_small, lookup, same, settle

RUN_KEYS = ("dataset", "model_id", "generation_config")


def literal_table(spark: SparkSession, columns: Mapping[str, Sequence]) -> DataFrame:
    """A table of values the caller wrote down."""
    return spark.createDataFrame(pa.table({name: list(values) for name, values in columns.items()}))


def param_grid(spark: SparkSession, axes: Mapping[str, Sequence]) -> DataFrame:
    """All combinations of the given settings, the first axis varying slowest."""
    rows = list(product(*axes.values()))
    return literal_table(spark, {name: [row[place] for row in rows] for place, name in enumerate(axes)})


def pending(wanted: DataFrame, finished: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wanted runs that are not finished."""
    return wanted.join(finished.select(*keys).distinct(), list(keys), "left_anti")


def known_only(df: DataFrame, known: DataFrame, key: str = "dataset") -> DataFrame:
    """Rows of the datasets in a registry, with the registry's columns; one dataset may hold most of the rows."""
    return lookup(df, known, [key], F.pmod(F.xxhash64(*df.columns), F.lit(4096)), how="inner")


def _once(predictions: DataFrame, keys: Sequence[str], columns: Sequence[str], join_keys: Sequence[str], repeated: str) -> DataFrame:
    """The keys and columns of predictions with one row for each key, and ``_rows``, how often it was given. They are dealt out by
    the gold rows' keys, so that the join with these needs no further exchange."""
    dealt = predictions.select(*keys, F.struct(F.lit(0), *columns).alias("_said")).repartition(*join_keys)
    one = dealt.groupBy(*keys).agg(F.count("*").alias("_rows"), F.min("_said").alias("_said"))
    said = F.col("_said")
    if repeated == "fail":
        place = F.concat_ws(" ", *[F.col(key).cast("string") for key in keys])
        said = F.when(F.col("_rows") > 1, F.raise_error(F.concat(F.lit("repeated prediction: "), place))).otherwise(said)
    return one.select(*keys, "_rows", *[said[column].alias(column) for column in columns])


def _shared(run_keys: Sequence[str], join_keys: Sequence[str]) -> list[str]:
    shared = [key for key in run_keys if key in join_keys]
    if not shared:
        raise ValueError("runs and gold rows need a key in common")
    return shared


def coverage(
    predictions: DataFrame, gold: DataFrame, run_keys: Sequence[str] = RUN_KEYS, join_keys: Sequence[str] = ("dataset", "row_id"),
) -> DataFrame:
    """Per run: gold rows, rows of its own, gold rows it has no prediction for, rows it has a prediction for more than once
    (``repeated`` counts the further ones), and predictions without a gold row. Gold rows are not repeated for the runs."""
    shared = _shared(run_keys, join_keys)
    keys = list(dict.fromkeys([*run_keys, *join_keys]))
    one = _once(predictions, keys, [], join_keys, "least")
    found = one.join(gold.select(*join_keys, F.lit(1).alias("_gold")), list(join_keys), "left")
    counts = {"own_rows": F.sum("_rows"), "_own": F.count("*"), "_met": F.count("_gold")}
    per_run = found.groupBy(*run_keys).agg(*[value.alias(name) for name, value in counts.items()])
    sizes = broadcast_if_small(gold.groupBy(*shared).agg(F.count("*").alias("gold_rows")))
    return per_run.join(sizes, shared).select(
        *run_keys, "gold_rows", "own_rows", (F.col("gold_rows") - F.col("_met")).alias("missing"),
        (F.col("own_rows") - F.col("_own")).alias("repeated"), (F.col("_own") - F.col("_met")).alias("surplus"),
    )


def evaluate_runs(
    predictions: DataFrame,
    gold: DataFrame,
    targets: Mapping[str, tuple[str, str, Sequence[str]]] | None = None,
    run_keys: Sequence[str] = RUN_KEYS,
    join_keys: Sequence[str] = ("dataset", "row_id"),
    repeated: str = "fail",
    whole: bool = False,
) -> DataFrame:
    """Reports of every run and target in one job: ``targets`` maps a name to gold column, predicted column, labels.

    Every run is scored on each gold row of its dataset once; what it has no prediction for is wrong. Of these rows only the
    number by gold labels is needed: that of the dataset less that of the rows the run has answered. A second prediction for a row is
    an error, or with ``repeated="least"`` the smallest one counts. Predictions without a gold row count nowhere. With ``whole`` a
    run with missing or surplus predictions is an error; ``coverage`` counts them.
    """
    if repeated not in ("fail", "least"):
        raise ValueError("repeated is fail or least")
    if targets is None:
        targets = {
            "emotion": ("voted_emotion", fixed.EMOTION_COLUMN, fixed.EMOTIONS),
            "sentiment": ("voted_sentiment", fixed.SENTIMENT_COLUMN, fixed.SENTIMENTS),
        }
    shared = _shared(run_keys, join_keys)
    wanted = [column for truth, said, _ in targets.values() for column in (truth, said)]
    predicted = [column for column in dict.fromkeys(wanted) if column in predictions.columns]
    true = [column for column in dict.fromkeys(wanted) if column not in predicted]
    keys = list(dict.fromkeys([*run_keys, *join_keys]))
    one = _once(predictions, keys, predicted, join_keys, repeated)
    met = one.join(gold.select(*join_keys, *true, F.lit(1).alias("_gold")), list(join_keys), "left")
    # From here on there is one row for each combination of labels, not for each prediction.
    counted = settle(met.groupBy(*run_keys, *true, *predicted, F.col("_gold").isNull().alias("_surplus")).agg(F.count("*").alias("_n")))
    known = broadcast_if_small(gold.groupBy(*shared, *true).agg(F.count("*").alias("_all")))
    runs = counted.select(*run_keys).distinct()
    have = counted.where("not _surplus").groupBy(*run_keys, *true).agg(F.sum("_n").alias("_have")).withColumnsRenamed({c: f"_of_{c}" for c in [*run_keys, *true]})
    expected = runs.join(known, shared)
    missing = expected.join(have, same(expected, have, {c: f"_of_{c}" for c in [*run_keys, *true]}), "left")
    missing = missing.select(*run_keys, *true, (F.col("_all") - F.coalesce("_have", F.lit(0))).alias("_n")).where("_n > 0")
    if whole:
        told = F.concat_ws(" ", *[F.col(key).cast("string") for key in run_keys])
        short = counted.where("_surplus").select(*run_keys).unionByName(missing.select(*run_keys)).select(told.alias("run")).distinct().limit(5)
        if names := [row["run"] for row in short.collect()]:
            raise ValueError(f"runs whose predictions are not those of the gold rows: {names}")
    answered = counted.where("not _surplus").select(*run_keys, *true, *predicted, "_n")
    rows = answered.unionByName(missing, allowMissingColumns=True)
    reports = target_reports(rows, targets, by=run_keys, weight="_n")
    return reports.select(*run_keys, "target", "ordinal", "label", "precision", "recall", "f1", "support")


def leaderboard(
    reports: DataFrame, label: str = "weighted avg", score: str = "f1", places: int = 5, run_keys: Sequence[str] = RUN_KEYS,
    group: str = "dataset", by: Sequence[str] = ("target",),
) -> DataFrame:
    """One row per run and target with the chosen score, best first within its dataset; ties follow the run's name."""
    metric = f"{label}_{'f1-score' if score == 'f1' else score}"
    rows = reports.where(F.col("label") == label).select(
        *run_keys, *by, F.lit(metric).alias("metric"), F.round(score, places).alias("score")
    )
    return rows.orderBy(*by, group, F.desc("score"), *[key for key in run_keys if key != group])


def top_runs(board: DataFrame, k: int = 1, group: Sequence[str] = ("dataset", "target"),
             run_keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """The best ``k`` runs of each group, with their rank."""
    best_first = W.partitionBy(*group).orderBy(F.desc("score"), *[key for key in run_keys if key not in group])
    return board.withColumn("rank", F.row_number().over(best_first).cast("long")).where(F.col("rank") <= k)
