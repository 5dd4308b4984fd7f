"""Results that are written once to shared storage, and joins against tables of a checked size."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 128 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session: the one the cluster names in ``spark.checkpoint.dir``, or a new one beside the
    tables of its warehouse where none is named. On a cluster a warehouse on a machine's own disk is no such place: that is
    an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            warehouse = spark.conf.get("spark.sql.warehouse.dir")
            if not re.match(r"local(\[|$)", context.master) and warehouse.startswith(("file:", "/")):
                raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
            folder = f"{warehouse}/checkpoints-{uuid.uuid4().hex}"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def release(spark: SparkSession) -> None:
    """Remove all that was landed or checkpointed in this session. DataFrames that were built on it can no longer be read, so
    call it once their results are written."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(folder):
        for entry in files.listStatus(folder):
            files.delete(entry.getPath(), True)


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint a short table, so a lost executor costs no recount and later passes see the same rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _holds_void(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_void(field.dataType) for field in kind.fields)
    if isinstance(kind, T.MapType):
        return _holds_void(kind.keyType) or _holds_void(kind.valueType)
    return _holds_void(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, T.NullType)


def land(df: DataFrame) -> DataFrame:
    """The same for tables as long as the data: written as Parquet next to the checkpoints, so that later passes read
    only the columns they need."""
    spark = df.sparkSession
    if _holds_void(df.schema):
        return settle(df)  # Parquet has no such type
    path = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits(held: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a settled table is small enough to broadcast: at most ``rows`` rows, and its texts within a fixed size."""
    texts = [F.octet_length(name) for name, kind in held.dtypes if kind in ("string", "binary")]
    texts += [
        F.octet_length(F.to_json(F.struct(name))) for name, kind in held.dtypes if kind.startswith(("array", "struct", "map"))
    ]
    size = F.lit(0).cast("long")
    for text in texts:
        size = size + F.coalesce(text, F.lit(0))
    counted = held.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    return counted["n"] <= rows and counted["size"] <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Settle ``df`` and hint a broadcast only when it was found to fit."""
    held = settle(df)
    return F.broadcast(held) if fits(held, rows) else held


def same(left: DataFrame, right: DataFrame, names: dict[str, str]) -> Column:
    """Null-safe equality of ``left[key]`` and ``right[value]`` over all pairs of ``names``."""
    test = F.lit(True)
    for mine, theirs in names.items():
        test = test & left[mine].eqNullSafe(right[theirs])
    return test


def lookup(
    df: DataFrame,
    table: DataFrame,
    on: list[str],
    spread: Column,
    how: str = "left",
    rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join ``df`` to a table that holds each key once, when a few keys of ``df`` may hold most of its rows.

    The table is settled and measured. One that fits is broadcast and ``df`` is not shuffled. A larger one is first
    repeated for the (key, ``spread``) pairs that occur, so no join key holds more rows than one spread cell.
    """
    held = settle(table)
    renamed = held.withColumnsRenamed({key: f"_on_{key}" for key in on})
    pairs = {key: f"_on_{key}" for key in on}
    if fits(held, rows):
        small = F.broadcast(renamed)
        return df.join(small, same(df, small, pairs), how).drop(*pairs.values())
    wide = df.withColumn("_cell", spread)
    cells = wide.select(*on, "_cell").distinct()
    cells = cells.withColumnsRenamed({"_cell": "_on__cell", **{key: f"_cell_{key}" for key in on}})
    hits = cells.join(renamed, same(cells, renamed, {f"_cell_{key}": f"_on_{key}" for key in on}))
    hits = hits.drop(*(f"_cell_{key}" for key in on))
    out = wide.join(hits, same(wide, hits, {"_cell": "_on__cell", **pairs}), how)
    return out.drop("_cell", "_on__cell", *pairs.values())
