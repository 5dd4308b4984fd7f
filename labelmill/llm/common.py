"""What several operators share: tables, batches of texts, and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from labelmill.batches import small_batches
from labelmill.settle import land

BATCH_ROWS = 1000
BATCH_BYTES = 4_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def widened(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of ``df`` with further columns; ``StructType.add`` would change the schema that ``df`` caches."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, T.DataType.fromDDL(v)) for k, v in columns.items())])


def utf8(text: str) -> Column:
    """The text as bytes; null stays null."""
    return F.col(text).cast("binary")


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_ROWS`` rows and a few megabytes, since one row may hold a very long text or
    a long list. Workers outlive their tasks, so what a task has freed goes back to the system at its end."""
    spark = df.sparkSession
    small_batches(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the values of one column take about ``most`` bytes, one row at least."""
    values = batch.column(column)
    sizes = _lengths(values)
    start, total = 0, 0
    for row, size in enumerate(sizes):
        if total and total + size > most:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def _lengths(values: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(values.value_lengths() if pa.types.is_list(values.type) else pc.binary_length(values), 0).to_pylist()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (columns a, b: long) as (node, root), root the smallest node.

    Alternating large-star and small-star steps: each links a node's neighbours to the smallest of them, so a component
    shrinks to a star around its smallest node in about log(n) rounds. A round is written to the shared folder; no node
    needs its neighbours in one place, only their minimum, which is pre-aggregated. Loops and repeated edges are ignored,
    an empty table gives an empty result.
    """
    order = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = land(order(edges.select("a", "b")))
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = order(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # Every link now points from a larger node to a smaller one.
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = land(order(small.unionByName(lower.select("a", F.col("m").alias("b")))))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
