"""Shards of near equal size by sampled splitters over a key, overfull ranges subdivided."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from labelmill.settle import land

#: Ranges for each shard, and sampled keys for each range.
RANGES, DRAWS = 8, 16


def assign(df: DataFrame, n: int, size: Column, key: Column, *tie: str) -> DataFrame:
    """``df`` (other columns kept, those named like the new ones replaced) with ``size`` (long), ``shard`` (int, 0 to n-1) and ``slot`` (long, gapless from 0 in each
    shard), so that the sums of ``size`` are near equal: none is further from the mean than the largest single row.

    Rows are ordered by ``key`` (a long; equal keys stand together), then by the columns ``tie``. A sample in which a row
    stands with a chance in proportion to its size gives splitters at its quantiles; they bound the sample, so what is
    collected and broadcast grows with ``n`` only. Each range is measured. One that holds more than its share, such as a key
    with a third of all rows, is dealt into cells by the hash of its place in the landed table. Cells are ordered by one sum
    over the short table of cells, rows by a window within their cell, so no task holds more than a cell.

    A size must not be negative; null counts as 0. Rows may repeat; a null key comes first. An empty table gives no rows. The
    input is landed once, so that a lost executor cannot change the order.
    """
    if n < 1:
        raise ValueError("at least one shard is needed")
    names = [c for c in df.columns if c.lower() not in ("size", "shard", "slot")]
    body = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in names)).alias("body")
    rows = land(df.select(body, F.coalesce(size, F.lit(0)).cast("long").alias("size"), F.coalesce(key, F.lit(-(2**63))).cast("long").alias("key"), F.monotonically_increasing_id().alias("row")))
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    total, wide = int(total or 0), n * RANGES
    weight = F.col("size") if total else F.lit(1)
    whole = total or int(count or 1)
    # Deterministic draws: the hash of the row's number decides.
    chance = F.pmod(F.xxhash64("row", F.lit(17)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    sample = rows.where(chance < weight * float(wide * DRAWS) / whole).select("key")
    keys = np.sort(np.asarray(sample.toArrow()["key"], np.int64))
    cuts = np.unique(keys[np.linspace(0, len(keys) - 1, wide + 1).astype(int)[1:-1]]) if len(keys) else np.zeros(0, np.int64)

    @F.pandas_udf("int")
    def range_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            own, places = batch.to_numpy(), np.searchsorted(cuts, batch.to_numpy(), "right") * 2
            at = np.searchsorted(cuts, own, "left")
            equal = (at < len(cuts)) & (cuts[np.minimum(at, len(cuts) - 1)] == own) if len(cuts) else np.zeros(len(own), bool)
            # A splitter's own key is a range of one key, between the ranges beside it.
            yield pd.Series(np.where(equal, at * 2 + 1, places)).astype("int32")

    placed = rows.withColumn("range", range_of("key"))
    fair, most = max(1, whole // wide), max(1, (count or 1) // wide)
    measured = placed.groupBy("range").agg(F.sum("size").alias("held"), F.count("*").alias("n"))
    cells = {
        r["range"]: int(max(-(-r["held"] // (2 * fair)), -(-r["n"] // (4 * most)), 1)) for r in measured.collect()
    }  # at most twice as many ranges as splitters
    parts = F.create_map(*(x for k, v in cells.items() if v > 1 for x in (F.lit(k), F.lit(v)))) if any(v > 1 for v in cells.values()) else None
    cell = F.lit(0) if parts is None else F.pmod(F.xxhash64("row"), F.coalesce(parts[F.col("range")], F.lit(1))).cast("int")
    placed = placed.withColumn("cell", cell)
    sums = placed.groupBy("range", "cell").agg(F.sum("size").alias("held"), F.count("*").alias("n")).collect()
    before, held, ranks = {}, 0, 0
    for r in sorted(sums, key=lambda r: (r["range"], r["cell"])):
        before[r["range"], r["cell"]] = (held, ranks)
        held, ranks = held + r["held"], ranks + r["n"]
    spark = df.sparkSession
    offsets = spark.createDataFrame([(*k, *v) for k, v in before.items()], "range int, cell int, held0 long, rank0 long")
    inside = Window.partitionBy("range", "cell").orderBy("key", *(F.col(f"body.`{c}`") for c in tie), "row")
    up_to = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = placed.withColumn("sum", F.sum("size").over(up_to)).withColumn("n", F.row_number().over(inside))
    ordered = ordered.join(F.broadcast(offsets), ["range", "cell"])
    middle = (F.col("held0") + F.col("sum")) * 2 - F.col("size") if total else (F.col("rank0") + F.col("n")) * 2 - 1
    shard = F.least(F.floor(middle.cast("decimal(38,0)") * n / (2 * whole)).cast("int"), F.lit(n - 1))
    ordered = land(ordered.select("body", "size", shard.alias("shard"), (F.col("rank0") + F.col("n") - 1).alias("rank")))
    firsts = ordered.groupBy("shard").agg(F.min("rank").alias("first"))
    return ordered.join(F.broadcast(firsts), "shard").select(
        *(F.col(f"body.`{c}`") for c in names), "size", "shard", (F.col("rank") - F.col("first")).alias("slot")
    )


def write(sharded: DataFrame, path: str, n: int, files: int = 1) -> None:
    """Write an assigned table as folders ``shard=k`` of ``files`` Parquet files each, ordered by slot within a file."""
    spread = F.pmod(F.col("slot"), F.lit(files))
    out = sharded.repartition(n * files, "shard", spread).sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").parquet(path)
