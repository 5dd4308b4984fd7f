"""Positions without a one-task sort: running totals, row numbers, slices, annotation batches and dialogue chunks.

A running total is cut into cells that follow the order. Each cell is summed by its own window partition, led by a row
with the total of the cells before it, so neither one group nor the whole table ends up in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from labelmill.settle import land, lookup

CELL_ROWS = 100_000
#: 64-bit numbers have fewer than 10,000 cells on the third level.
LEVELS = 3
#: Totals of all groups together that one window may hold: short rows.
FEW_CELLS = 100_000


def running(
    df: DataFrame,
    order: str | Sequence[str],
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    by: Sequence[str] = (),
    cell: Column | None = None,
    levels: int = LEVELS,
    own: bool = True,
) -> DataFrame:
    """Add running sums and maxima, each over the rows of the same ``by`` group up to and including the own row (``own=False``:
    before it).

    ``cell`` must not fall along the order; by default it cuts the first, numeric order column into equal ranges. The totals
    before a cell are running sums over cells. These totals are stored and counted: up to ``FEW_CELLS`` meet in one window, more are
    summed the same way on ``levels`` levels, so ids that are far apart and give nearly every row a cell of its own do not
    meet in one task. A given ``cell`` must have few values in each group.
    """
    order = [order] if isinstance(order, str) else list(order)
    sums, maxes, by = dict(sums or {}), dict(maxes or {}), list(by)
    keys = [*by, "_cell"]
    held = [*[f"add_{name}" for name in sums], *[f"top_{name}" for name in maxes]]
    cells = df.withColumns(
        {"_cell": F.floor(F.col(order[0]) / CELL_ROWS) if cell is None else cell, "_lead": F.lit(1)}
        | {f"_add_{name}": value for name, value in sums.items()}
        | {f"_top_{name}": value for name, value in maxes.items()}
    )
    totals = cells.groupBy(*keys).agg(
        F.lit(0).alias("_lead"),
        *[F.sum(f"_add_{name}").alias(f"_add_{name}") for name in sums],
        *[F.max(f"_top_{name}").alias(f"_top_{name}") for name in maxes],
    )
    totals = land(totals)
    if cell is None and levels > 1 and totals.count() > FEW_CELLS:
        inner = totals.withColumnsRenamed({"_cell": "_at", **{f"_{kind}": f"_of_{kind}" for kind in held}}).drop("_lead")
        added = {f"_{kind}": F.col(f"_of_{kind}") for kind in held}
        higher = running(
            inner, "_at", {k: v for k, v in added.items() if k.startswith("_add")}, {k: v for k, v in added.items() if k.startswith("_top")},
            by, levels=levels - 1, own=False,
        )
        before = higher.drop(*[f"_of_{kind}" for kind in held]).withColumnRenamed("_at", "_cell").withColumn("_lead", F.lit(0))
    else:
        earlier = W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
        before = totals.withColumns(
            {f"_add_{name}": F.coalesce(F.sum(f"_add_{name}").over(earlier), F.lit(0)) for name in sums}
            | {f"_top_{name}": F.max(f"_top_{name}").over(earlier) for name in maxes}
        )
    # One row with what came before leads every cell, so the window needs no join to go on from it.
    led = cells.unionByName(before, allowMissingColumns=True)
    inside = W.partitionBy(*keys).orderBy("_lead", *order).rowsBetween(W.unboundedPreceding, 0 if own else -1)
    out = led.withColumns(
        {name: F.sum(f"_add_{name}").over(inside) for name in sums}
        | {name: F.max(f"_top_{name}").over(inside) for name in maxes}
    )
    helpers = ["_cell", "_lead", *[f"_add_{name}" for name in sums], *[f"_top_{name}" for name in maxes]]
    return out.where(F.col("_lead") == 1).drop(*helpers)


def row_ids(df: DataFrame, order_by: Sequence[str | Column], name: str = "row_id") -> DataFrame:
    """Number all rows from 0 in the given order.

    The sorted rows are landed once, so the number of rows per sorted part cannot change between the two passes.
    """
    ranked = land(df.orderBy(*order_by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    parts = ranked.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    # One row per sorted part, so never more than the number of shuffle partitions.
    starts = F.broadcast(parts.select("_part", F.coalesce(before, F.lit(0)).alias("_start")))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranked.join(starts, part == F.col("_part")).withColumn(name, F.col("_start") + inside).drop(
        "_at", "_part", "_start"
    )


def take_slice(df: DataFrame, start: int, stop: int | None = None, row_id: str = "row_id") -> DataFrame:
    rows = df.where(F.col(row_id) >= start)
    return rows if stop is None else rows.where(F.col(row_id) < stop)


def head_rows(df: DataFrame, n: int, row_id: str = "row_id") -> DataFrame:
    return take_slice(df, 0, n, row_id)


def head_share(df: DataFrame, share: float, row_id: str = "row_id") -> DataFrame:
    """The first ``floor(rows * share)`` rows; a share of 1 or more keeps everything."""
    if share >= 1:
        return df
    rows = df.agg(F.floor(F.count("*") * F.lit(float(share)))).scalar()
    return df.where(F.col(row_id) < rows)


def last_row(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    return df.where(F.col(row_id) == df.agg(F.max(row_id)).scalar())


def stack_parts(parts: Sequence[DataFrame], name: str = "part") -> DataFrame:
    """Union all; the part number keeps the order of the inputs."""
    stacked = parts[0].withColumn(name, F.lit(0))
    for number, part in enumerate(parts[1:], start=1):
        stacked = stacked.unionByName(part.withColumn(name, F.lit(number)))
    return stacked


def concat_ranges(df: DataFrame, ranges: Sequence[tuple[int, int | None]], row_id: str = "row_id") -> DataFrame:
    """The rows of the position ranges one after another, renumbered; a row in two ranges comes out twice.

    Only the last range may be open.
    """
    at, pieces, start = F.col(row_id), [], 0
    for low, high in ranges:
        inside = at >= low if high is None else (at >= low) & (at < high)
        pieces.append(F.when(inside, at - low + start))
        start += 0 if high is None else high - low
    places = F.filter(F.array(*pieces), lambda place: place.isNotNull())
    return df.withColumn("_place", F.explode(places)).withColumn(row_id, F.col("_place")).drop("_place")


def qc_batches(
    df: DataFrame, qc: int = 300, qc_size: int = 75, other_size: int = 525, k: int = 4, row_id: str = "row_id"
) -> DataFrame:
    """Deal the first ``qc`` rows and the others into ``k`` batches, control rows first; the last takes what remains."""
    at = F.col(row_id)
    is_qc = at < qc
    place = F.when(is_qc, at).otherwise(at - qc)
    batch = F.least(F.floor(place / F.when(is_qc, qc_size).otherwise(other_size)), F.lit(k - 1).cast("long"))
    out = df.withColumns({"is_qc": is_qc, "batch": batch})
    return out.withColumn("batch_pos", place - _batch_start(qc, qc_size, other_size, k))


def restore_batches(
    df: DataFrame, qc: int = 300, qc_size: int = 75, other_size: int = 525, k: int = 4, row_id: str = "row_id"
) -> DataFrame:
    """The positions before :func:`qc_batches`, from batch number and position inside the batch."""
    place = F.col("batch_pos") + _batch_start(qc, qc_size, other_size, k)
    return df.withColumn(row_id, F.when(F.col("is_qc"), place).otherwise(place + qc))


def _batch_start(qc: int, qc_size: int, other_size: int, k: int) -> Column:
    """Place of a batch's first own-kind row, less the control rows that stand before it in the batch."""
    batch = F.col("batch")
    left = F.greatest(F.lit(qc) - batch * qc_size, F.lit(0))
    ahead = F.when(batch < k - 1, F.least(left, F.lit(qc_size))).otherwise(left)
    return F.when(F.col("is_qc"), batch * qc_size).otherwise(batch * other_size - ahead)


def chunk_dialogues(df: DataFrame, k: int, conv_no: str = "conv_no") -> DataFrame:
    """``floor(n / k)`` dialogues to a chunk, the rest to the last one; rows before the first dialogue are left out."""
    inside = df.where(F.col(conv_no) >= 0)
    size = inside.agg(F.floor((F.max(conv_no) + 1) / k)).scalar()
    chunk = F.when(size > 0, F.least(F.floor(F.col(conv_no) / size), F.lit(k - 1).cast("long"))).otherwise(k - 1)
    return inside.withColumn("chunk", chunk.cast("long"))


def relabel_dialogues(df: DataFrame, source: str = "source", conv_no: str = "conv_no") -> DataFrame:
    """Number dialogues anew over all chunks, inside a chunk by source; dialogues are dense within each source."""
    runs = df.groupBy("chunk", source).agg(F.min(conv_no).alias("_first"), F.max(conv_no).alias("_last"))
    size = F.col("_last") - F.col("_first") + 1
    before = W.orderBy("chunk", source).rowsBetween(W.unboundedPreceding, -1)
    starts = runs.withColumn("_start", F.coalesce(F.sum(size).over(before), F.lit(0)) - F.col("_first"))
    starts = starts.select("chunk", source, "_start")
    joined = lookup(df, starts, ["chunk", source], F.floor(F.col(conv_no) / CELL_ROWS), how="inner")
    return joined.withColumn("new_conv_no", F.col(conv_no) + F.col("_start")).drop("_start")
