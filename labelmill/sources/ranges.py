"""One large CSV or JSON array file read by many tasks, although where a record starts depends on all that stands before it.

Spark's text scan cuts the file into ranges; each task packs what it reads into cells of about a megabyte. Whether a cell begins inside
quotes is not known, so its summary is taken for both cases: the state it ends in, and how many records begin. A cell is thus a
function from state to state. Windows over the short summaries put these functions together, which tells each cell its
state and position; the cells are then cut into records, and only the pieces of records that span cells are shuffled.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from labelmill.batches import small_batches
from labelmill.settle import broadcast_if_small, land

# What runs on workers travels by value, so executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELL_BYTES = 1 << 20
#: Short rows, one for each cell, that are broadcast at most.
BROADCAST_CELLS = 1_000_000
PLACE = ("_path", "_block", "_cell")
_ESCAPED = re.compile(rb"\\.", re.S)


def _cells(spark: SparkSession, path: str | Sequence[str], separator: bytes, summary: Callable[[bytes], tuple], schema: str) -> DataFrame:
    """(_path, _block, _cell, data, and the summary's columns), stored: a second scan could be cut into other ranges."""
    lines = spark.read.option("lineSep", separator.decode()).text(path).select(
        F.col("value").cast("binary").alias("data"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
    )
    kind = T.StructType.fromDDL(f"_path string, _block long, _cell long, data binary, {schema}")
    names, room = kind.names, CELL_BYTES

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(kind), strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, held, size = None, 0, [], 0

        def cell() -> tuple:
            data = separator.join(held) + separator
            return (*at, number, data, *summary(data))

        for batch in batches:
            paths, blocks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for value, path, block in zip(batch.column(0).to_pylist(), paths, blocks, strict=True):
                if (path, block) != at or size >= room:
                    if held:
                        yield packed([cell()])
                    number = number + 1 if (path, block) == at else 0
                    at, held, size = (path, block), [], 0
                held.append(value)
                size += len(value) + 1
        if held:
            yield packed([cell()])

    small_batches(spark)
    return land(lines.mapInArrow(run, kind))


def _starting_state(order: W) -> Column:
    """The state that a cell begins in: its predecessors are constant, keep the state or turn it over, so the last constant
    one and the turns since then decide."""
    constant, turns = F.col("_e0") == F.col("_e1"), ((F.col("_e0") == 1) & (F.col("_e1") == 0)).cast("long")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    settled = F.last(F.when(constant, F.struct(F.col("_e0").cast("long").alias("state"), F.col("_turns").alias("turns"))), ignorenulls=True).over(before)
    turned = F.coalesce(F.sum(turns).over(before), F.lit(0))
    return F.pmod(F.coalesce(settled["state"], F.lit(0)) + turned - F.coalesce(settled["turns"], F.lit(0)), F.lit(2))


def _placed(cells: DataFrame, depth: bool, count: Column) -> DataFrame:
    """Per cell: the state it starts in (and its depth), and the records that begin (or end, as ``count`` says) before it in its
    file. One file's cells meet in a window, as short rows."""
    order = W.partitionBy("_path").orderBy("_block", "_cell")
    upto, before = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, -1)
    turns = ((F.col("_e0") == 1) & (F.col("_e1") == 0)).cast("long")
    short = cells.drop("data").withColumn("_turns", F.sum(turns).over(upto)).withColumn("_state", _starting_state(order))
    if depth:
        change = F.when(F.col("_state") == 1, F.col("_d1")).otherwise(F.col("_d0"))
        short = short.withColumn("_depth", F.coalesce(F.sum(change).over(before), F.lit(0)))
    counted = short.withColumn("_n", count)
    return counted.select(*PLACE, "_state", *(["_depth"] if depth else []), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))


def _joined(cells: DataFrame, places: DataFrame) -> DataFrame:
    renamed = broadcast_if_small(places.withColumnsRenamed({c: f"_of{c}" for c in PLACE}), BROADCAST_CELLS)
    return cells.join(renamed, [cells[c] == renamed[f"_of{c}"] for c in PLACE]).drop(*[f"_of{c}" for c in PLACE])


def _glued(pieces: DataFrame, between: bytes) -> DataFrame:
    """(_path, position, value) of whole records, from pieces with a key (_path, position) of which only the open ones may have
    company."""
    whole = pieces.where("not open").select("_path", "position", "value")
    parts = pieces.where("open").groupBy("_path", "position").agg(F.array_sort(F.collect_list(F.struct("_block", "_cell", "value"))).alias("parts"))
    texts = F.transform("parts", lambda p: p["value"].cast("string"))
    return whole.unionByName(parts.select("_path", "position", F.array_join(texts, between.decode()).cast("binary").alias("value")))


# CSV


def _after(line: bytes, inside: int, sep: bytes, quote: bytes) -> int:
    """Whether a line that begins inside quotes or not ends inside: a quote opens at the start of a field only, a doubled one
    inside does not close."""
    at = 0
    if not inside and line.startswith(quote):
        inside, at = 1, len(quote)
    while True:
        if inside:
            found = line.find(quote, at)
            if found < 0:
                return 1
            at = found + len(quote)
            if line.startswith(quote, at):
                at += len(quote)
            else:
                inside = 0
        else:
            found = line.find(sep + quote, at)
            if found < 0:
                return 0
            inside, at = 1, found + len(sep) + len(quote)


def _blank(line: bytes) -> bool:
    return line in (b"", b"\r")


def _csv_summary(sep: bytes, quote: bytes) -> Callable[[bytes], tuple]:
    def summary(data: bytes) -> tuple:
        lines = data.split(b"\n")[:-1]
        state, begun = [0, 1], [0, 0]
        for line in lines:
            full = not _blank(line)
            for s in (0, 1):
                begun[s] += full and not state[s]
            if quote in line:
                same = state[0] == state[1]
                state[0] = _after(line, state[0], sep, quote)
                state[1] = state[0] if same else _after(line, state[1], sep, quote)
        return (*state, *begun)

    return summary


def csv_records(spark: SparkSession, path: str | Sequence[str], sep: str = ",", quote: str = '"') -> DataFrame:
    """(_path, position, value): the records of CSV files as binary, numbered from 0 in each file; quoted fields may hold
    line breaks and doubled quotes. Blank lines between records are none."""
    cells = _cells(spark, path, b"\n", _csv_summary(sep.encode(), quote.encode()), "_e0 int, _e1 int, _n0 long, _n1 long")
    places = _placed(cells, False, F.when(F.col("_state") == 1, F.col("_n1")).otherwise(F.col("_n0")))
    comma, mark = sep.encode(), quote.encode()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                file, block, cell, data, inside, before = (batch.column(i)[row].as_py() for i in range(6))
                records: list[list[bytes]] = [[]]
                for line in data.split(b"\n")[:-1]:
                    if inside:
                        records[-1].append(line)
                    elif not _blank(line):
                        records.append([line])
                    if mark in line:
                        inside = _after(line, inside, comma, mark)
                head = bool(records[0])
                kept = records if head else records[1:]
                n, first = len(kept), before - head
                # What continues a record of an earlier cell, and what is not closed here, has further pieces.
                open_ = [(k == 0 and head) or (k == n - 1 and bool(inside)) for k in range(n)]
                columns = [[file] * n, [block] * n, [cell] * n, list(range(first, first + n)), [b"\n".join(r) for r in kept], open_]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["_path", "_block", "_cell", "position", "value", "open"])

    rows = _joined(cells.select(*PLACE, "data"), places).select(*PLACE, "data", "_state", "_before")
    pieces = rows.mapInArrow(cut, "_path string, _block long, _cell long, position long, value binary, open boolean")
    return _glued(pieces, b"\n")


# JSON


def _json_parts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with escapes blanked, how many quotes stand before or at each place)."""
    text = np.frombuffer(_ESCAPED.sub(b"  ", data), np.uint8)
    return text, np.cumsum(text == ord('"'), dtype=np.int64)


def _depths(text: np.ndarray, quotes: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray]:
    """(change of depth up to each place, places where a brace closes outside texts)."""
    outside = (quotes + state) % 2 == 0
    opens, closes = (text == ord("{")) | (text == ord("[")), (text == ord("}")) | (text == ord("]"))
    change = np.cumsum((opens & outside).astype(np.int64) - (closes & outside))
    return change, np.flatnonzero((text == ord("}")) & outside)


def _json_summary(data: bytes) -> tuple:
    text, quotes = _json_parts(data)
    out = []
    for state in (0, 1):
        change, closed = _depths(text, quotes, state)
        depth, times = np.unique(change[closed], return_counts=True)
        out.append((int(quotes[-1] + state) % 2, int(change[-1]), list(zip(depth.tolist(), times.tolist(), strict=True))))
    return tuple(out[s][i] for i in range(3) for s in (0, 1))


def json_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(_path, position, value): the objects of files that each hold one JSON array of objects, as binary, numbered from 0 in
    each file. The scan is cut at closing braces, so the array may be one line."""
    cells = _cells(spark, path, b"}", _json_summary, "_e0 int, _e1 int, _d0 long, _d1 long, _h0 map<long,long>, _h1 map<long,long>")
    held = F.when(F.col("_state") == 1, F.col("_h1")).otherwise(F.col("_h0"))
    # A brace that closes at the depth of the array ends an object.
    places = _placed(cells, True, F.coalesce(F.try_element_at(held, 1 - F.col("_depth")), F.lit(0)))
    last = F.row_number().over(W.partitionBy("_path").orderBy(F.desc("_block"), F.desc("_cell"))) == 1
    places = places.withColumn("_last", last)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                file, block, cell, data, state, depth, before, last = (batch.column(i)[row].as_py() for i in range(8))
                text, quotes = _json_parts(data)
                change, closed = _depths(text, quotes, state)
                ends = (closed[change[closed] + depth == 1] + 1).tolist()
                starts, rest = [0, *ends], data[ends[-1] if ends else 0 :]
                found = [data[s:e] for s, e in zip(starts[:-1], ends, strict=True)]
                if last:
                    # The scan's separator follows the end of the file too.
                    closed_all = depth + int(change[-1]) == -1 and int(quotes[-1] + state) % 2 == 0
                    if not closed_all or not re.fullmatch(rb"\s*(\[\s*)?\]\s*\}", rest):
                        raise ValueError(f"{file} does not end as an array of objects: {rest[-80:]!r}")
                elif rest:
                    found.append(rest)
                n = len(found)
                open_ = [k == 0 or k >= len(ends) for k in range(n)]
                columns = [[file] * n, [block] * n, [cell] * n, list(range(before, before + n)), found, open_]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["_path", "_block", "_cell", "position", "value", "open"])

    rows = _joined(cells.select(*PLACE, "data"), places).select(*PLACE, "data", "_state", "_depth", "_before", "_last")
    pieces = rows.mapInArrow(cut, "_path string, _block long, _cell long, position long, value binary, open boolean")
    return _glued(pieces, b"").withColumn("value", F.regexp_replace(F.col("value").cast("string"), r"^\s*[\[,]?\s*", ""))


def numbered(records: DataFrame, skip: int = 0, per_file: bool = False, name: str = "row_id") -> DataFrame:
    """Records with their position over all files in path order (or inside each file), less the first ``skip`` of each file."""
    kept = records.where(F.col("position") >= skip) if skip else records
    if per_file:
        return kept.withColumn(name, F.col("position") - skip)
    sizes = kept.groupBy("_path").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(W.orderBy("_path").rowsBetween(W.unboundedPreceding, -1))
    starts = broadcast_if_small(sizes.select(F.col("_path").alias("_of"), F.coalesce(before, F.lit(0)).alias("_start")), BROADCAST_CELLS)
    return kept.join(starts, F.col("_path") == F.col("_of")).withColumn(name, F.col("position") - skip + F.col("_start")).drop("_of", "_start")
