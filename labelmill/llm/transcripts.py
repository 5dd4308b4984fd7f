"""Chat transcripts to canonical turns: a hidden Markov model over speaker markers and line features recovers the roles.

A state is a role and whether the line opens a turn. Start, transition and emission tables are counted on transcripts with
known roles. The best states of a transcript are found by Viterbi; a long one is cut into parts, each of which is a matrix of
best scores from state to state, so that parts are joined by products of matrices and no task holds a whole transcript.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from labelmill.llm.common import map_batches
from labelmill.operators.positions import CELL_ROWS, row_ids
from labelmill.settle import land, lookup

ROLES = ("system", "user", "assistant")
#: Markers at the start of a line, in lower case and without the signs around them, by what they say about the speaker.
MARKERS = {
    "system": 1, "sys": 1, "context": 1,
    "user": 2, "human": 2, "q": 2, "question": 2, "customer": 2, "me": 2,
    "assistant": 3, "ai": 3, "bot": 3, "a": 3, "answer": 3, "agent": 3,
}
_ANY = 4
STATES = 2 * len(ROLES)
#: Marker kind, first line or after a blank one, length class, whether it ends as a question.
FEATURES = (5, 3, 5, 2)
FAN = 256
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "### Context: ", "user": "### Human: ", "assistant": "### AI: "},
    {"system": "[sys] ", "user": "Q: ", "assistant": "A: "},
    {"system": "<system> ", "user": "<user> ", "assistant": "<bot> "},
)
_MARKER = r"^\s*(?:[#*<\[|]+\s*)?([A-Za-z]{1,10})\s*(?:[>\]|*]+\s*:?|:)\s*"
_BULLET = r"^\s*(?:-|--|>)\s+"


def marker(line: Column) -> Column:
    """0 no marker, 1 to 3 that of a role, 4 a dash that names no speaker."""
    name = F.lower(F.regexp_extract(line, _MARKER, 1))
    kind = F.when(F.regexp_extract(line, _BULLET, 0) != "", F.lit(_ANY)).otherwise(F.lit(0))
    for code in (1, 2, 3):
        kind = F.when(name.isin([k for k, v in MARKERS.items() if v == code]), F.lit(code)).otherwise(kind)
    return kind


def body(line: Column) -> Column:
    """The line without its marker."""
    kind = marker(line)
    return F.when(kind == _ANY, F.regexp_replace(line, _BULLET, "")).when(kind > 0, F.regexp_replace(line, _MARKER, "")).otherwise(line)


def _codes(lines: Column, before: Column) -> Column:
    """One code for all features of each line; ``before`` says whether the line before the first one is blank, null if there is
    none."""
    lead = F.when(before.isNull(), 0).when(before, 1).otherwise(2)

    def code(line: Column, i: Column) -> Column:
        size = F.length(line)
        place = F.when(i == 0, lead).when(F.trim(F.get(lines, i - 1)) == "", 1).otherwise(2)
        length = F.when(size == 0, 0).when(size < 40, 1).when(size < 120, 2).when(size < 300, 3).otherwise(4)
        out = F.lit(0)
        for part, n in zip((marker(line), place, length, F.rtrim(line).endswith("?").cast("int")), FEATURES, strict=True):
            out = out * n + part
        return out.cast("int")

    return F.transform(lines, code)


def parts(df: DataFrame, key: str, order: str, text: str, *more: str, span: int = 4096) -> DataFrame:
    """(k, key, part, rows): transcripts in parts of ``span`` rows, counted from 0 in each, whatever numbers order them.

    Rows without order come first, rows of one order follow each other by their text; a null text is one empty line. ``k`` names
    the key, null included. Rows get their places by one sort over all tasks, so neither a long transcript nor many rows of one
    order meet in a task, and ``span`` bounds what a part holds."""
    at = F.coalesce(F.col(f"`{order}`").cast("long"), F.lit(-(2**63)))
    name = F.coalesce(F.concat(F.lit("k"), F.col(f"`{key}`").cast("string")), F.lit("n"))
    rows = df.select(
        name.alias("k"), F.col(f"`{key}`").alias("key"), at.alias("at"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        F.struct(F.lit(0).alias("none"), *(F.col(f"`{m}`").alias(m) for m in more)).alias("more"),
    )
    # The last key tells equal rows apart, so that they can be sorted by several tasks.
    placed = row_ids(rows.withColumn("copy", F.monotonically_increasing_id()), ["k", "at", "text", "more", "copy"], "place")
    first = placed.groupBy("k").agg(F.min("place").alias("first"))
    placed = lookup(placed, first, ["k"], F.floor(F.col("place") / CELL_ROWS), how="inner")
    row = F.struct(F.col("place").alias("at"), "text", *(F.col("more")[m].alias(m) for m in more)).alias("row")
    cut = placed.select("k", "key", F.floor((F.col("place") - F.col("first")) / span).cast("long").alias("part"), row)
    return cut.groupBy("k", "key", "part").agg(F.array_sort(F.collect_list("row")).alias("rows"))


def _led(own: DataFrame, *last: Column) -> DataFrame:
    """Parts with the values ``last`` of the part before, null in the first one."""
    before = own.select(F.col("k").alias("_k"), (F.col("part") + 1).alias("_part"), *last)
    return own.join(before, (F.col("k") == F.col("_k")) & (F.col("part") == F.col("_part")), "left").drop("_k", "_part")


def fit(df: DataFrame, key: str, order: str, text: str, role: str, span: int = 4096) -> dict:
    """Log tables {"move", "emit"} counted on transcripts with known roles, one row for each turn with its marker in place. All
    rows count, each after the one before it, in whatever parts they come; rows with another role than ``ROLES`` are passed
    over. The counts are a table of fixed size. An empty input gives even tables."""
    known = df.where(F.col(f"`{role}`").isin(*ROLES)).withColumn("role_", F.array_position(F.array(*map(F.lit, ROLES)), F.col(f"`{role}`")).cast("int") - 1)
    own = parts(known, key, order, text, "role_", span=span)
    split = F.flatten(F.transform("rows", lambda r: F.split(r["text"], "\n", -1)))
    states = F.flatten(F.transform("rows", lambda r: F.transform(F.split(r["text"], "\n", -1), lambda _, i: r["role_"] * 2 + F.when(i > 0, 1).otherwise(0))))
    own = land(own.select("k", "part", split.alias("lines"), states.alias("s")))
    own = _led(own, _blank_end(), F.element_at("s", -1).alias("_s"))
    seen = own.select("_s", "s", _codes(F.col("lines"), F.col("_blank")).alias("c"))
    # The line before the first one is the start.
    start = F.coalesce(F.col("_s"), F.lit(STATES))
    at = F.explode(F.transform("s", lambda s, i: F.struct(F.when(i == 0, start).otherwise(F.get("s", i - 1)).alias("a"), s.alias("b"), F.get("c", i).alias("c"))))
    counts = seen.select(at.alias("x")).select("x.*").groupBy("a", "b", "c").count().collect()
    move = np.full((STATES + 1, STATES + 1), 0.1)
    emit = np.full((STATES + 1, int(np.prod(FEATURES))), 0.01)
    for a, b, c, n in counts:
        emit[b, c] += n
        move[a, b] += n
    move, emit = np.log(move[:, :STATES] / move[:, :STATES].sum(axis=1, keepdims=True)), np.log(emit / emit.sum(axis=1, keepdims=True))
    return {"move": np.concatenate([move, np.full((STATES + 1, 1), -np.inf)], axis=1), "emit": emit}


def _blank_end() -> Column:
    return (F.trim(F.element_at("lines", -1)) == "").alias("_blank")


def _step(model: dict, code: int) -> np.ndarray:
    """Scores of going from any state to any other one that emits ``code``."""
    return model["move"] + model["emit"][:, code][None, :]


def _product(steps: list[np.ndarray]) -> np.ndarray:
    """Best scores over all ways through the steps: the matrix product with max for sum and sum for product."""
    out = steps[0]
    for step in steps[1:]:
        out = (out[:, :, None] + step[None, :, :]).max(axis=1)
    return out


def _walk(steps: list[np.ndarray], enter: int, leave: int | None) -> list[int]:
    """States after each step on the best way from ``enter`` to ``leave`` (the best end if None); of equal ones the first."""
    score, back = steps[0][enter], []
    for step in steps[1:]:
        ways = score[:, None] + step
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0)
    states = [int(score.argmax()) if leave is None else leave]
    for own in reversed(back):
        states.append(int(own[states[-1]]))
    return states[::-1]


def _joined(level: DataFrame) -> DataFrame:
    """Neighbouring parts (k, part, m) in groups of FAN: (k, part, own parts in order)."""
    grouped = level.groupBy("k", F.floor(F.col("part") / FAN).cast("long").alias("up"))
    return grouped.agg(F.array_sort(F.collect_list(F.struct("part", "m"))).alias("own"))


def parse(df: DataFrame, model: dict, key: str, order: str, text: str, span: int = 4096) -> DataFrame:
    """(key, part, lines): every line of the transcripts as a struct (role, opens, line), in order.

    ``opens`` marks the first line of a turn, whose marker is cut off. A transcript may be spread over rows, which ``order``
    puts in order, see ``parts``. Any number of parts is decoded exactly: a part knows how the one before it ends, parts become
    matrices, FAN at a time, and the best states at their borders are handed back down.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    split = F.flatten(F.transform("rows", lambda r: F.split(r["text"], "\n", -1)))
    cut = parts(df, key, order, text, span=span).select("k", "key", "part", split.alias("lines"))
    cut = _led(land(cut), _blank_end())
    cut = land(cut.select("k", "key", "part", "lines", _codes(F.col("lines"), F.col("_blank")).alias("codes")))
    last = cut.agg(F.max("part")).first()[0] or 0

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [_product([_step(shared.value, c) for c in own]).ravel() for own in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(m, pa.list_(pa.float64()))], ["k", "part", "m"])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [_product(_squares(own)).ravel() for own in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(m, pa.list_(pa.float64()))], ["k", "part", "m"])

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, own, enter, leave in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ends = _walk(_squares(own), enter, leave)
                columns = [[k] * len(own), [x["part"] for x in own], [enter, *ends[:-1]], ends]
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["k", "part", "enter", "leave"])

    groups = []
    if last:
        level = land(map_batches(cut.select("k", "part", "codes"), matrices, "k string, part long, m array<double>"))
        while True:
            groups.append(land(_joined(level)))
            last //= FAN
            if not last:
                break
            up = groups[-1].select("k", F.col("up").alias("part"), "own")
            level = land(map_batches(up, products, "k string, part long, m array<double>"))
    ends = None
    for group in reversed(groups):
        if ends is None:
            given = group.select("k", "own", F.lit(STATES).alias("enter"), F.lit(None).cast("int").alias("leave"))
        else:
            given = group.join(ends.withColumnRenamed("part", "up"), ["k", "up"]).select("k", "own", "enter", "leave")
        ends = land(map_batches(given, borders, "k string, part long, enter int, leave int"))
    if ends is None:
        cut = cut.select("*", F.lit(STATES).alias("enter"), F.lit(None).cast("int").alias("leave"))
    else:
        cut = cut.join(ends, ["k", "part"]).select(*cut.columns, "enter", "leave")
    kind = cut.schema["key"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True)
            states = [_walk([_step(shared.value, c) for c in own], enter, leave) for own, enter, leave in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(states, pa.list_(pa.int32()))], ["key", "part", "lines", "states"])

    found = map_batches(cut.select("key", "part", "lines", "codes", "enter", "leave"), decode, f"key {kind}, part long, lines array<string>, states array<int>")
    named = F.zip_with("lines", "states", lambda line, s: F.struct(
        F.get(F.array(*map(F.lit, ROLES)), F.floor(s / 2).cast("int")).alias("role"), (s % 2 == 0).alias("opens"),
        F.when(s % 2 == 0, body(line)).otherwise(line).alias("line"),
    ))
    return found.select("key", "part", named.alias("lines"))


def _squares(own: list[dict]) -> list[np.ndarray]:
    return [np.array(x["m"]).reshape(STATES + 1, STATES + 1) for x in own]


def render(parsed: DataFrame) -> DataFrame:
    """(key, part, roles, rendered): canonical turns, each `<|im_start|>role`, its lines and `<|im_end|>`; the parts of a
    transcript in order make up the whole. ``roles`` are those of the turns that open in the part."""
    ends = parsed.groupBy("key").agg(F.max("part").alias("last"))
    rows = parsed.join(ends.withColumnRenamed("key", "_key"), F.col("key").eqNullSafe(F.col("_key"))).drop("_key")

    def piece(x: Column, i: Column) -> Column:
        close = F.when((i > 0) | (F.col("part") > 0), F.lit("<|im_end|>\n")).otherwise(F.lit(""))
        return F.when(x["opens"], F.concat(close, F.lit("<|im_start|>"), x["role"], F.lit("\n"), x["line"])).otherwise(F.concat(F.lit("\n"), x["line"]))

    closed = F.when(F.col("part") == F.col("last"), F.lit("<|im_end|>\n")).otherwise(F.lit(""))
    return rows.select(
        "key", "part", F.transform(F.filter("lines", lambda x: x["opens"]), lambda x: x["role"]).alias("roles"),
        F.concat(F.array_join(F.transform("lines", piece), ""), closed).alias("rendered"),
    )
