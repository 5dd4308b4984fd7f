"""Near-duplicate documents by 64-bit SimHash and covering locality-sensitive hashing.

Two fingerprints within radius 3 agree on all bits of at least one of 15 structured masks: every bit position carries a
non-zero vector of 4 bits, a mask takes the positions whose vector has an odd product with the mask's own vector, and three
differing positions span at most 3 dimensions, so some mask avoids them all. No link is left to chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from labelmill.llm.common import components, map_batches, utf8, widened
from labelmill.settle import land

RADIUS = 3
SEED = 42
SHINGLE = 3
BUCKET = 2048
_BLOCK = 100_000


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks as signed longs: 2^(radius+1) - 1 of them."""
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(64)]
    return [
        signed(sum(1 << i for i in range(64) if (vectors[i] & v).bit_count() % 2)) for v in range(1, 2 ** (radius + 1))
    ]


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the words of UTF-8 text as a signed long; 0 without words."""
    words = (data or b"").lower().split()  # on bytes both touch ASCII only
    if not words:
        return 0
    counts, total = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    for start in range(0, total, _BLOCK):
        part = words[start : start + _BLOCK + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big", signed=True)


def with_fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the SimHash of ``text`` as a long in ``out`` (replacing a column of that name). Null and empty texts,
    and texts of white space only, get 0. All other columns pass through."""
    rest = df.drop(out)
    schema = widened(rest, **{out: "long"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.int64())], [*batch.schema.names[:-1], out]
            )

    return map_batches(rest.select(*(F.col(f"`{c}`") for c in rest.columns), utf8(f"`{text}`").alias(out)), run, schema)


def _forest(fingerprints: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links that join all fingerprints of a bucket that are reachable in steps of at most ``radius``, one less than there
    are fingerprints at most."""
    left, right = [], []
    rest = fingerprints
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            # Of signed numbers, bitwise_count would count the bits of the absolute value.
            near = np.bitwise_count((rest ^ at).view(np.uint64)) <= radius
            if near.any():
                found = rest[near]
                left += [int(at)] * len(found)
                right += found.tolist()
                front += list(found)
                rest = rest[~near]
    return left, right


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Enough links (a, b) between the distinct longs in column ``fp`` that every pair within ``radius`` bits is connected.

    Fingerprints meet under the covering masks. A bucket of two is one comparison; up to ``bucket`` fingerprints are
    compared in one row and give a spanning forest. A larger bucket is divided without loss: the bits not yet agreed on are
    cut into radius + 1 blocks, one of which must agree, and the bucket is dealt out by each block, until it fits. Once
    only log2(bucket) bits are open, it must.
    """
    keys = F.array(*(F.struct(F.lit(m).alias("used"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for m in masks(radius)))
    level = nodes.select("fp", F.explode(keys).alias("at")).select("fp", "at.used", F.xxhash64("at.used", "at.k").alias("k"))
    out = None
    while True:
        sizes = land(
            level.groupBy("used", "k").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
        )
        twos = sizes.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
        more = level.join(sizes.where("n > 2").select("used", "k", "n"), ["used", "k"])
        fitting = more.where(F.col("n") <= bucket).groupBy("used", "k").agg(F.sort_array(F.collect_list("fp")).alias("fps"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                left, right = [], []
                column = batch.column(0)
                flat, ends = np.asarray(column.flatten()), np.asarray(column.offsets)
                for lo, hi in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True):
                    a, b = _forest(flat[lo:hi], radius)
                    left += a
                    right += b
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

        found = twos.unionByName(fitting.select("fps").mapInArrow(run, "a long, b long"))
        out = found if out is None else out.unionByName(found)
        if sizes.where(F.col("n") > bucket).isEmpty():
            return out

        def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                used, k, fp = (np.asarray(c) for c in batch.columns)
                for mask in np.unique(used):
                    rows = used == mask
                    open_bits = [i for i in range(64) if not int(mask) >> i & 1]
                    for block in range(radius + 1):
                        own = signed(sum(1 << i for i in open_bits[block :: radius + 1]))
                        n = int(rows.sum())
                        yield pa.RecordBatch.from_arrays([
                            pa.array(fp[rows]), pa.array(np.full(n, signed((int(mask) | own) & (1 << 64) - 1))),
                            pa.array(k[rows]), pa.array(fp[rows] & own),
                        ], ["fp", "used", "old", "own"])

        large = more.where(F.col("n") > bucket).select("used", "k", "fp")
        split = large.mapInArrow(divide, "fp long, used long, old long, own long")
        level = land(split.select("fp", "used", F.xxhash64("old", "used", "own").alias("k")).distinct())


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``fp`` (long), ``component_id``.

    Documents are linked when their fingerprints differ in at most ``radius`` bits; ``component_id`` is the smallest id
    reachable. Equal fingerprints are one node, whatever their number. Rows without id take part and get the component's
    id, null if no member has one; repeated rows stay. Other columns are not read. An empty table gives no rows.
    """
    # The name of the given id may be any, also one used here.
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    prints = land(with_fingerprints(docs, "text", "fp").select("doc_id", "fp"))
    return prints.join(classes(prints, radius), "fp").select("doc_id", "fp", "component_id")


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id, keeper) for every fingerprint in ``prints`` (doc_id, fp), which must be stored. ``keeper`` marks one
    fingerprint of each component: the one with the smallest id, or the smallest one if no member has an id."""
    nodes = land(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    order = F.struct(F.col("least").isNull(), "least", "fp")
    chosen = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min_by("fp", order).alias("kept"))
    return land(rooted.join(chosen, "root").select("fp", "component_id", (F.col("fp") == F.col("kept")).alias("keeper")))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of every component one row of the smallest id stays, of rows that repeat
    that id and fingerprint one; if no member has an id, one of those without. Columns stay as they are."""
    held = land(with_fingerprints(df, text, "_fp"))
    key = F.col(f"`{doc_id}`")
    chosen = classes(held.select(key.alias("doc_id"), F.col("_fp").alias("fp")), radius).where("keeper")
    chosen = chosen.select(F.col("fp").alias("_kept_fp"), F.col("component_id").alias("_kept_id"))
    kept = held.join(chosen, (F.col("_fp") == F.col("_kept_fp")) & key.eqNullSafe(F.col("_kept_id")), "left_semi")
    one = Window.partitionBy("_fp", key).orderBy("_fp")
    return kept.withColumn("_n", F.row_number().over(one)).where("_n = 1").select(*(F.col(f"`{c}`") for c in df.columns))
