"""Nearest neighbours by cosine over balanced posting lists.

Centroids come from a hierarchical clustering of a bounded sample, split until every part holds its share, so lists are of similar
length. Every vector is in the list of its nearest centroid and, near a boundary, in those of further ones. Centroids are
searched by a beam along a graph of their neighbours that each task holds in memory. A query visits the lists whose centroids
are within a ratio of the nearest one's distance; scores are computed on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from labelmill.llm.common import map_batches
from labelmill.settle import land

#: Vectors of a list, most centroids, and bytes of the sample that they are fitted on: bounds of what the driver holds.
LIST, MOST_LISTS, SAMPLE_BYTES = 256, 1 << 16, 64 << 20
#: A vector is copied to lists up to (1 + REPLICATE) times its nearest centroid's distance, COPIES at most; a query visits those
#: up to (1 + VISIT) times, as far as the beam reaches.
REPLICATE, COPIES, VISIT, BEAM = 0.15, 4, 0.25, 256
DEGREE = 16
_BLOCK, _QUERIES = 4096, 4096


def _unit(x: np.ndarray) -> np.ndarray:
    # Divided by the largest component first, so that squares of very large or small ones stay finite.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(sample: np.ndarray, most: int, seed: int = 7) -> np.ndarray:
    """At most about ``most`` unit centroids of balanced parts of the unit vectors ``sample``."""
    draw = np.random.default_rng(seed)
    share, out, parts = max(1, -(-len(sample) // max(1, most))), [], [sample] if len(sample) else []
    while parts:
        own = parts.pop()
        k = min(8, -(-len(own) // share))
        if k > 1:
            centre = own[draw.choice(len(own), k, replace=False)]
            for _ in range(6):
                at = (own @ centre.T).argmax(axis=1)
                sums = np.zeros_like(centre)
                np.add.at(sums, at, own)
                size = np.linalg.norm(sums, axis=1, keepdims=True)
                centre = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centre)
            at = (own @ centre.T).argmax(axis=1)
            split = [own[at == i] for i in range(k) if (at == i).any()]
            if len(split) > 1:
                parts += split
                continue
        mean = own.mean(axis=0)
        size = np.linalg.norm(mean)
        out.append(mean / size if size > 1e-9 else own[0])
    return np.stack(out) if out else np.zeros((0, 0))


def reach(lists: int) -> int:
    """How many centroids a query's beam holds: it grows with the root of their number beyond 1,024, or all of few."""
    return max(BEAM, int(np.ceil(BEAM * np.sqrt(lists / 1024))))


class Graph:
    """Centroids, each linked to its nearest ones and to a few at random, and a beam search along the links."""

    def __init__(self, centre: np.ndarray, seed: int = 11) -> None:
        self.centre, n = centre, len(centre)
        draw, near = np.random.default_rng(seed), []
        for lo in range(0, n, 1024):
            like = centre[lo : lo + 1024] @ centre.T
            near.append(np.argsort(-like, axis=1)[:, 1 : DEGREE + 1] if n <= DEGREE + 1 else np.argpartition(-like, DEGREE + 1, axis=1)[:, : DEGREE + 1])
        self.links = np.concatenate([np.concatenate(near), draw.integers(0, n, (n, 4))], axis=1) if n else np.zeros((0, 0), int)
        self.doors = draw.choice(n, min(n, 64), replace=False) if n else np.zeros(0, int)

    def search(self, vectors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of about the ``beam`` nearest centroids of each unit vector, nearest first; -1 and inf fill up."""
        n, width = len(vectors), min(beam, len(self.centre))
        measure = lambda ids: np.sqrt(np.maximum(2 - 2 * np.einsum("nd,nmd->nm", vectors, self.centre[ids]), 0))
        ids = np.broadcast_to(self.doors, (n, len(self.doors)))
        far, done = measure(ids), np.zeros(ids.shape, bool)
        while True:
            order = np.argsort(np.where(done, np.inf, far), axis=1)[:, :4]
            fresh = ~np.take_along_axis(done, order, 1) & np.isfinite(np.take_along_axis(far, order, 1))
            if not fresh.any():
                break
            done = done.copy()
            np.put_along_axis(done, order, True, 1)
            new = self.links[np.take_along_axis(ids, order, 1)].reshape(n, -1)
            ids, far = np.concatenate([ids, new], axis=1), np.concatenate([far, measure(new)], axis=1)
            done = np.concatenate([done, np.zeros(new.shape, bool)], axis=1)
            # Of repeated ids one stays, one that was followed already if there is one.
            order = np.lexsort((~done, ids), axis=1)
            ids, far, done = (np.take_along_axis(x, order, 1) for x in (ids, far, done))
            far = np.where(np.concatenate([np.zeros((n, 1), bool), ids[:, 1:] == ids[:, :-1]], axis=1), np.inf, far)
            order = np.argsort(far, axis=1)[:, :width]
            ids, far, done = (np.take_along_axis(x, order, 1) for x in (ids, far, done))
        order = np.argsort(far, axis=1)
        ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
        return np.where(np.isfinite(far), ids, -1), far


def _lists(graph: Graph, vectors: np.ndarray, copies: bool, sizes: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: where vectors are kept, or which lists queries visit. Those reach on until they hold ``least``."""
    rows, lists = [], []
    for lo in range(0, len(vectors), 128):
        ids, far = graph.search(vectors[lo : lo + 128], 4 * COPIES if copies else reach(len(graph.centre)))
        if copies:
            ids, far = ids[:, :COPIES], far[:, :COPIES]
            keep = far <= far[:, :1] * (1 + REPLICATE) + 1e-9
        else:
            held = np.cumsum(np.where(ids >= 0, sizes[ids], 0), axis=1) - np.where(ids >= 0, sizes[ids], 0)
            keep = (far <= far[:, :1] * (1 + VISIT) + 1e-9) | (held < least)
        keep &= ids >= 0
        row, column = np.nonzero(keep)
        rows.append(row + lo)
        lists.append(ids[row, column])
    return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(lists or [np.zeros(0, int)])


def _stack(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width).astype(np.float64)


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v): one row for each id whose vector can be compared. Left out are null ids, vectors that are null, empty, zero or
    hold null or non-finite components, and those of another length than most (of equally frequent ones the shorter). Of rows
    that repeat an id the smallest vector counts."""
    v = F.col("v")
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (common["n"] if common else -1))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def nearest(df: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by ``every`` its ``k`` nearest other rows found, by
    cosine in double precision, ties to the smaller id.

    Equal vectors are indexed once, with their k + 1 smallest ids, and equal queries asked once, so copies cost nothing. All others
    are indexed, in lists that are cut into blocks of a bounded size; a block meets a bounded number of queries in a task. Which
    rows can be compared says ``usable``; an empty table gives no rows.
    """
    spark = df.sparkSession
    rows = land(usable(df, vec_id, vector))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    members = land(ranked)
    kinds = members.where("n = 1").select(F.col("id").alias("kind"), "v")
    count = kinds.count()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = len(kinds.first()["v"])
    draws = max(1, SAMPLE_BYTES // (8 * width))
    sample = kinds if count <= draws else kinds.where(F.pmod(F.xxhash64("kind", F.lit(3)), F.lit(1 << 30)) < int(0.98 * draws / count * (1 << 30)))
    sample = _unit(_stack(sample.select("v").toArrow()["v"].combine_chunks(), width))
    lists = min(MOST_LISTS, max(1, count // LIST), max(1, len(sample) // 16))
    shared = spark.sparkContext.broadcast(Graph(centroids(sample, lists)))

    def route(copies: bool, held=None):  # noqa: ANN001, ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, at = _lists(shared.value, _unit(_stack(batch.column(1), width)), copies, None if held is None else held.value, 8 * (k + 1))
                out = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *out.columns], ["list", "kind", "v"])

        return run

    posted = land(map_batches(kinds, route(True), "list int, kind long, v array<double>"))
    sizes = np.zeros(len(shared.value.centre), np.int64)
    for at, n in posted.groupBy("list").count().collect():  # at most MOST_LISTS rows
        sizes[at] = n
    asked = rows.where(F.col("id") % every == 0)
    asking = land(asked.groupBy("v").agg(F.min("id").alias("kind")).select("kind", "v"))
    visits = land(map_batches(asking, route(False, spark.sparkContext.broadcast(sizes)), "list int, kind long, v array<double>"))
    # Long lists are cut into blocks, and so are the queries of a list.
    block = spark.createDataFrame([(i, -(-int(n) // _BLOCK)) for i, n in enumerate(sizes) if n], "list int, blocks int")
    calls = visits.groupBy("list").agg(F.ceil(F.count("*") / _QUERIES).cast("int").alias("calls"))
    cut = land(block.join(calls, "list")).repartition(1)
    cut = F.broadcast(cut)
    split = lambda n, salt: F.pmod(F.xxhash64("kind", F.lit(salt)), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = posted.join(cut, "list").select("list", split("blocks", 1).alias("b"), spread("calls").alias("c"), "kind", "v")
    right = visits.join(cut, "list").select("list", split("calls", 2).alias("c"), spread("blocks").alias("b"), "kind", "v")

    def meet(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"q": np.zeros(0, np.int64), "kind": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(mine) or not len(theirs):
            return none
        mine = mine.sort_values("kind")
        a, b = np.stack(theirs["v"]), np.stack(mine["v"])
        ids, parts = mine["kind"].to_numpy(), []
        # A query's own vector is among its nearest; its own and the next k kinds are enough.
        top = min(k + 1, len(b))
        for lo in range(0, len(a), 256):
            own = a[lo : lo + 256]
            big = np.abs(own).max(axis=1, keepdims=True), np.abs(b).max(axis=1, keepdims=True)
            x, y = own / big[0], b / big[1]
            score = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :])
            at = np.argsort(-score, axis=1, kind="stable")[:, :top]
            q = np.repeat(theirs["kind"].to_numpy()[lo : lo + 256], top)
            parts.append(pd.DataFrame({"q": q, "kind": ids[at.ravel()], "score": np.take_along_axis(score, at, 1).ravel()}))
        return pd.concat(parts)

    keys = ["list", "b", "c"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "q long, kind long, score double")
    found = found.groupBy("q", "kind").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "kind")
    found = land(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n"))
    # Kinds become their members, asked vectors the rows that hold them.
    heads = members.where("n = 1").select("v", F.col("id").alias("kind"))
    own = members.select("v", "id").join(heads, "v").select("kind", F.col("id").alias("vec_id"))
    queries = asked.join(asking.withColumnRenamed("kind", "q"), "v").select("q", F.col("id").alias("query_id"))
    out = found.join(own, "kind").join(queries, "q").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
