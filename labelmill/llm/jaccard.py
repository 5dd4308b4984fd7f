"""Documents whose sets of word n-grams have a Jaccard similarity of 85 in 100 or more, and their connected components.

Overlaps are entries of the product of the document by n-gram incidence matrix with its transpose. The product is never formed as a
whole; it is taken block by block, and pairs go as soon as a bound that follows from their sizes rules them out:

1. Sets of a pair that links differ in at most k n-grams, k being known from their sizes. Columns are dealt by their hash into k + 1
   parts and a few spare ones, so linked rows agree on whole parts. Row blocks are the rows that agree on a part; other pairs
   are below the bound and never meet.
2. Within a row block the product is taken over a coarse incidence matrix modulo two: several columns are one bit, which tells
   whether a row holds an odd number of them. Rows differ in at least as many n-grams as bits: pairs with more than k go.
3. For what is left the incidence rows are multiplied in column blocks, and Spark sums the overlap counts of a pair over its blocks.

Equal sets are one row. Pairs already joined by others are not multiplied again, so a large group of near copies costs few
products for each of its members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelmill.llm import wordhash
from labelmill.llm.common import components, map_batches, pieces, utf8
from labelmill.settle import fits, land

NGRAM = 4
PERCENT = 85
#: Parts that linked rows agree on for sure; those without n-grams count only in rows that have as many of them.
SPARE = 4
#: Coarse columns for each n-gram that linked rows may differ in: a byte of bits.
FINE = 8
#: Rows and bytes of a row block, n-grams of a column block.
ROWS, BYTES, COLUMNS = 2048, 32_000_000, 4096
#: A row block may name so many pairs for each of its rows before it names a spanning forest only.
NAMED = 4
_BROADCAST = 1_000_000


def apart(total, percent: int = PERCENT):  # noqa: ANN001, ANN201
    """The most n-grams in which two sets with ``total`` n-grams in sum may differ if they link; more for larger sums."""
    return (100 - percent) * total // (100 + percent)


def bands(most: int, percent: int = PERCENT) -> np.ndarray:
    """Least sizes of the size bands, up to ``most`` and two bands beyond: linked sets are in one band or in neighbouring ones."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // percent + 1)
    return np.array([*out, out[-1] * 100 // percent + 1, (out[-1] * 100 // percent + 1) * 100 // percent + 1], np.int64)


def grams_of(texts: list[bytes | None], n: int = NGRAM) -> list[np.ndarray]:
    """The sorted distinct hashes of the word n-grams of each text, A-Z folded; the whole sequence is one where words are fewer."""
    hashes, _, _, first = wordhash.words(texts)
    weights = [np.uint64(2 * i * 0x9E3779B1 + 1) for i in range(n)]
    full = sum((hashes[i : len(hashes) - n + 1 + i] * w for i, w in enumerate(weights)), np.uint64(0)) if len(hashes) >= n else hashes[:0]
    full = wordhash.mix(full)
    out = []
    for start, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if end - start >= n:
            out.append(np.unique(full[start : end - n + 1]))
        else:
            short = np.zeros(min(1, end - start), np.uint64)
            for h, w in zip(hashes[start:end], weights, strict=False):
                short += np.full(1, h) * w
            out.append(wordhash.mix(short + np.uint64(end - start)))
    return out


def _summed(parts: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.add.at(out, parts, values)
    return out


def _deal(values: np.ndarray, n: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def signatures(grams: np.ndarray, band: int, top: int, percent: int = PERCENT) -> tuple[np.ndarray, bytes]:
    """(parts, coarse row) of a set as a row of the blocks of a ``band``, whose larger sets have at most ``top`` n-grams."""
    most = apart(2 * top, percent)
    n, seed = most + 1 + SPARE, np.uint64(band * 0x632BE5AB + 0x1234567)
    held = wordhash.mix(grams ^ seed)
    at = _deal(held, n)
    sums, empty = _summed(at, wordhash.mix(held), n), np.bincount(at, minlength=n) == 0
    # A pair agrees on more than SPARE parts; if none of these holds an n-gram, both rows have as many empty ones.
    keep = ~empty if empty.sum() <= SPARE else np.ones(n, bool)
    where = np.flatnonzero(keep).astype(np.uint64)
    parts = wordhash.mix(wordhash.mix(sums[keep] + where * np.uint64(0x9E3779B97F4A7C15)) ^ seed)
    fine = wordhash.mix(held ^ np.uint64(0x5851F42D4C957F2D))
    width = FINE * (most + 1)
    return parts, np.packbits(np.bincount(_deal(fine, width), minlength=width) & 1).tobytes()


def _rows(docs: DataFrame, percent: int) -> DataFrame:
    """(row, doc_id, n, k1, k2, own): set size, set hash, and the parts and coarse rows of each row by band; stored."""
    kind = pa.struct([("band", pa.int32()), ("parts", pa.list_(pa.int64())), ("coarse", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1):
                sets = grams_of(batch.column(1).to_pylist())
                cuts = bands(max(map(len, sets), default=1), percent)
                own = []
                for s in sets:
                    rows, band = [], int(np.searchsorted(cuts, len(s), "right")) - 1
                    for b in (band, band + 1) if len(s) else ():
                        if apart(2 * int(cuts[b + 1] - 1), percent) > 0:
                            parts, coarse = signatures(s, b, int(cuts[b + 1] - 1), percent)
                            rows.append({"band": b, "parts": parts.view(np.int64), "coarse": coarse})
                    own.append(rows)
                k1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                k2 = np.array([wordhash.mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1), pa.array(k2), pa.array(own, pa.list_(kind))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "k1", "k2", "own"])

    found = map_batches(docs, run, "doc_id long, n long, k1 long, k2 long, own array<struct<band:int,parts:array<long>,coarse:binary>>")
    return land(found.select(F.monotonically_increasing_id().alias("row"), "*"))


def _near(x: np.ndarray, sizes: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of the rows ``others`` row i may link with: coarse columns that agree are counted and held against the sizes."""
    return others[np.bitwise_count(x[others] ^ x[i]).sum(axis=1, dtype=np.int64) <= apart(sizes[others] + sizes[i], percent)]


def _named(x: np.ndarray, sizes: np.ndarray, groups: np.ndarray, percent: int, whole: bool) -> tuple[list[tuple[int, int]], bool]:
    """(pairs, all): pairs of rows of different groups that may link. If these are more than ``NAMED`` a row, ``all`` is false
    and the pairs are a spanning forest of them, unless the ``whole`` is asked for."""
    out: list[tuple[int, int]] = []
    n = len(x)
    for i in range(n - 1):
        others = np.arange(i + 1, n)
        others = others[groups[others] != groups[i]]
        out += [(i, j) for j in _near(x, sizes, i, others, percent).tolist()]
        if not whole and len(out) > NAMED * n:
            break
    else:
        return out, True
    forest, rest = [], np.arange(n)
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            i = front.pop()
            near = _near(x, sizes, i, rest, percent)
            forest += [(i, j) for j in near[groups[near] != groups[i]].tolist()]
            front += near.tolist()
            rest = np.setdiff1d(rest, near, assume_unique=True)
    return forest, False


def _blocks(members: DataFrame, percent: int, whole: bool) -> DataFrame:
    """(part, a, b, done): pairs that may link, of the row blocks in ``members`` (part, band, row, comp, n, coarse, size of the block).
    A block beyond ROWS rows or BYTES bytes is cut into smaller ones, every two of which are one block."""
    room = F.greatest(F.lit(2), F.least(F.lit(ROWS), F.lit(BYTES) / F.greatest(F.lit(1), F.octet_length("coarse"))).cast("int"))
    cuts = F.when(F.col("members") <= room, 1).otherwise(F.ceil(2 * F.col("members") / room)).cast("int")
    dealt = members.select("*", cuts.alias("cuts")).withColumn("own", F.pmod(F.xxhash64("row"), F.col("cuts")).cast("int"))
    both = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda o: F.struct(F.least("own", o).alias("p"), F.greatest("own", o).alias("q")))
    rows = dealt.withColumn("at", F.explode(both)).groupBy("part", "at").agg(F.array_sort(F.collect_list(F.struct("row", "comp", "n", "coarse"))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.column(1)[k].values
                row, comp, n = (np.asarray(own.field(c)) for c in range(3))
                x = np.frombuffer(b"".join(own.field(3).to_pylist()), np.uint8).reshape(len(row), -1)
                pairs, done = _named(x, n, comp, percent, whole)
                part = batch.column(0)[k].as_py()
                a, b = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
                # A row without pair tells that this block is to be asked again.
                a, b = (np.append(row[v], np.zeros(int(not done), np.int64)) for v in (a, b))
                kind = [pa.array(np.full(len(a), part, np.int64)), pa.array(a), pa.array(b), pa.array(np.full(len(a), done))]
                yield pa.RecordBatch.from_arrays(kind, ["part", "a", "b", "done"])

    return map_batches(rows.select("part", "rows"), run, "part long, a long, b long, done boolean")


def _products(docs: DataFrame, rows: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b): those of the ``pairs`` (a, b: rows) whose sets link, by products of their incidence rows in column blocks."""
    wanted = land(pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b"))).distinct())
    wanted = land(rows.join(F.broadcast(wanted) if fits(wanted, _BROADCAST) else wanted, "row").select("row", "doc_id", "n", "k1", "k2"))
    ids = land(wanted.select(F.col("doc_id").alias("_id")).distinct())
    texts = docs.join(F.broadcast(ids) if fits(ids, _BROADCAST) else ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n", "k1", "k2", "cut", "block", "grams"]
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.list_(pa.int64())]
        for whole in batches:
            for batch in pieces(whole, 1):
                for s in grams_of(batch.column(1).to_pylist()):
                    k1 = s.sum(dtype=np.uint64).view(np.int64)
                    k2 = wordhash.mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64).view(np.int64)
                    # Blocks are cut by the size of the larger set of a pair.
                    for cut in sorted({int(np.ceil(np.log2(max(1, n / COLUMNS)))) for n in (len(s), len(s) * 100 // percent)}):
                        at = _deal(s, 1 << cut)
                        ends = np.searchsorted(at, np.arange((1 << cut) + 1))
                        found = [(len(s), k1, k2, cut, c, s[lo:hi].view(np.int64)) for c, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if hi > lo]
                        columns = zip(*found, strict=True) if found else [[]] * len(names)
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    sets = map_batches(texts, run, "n long, k1 long, k2 long, cut int, block int, grams array<long>").dropDuplicates(["n", "k1", "k2", "cut", "block"])
    held = land(sets.join(wanted, ["n", "k1", "k2"]).select("row", "n", "cut", "block", "grams"))
    side = lambda s: held.select(F.col("row").alias(s), F.col("n").alias(f"n_{s}"), "cut", F.col("block").alias("block"), F.col("grams").alias(f"grams_{s}"))
    size = lambda s: wanted.select(F.col("row").alias(s), F.col("n").alias(f"n_{s}"))
    sized = pairs.join(size("a"), "a").join(size("b"), "b")
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    sized = sized.where(100 * small >= percent * large).withColumn("cut", F.ceil(F.log2(F.greatest(F.lit(1.0), large / COLUMNS))).cast("int"))
    met = sized.join(side("a").drop("n_a"), ["a", "cut"]).join(side("b").drop("n_b"), ["b", "cut", "block"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(4), batch.column(5)
            # Both rows hold distinct columns: what stands twice in both together is their overlap.
            found = [len(np.intersect1d(np.asarray(x[i].values), np.asarray(y[i].values), assume_unique=True)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.int64())], ["a", "b", "n_a", "n_b", "overlap"])

    counts = map_batches(met.select("a", "b", "n_a", "n_b", "grams_a", "grams_b"), multiply, "a long, b long, n_a long, n_b long, overlap long")
    summed = counts.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))
    return land(summed.where(100 * F.col("overlap") >= percent * (F.col("n_a") + F.col("n_b") - F.col("overlap"))).select("a", "b"))


def _likely(signed: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b): those of ``pairs`` (a, b, band) that the coarse rows do not rule out."""
    side = lambda s: signed.select(F.col("row").alias(s), "band", F.col("n").alias(f"n_{s}"), F.col("coarse").alias(f"x_{s}"))
    both = pairs.join(side("a"), ["a", "band"]).join(side("b"), ["b", "band"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = apart(np.asarray(batch.column(2)) + np.asarray(batch.column(3)), percent)
            differ = [(int.from_bytes(x) ^ int.from_bytes(y)).bit_count() for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), ["a", "b"]).filter(pa.array(np.array(differ, np.int64) <= most))

    return map_batches(both.select("a", "b", "n_a", "n_b", "x_a", "x_b"), run, "a long, b long")


def links(docs: DataFrame, rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links between the distinct sets in ``rows``, enough of them to connect all that are connected by links."""
    alike = land(rows.where("size(own) > 0").groupBy("n", "k1", "k2").agg(F.min("row").alias("row")).select("row"))
    kept = rows.join(F.broadcast(alike) if fits(alike, _BROADCAST) else alike, "row", "left_semi")
    one = F.explode("own").alias("o")
    signed = kept.select("row", "n", one).select("row", "n", "o.band", "o.coarse")
    places = kept.select("row", one).select("row", "o.band", F.explode("o.parts").alias("part"))
    # Nearly every part is one row's own: they are dealt out as they are, since sums of one row would be wider.
    met = places.repartition("part").groupBy("part").agg(F.count("*").alias("members"), F.min("row").alias("a"), F.max("row").alias("b"), F.min("band").alias("band"))
    met = land(met.where("a < b"))
    # Every row is held against the first one of its blocks.
    blocks = land(met.where("members > 2").select("part", "members", "a"))
    members = land(places.join(F.broadcast(blocks) if fits(blocks, _BROADCAST) else blocks, "part"))
    stars = met.where("members = 2").select("a", "b", "band").unionByName(members.where("row > a").select("a", F.col("row").alias("b"), "band"))
    found = _products(docs, rows, land(_likely(signed, stars.distinct(), percent).distinct()), percent)
    again = None
    while True:
        # Blocks whose rows are not all connected yet are multiplied whole.
        roots = land(components(found).distinct())
        known = members if again is None else members.join(F.broadcast(again) if fits(again, _BROADCAST) else again, "part", "left_semi")
        known = known.where("row > a").join(F.broadcast(roots) if fits(roots, _BROADCAST) else roots, F.col("row") == F.col("node"), "left")
        known = land(known.select("part", "band", "row", "members", F.coalesce("root", "row").alias("comp")))
        several = known.groupBy("part").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("part")
        several = land(several)
        open_rows = known.join(F.broadcast(several) if fits(several, _BROADCAST) else several, "part", "left_semi")
        open_rows = open_rows.join(signed.select("row", "band", "n", "coarse"), ["row", "band"])
        named = land(_blocks(open_rows, percent, again is not None))
        more = _products(docs, rows, land(named.where("a < b").select("a", "b").distinct()), percent)
        found = land(found.unionByName(more))
        if again is not None:
            return found
        again = land(named.where("not done").select("part").distinct())
        if again.isEmpty():
            return found


def similar(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``n_shingles`` (distinct word 4-grams), ``component_id``.

    Documents link when ``percent`` of the n-grams that either holds, or more, are held by both (compared in whole numbers);
    ``component_id`` is the smallest id reachable by links. Words end at ASCII white space, A-Z are folded; fewer than four
    words are one n-gram, and n-grams are compared by hashes of 64 bits. Null and empty texts and those of white space only have no n-gram and link with
    nothing. Equal sets are one node whatever their number. Rows without id take part and get their component's id,
    null if no member has one; repeated rows and ids stay. Other columns are not read. An empty table gives no rows.
    """
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), utf8(f"`{text}`").alias("text"))
    rows = _rows(docs, percent)
    nodes = land(rows.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")))
    roots = components(links(docs, rows, percent)).distinct()
    rooted = nodes.join(roots, "node", "left").select("n", "k1", "k2", "least", F.coalesce("root", "node").alias("root"))
    chosen = land(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    rooted = land(rooted.join(F.broadcast(chosen) if fits(chosen, _BROADCAST) else chosen, "root").select("n", "k1", "k2", "component_id"))
    joined = rows.select("doc_id", "n", "k1", "k2").join(F.broadcast(rooted) if fits(rooted, _BROADCAST) else rooted, ["n", "k1", "k2"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
