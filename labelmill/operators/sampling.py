"""Reproducible shuffles, splits, bootstrap draws and quota samples.

Rows are ordered by ``md5(id-seed)``, which depends on neither partitioning nor engine. A split looks for the one key per
class at which the class is cut, so the rows themselves are compared with a small table and never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from labelmill.operators.positions import running
from labelmill.settle import broadcast_if_small, land, lookup, same, settle

# 4,096 cells per class: at 100 billion rows each one holds about 25 million ids.
KEY_DIGITS = 3
#: Rows of a cell that are ranked; a larger one is counted by further digits.
LEAF_ROWS = 100_000
#: Ids that a quota walk reads first.
FIRST_IDS = 1_000_000


def shuffle_key(row_id: str | Column, seed: int) -> Column:
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat(row_id.cast("string"), F.lit(f"-{seed}")))


def _key_cell(key: str) -> Column:
    """The first hex digits of the key: even cells, in the order of the keys."""
    return F.substring(key, 1, KEY_DIGITS)


def shuffled_positions(
    df: DataFrame, seed: int, row_id: str = "row_id", by: tuple[str, ...] = (), name: str = "position"
) -> DataFrame:
    """Add each row's place, from 0, in the shuffled order of the table or of its group."""
    keyed = df.withColumn("_key", shuffle_key(row_id, seed))
    ranked = running(keyed, ["_key", row_id], sums={name: F.lit(1)}, by=by, cell=_key_cell("_key"))
    return ranked.withColumn(name, F.col(name) - 1).drop("_key")


def seeded_shuffle(df: DataFrame, seed: int = 14, row_id: str = "row_id") -> DataFrame:
    """The rows in shuffled order."""
    return df.orderBy(shuffle_key(row_id, seed), row_id)


class _Classes:
    """Row counts per class and key cell, settled once; ``cut`` finds the key below which a class has n rows."""

    def __init__(self, df: DataFrame, by: str | None, seed: int, row_id: str):
        self.by = by
        label = F.lit(None).cast("string") if by is None else F.col(by)
        self.keyed = df.select(
            label.alias("_class"), F.col(row_id).alias("_id"), shuffle_key(row_id, seed).alias("_key")
        ).withColumn("_cell", _key_cell("_key"))
        counts = self.keyed.groupBy("_class", "_cell").agg(F.count("*").alias("_n"))
        upto = W.partitionBy("_class").orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)
        self.cells = settle(counts.withColumn("_upto", F.sum("_n").over(upto)))
        self.sizes = self.cells.groupBy("_class").agg(F.sum("_n").alias("_size"))

    def cut(self, quotas: DataFrame, name: str) -> DataFrame:
        """One row per class of ``quotas(_class, _quota)``: the key and id of the ``_quota``-th row in shuffled order."""
        return self.find(quotas).select("_class", F.struct("_key", "_id").alias(name))

    def find(self, places: DataFrame) -> DataFrame:
        """The row of each ``places(_class, _quota, ...)``: its class, key and id, and the other columns of ``places``.

        The cells are the top of a counting tree over the digits of the keys. Where a cell that is asked for holds more than
        ``LEAF_ROWS`` rows, the rows of these cells alone are counted by further digits; only rows of asked leaves are ranked.
        """
        others = [column for column in places.columns if column not in ("_class", "_quota")]
        places = places.withColumnsRenamed({"_class": "_wanted"})

        def reached(counts: DataFrame, test: Column, at: str) -> DataFrame:
            hit = counts.join(places if at == "_quota" else hits, test)
            hit = hit.where((F.col("_upto") - F.col("_n") < F.col(at)) & (F.col(at) <= F.col("_upto")))
            nth = (F.col(at) - F.col("_upto") + F.col("_n")).alias("_rank")
            return settle(hit.select("_wanted", *others, F.col("_cell").alias("_edge"), nth, F.col("_n").alias("_rows")))

        hits = reached(self.cells, same(self.cells, places, {"_class": "_wanted"}), "_quota")
        digits = KEY_DIGITS
        while (hits.agg(F.max("_rows")).first()[0] or 0) > LEAF_ROWS and digits < 32:
            rows = self._of(hits, digits)
            digits = min(32, digits + 2)
            counts = rows.groupBy("_class", "_cell", F.substring("_key", 1, digits).alias("_inner")).agg(F.count("*").alias("_n"))
            upto = W.partitionBy("_class", "_cell").orderBy("_inner").rowsBetween(W.unboundedPreceding, 0)
            counts = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumnsRenamed({"_cell": "_outer", "_inner": "_cell"})
            hits = reached(counts, same(counts, hits, {"_class": "_wanted", "_outer": "_edge"}), "_rank")
        rows = self._of(hits, digits)
        place = F.row_number().over(W.partitionBy("_class", "_cell").orderBy("_key", "_id"))
        ranked = rows.withColumn("_place", place)
        asked = broadcast_if_small(hits.drop("_rows"))
        found = ranked.join(asked, same(ranked, asked, {"_class": "_wanted", "_cell": "_edge", "_place": "_rank"}))
        return found.select("_class", "_key", "_id", *others)

    def _of(self, hits: DataFrame, digits: int) -> DataFrame:
        """The rows (_class, _id, _key, _cell) of the cells in ``hits``, which are that many digits long."""
        edges = broadcast_if_small(hits.select(F.col("_wanted").alias("_mine"), "_edge").distinct())
        keyed = self.keyed.withColumn("_cell", F.substring("_key", 1, digits))
        return keyed.join(edges, same(keyed, edges, {"_class": "_mine", "_cell": "_edge"})).drop("_mine", "_edge")


def _mark(df: DataFrame, classes: _Classes, cuts: DataFrame, seed: int, row_id: str) -> DataFrame:
    """Put each row's own key and the cuts of its class next to it."""
    keyed = df.withColumn("_own", F.struct(shuffle_key(row_id, seed).alias("_key"), F.col(row_id).alias("_id")))
    if classes.by is None:
        cuts = settle(cuts)
        for name in [column for column in cuts.columns if column != "_class"]:
            keyed = keyed.withColumn(name, cuts.select(name).scalar())
        return keyed
    cuts = cuts.withColumnRenamed("_class", classes.by)
    return lookup(keyed, cuts, [classes.by], F.pmod(F.xxhash64(row_id), F.lit(4096)))


def _at_most(cut: str) -> Column:
    return F.coalesce(F.col("_own") <= F.col(cut), F.lit(False))


def train_rows(total: Column, test_share: float) -> Column:
    return total - F.ceil(F.lit(float(test_share)) * total)


def stratified_split(
    df: DataFrame, label: str, test: float = 0.7, seed: int = 88, row_id: str = "row_id", min_class: int = 2
) -> DataFrame:
    """Add ``split`` (train or test) with exact sizes: n - ceil(test * n) training rows, shared by largest remainder.

    A class with fewer than ``min_class`` rows is an error, and so is a part that cannot hold a row of every class, unless one
    part is meant to be empty (``test`` 0 or 1); with ``min_class`` below 2 neither is.
    """
    if not 0 <= test <= 1:
        raise ValueError("test must lie between 0 and 1")
    classes = _Classes(df, label, seed, row_id)
    if min_class > 1 and not classes.sizes.where(F.col("_size") < min_class).isEmpty():
        raise ValueError(f"a class of {label} has fewer than {min_class} rows")
    if min_class > 1 and 0 < test < 1:
        whole_table = classes.sizes.agg(F.sum("_size").alias("rows"), F.count("*").alias("classes"))
        parts = whole_table.select("rows", "classes", train_rows(F.col("rows"), test).alias("train")).first()
        if parts["rows"] and min(parts["train"], parts["rows"] - parts["train"]) < parts["classes"]:
            raise ValueError(f"a part of {test} leaves too few rows for {parts['classes']} classes of {label}")
    total = classes.sizes.agg(F.sum("_size")).scalar()
    whole = {"_total": total.cast("decimal(19,0)"), "_train": train_rows(total, test).cast("decimal(19,0)")}
    shares = classes.sizes.withColumns(whole).withColumn("_exact", F.col("_train") * F.col("_size").cast("decimal(19,0)"))
    shares = shares.withColumns({"_floor": F.expr("_exact div _total"), "_rest": F.col("_exact") % F.col("_total")})
    # One row per class: ranking them takes one small task.
    by_rest = F.row_number().over(W.orderBy(F.desc("_rest"), "_class"))
    missing = train_rows(total, test) - shares.agg(F.sum("_floor")).scalar()
    quotas = shares.withColumn("_order", by_rest).select(
        "_class", (F.col("_floor") + F.when(F.col("_order") <= missing, 1).otherwise(0)).alias("_quota")
    )
    marked = _mark(df, classes, classes.cut(quotas, "_cut"), seed, row_id)
    return marked.withColumn("split", F.when(_at_most("_cut"), "train").otherwise("test")).drop("_own", "_cut")


def with_validation(splits: DataFrame) -> dict[str, DataFrame]:
    """Named splits; validation is the test part."""
    test = splits.where(F.col("split") == "test").drop("split")
    return {"train": splits.where(F.col("split") == "train").drop("split"), "validation": test, "test": test}


def fixed_split(df: DataFrame, label: str, train: int, test: int, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """Add ``split``: ``train`` rows and then ``test`` rows of every class, the others are ``rest``."""
    classes = _Classes(df, label, seed, row_id)
    if not classes.sizes.where(F.col("_size") < train + test).isEmpty():
        raise ValueError(f"a class of {label} has fewer than {train + test} rows")
    names = classes.sizes.select("_class")
    first = classes.cut(names.withColumn("_quota", F.lit(train)), "_first")
    second = classes.cut(names.withColumn("_quota", F.lit(train + test)), "_second")
    second = second.withColumnRenamed("_class", "_wanted")
    cuts = second.join(first, same(second, first, {"_wanted": "_class"}), "left")
    cuts = cuts.select(F.col("_wanted").alias("_class"), "_first", "_second")
    marked = _mark(df, classes, cuts, seed, row_id)
    split = F.when(_at_most("_first"), "train").when(_at_most("_second"), "test").otherwise("rest")
    return marked.withColumn("split", split).drop("_own", "_first", "_second")


def random_split(df: DataFrame, test: float = 0.15, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """Add ``split`` with exact sizes and no classes."""
    classes = _Classes(df, None, seed, row_id)
    total = classes.sizes.agg(F.sum("_size")).scalar()
    quota = classes.sizes.select("_class", train_rows(total, test).alias("_quota"))
    marked = _mark(df, classes, classes.cut(quota, "_cut"), seed, row_id)
    return marked.withColumn("split", F.when(_at_most("_cut"), "train").otherwise("test")).drop("_own", "_cut")


def bootstrap(df: DataFrame, label: str, n: int = 50, seed: int = 10, row_id: str = "row_id") -> DataFrame:
    """``n`` draws with replacement from every class: column ``draw`` and the drawn row.

    Ids are counted by class and key; only those of cells that are drawn from are ranked, and the drawn rows are fetched by id
    afterwards. Without draws there are no rows.
    """
    if n < 0:
        raise ValueError("the number of draws must not be negative")
    if n == 0:
        return df.withColumn("draw", F.lit(0).cast("long")).where(F.lit(False))
    classes = _Classes(df, label, seed, row_id)
    draws = classes.sizes.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    name = F.concat(F.coalesce(F.col("_class").cast("string"), F.lit("")), F.lit("-"), F.col("draw").cast("string"))
    number = F.conv(F.substring(F.md5(F.concat(name, F.lit(f"-{seed}"))), 1, 8), 16, 10).cast("long")
    picked = classes.find(draws.select("_class", "draw", (F.pmod(number, F.col("_size")) + 1).alias("_quota"))).select("_id", "draw")
    picked = broadcast_if_small(picked)
    return df.join(picked, df[row_id] == picked["_id"]).drop("_id")


def quota_sample(
    df: DataFrame,
    stratum: str,
    size: str,
    quotas: Mapping[str, float],
    cap: float,
    row_id: str = "row_id",
    carried: Mapping[str, int] | None = None,
    carried_size: int = 0,
) -> DataFrame:
    """Walk the rows in order and keep a row while its stratum is below its quota; stop once the kept sizes reach
    ``cap`` or every quota is full. ``carried`` counts and sizes of an earlier sample are taken over.

    Kept rows come back with ``kept_before`` (rows of their stratum) and ``size_before`` (all strata). The input is read in
    ranges of ids, each twice as wide as the one before, and no further than the range in which the walk is over; what is
    read is landed, so hand in ids, strata and sizes rather than texts.
    """
    carried = dict(carried or {})
    names = list(quotas)
    # A row is accepted while carried + earlier < quota, so ceil(quota - carried) rows of a stratum are.
    room = {name: _room(quotas[name], carried.get(name, 0)) for name in names}
    mine = {name: F.coalesce(F.col(stratum) == name, F.lit(False)) for name in names}
    df = _read_far_enough(df, mine, room, size, cap - carried_size, row_id)
    seen = {name: f"_seen_{number}" for number, name in enumerate(names)}
    counted = running(df, row_id, sums={seen[name]: mine[name].cast("long") for name in names})
    before = {name: F.col(seen[name]) - mine[name].cast("long") for name in names}
    accepted = F.lit(False)
    for name in names:
        accepted = accepted | (mine[name] & (before[name] < room[name]))
    full = F.lit(True)
    for name in names:
        full = full & (before[name] >= room[name])
    kept_before = F.coalesce(*[F.when(mine[name], before[name] + carried.get(name, 0)) for name in names])
    # A quota that is full stays full, so the walk is over from the first such row on.
    walked = counted.withColumns({"_accepted": accepted, "_full": full, "kept_before": kept_before})
    taken = F.when(F.col("_accepted"), F.col(size)).otherwise(0).cast("long")
    summed = running(walked, row_id, sums={"_size": taken})
    size_before = F.col("_size") - taken + carried_size
    out = summed.withColumn("size_before", size_before)
    out = out.where(F.col("_accepted") & ~F.col("_full") & (F.col("size_before") < cap))
    return out.drop("_accepted", "_full", "_size", *seen.values())


def _read_far_enough(
    df: DataFrame, mine: Mapping[str, Column], room: Mapping[str, int], size: str, cap: float, row_id: str,
) -> DataFrame:
    """The landed rows up to an id at which the walk is over for sure: every stratum has had as many rows as there is room for, or
    the sizes of strata that still have room make up the cap."""
    ends = df.agg(F.min(row_id).alias("lo"), F.max(row_id).alias("hi")).first()
    read, seen, sure, width = [], dict.fromkeys(mine, 0), 0, FIRST_IDS
    lo = ends["lo"]
    while lo is not None and lo <= ends["hi"]:
        part = land(df.where((F.col(row_id) >= lo) & (F.col(row_id) < lo + width)))
        read.append(part)
        sums = [value.alias(f"{kind}{k}") for k, name in enumerate(mine) for kind, value in (
            ("n", F.count_if(mine[name])), ("size", F.coalesce(F.sum(F.when(mine[name], F.col(size))), F.lit(0))))]
        found = part.agg(F.lit(0).alias("none"), *sums).first()
        for k, name in enumerate(mine):
            seen[name] += found[f"n{k}"]
            sure += found[f"size{k}"] if seen[name] <= room[name] else 0
        if all(seen[name] >= room[name] for name in mine) or sure >= cap:
            break
        lo, width = lo + width, 2 * width
    out = read[0] if read else land(df.limit(0))
    for part in read[1:]:
        out = out.unionByName(part)
    return out


def _room(quota: float, taken: int) -> int:
    return 1 << 62 if math.isinf(quota) else max(math.ceil(Fraction(quota) - taken), 0)


def strata_quotas(conversations: float, parts: Mapping[str, float]) -> dict[str, float]:
    """Quotas in proportion to ``parts`` plus one each, as used for mixed batches of conversations."""
    whole = sum(parts.values())
    return {name: conversations * part / whole + 1 for name, part in parts.items()}
