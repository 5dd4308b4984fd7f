"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Items are cut into windows of 13 words. A window occurs in a document only if each of its 3-word shingles does, so it is
enough to join the rarest one (the prefix of a full-containment join has length one). Documents meet that shingle at a
place, which fixes where the item would lie (positional bound) and whether it fits (length bound); the item's shingles are
then compared at their exact places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelmill.settle import fits, land

WINDOW = 13
SHINGLE = 3
SHARE = 20
#: All but other ASCII than letters and digits, each named by itself: Java looks single characters up in a table, and takes many
#: times as long for the same class in ranges. Upper case stands beside lower case, as words are counted in unfolded texts.
_WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of ``text`` with A-Z in lower case; null has none."""
    plain = F.octet_length(text) == F.length(text)  # ASCII only: the built-in lower() folds the same letters
    folded = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.regexp_extract_all(folded, F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


def _shingles(words: Column, size: int) -> Column:
    """Structs (p, w0, w1, ..) of the shingles of ``size`` words with their places."""
    n = F.size(words)
    starts = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
    parts = [F.slice(words, i + 1, F.greatest(n - (size - 1), F.lit(0))) for i in range(size)]
    return F.arrays_zip(starts.alias("p"), *(part.alias(f"w{i}") for i, part in enumerate(parts)))


def _exploded(df: DataFrame, size: int, *keep: str) -> DataFrame:
    rows = df.select(*keep, F.explode(_shingles(F.col("words"), size)).alias("g"))
    return rows.select(*keep, F.col("g.p").alias("p"), F.array(*(f"g.w{i}" for i in range(size))).alias("gram"))


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
    window: int = WINDOW, share: int = SHARE,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >=
    n_words).

    A window is ``window`` consecutive words of an item, or the whole of a shorter item; a document word inside any
    occurrence of a window is hit. Null and empty texts have no words; items without words, or without id, have no windows.
    Items may repeat; an id counts once. Rows that repeat an id, or have none, are told apart by their place in the landed
    table. An empty benchmark leaves every document clean; other columns are not read.
    """
    held = land(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), *_numbered(F.col(f"`{text}`")), F.col(f"`{text}`").alias("text")))
    marks = _marks(held.select("row", "n_words", "text"), _named(items, item_id, text), window)
    out = held.select("row", "doc_id", "n_words").join(marks, "row", "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), _bad(share).alias("contaminated"),
    )


def keep_clean(
    docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, share: int = SHARE,
) -> DataFrame:
    """The rows of ``docs`` that ``contamination`` does not call contaminated, with their columns as they are."""
    body = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("body")
    held = land(docs.select(body, *_numbered(F.col(f"`{text}`"))))
    marks = _marks(held.select("row", "n_words", F.col(f"body.`{text}`").alias("text")), _named(items, item_id, text), window)
    bad = land(held.select("row", "n_words").join(marks, "row").where(_bad(share)).select("row"))
    return held.join(F.broadcast(bad) if fits(bad) else bad, "row", "left_anti").select("body.*")


def _numbered(text: Column) -> list[Column]:
    count = F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")
    return [F.monotonically_increasing_id().alias("row"), count.alias("n_words")]


def _named(items: DataFrame, item_id: str, text: str) -> DataFrame:
    return items.select(F.col(f"`{item_id}`").cast("string").alias("item_id"), words(F.col(f"`{text}`")).alias("words"))


def _bad(share: int) -> Column:
    return F.coalesce((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")), F.lit(False))


def _marks(held: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(row, n_hit, ids) of the rows in ``held`` (row, n_words, text) that a window of an item occurs in."""
    if window < SHINGLE:
        raise ValueError(f"a window has at least {SHINGLE} words")
    bench = items.where("size(words) > 0 and item_id is not null").distinct()
    # Equal texts are one item, known by their content.
    bench = bench.select("item_id", "words", F.sha2(F.array_join("words", " "), 256).alias("item"))
    named = land(bench.select("item", "item_id").distinct())
    bench = bench.dropDuplicates(["item"]).select("item", "words", F.size("words").alias("len"), F.least(F.size("words"), F.lit(window)).alias("win"))
    bench = land(bench)
    sizes = [r["s"] for r in bench.select(F.least(F.lit(SHINGLE), "len").alias("s")).distinct().collect()]  # of 1, 2 and 3
    source = held.where("n_words > 0").select("row", "n_words", words(F.col("text")).alias("words"))
    hits = held.sparkSession.createDataFrame([], "row long, item string, start int, end int")
    for size in sorted(sizes):
        own = bench.where(F.least(F.lit(SHINGLE), "len") == size)
        at = land(_exploded(own, size, "item", "len", "win").withColumn("id", F.xxhash64("gram")))
        grams = land(at.select("gram", "id").distinct())
        found = _exploded(source, size, "row", "n_words").join(F.broadcast(grams) if fits(grams) else grams, "gram")
        found = land(found.select("row", "n_words", "p", "id"))
        hits = hits.unionByName(_occurrences(found, at, size))
    hits = land(hits)
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["to"]))).alias("n"), F.greatest(acc["to"], x["e"]).alias("to")
    )
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    span = F.struct(F.col("start").alias("s"), F.col("end").alias("e"))
    # The spans of a row are bounded by its own words.
    covered = F.aggregate(F.sort_array(F.collect_set(span)), none, step, lambda acc: acc["n"]).cast("long")
    covered = hits.groupBy("row").agg(covered.alias("n_hit"))
    by_item = hits.select("row", "item").distinct().join(F.broadcast(named) if fits(named) else named, "item")
    return covered.join(by_item.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("ids")), "row")


def _occurrences(found: DataFrame, at: DataFrame, size: int) -> DataFrame:
    """(row, item, start, end): the words of a document that windows of an item cover, one row for each unbroken run."""
    rarity = found.groupBy("id").agg(F.count("*").alias("n"))
    # The rarest shingle of each window: its index is the window's start, the shingle lies at ``p``.
    seen = at.join(rarity, "id", "left").select("item", "len", "win", "p", "id", F.coalesce("n", F.lit(0)).alias("n"))
    by_start = seen.select("item", "len", "win", "p", "id", "n", F.explode(
        F.sequence(F.greatest(F.lit(0), F.col("p") - (F.col("win") - size)), F.least("p", F.col("len") - F.col("win")))
    ).alias("w"))
    prefix = by_start.groupBy("item", "w").agg(F.min_by(F.struct("p", "id", "n"), F.struct("n", "p")).alias("x"), F.first("win").alias("win"))
    # A window with a shingle that no document holds occurs nowhere.
    prefix = land(prefix.where("x.n > 0").select("item", "w", "win", F.col("x.p").alias("ip"), F.col("x.id").alias("id")))
    near = found.join(F.broadcast(prefix) if fits(prefix) else prefix, "id")
    start = F.col("p") - F.col("ip") + F.col("w")
    near = near.where((start >= 0) & (start + F.col("win") <= F.col("n_words")))
    # ``d``: where word 0 of the item would lie.
    near = near.select("row", "item", (F.col("p") - F.col("ip")).alias("d")).distinct()
    shingles = at.select("item", F.col("p").alias("ip"), "id", "win")
    lined = near.join(F.broadcast(shingles) if fits(shingles) else shingles, "item")
    lined = lined.select("row", "item", "d", "win", "ip", "id", (F.col("d") + F.col("ip")).alias("p"))
    lined = lined.join(found.select("row", "p", "id"), ["row", "p", "id"])
    # Runs of matching shingles on one line, by the usual island grouping; a run covers a window if it is long enough.
    places = lined.groupBy("row", "item", "d").agg(F.first("win").alias("win"), F.sort_array(F.collect_set("ip")).alias("ips"))
    island = F.explode(F.transform("ips", lambda x, i: F.struct((x - i).alias("run"), x.alias("ip")))).alias("x")
    runs = places.select("row", "item", "d", "win", island).groupBy("row", "item", "d", "x.run").agg(
        F.first("win").alias("win"), F.min("x.ip").alias("lo"), F.max("x.ip").alias("hi")
    )
    runs = runs.where(F.col("hi") - F.col("lo") + size >= F.col("win"))
    return runs.select("row", "item", (F.col("d") + F.col("lo")).cast("int").alias("start"), (F.col("d") + F.col("hi") + size).cast("int").alias("end"))
