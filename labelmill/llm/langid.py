"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from labelmill.llm.common import map_batches, pieces, widened

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
TRAIN_PER_LANGUAGE = 20_000
MOST_LANGUAGES = 500
UNKNOWN = "und"
_CHARS = 400_000


class _Letters:
    """Which code points are letters, looked up by table."""

    def __init__(self) -> None:
        self.table = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        found = self.table[np.minimum(points, 0xFFFF)]
        for c in np.unique(points[points > 0xFFFF]):
            found[points == c] = chr(c).isalpha()
        return found


def grams(texts: list[str], letters: _Letters, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, the text each one belongs to, and the number of letters of each text.

    Letters are lower-cased, every run of other characters is one space, and every text stands between spaces; n-grams do not
    cross texts.
    """
    points = np.frombuffer("\n".join(["", *(t.lower().replace("\n", " ") for t in texts), ""]).encode("utf-32-le", "replace"), np.uint32)
    ends = points == 10
    owner = np.cumsum(ends) - 1
    letter = letters(points)
    n_letters = np.bincount(owner[letter], minlength=len(texts))[: len(texts)]
    points = np.where(letter, points, 32).astype(np.uint64)
    points[ends] = 32
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept |= ends
    # The boundary after a text stands for the other characters at its end.
    at = np.flatnonzero(kept)
    kept[at[:-1][~letter[at[:-1]] & ~ends[at[:-1]] & ends[at[1:]]]] = False
    points, owner, letter = points[kept], owner[kept], letter[kept]
    hashes, owners = [], []
    for n in ORDERS:
        if len(points) < n:
            continue
        key = np.full(len(points) - n + 1, n, np.uint64)
        some = np.zeros(len(key), bool)
        for i in range(n):
            key = key * np.uint64(0x9E3779B97F4A7C15) + points[i : len(points) - n + 1 + i]
            some |= letter[i : len(points) - n + 1 + i]
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key >>= np.uint64(32)
        # The space between two texts opens the later one; a gram that holds letters of both is left out.
        inside = some & ((owner[n - 1 :] == owner[: len(key)]) | (~letter[n - 1 :] & (owner[n - 1 :] == owner[: len(key)] + 1)))
        hashes.append((key[inside] % np.uint64(buckets)).astype(np.int64))
        owners.append(owner[: len(key)][inside])
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n_letters
    return np.concatenate(hashes), np.concatenate(owners), n_letters


def fit(df: DataFrame, label: str = "lang", text: str = "text", per_language: int = TRAIN_PER_LANGUAGE, key: Column | None = None) -> dict:
    """A model {"languages", "weights"} from the rows of ``df`` whose label and text are not null.

    At most about ``per_language`` rows of each language are learned from, chosen by the hash of ``key`` (the text if none is
    given); with that bound the counts, one row per language and bucket, are small whatever the input. The prior is uniform.
    An empty table gives a model without languages.
    """
    rows = df.select(F.col(f"`{label}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"),
                     F.pmod(F.xxhash64(F.col(f"`{text}`") if key is None else key), F.lit(1_000_000)).alias("draw"))
    rows = rows.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(sizes)
    wanted = F.lit(False)
    for name in languages:
        wanted |= (F.col("lang") == name) & (F.col("draw") < math.ceil(1e6 * min(1, per_language / sizes[name])))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, counts = _Letters(), {}
        for whole in batches:
            for batch in pieces(whole, 1, _CHARS):
                langs = batch.column(0).to_pylist()
                found, owner, _ = grams(batch.column(1).to_pylist(), letters)
                at = {name: i for i, name in enumerate(dict.fromkeys(langs))}
                group = np.array([at[x] for x in langs], np.int64)[owner]
                sums = np.bincount(group * BUCKETS + found, minlength=len(at) * BUCKETS).reshape(-1, BUCKETS)
                for name, i in at.items():
                    counts[name] = counts.get(name, 0) + sums[i]
        for name, own in counts.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used)), pa.array(used), pa.array(own[used])], ["lang", "bucket", "n"])

    weights = np.full((BUCKETS, len(languages)), SMOOTHING)
    if languages:
        sums = map_batches(rows.where(wanted).select("lang", "text"), count, "lang string, bucket long, n long")
        sums = sums.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
        at = {name: i for i, name in enumerate(languages)}
        weights[np.asarray(sums["bucket"]), np.array([at[x] for x in sums["lang"].to_pylist()], np.int64)] += np.asarray(sums["n"])
    return {"languages": languages, "weights": np.log(weights) - np.log(weights.sum(axis=0))}


def predict(df: DataFrame, model: dict, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the most probable language of each whole text and its probability.

    Null texts and texts without a letter get ``und`` and score 0, as do all texts under a model without languages; ties go to
    the language first in order. Columns named like the two new ones are replaced, others pass through. The log-probability
    matrix is broadcast: ``BUCKETS`` x at most ``MOST_LANGUAGES`` doubles.
    """
    matrix = df.sparkSession.sparkContext.broadcast(model["weights"])
    languages = model["languages"]
    rest = df.drop(lang, score)
    schema = widened(rest, **{lang: "string", score: "double"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, weights = _Letters(), matrix.value
        for whole in batches:
            for batch in pieces(whole, whole.num_columns - 1, _CHARS):
                texts = [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()]
                found, owner, n_letters = grams(texts, letters)
                sums = np.zeros((len(texts), len(languages)))
                for i in range(len(languages)):
                    sums[:, i] = np.bincount(owner, weights[found, i], len(texts))[: len(texts)]
                known = (n_letters > 0) & (len(languages) > 0)
                best, names = np.zeros(len(texts)), [UNKNOWN] * len(texts)
                if known.any():
                    top = sums.argmax(axis=1)
                    best = np.where(known, 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
                    names = [languages[t] if k else UNKNOWN for t, k in zip(top, known, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names), pa.array(best)], [*batch.schema.names[:-1], lang, score])

    return map_batches(rest.select(*(F.col(f"`{c}`") for c in rest.columns), F.col(f"`{text}`").alias(score)), run, schema)
