"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = s(threshold_k - w.x): one weight vector over hashed text features is shared by all grades, the thresholds are
ordered. Selection goes by the expected grade or by the probability of reaching a grade.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from labelmill.llm import wordhash
from labelmill.llm.common import map_batches, pieces, utf8, widened
from labelmill.settle import settle

BUCKETS = 1 << 18
#: The model is fitted on at most about this many rated rows.
SAMPLE = 8_000
#: Bytes of the sampled texts; one counts as the bytes of its features at most.
SAMPLE_BYTES = 64_000_000
STEPS = 60
RIDGE = 3e-4
_SHAPES = 6**3
_EXTRA = _SHAPES + 3
WIDTH = BUCKETS + _EXTRA

_CLASS = np.full(256, 4, np.uint8)  # other signs
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[128:] = 3
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5  # signs of ordinary prose

_SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Bytes of a word's beginning that are a feature of their own.
PREFIXES = (4, 5)


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) triples: presence of each hashed word and word beginning (without signs), and shares of word
    shapes (classes of the first and the last two bytes), of words that repeat the one before, of words that occurred before,
    and a constant. A text without words has the constant only."""
    n = len(texts)
    pairs = []
    for prefix in (0, *PREFIXES):
        hashes, _, _, first = wordhash.words(texts, _SIGNS, prefix)
        owner = np.repeat(np.arange(n), np.diff(first))
        hashes = wordhash.mix(hashes ^ np.uint64(prefix))
        pairs.append(owner * np.int64(BUCKETS) + (hashes >> np.uint64(46)).astype(np.int64))
    pair = np.unique(np.concatenate(pairs))
    hashes, starts, ends, first = wordhash.words(texts)
    owner = np.repeat(np.arange(n), np.diff(first))
    whole = _CLASS[np.frombuffer(b"\n".join(x or b"" for x in texts) + b"\n", np.uint8)].astype(np.int64)
    shape = whole[starts] * 36 + whole[np.maximum(ends - 2, starts)] * 6 + whole[ends - 1]
    shapes, counts = np.unique(owner * _EXTRA + shape, return_counts=True)
    size = np.maximum(np.diff(first), 1)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    again = 1 - np.bincount(np.unique(owner.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24)).astype(np.int64) >> 40, minlength=n)[:n] / size
    repeats = np.bincount(owner[same], minlength=n)[:n] / size
    rows = np.arange(n)
    text = np.concatenate([pair // BUCKETS, shapes // _EXTRA, rows, rows, rows])
    feature = np.concatenate([pair % BUCKETS, BUCKETS + shapes % _EXTRA, *(np.full(n, BUCKETS + _SHAPES + i) for i in range(3))])
    worded = np.diff(first) > 0
    value = np.concatenate([np.ones(len(pair)), 10 * counts / size[shapes // _EXTRA], 10 * repeats, 10 * again * worded, np.ones(n)])
    return text, feature, value


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def probabilities(eta: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1.. as columns."""
    return _sigmoid(eta[:, None] - thresholds[None, :])


def loss_and_gradient(
    eta: np.ndarray, thresholds: np.ndarray, grade: np.ndarray, weight: np.ndarray | None = None,
) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood with its derivatives by eta and by the thresholds; a row counts ``weight`` times."""
    k = len(thresholds)
    times = np.ones(len(eta)) if weight is None else weight
    tail = np.concatenate([np.ones((len(eta), 1)), probabilities(eta, thresholds), np.zeros((len(eta), 1))], axis=1)
    rows = np.arange(len(eta))
    up, down = tail[rows, grade], tail[rows, grade + 1]
    own = np.maximum(up - down, 1e-12)
    slope_up, slope_down = up * (1 - up), down * (1 - down)
    by_eta = -times * (slope_up - slope_down) / own
    up_share, down_share = times * slope_up / own, times * slope_down / own
    by_threshold = np.array([up_share[grade == j + 1].sum() - down_share[grade == j].sum() for j in range(k)])
    return float(-(times * np.log(own)).sum()), by_eta, by_threshold


def minimise(function, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:  # noqa: ANN001
    """Limited-memory BFGS with a backtracking line search; ``function`` gives value and gradient."""
    value, slope = function(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        way, kept = slope.copy(), []
        for dx, dg, scale in reversed(pairs):
            a = scale * (dx @ way)
            kept.append(a)
            way -= a * dg
        if pairs:
            dx, dg, scale = pairs[-1]
            way *= (dx @ dg) / (dg @ dg)
        else:
            way /= max(1.0, float(np.abs(way).sum()))
        for (dx, dg, scale), a in zip(pairs, reversed(kept), strict=True):
            way += (a - scale * (dg @ way)) * dx
        size, fall = 1.0, float(slope @ way)
        if fall <= 1e-14:
            break
        while True:
            new = x - size * way
            new_value, new_slope = function(new)
            if new_value <= value - 1e-4 * size * fall or size < 1e-6:
                break
            size /= 2
        dx, dg = new - x, new_slope - slope
        if dx @ dg > 1e-12:
            pairs = [*pairs[1 - memory :], (dx, dg, 1 / (dx @ dg))]
        done = abs(value - new_value) <= 1e-9 * max(1.0, abs(value))
        x, value, slope = new, new_value, new_slope
        if done:
            break
    return x


def fit_arrays(
    text: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, weight: np.ndarray | None = None,
) -> dict:
    """Weights and ordered thresholds of the least mean loss plus ``RIDGE`` / 2 |w|^2; the lowest threshold and the logarithms
    of the gaps are free. A text stands for ``weight`` equal ones."""
    n = max(1, len(grade))
    times = np.ones(len(grade)) if weight is None else weight
    total = max(1.0, float(times.sum()))
    share = np.array([(times[grade >= k].sum() + 1) / (total + grades) for k in range(1, grades)])
    start = -np.log(share / (1 - share))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    thresholds = lambda f: np.cumsum(np.concatenate([f[:1], np.exp(f[1:])]))

    def function(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights, own = x[:WIDTH], x[WIDTH:]
        eta = np.bincount(text, weights[feature] * value, n)[:n]
        loss, by_eta, by_threshold = loss_and_gradient(eta[: len(grade)], thresholds(own), grade, times)
        slope = np.bincount(feature, np.append(by_eta, 0)[text] * value, WIDTH) / total + RIDGE * weights
        tails = np.cumsum(by_threshold[::-1])[::-1] / total
        tails[1:] *= np.exp(own[1:])
        return loss / total + RIDGE / 2 * float(weights @ weights), np.concatenate([slope, tails])

    x = minimise(function, np.concatenate([np.zeros(WIDTH), free]), STEPS)
    return {"weights": x[:WIDTH], "thresholds": thresholds(x[WIDTH:])}


def fit(rated: DataFrame, grades: int, grade: str = "grade", text: str = "text", sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> dict:
    """A model from rows with a grade from 0 to ``grades`` - 1.

    Rows of one text and grade are one row that counts as often. Of these at most ``sample`` are used, with ``most_bytes`` of
    text in sum, chosen by the hashes of text and grade. That bounds what the driver holds, however many copies there are
    and however long texts are. Rows with a null text, and with a null grade or one out of range, are left out. Without rows
    the model rates every text alike.
    """
    if grades < 2:
        raise ValueError("at least two grades are needed")
    rows = rated.select(F.col(f"`{grade}`").cast("int").alias("grade"), utf8(f"`{text}`").alias("text"))
    rows = rows.where((F.col("grade") >= 0) & (F.col("grade") < grades) & F.col("text").isNotNull())
    # Chosen by the text alone, so that a join that has brought the grades needs to move the chosen texts only.
    share = min(1.0, sample / max(1, rows.count()))
    rows = rows.where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1_000_000)) < max(1, int(share * 1_000_000)))
    rows = rows.withColumns({"code": F.xxhash64("text", "grade", F.lit(3)), "other": F.xxhash64("grade", "text", F.lit(7))})
    # Texts are shuffled for the rows that are drawn only; before, they are known by their hashes.
    short = rows.select("code", "other", F.least(F.octet_length("text"), F.lit(8 * WIDTH)).alias("size")).groupBy("code", "other").agg(F.max("size").alias("size"), F.count("*").alias("times"))
    drawn = settle(short.orderBy("code", "other").limit(sample))
    before = F.sum("size").over(Window.orderBy("code", "other"))  # over ``sample`` short rows at most
    drawn = drawn.withColumn("upto", before).where(F.col("upto") <= most_bytes).select("code", "other", "times")
    found = rows.join(F.broadcast(drawn), ["code", "other"]).groupBy("code", "other", "times").agg(F.first("grade").alias("grade"), F.first("text").alias("text"))
    rows = found.select("grade", "text", F.col("times").cast("double").alias("times"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1):
                own, feature, value = features(batch.column(1).to_pylist())
                order = np.argsort(own, kind="stable")
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(own, minlength=batch.num_rows))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (feature[order].astype(np.int32), value[order].astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], ["grade", "times", "feature", "value"])

    got = map_batches(rows, run, "grade int, times double, feature array<int>, value array<float>").toArrow().combine_chunks()
    sizes = np.asarray(got["feature"].combine_chunks().value_lengths()) if got.num_rows else np.zeros(0, int)
    flat = lambda name: np.concatenate([np.asarray(c.flatten()) for c in got[name].chunks] or [np.zeros(0)])
    text_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    return fit_arrays(text_of, flat("feature").astype(np.int32), flat("value").astype(np.float32), np.asarray(got["grade"]).astype(int), grades, np.asarray(got["times"]).astype(float))


def rate(df: DataFrame, model: dict, text: str = "text", grade: int | None = None) -> DataFrame:
    """``df`` with ``expected_grade`` (double) and ``tail_probability`` (double: of grade ``grade`` or more, the highest one if
    none is given). A text that is null or has no words is rated 0 and 0. Columns named like the new ones are replaced; the
    model is broadcast and has a fixed width."""
    thresholds, shared = model["thresholds"], df.sparkSession.sparkContext.broadcast(model["weights"])
    at = (len(thresholds) if grade is None else grade) - 1
    rest = df.drop("expected_grade", "tail_probability")
    schema = widened(rest, expected_grade="double", tail_probability="double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for whole in batches:
            for batch in pieces(whole, whole.num_columns - 1):
                texts = batch.column(batch.num_columns - 1).to_pylist()
                own, feature, value = features(texts)
                eta = np.bincount(own, weights[feature] * value, len(texts))[: len(texts)]
                tail = probabilities(eta, thresholds) * np.array([bool(t and t.split()) for t in texts])[:, None]
                columns = [pa.array(tail.sum(axis=1)), pa.array(tail[:, at])]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], schema.names)

    return map_batches(rest.select(*(F.col(f"`{c}`") for c in rest.columns), utf8(f"`{text}`").alias("expected_grade")), run, schema)


def graded(quality: Column, toxic: Column) -> Column:
    """Grades of two binary ratings: 0 toxic, 1 of low quality, 2 good; null if one that matters is missing."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 2)
