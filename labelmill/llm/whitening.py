"""Whitening of embeddings by their leading principal components.

The covariance is summed by Spark over the distinct vectors; only its d x d entries reach the driver. Its eigenvectors come from
FEAST: a contour around an interval of eigenvalues, integrated by Gauss-Legendre quadrature of complex shifted solves, projects
random vectors onto the eigenvectors inside, and a Rayleigh-Ritz step extracts these. Inertia counts (signs of the pivots of the
shifted covariance, brought to tridiagonal form) choose the intervals and show that no eigenvalue was missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from labelmill.llm.common import map_batches, widened
from labelmill.settle import land

COMPONENTS = 16
#: The driver holds the covariance and a few matrices of that size: 128 MB each at most.
MOST_DIMENSIONS = 4096
#: Entries are numbers x = floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Quadrature points on the upper half of a contour, eigenvalues that an interval is divided down to, steps of one attempt.
POINTS, GROUP, STEPS = 8, 6, 12
_EPS = float(np.finfo(float).eps)
#: Differences of two entries must fit into a long.
_MOST = float(1 << 61)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal) of an orthogonally similar tridiagonal matrix, by Householder reflections."""
    a, n = matrix.astype(float), len(matrix)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += size if v[0] >= 0 else -size
        v /= np.linalg.norm(v)
        part = a[k + 1 :, k + 1 :]
        p = part @ v
        p -= (v @ p) * v
        part -= 2 * (np.outer(v, p) + np.outer(p, v))
        own = a[k + 1 :, k] - 2 * (v @ a[k + 1 :, k]) * v
        a[k + 1 :, k], a[k, k + 1 :] = own, own
    return np.diag(a).copy(), np.diag(a, 1).copy()


def above(form: tuple[np.ndarray, np.ndarray], shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal ``form`` exceed each shift: the positive pivots, by Sylvester's law."""
    diagonal, off = form
    tiny = np.finfo(float).tiny / _EPS
    count, pivot = np.zeros(len(shifts), np.int64), np.ones(len(shifts))
    for i, own in enumerate(diagonal):
        pivot = own - shifts - (off[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot > 0
    return count


def intervals(form: tuple[np.ndarray, np.ndarray], lo: float, hi: float) -> Iterator[tuple[float, float, int]]:
    """Intervals of (lo, hi] with the number of eigenvalues in each, highest first; cut where no eigenvalue is near, if such
    a place is found."""
    grid = np.linspace(lo, hi, 65)
    counts = above(form, grid)
    total = int(counts[0] - counts[-1])
    if total == 0:
        return
    if total <= GROUP or hi - lo <= 1e-11 * max(abs(lo), abs(hi)):
        yield lo, hi, total
        return
    cells = np.diff(counts) == 0
    inner = [i for i in range(1, 63) if cells[i] and counts[i] not in (counts[0], counts[-1])]
    if inner:
        # The middle of the widest empty stretch.
        runs = np.split(inner, np.flatnonzero(np.diff(inner) > 1) + 1)
        widest = max(runs, key=len)
        cut = (grid[widest[0]] + grid[widest[-1] + 1]) / 2
    else:
        cut = grid[32]
    yield from intervals(form, cut, hi)
    yield from intervals(form, lo, cut)


def inside(matrix: np.ndarray, lo: float, hi: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues in (lo, hi] and their eigenvectors, by contour integration and Rayleigh-Ritz. A subspace that
    does not bring out all of them is doubled, up to the whole space."""
    n = len(matrix)
    norm = np.linalg.norm(matrix, 2)
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    turn = np.exp(1j * np.pi / 2 * (1 - nodes))
    centre, radius = (lo + hi) / 2, (hi - lo) / 2
    draw, width = np.random.default_rng(17), 2 * count + 8
    while True:
        width = min(width, n)
        basis = draw.standard_normal((n, width))
        for _ in range(STEPS):
            projected = np.zeros((n, width))
            for w, e in zip(weights, turn, strict=True):
                shifted = (centre + radius * e) * np.eye(n) - matrix
                projected += w / 2 * (radius * e * np.linalg.solve(shifted, basis)).real
            basis = np.linalg.qr(projected)[0]
            values, mixed = np.linalg.eigh(basis.T @ matrix @ basis)
            basis = basis @ mixed
            own = (values > lo) & (values <= hi)
            found, vectors = values[own], basis[:, own]
            rest = np.linalg.norm(matrix @ vectors - vectors * found, axis=0).max(initial=0)
            if len(found) == count and rest <= 4 * n * _EPS * norm:
                return found, vectors
        if width == n:
            # A basis of the whole space leaves out nothing; a value within rounding of an end may count on either side.
            return found, vectors
        width *= 2


def leading(matrix: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the ``most`` largest eigenvalues of a covariance that exceed rounding, falling, and unit eigenvectors as
    columns, each with its largest entry positive. Fewer if its rank is smaller."""
    n = len(matrix)
    none = np.zeros(0), np.zeros((n, 0))
    norm = np.abs(matrix).sum(axis=1).max(initial=0)
    if not norm > 0:
        return none
    form = tridiagonal(matrix)
    least = 8 * n * _EPS * norm
    values, vectors, want = [], [], min(most, int(above(form, np.array([least]))[0]))
    for lo, hi, count in intervals(form, least, norm * (1 + 1e-9)):
        own, space = inside(matrix, lo, hi, count)
        values.append(own)
        vectors.append(space)
        if sum(map(len, values)) >= want:
            break
    if not values:
        return none
    # Spaces of neighbouring intervals are made orthogonal to rounding.
    basis = np.linalg.qr(np.concatenate(vectors, axis=1))[0]
    values, mixed = np.linalg.eigh(basis.T @ matrix @ basis)
    order = np.argsort(-values)[:want]
    out = (basis @ mixed)[:, order]
    return values[order], out * np.where(np.take_along_axis(out, np.abs(out).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)


@dataclass(frozen=True)
class Whitening:
    """Fitted on ``n`` distinct vectors with sums n * base + rest by dimension (whole numbers, 0 <= rest < n)."""

    n: int
    base: list[int]
    rest: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    scale: int
    offset: int

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]


def _usable(vec: Column, scale: int) -> Column:
    fine = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double") * scale) < _MOST)
    return F.coalesce(F.forall(vec, fine), F.lit(False))


def _numbers(vec: Column, scale: int, offset: int) -> Column:
    return F.transform(vec, lambda c: F.floor(c.cast("double") * scale) + F.lit(offset).cast("long"))


def _matrix(column: pa.Array) -> np.ndarray:
    rows = len(column)
    return np.asarray(column.flatten()).reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def _centred(x: np.ndarray, base: np.ndarray, part: np.ndarray) -> np.ndarray:
    return (x - base).astype(float) - part


def _moments(held: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(i, j, v) for i <= j: sums of products of the entries that ``of`` makes of each vector in column x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = of(_matrix(batch.column(0)))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    return map_batches(held, run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def _sums(held: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors in column x and their exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                n, hi, lo = n + len(x), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                high, low = (hi, lo) if high is None else (high + hi, low + lo)
        if n:
            columns = [np.arange(len(high), dtype=np.int32), np.full(len(high), n), high, low]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "n", "hi", "lo"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = map_batches(held, run, "i int, n long, hi long, lo long").groupBy("i").agg(wide("n"), wide("hi"), wide("lo")).orderBy("i").collect()
    return (int(found[0]["n"]), [(int(r["hi"]) << 32) + int(r["lo"]) for r in found]) if found else (0, [])


def _symmetric(moments: DataFrame, d: int) -> np.ndarray:
    out = np.zeros((d, d))
    for r in moments.collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def fit(df: DataFrame, vec: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> Whitening:
    """Principal components of the distinct vectors of ``df``, their entries c taken as floor(scale * c) + offset.

    Rows whose vector is null or holds null or non-finite entries (or entries beyond a long) take no part, nor do vectors of
    another length than most (of equally frequent lengths the greater counts). Copies of a vector count once, however many
    there are: they are put together before they are shuffled. Sums are exact; covariances are centred before they are
    multiplied, with divisor n. The driver gets d sums and d x d products, no vectors; ``MOST_DIMENSIONS`` bounds d. Without
    vectors, or with one, there are no components. Other columns are not read.
    """
    usable = df.where(_usable(F.col(f"`{vec}`"), scale)).select(_numbers(F.col(f"`{vec}`"), scale, offset).alias("x"))
    length = usable.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = length["d"] if length else 0
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions; the driver holds matrices of at most {MOST_DIMENSIONS}")
    if d == 0:
        return Whitening(0, [], [], np.zeros(0), np.zeros((0, 0)), 0.0, 0.0, scale, offset)
    held = land(usable.where(F.size("x") == d).distinct())
    n, sums = _sums(held)
    base, rest = [s // n for s in sums], [s % n for s in sums]
    whole, part = np.array(base, np.int64), np.array([r / n for r in rest])
    covariance = _symmetric(_moments(held, lambda x: _centred(x, whole, part)), d) / n
    values, vectors = leading(covariance, components)
    k, mixed = len(values), vectors / np.sqrt(values)
    if k:
        # The mean of what was projected is zero but for rounding; it is measured and taken off all the same.
        project = lambda x: _centred(x, whole, part) @ mixed
        one = _symmetric(_moments(held, lambda x: np.column_stack([np.ones(len(x)), project(x)])), k + 1)
        mean = one[0, 1:] / n
        error = float(np.abs(_symmetric(_moments(held, lambda x: project(x) - mean), k) / n - np.eye(k)).max())
    else:
        error = 0.0
    return Whitening(n, base, rest, values, vectors, float(np.trace(covariance)), error, scale, offset)


def whiten(df: DataFrame, model: Whitening, vec: str = "embedding", out: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """The rows of ``df`` that ``fit`` would use, with ``out`` (array of double, an entry for each component) and ``deviation`` (long:
    the sum over dimensions of (n * x - sum)^2, exact; null where that is beyond a long), which replace columns of these
    names. Repeated rows stay, all other columns pass through; an empty table gives no rows."""
    source, keep = F.col(f"`{vec}`"), [F.col(f"`{c}`") for c in df.columns if c not in (out, deviation)]
    usable = df.where(_usable(source, model.scale) & (F.size(source) == len(model.base)) & F.lit(len(model.base) > 0))
    rows = usable.select(*keep, _numbers(source, model.scale, model.offset).alias(out))
    n, base, remainder = model.n, np.array(model.base, np.int64), np.array(model.rest, np.int64)
    part, mixed = np.array([r / max(n, 1) for r in model.rest]), model.vectors / np.sqrt(model.values)
    sums = [n * b + r for b, r in zip(model.base, model.rest, strict=True)]

    def exact(x: np.ndarray) -> list[int | None]:
        if len(base) * (n * (float(np.abs(x - base).max(initial=0)) + 1)) ** 2 < float(1 << 62):
            return ((n * (x - base) - remainder) ** 2).sum(axis=1).tolist()
        found = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(batch.num_columns - 1)).reshape(batch.num_rows, len(base))
            white = _centred(x, base, part) @ mixed
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * mixed.shape[1])
            columns = [*batch.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(white.ravel())), pa.array(exact(x), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], out, deviation])

    return map_batches(rows, run, widened(rows.drop(out), **{out: "array<double>", deviation: "long"}))
