"""Runs: maximal stretches of a text in which the words repeat with a period.

The first phase of Baier's suffix sorter groups suffixes by the longest Lyndon word that they begin with, so the width of a
suffix's group is its entry of the Lyndon array. Every run holds a Lyndon word as long as its period, longest at its place under
an order of the words or under the reverse order; so the entries of the two arrays are all roots there can be. Each is
extended to both sides by longest common extensions, and the runs are what is long enough.

Words that no run can hold are cut out before that, without loss. A run of length >= max(12, 2q) with period q lies in
copies of six words in a row: its first length - q words are covered by such copies q words further on, its last length - q ones by
such copies q words before, and together these are all. So only stretches covered by six words that occur twice in the text matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelmill.llm import wordhash
from labelmill.llm.common import map_batches, pieces, utf8, widened

LEAST = 12
RUNS = "array<struct<start:long,length:long,period:long>>"


def lyndon(values: list[int]) -> list[int]:
    """The length of the longest Lyndon word that starts at each place: the groups of suffixes are taken from the highest down,
    and each suffix moves the nearest one before it that is in a lower group into a new group, just above its old one, as
    much wider as suffixes of the group at hand have led to it. A group is final once it is taken."""
    n = len(values)
    symbols = sorted(set(values))
    number = {v: k for k, v in enumerate(symbols)}
    group = [number[v] for v in values]
    members: list[list[int]] = [[] for _ in symbols]
    for i, k in enumerate(group):
        members[k].append(i)
    width, lower, upper = [1] * len(symbols), list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
    # Places are shifted by one: before[p] is p while p - 1 waits, else a place further left; 0 stands for none.
    before, out = list(range(n + 1)), [0] * n
    at = len(symbols) - 1
    while at >= 0:
        own = [i for i in members[at] if group[i] == at]
        members[at] = []
        size = width[at]
        for i in own:
            before[i + 1] = i
            out[i] = size
        led: dict[int, int] = {}
        for i in own:
            p = i
            while before[p] != p:
                before[p] = before[before[p]]
                p = before[p]
            if p:
                before[i + 1] = p
                led[p - 1] = led.get(p - 1, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in led.items():
            moved.setdefault((times, group[j]), []).append(j)
        # Those led to more often come first, so that the others get between them and the old group.
        for times, old in sorted(moved, reverse=True):
            new = len(width)
            for j in moved[times, old]:
                group[j] = new
            members.append(moved[times, old])
            width.append(width[old] + times * size)
            above = upper[old]
            lower.append(old)
            upper.append(above)
            lower[above] = new  # some group is above: the one at hand at least
            upper[old] = new
        at = lower[at]
    return out


class Extensions:
    """Longest common extensions in a sequence, from names of all its blocks of 2^k values, equal for equal blocks."""

    def __init__(self, values: np.ndarray, longest: int) -> None:
        self.names = [np.unique(values, return_inverse=True)[1]]
        while 1 << len(self.names) <= longest:
            last, half = self.names[-1], 1 << (len(self.names) - 1)
            if len(last) <= half:
                break
            both = last[:-half].astype(np.int64) * (int(last.max()) + 1) + last[half:]
            self.names.append(np.unique(both, return_inverse=True)[1].astype(np.int32))

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many values from a on equal those from b on."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            x, y = a + out, b + out
            fits = (x < len(names)) & (y < len(names))
            same = names[np.where(fits, x, 0)] == names[np.where(fits, y, 0)]
            out += np.where(fits & same, 1 << k, 0)
        return out

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many values up to a, itself included, equal those up to b."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            x, y = a - out - (1 << k) + 1, b - out - (1 << k) + 1
            fits = (x >= 0) & (y >= 0)
            same = names[np.where(fits, x, 0)] == names[np.where(fits, y, 0)]
            out += np.where(fits & same, 1 << k, 0)
        return out


def _found(stretches: list[list[int]], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, start, length, period) of all runs of all stretches, sorted, each of which holds non-negative words."""
    sizes = np.array([len(s) for s in stretches])
    first = np.cumsum(sizes + 1) - sizes - 1
    # A value of its own ends each stretch, so that no extension passes it.
    whole = np.concatenate([np.append(np.array(s, np.int64), -1 - k) for k, s in enumerate(stretches)])
    place, period = [], []
    for sign in (1, -1):
        for s, at in zip(stretches, first.tolist(), strict=True):
            own = np.array(lyndon(s if sign == 1 else [-v for v in s]), np.int64)
            fits = np.flatnonzero(2 * own <= len(s))
            place.append(at + fits)
            period.append(own[fits])
    p, q = np.concatenate(place), np.concatenate(period)
    reach = Extensions(whole, int(sizes.max()))
    ahead = reach.right(p, p + q)
    back = np.where(p > 0, reach.left(np.maximum(p - 1, 0), np.maximum(p - 1, 0) + q), 0)
    start, length = p - back, back + q + ahead
    long = length >= np.maximum(least, 2 * q)
    start, length, q = np.unique(np.stack([start[long], length[long], q[long]]), axis=1)
    owner = np.searchsorted(first, start, "right") - 1
    order = np.lexsort((q, start))
    owner, start, length, q = (x[order] for x in (owner, start, length, q))
    return owner, start - first[owner], length, q


def _stretches(texts: list[bytes | None], gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the stretches of words that are covered by ``gram`` words in a row which occur twice in a text."""
    hashes, _, _, first = wordhash.words(texts)
    n = len(hashes)
    full = np.arange(n)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    full = full[full + gram <= first[owner + 1]]
    if not len(full):
        return full, full, full
    codes = wordhash.mix(wordhash.range_hashes(hashes, full, full + gram) ^ (owner[full].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(codes)
    same = codes[order[1:]] == codes[order[:-1]]
    twice = np.zeros(len(full), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, full[twice], 1)
    np.add.at(steps, full[twice] + gram, -1)
    covered = np.cumsum(steps[:-1]) > 0
    # Stretches of two texts that touch are apart.
    begins = covered.copy()
    begins[1:] &= ~covered[:-1]
    begins[first[:-1][first[:-1] < n]] |= covered[first[:-1][first[:-1] < n]]
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], n)
    stops = np.append(np.flatnonzero(~covered), n)
    ends = np.minimum(ends, stops[np.searchsorted(stops, starts)])
    text = owner[starts]
    return text, starts - first[text], ends - first[text]


def runs_of(texts: list[bytes | None], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    owner, starts, ends = _stretches(texts, max(1, least // 2))
    keep = ends - starts >= least
    owner, starts, ends = owner[keep], starts[keep], ends[keep]
    if not len(owner):
        return out
    held: list[list[int]] = []
    numbers: dict[bytes, int] = {}
    for text in np.unique(owner).tolist():
        words = texts[text].split()
        for s, e in zip(starts[owner == text].tolist(), ends[owner == text].tolist(), strict=True):
            held.append([numbers.setdefault(w, len(numbers)) for w in words[s:e]])
    for k, start, length, period in zip(*(x.tolist() for x in _found(held, least)), strict=True):
        out[owner[k]].append((int(starts[k]) + start, length, period))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


def find(df: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", least: int = LEAST) -> DataFrame:
    """``df`` with all runs of each whole text and with the text less their repeats (these replace columns of those names).

    Words are what ASCII white space separates, numbered from 0. A run is a stretch of words with smallest period q and a
    length of ``least`` (2 at least) and 2 q or more that no neighbouring word extends; ``runs`` has all of them by start, then
    period, so ties stand side by side. ``collapsed`` joins by one space the words that no run holds behind its first q words.
    Null and empty texts, and texts of white space only, have no runs and collapse to an empty text. Repeated rows stay, all
    other columns pass through; an empty table gives no rows. A text is taken whole within one task, whatever its length.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    rest = df.drop(runs, collapsed)
    schema = widened(rest, **{runs: RUNS, collapsed: "string"})
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, whole.num_columns - 1):
                texts = batch.column(batch.num_columns - 1).to_pylist()
                found = runs_of(texts, least)
                flat = np.array([r for own in found for r in own], np.int64).reshape(-1, 3)
                ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
                values = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(kind))
                short = pa.array([b" ".join(collapse((t or b"").split(), own)) for t, own in zip(texts, found, strict=True)], pa.binary())
                columns = [*batch.columns[:-1], pa.ListArray.from_arrays(ends, values), short.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], runs, collapsed])

    return map_batches(df.select(*(F.col(f"`{c}`") for c in rest.columns), utf8(f"`{text}`").alias(runs)), run, schema)
