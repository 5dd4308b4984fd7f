"""Hashes of all words of a batch of texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, of: int) -> np.ndarray:
    out = np.full(n, of, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[s:e] for each s, e: a polynomial modulo 2^64, from running sums."""
    n = len(values) + 1
    sums = np.zeros(n, np.uint64)
    np.cumsum(values * powers(n - 1, _BASE), dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(n, _INVERSE)[starts])


def words(texts: list[bytes | None], separators: np.ndarray = _SPACE, prefix: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first) of the words of UTF-8 texts, A-Z folded to lower case.

    Words are runs of other bytes than ``separators`` (ASCII white space), which must hold the line break; of longer ones only
    the first ``prefix`` bytes are hashed, if that is not 0; ``starts`` and ``ends`` are byte places in the texts joined by one
    line break, ``first`` holds the index of each text's first word, and the number of words at last.
    """
    whole = np.frombuffer(b"\n".join(x or b"" for x in texts).lower() + b"\n", np.uint8)
    space = separators[whole]
    before = np.ones(len(space), bool)
    before[1:] = space[:-1]
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(~before & space)
    stops = np.minimum(ends, starts + prefix) if prefix else ends
    hashes = range_hashes(whole.astype(np.uint64) + np.uint64(1), starts, stops)
    offsets = np.cumsum([0, *(len(x or b"") + 1 for x in texts)])
    return hashes, starts, ends, np.searchsorted(starts, offsets)
