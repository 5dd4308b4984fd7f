"""SentencePiece encoding and decoding with N-best segmentation.

The pieces that fit a text span a lattice; a segmentation is a path, its score the sum of its pieces' scores. A forward Viterbi
pass gives the best score of every prefix. These are exact heuristics for an A-star search from the end of the text, which
therefore completes paths in order of their scores. As no piece holds a word mark after another character, the lattice falls
apart at word marks: best paths of all different words of a batch are found at once in numpy, and the N best of a text differ
from its best in the N - 1 words only whose second path costs least, so A-star runs over those.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from labelmill.llm import wordhash
from labelmill.llm.common import map_batches, pieces, widened

MARK = "▁"
#: What a character that no piece holds costs below the lowest score, as in the SentencePiece library.
UNKNOWN_COST = 10.0
_SLOTS = 18
#: Words of similar length are segmented together; longer ones than the last one by one.
_WIDTHS = (4, 6, 8, 10, 12, 16, 24, 64)
_AT_ONCE = 20_000
#: Bytes of text that are handled at a time, and words that are kept with their paths before all are forgotten.
_BYTES, _KEPT = 1_000_000, 200_000


class Vocabulary:
    """Pieces of a SentencePiece model, with tables to find many at once."""

    def __init__(self, table: list[tuple[str, float, str]]) -> None:
        self.pieces = [p for p, _, _ in table]
        self.kinds = [k for _, _, k in table]
        self.scores = np.array([s for _, s, _ in table] or [0.0])
        self.normal = {p: i for i, (p, _, kind) in enumerate(table) if kind == "normal"}
        if any(MARK in p.lstrip(MARK) for p in self.normal):
            raise ValueError("a piece holds a word mark after another character")
        self.longest = max(map(len, self.normal), default=1)
        self.unknown_score = min((table[i][1] for i in self.normal.values()), default=0.0) - UNKNOWN_COST
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == "unknown"), 0)
        own = {p: i for i, (p, _, kind) in enumerate(table) if kind == "byte"}
        self.bytes = [own.get(f"<0x{b:02X}>", -1) for b in range(256)]
        self.has_bytes = min(self.bytes) >= 0
        self.keys, self.ids = np.zeros(1 << _SLOTS, np.uint64), np.full(1 << _SLOTS, -1, np.int32)
        for piece, i in self.normal.items():
            key = self._key(np.array([[ord(c) for c in piece]], np.uint64))
            slot = int(self._slot(key)[0])
            while self.ids[slot] >= 0:
                slot = (slot + 1) % (1 << _SLOTS)
            self.keys[slot], self.ids[slot] = key[0], i

    @classmethod
    def of(cls, state: dict) -> Vocabulary:
        """A vocabulary from the attributes of another one, which are plain values that can be broadcast."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    @staticmethod
    def _step(keys: np.ndarray, points: np.ndarray) -> np.ndarray:
        return (keys + points + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    def _key(self, points: np.ndarray) -> np.ndarray:
        keys = np.zeros(len(points), np.uint64)
        for i in range(points.shape[1]):
            keys = self._step(keys, points[:, i])
        return keys

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (wordhash.mix(keys) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these keys, -1 where there is none."""
        slot = self._slot(keys)
        found = np.where(self.keys[slot] == keys, self.ids[slot], -1)
        rest = np.flatnonzero((found < 0) & (self.ids[slot] >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) % (1 << _SLOTS)
            hit = self.keys[slot[rest]] == keys[rest]
            found[rest[hit]] = self.ids[slot[rest[hit]]]
            rest = rest[~hit & (self.ids[slot[rest]] >= 0)]
        return found

    def spell(self, char: str) -> list[int]:
        """Ids of a character that is no piece: its bytes, or the unknown piece."""
        return [self.bytes[b] for b in char.encode("utf-8")] if self.has_bytes else [self.unknown]


def spelled(table: list[tuple[str, float, str]]) -> list[bytes]:
    """What each piece stands for in a decoded text."""
    joined = {"normal": lambda p: p.replace(MARK, " ").encode(), "byte": lambda p: bytes([int(p[3:5], 16)])}
    return [joined.get(k, lambda _: b"")(p) for p, _, k in table]


def lattice(vocab: Vocabulary, text: str) -> tuple[list[list[tuple[int, int, float]]], list[float]]:
    """(edges, forward): edges[j] holds (i, piece id or -1, score) for each piece text[i:j], forward[j] the best score of
    text[:j]."""
    edges: list[list[tuple[int, int, float]]] = [[]]
    forward = [0.0]
    for j in range(1, len(text) + 1):
        own = []
        for i in range(j - 1, max(-1, j - 1 - vocab.longest), -1):
            at = vocab.normal.get(text[i:j])
            if at is not None:
                own.append((i, at, float(vocab.scores[at])))
            elif i == j - 1:
                own.append((i, -1, vocab.unknown_score))
        edges.append(own)
        forward.append(max(forward[i] + s for i, _, s in own))
    return edges, forward


def n_best(vocab: Vocabulary, text: str, n: int) -> list[tuple[float, list[int]]]:
    """The ``n`` best segmentations of ``text`` (word marks in place), best first, by A-star from its end. Ties: the path with
    the shorter pieces at the end first."""
    edges, forward = lattice(vocab, text)
    out: list[tuple[float, list[int]]] = []
    count = 0
    queue: list[tuple[float, int, int, float, tuple | None]] = [(-forward[-1], 0, len(text), 0.0, None)]
    while queue and len(out) < n:
        _, _, at, score, path = heapq.heappop(queue)
        if at == 0:
            ids = []
            while path:
                (i, own), path = path
                ids += vocab.spell(text[i]) if own < 0 else [own]
            out.append((score, ids))
            continue
        for i, own, s in edges[at]:
            count += 1
            heapq.heappush(queue, (-(forward[i] + s + score), count, i, s + score, ((i, own), path)))
    return out


def _best(vocab: Vocabulary, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best paths of words, a row of code points each, filled up with zeros: (ids flat, number of each, best, second best score,
    whether a character needs several bytes). As paths run forward, what follows a word does not count."""
    n, length = points.shape
    keys = np.zeros((n, length), np.uint64)
    found: list[np.ndarray] = []
    for size in range(1, min(length, vocab.longest) + 1):
        keys = vocab._step(keys[:, : length - size + 1], points[:, size - 1 :].astype(np.uint64))
        found.append(vocab.find(keys.ravel()).reshape(keys.shape))
    single = found[0]
    none = single < 0
    spelled = np.array(vocab.bytes, np.int32)[np.minimum(points, 127)] if vocab.has_bytes else np.full(points.shape, vocab.unknown, np.int32)
    wide = (none & (points > 127)).any(axis=1) & vocab.has_bytes
    found[0] = np.where(none, spelled, single)
    best, second = np.full((length + 1, n), -np.inf), np.full((length + 1, n), -np.inf)
    best[0] = 0
    back, which = np.zeros((length + 1, n), np.int32), np.zeros((length + 1, n), np.int32)
    for j in range(1, length + 1):
        for size in range(1, min(j, vocab.longest) + 1):
            ids = found[size - 1][:, j - size]
            score = vocab.scores[ids]
            if size == 1:
                score = np.where(none[:, j - 1], vocab.unknown_score, score)
            else:
                score = np.where(ids < 0, -np.inf, score)
            first, next_one = best[j - size] + score, second[j - size] + score
            better = first > best[j]
            second[j] = np.maximum(np.maximum(second[j], next_one), np.minimum(first, best[j]))
            best[j] = np.where(better, first, best[j])
            back[j] = np.where(better, size, back[j])
            which[j] = np.where(better, ids, which[j])
    # Paths are walked from the end; every word takes a step as long as it is not at its start.
    at, steps, owners = lengths.copy(), [], []
    rows = every = np.arange(n)
    while len(rows):
        steps.append(which[at[rows], rows])
        owners.append(rows)
        at[rows] -= back[at[rows], rows]
        rows = rows[at[rows] > 0]
    owner, ids = np.concatenate(owners[::-1]), np.concatenate(steps[::-1])
    order = np.argsort(owner, kind="stable")
    return ids[order], np.bincount(owner, minlength=n), best[lengths, every], second[lengths, every], wide


class _Words(dict):
    """Numbers of words as they are met, and best paths of all of them: ids ``flat[start[w] : start[w] + size[w]]``, best score,
    cost of the second. Kept from batch to batch, as most words of a text are known from earlier ones."""

    def __init__(self, vocab: Vocabulary) -> None:
        super().__init__()
        self.vocab, self.names, self.paths = vocab, [], {}
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.best, self.gap, self.flat = np.zeros(0), np.zeros(0), np.zeros(0, np.int32)

    def __missing__(self, word: str) -> int:
        self[word] = found = len(self.names)
        self.names.append(MARK + word)
        return found

    def number(self, words: list[str]) -> np.ndarray:
        """The numbers of words, whose best paths are known from now on."""
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self.names) > len(self.size):
            self._learn(self.names[len(self.size) :])
        return out

    def _learn(self, words: list[str]) -> None:
        n, vocab = len(words), self.vocab
        size, top, gap, starts = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        parts, at = [self.flat], len(self.flat)
        lengths = np.fromiter(map(len, words), np.int64, n)
        slow = np.flatnonzero(lengths > _WIDTHS[-1]).tolist()
        for least, width in zip((0, *_WIDTHS), _WIDTHS, strict=False):
            own = np.flatnonzero((lengths > least) & (lengths <= width))
            for lo in range(0, len(own), _AT_ONCE):
                rows = own[lo : lo + _AT_ONCE]
                text = "".join([words[i] for i in rows.tolist()])
                points = np.zeros((len(rows), width), np.uint32)
                points[np.arange(width) < lengths[rows, None]] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                ids, sizes, best, second, wide = _best(vocab, points, lengths[rows])
                size[rows], top[rows], gap[rows] = sizes, best, best - second
                starts[rows] = at + np.cumsum(sizes) - sizes
                parts.append(ids.astype(np.int32))
                at += len(ids)
                slow += rows[wide].tolist()
        for i in slow:
            found = n_best(vocab, words[i], 2)
            size[i], top[i] = len(found[0][1]), found[0][0]
            gap[i] = found[0][0] - found[1][0] if len(found) > 1 else np.inf
            starts[i] = at
            parts.append(np.array(found[0][1], np.int32))
            at += len(found[0][1])
        self.flat = np.concatenate(parts)
        self.start, self.size = np.concatenate([self.start, starts]), np.concatenate([self.size, size])
        self.best, self.gap = np.concatenate([self.best, top]), np.concatenate([self.gap, gap])

    def ids(self, words: np.ndarray) -> np.ndarray:
        """The ids of a sequence of words, one after the other."""
        size = self.size[words]
        before = np.cumsum(size) - size
        return self.flat[np.repeat(self.start[words] - before, size) + np.arange(size.sum())]

    def others(self, word: int, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best paths of one word; the one in ``flat`` leads, also where others have the same score."""
        if (word, n) not in self.paths:
            found, start = n_best(self.vocab, self.names[word], n), self.start[word]
            lead = self.flat[start : start + self.size[word]].tolist()
            self.paths[word, n] = [(found[0][0], lead), *[p for p in found if p[1] != lead][: n - 1]]
        return self.paths[word, n]


def split(text: str) -> list[str]:
    """The words of a text without their first mark: "a b" -> ["a", "b"], a run of blanks stays with the word after it."""
    if "  " in text or MARK in text or text[:1] == " ":
        return [w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]
    return text.split(" ")


def _alternatives(known: _Words, words: np.ndarray, ids: np.ndarray, n: int) -> list[tuple[float, np.ndarray]]:
    """The second to ``n``-th best segmentation of a text, whose best one is ``ids``."""
    gaps = known.gap[words]
    near = np.argsort(gaps, kind="stable")[: n - 1] if len(gaps) <= n else np.sort(np.argpartition(gaps, n - 1)[:n])
    near = [int(i) for i in near if np.isfinite(gaps[i])]
    choices = [known.others(int(words[i]), n) for i in near]
    total = float(known.best[words].sum())
    start = (0,) * len(near)
    queue, seen, out = [(0.0, start)], {start}, []
    while queue and len(out) < n:
        loss, picks = heapq.heappop(queue)
        out.append((loss, picks))
        for k, pick in enumerate(picks):
            more = (*picks[:k], pick + 1, *picks[k + 1 :])
            if pick + 1 < len(choices[k]) and more not in seen:
                seen.add(more)
                cost = sum(c[0][0] - c[p][0] for c, p in zip(choices, more, strict=True))
                heapq.heappush(queue, (cost, more))
    ends = np.cumsum(known.size[words])
    result = []
    for loss, picks in out[1:]:
        changed = sorted((i, choices[k][p][1]) for k, (i, p) in enumerate(zip(near, picks, strict=True)) if p)
        parts, last = [], 0
        for i, own in changed:
            parts += [ids[last : ends[i] - known.size[words[i]]], np.array(own, np.int32)]
            last = ends[i]
        result.append((total - loss, np.concatenate([*parts, ids[last:]])))
    return result


def _listed(others: list[list[tuple[float, np.ndarray]]]) -> pa.Array:
    """Alternatives as an array of lists of (score, ids)."""
    flat = [x for own in others for x in own]
    ends = lambda sizes: pa.array(np.cumsum([0, *sizes]), pa.int32())
    ids = pa.array(np.concatenate([np.zeros(0, np.int32), *(x for _, x in flat)]), pa.int32())
    ids = pa.ListArray.from_arrays(ends(len(x) for _, x in flat), ids)
    kind = pa.StructArray.from_arrays([pa.array([s for s, _ in flat], pa.float64()), ids], ["score", "ids"])
    return pa.ListArray.from_arrays(ends(map(len, others)), kind)


def load(path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) of a SentencePiece model file, read on the driver; its size is that of the vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = " a  Bé\nÅ "
    if model.normalize(probe) != MARK + probe.replace(" ", MARK):
        raise ValueError("only models that leave texts as they are, but for word marks, are supported")
    kind = lambda i: (
        "byte" if model.is_byte(i) else "unknown" if model.is_unknown(i) else "control" if model.is_control(i) or model.is_unused(i) else "normal"
    )
    return [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.vocab_size())]


def _with_input(df: DataFrame, rest: DataFrame, column: str) -> tuple[DataFrame, int, int]:
    """(table, place of ``column``, number of columns of ``rest``): ``rest`` as it is, or with ``column`` behind it where it was
    dropped from ``df``."""
    width = len(rest.columns)
    if column in rest.columns:
        return rest, rest.columns.index(column), width
    return df.select(*(F.col(f"`{c}`") for c in rest.columns), F.col(f"`{column}`").alias("_input")), width, width


def _encoder(held: Broadcast, place: int, width: int, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with ids, score and alternatives of the texts in column ``place`` behind the first ``width`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary.of(held.value)
        known = _Words(vocab)
        for whole in batches:
            for batch in pieces(whole, place, _BYTES):
                if len(known) > _KEPT or len(known.flat) > 16 * _KEPT:
                    known = _Words(vocab)
                texts = batch.column(place).to_pylist()
                split_texts = [split(t) if t else [] for t in texts]
                words = known.number(list(chain.from_iterable(split_texts)))
                ends = np.cumsum([0, *map(len, split_texts)])
                del split_texts
                sizes = np.concatenate([[0], np.cumsum(known.size[words])])[ends]
                spans = list(zip(ends.tolist(), ends[1:].tolist(), strict=False))
                scores = [float(known.best[words[a:b]].sum()) for a, b in spans]
                missing = [t is None for t in texts]
                flat = known.ids(words)
                ids = pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32), mask=np.array([*missing, False])), pa.array(flat, pa.int32()))
                others = [
                    _alternatives(known, words[a:b], flat[sizes[i] : sizes[i + 1]], n) if n > 1 and b > a else []
                    for i, (a, b) in enumerate(spans)
                ]
                columns = [ids, pa.array(scores, pa.float64(), mask=np.array(missing)), _listed(others)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *columns], [*batch.schema.names[:width], "ids", "score", "alternatives"])

    return run


def encode(df: DataFrame, model: str | list[tuple[str, float, str]], text: str = "text", n: int = 1) -> DataFrame:
    """``df`` with ``ids`` (array<int>: the best segmentation of the whole text), ``score`` (double) and ``alternatives``
    (array<struct<score, ids>>: the second to ``n``-th best, best first, fewer if there are no more).

    ``model`` is a model file's path or the table that ``load`` gives. Of equal scores any may lead, always the same one. A null
    text has null ids and score, an empty one no ids and score 0; both have no alternatives. Columns named like the new ones are
    replaced. Texts are handled one batch of bytes at a time, a very long one alone.
    """
    held = df.sparkSession.sparkContext.broadcast(vars(Vocabulary(load(model) if isinstance(model, str) else model)))
    rest = df.drop("ids", "score", "alternatives")
    schema = widened(rest, ids="array<int>", score="double", alternatives="array<struct<score:double,ids:array<int>>>")
    given, place, width = _with_input(df, rest, text)

    return map_batches(given, _encoder(held, place, width, n), schema)


def _spell(words: list[bytes], ids: pa.ListScalar) -> str | None:
    if not ids.is_valid:
        return None
    numbers = np.asarray(ids.values)
    if len(numbers) and numbers.min() < 0:
        raise ValueError("negative id")
    return b"".join(map(words.__getitem__, numbers.tolist())).decode("utf-8", "replace").removeprefix(" ")


def decode(df: DataFrame, model: str | list[tuple[str, float, str]], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text that ``ids`` spell in ``out``: word marks become blanks, the first of which was added before the
    text, byte pieces are joined as UTF-8 (a broken sequence gives the replacement character), control pieces give nothing.
    Null ids give null, none an empty text; an id outside the vocabulary is an error."""
    held = df.sparkSession.sparkContext.broadcast(spelled(load(model) if isinstance(model, str) else model))
    rest = df.drop(out)
    schema = widened(rest, **{out: "string"})
    given, place, width = _with_input(df, rest, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held.value
        for whole in batches:
            for batch in pieces(whole, place, _BYTES // 4):
                texts = [_spell(words, own) for own in batch.column(place)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(texts, pa.string())], schema.names)

    return map_batches(given, run, schema)


def encode_checked(df: DataFrame, model: str | list[tuple[str, float, str]], text: str = "text", n: int = 1) -> DataFrame:
    """``encode``, with ``round_trip`` (boolean: whether the ids spell the text again; a null text does) in place of the text, in
    one pass of one worker a task. Columns named like the new ones are replaced; other cases are those of ``encode``."""
    pairs = load(model) if isinstance(model, str) else model
    context = df.sparkSession.sparkContext
    held, spelling = context.broadcast(vars(Vocabulary(pairs))), context.broadcast(spelled(pairs))
    rest = df.drop(text, "ids", "score", "alternatives", "round_trip")
    schema = widened(rest, ids="array<int>", score="double", alternatives="array<struct<score:double,ids:array<int>>>", round_trip="boolean")
    given, place, width = _with_input(df, rest, text)
    # The text goes along behind the other columns until its ids are decoded.
    encoded = _encoder(held, place, width + 1, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = spelling.value
        for batch in encoded(batches):
            same = [_spell(words, ids) == own.as_py() for ids, own in zip(batch.column(width + 1), batch.column(width), strict=True)]
            columns = [*batch.columns[:width], *batch.columns[width + 1 :], pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return map_batches(given, run, schema)
