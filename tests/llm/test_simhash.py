import random
import re

import numpy as np
import pytest
import xxhash

from labelmill.llm import simhash
from labelmill.llm.common import components


def plain(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(prints):
    """(id, fingerprint) pairs -> smallest id reachable, by comparing all pairs."""
    prints = list(prints)
    out, left = {}, set(range(len(prints)))
    for start in sorted(left, key=lambda i: prints[i][0]):
        if start in left:
            front, own = [start], prints[start][0]
            left.discard(start)
            while front:
                at = front.pop()
                out[prints[at][0]] = own
                near = [i for i in left if ((prints[i][1] ^ prints[at][1]) & (1 << 64) - 1).bit_count() <= 3]
                left.difference_update(near)
                front += near
    return out


@pytest.mark.parametrize("text", ["", None, " \t\n", "one", "One TWO", "a b c", "Ä É x y z ß", "w " * 500, "a b c d e f g A B C"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) % (1 << 64) == plain(text)


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(random.Random(1).choices(["aa", "bb", "cc", "dd"], k=1000))
    monkeypatch.setattr(simhash, "_BLOCK", 64)
    assert simhash.fingerprint(text.encode()) % (1 << 64) == plain(text)


def test_masks_cover():
    draw = random.Random(3)
    masks = simhash.masks()
    assert len(masks) == 15
    for _ in range(20_000):
        bits = sum(1 << b for b in draw.sample(range(64), draw.randint(0, 3)))
        assert any(not (m & bits) for m in masks)


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(-500, 500), draw.randrange(-500, 500)) for _ in range(420)] + [(1, 1), (2, 3), (3, 2)]
    edges += [(i, i + 1) for i in range(10_000, 10_200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    used = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in used}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("bucket", [2048, 4])
def test_every_link_is_found(spark, bucket):
    """Dense balls of fingerprints, so that buckets overflow when they hold four."""
    draw = random.Random(bucket)
    prints = set()
    for _ in range(12):
        centre = draw.getrandbits(64)
        for _ in range(40):
            prints.add(simhash.signed(centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 4)))))
    prints = sorted(prints)
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = components(simhash.links(nodes, bucket=bucket)).collect()
    got = {p: p for p in prints} | {r["node"]: r["root"] for r in found}
    assert got == classes((p, p) for p in prints)


def test_near_duplicates_against_all_pairs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    want = classes((r["doc_id"], plain(r["text"])) for r in rows)
    got = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert len(got) == len(rows) and len(set(want.values())) < len(rows)
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got} == {r["doc_id"]: plain(r["text"]) for r in rows}


def test_edges(spark, clash):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, "a b c d"), (3, "A B c D"), (3, "a b c d"), (None, "a b c d"), (7, None), (8, ""), (9, " \n"), (None, "x y z u v w"),
            (None, "X y z u v w"), (10, long), (11, long + " "), (12, "quite another text of its own")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(clash(rows)).collect()), key=str)
    want = [(5, 3), (3, 3), (3, 3), (None, 3), (7, 7), (8, 7), (9, 7), (None, None), (None, None), (10, 10), (11, 10), (12, 12)]
    assert got == sorted(want, key=str)
    kept = simhash.keep_one(clash(rows))
    assert kept.columns == clash(rows).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(map(str, [3, 7, None, 10, 12]))
    none = clash([]).where("doc_id > 0")
    assert simhash.near_duplicates(none).collect() == [] and simhash.keep_one(none).collect() == []


def test_forest_joins_all():
    fps = np.array([0, 1, 3, 7, 15, 255, 254, 1 << 40], np.int64)
    a, b = simhash._forest(fps, 3)
    groups = classes((int(x), int(x)) for x in fps)
    assert len(a) == len(fps) - len(set(groups.values()))
