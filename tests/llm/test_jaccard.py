import random
import re
from collections import Counter

import numpy as np
import pytest

from labelmill.llm import jaccard


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def brute(rows):
    sets, parent, holders = [plain(t) for _, t in rows], list(range(len(rows))), {}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j, both in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (own, _) in enumerate(rows):
        if own is not None:
            least[root(i)] = min(own, least.get(root(i), own))
    return Counter((own, len(sets[i]), least.get(root(i)) if sets[i] else own) for i, (own, _) in enumerate(rows))


def families(seed, number=45):
    draw, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(400)]
    for _ in range(number):
        base = draw.choices(words, k=draw.choice([3, 5, 9, 10, 12, 30, 80, 200, 600]))
        for _ in range(draw.choice([1, 2, 3, 12])):
            own = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 5])):
                own[draw.randrange(len(own))] = draw.choice(words)
            rows.append(" ".join(own[: max(1, len(own) - draw.choice([0, 0, draw.randint(0, len(own) // 8 + 1)]))]))
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_every_linked_pair_shares_a_part():
    """Over all sizes: sets that just link meet in the blocks of a band, and their coarse rows do not part them."""
    draw = np.random.default_rng(2)
    cuts = jaccard.bands(3000)
    for small in [*range(6, 60), 85, 100, 170, 171, 500, 1999]:
        for extra in (0, 1, small // 10, small * 15 // 85):
            both = draw.integers(0, 1 << 63, small).astype(np.uint64)
            more = draw.integers(0, 1 << 63, extra).astype(np.uint64)
            a, b = np.unique(both), np.unique(np.concatenate([both, more]))
            if 100 * len(a) < 85 * len(b) or len(a) == len(b):
                continue
            bands = [{int(np.searchsorted(cuts, len(s), "right")) - 1 + k for k in (0, 1)} for s in (a, b)]
            met = False
            for band in bands[0] & bands[1]:
                (p, x), (q, y) = (jaccard.signatures(s, band, int(cuts[band + 1] - 1)) for s in (a, b))
                if len(np.intersect1d(p, q)):
                    met = True
                    differ = (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()
                    assert differ <= jaccard.apart(len(a) + len(b))
            assert met


@pytest.mark.parametrize("small", [False, True])
def test_as_all_pairs(spark, monkeypatch, small):
    if small:  # blocks of rows and columns are cut, and blocks name a forest first
        for name, value in {"ROWS": 4, "NAMED": 0, "COLUMNS": 16}.items():
            monkeypatch.setattr(jaccard, name, value)
    rows = families(7 + small)
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(map(tuple, got)) == brute(rows)


def test_chain_of_links(spark):
    """Each text links with the next one only; the smallest id is in the middle."""
    words = [f"w{i}" for i in range(400)]
    rows = [(abs(i - 6) + (100 if i > 6 else 0), " ".join(words[7 * i : 7 * i + 130])) for i in range(13)]
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == brute(rows)
    assert {r["component_id"] for r in got} == {0}


def test_edges(spark, clash):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(5, base), (5, base), (3, base + " more"), (None, base.upper()), (7, None), (8, ""), (8, " \n"), (9, "a"), (2, "A"), (9, "b c"), (5, "unlike " * 4)]
    rows += [(None, "nobody knows this id at all"), (11, " ".join(f"v{i % 9001}" for i in range(50_000))), (10, " ".join(f"v{i % 9001}" for i in range(49_000)))]
    got = jaccard.similar(clash(rows)).collect()
    assert Counter(map(tuple, got)) == brute(rows)
    assert jaccard.similar(clash([(1, "x")]).limit(0)).collect() == []
