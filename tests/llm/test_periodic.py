import random

import pytest

from labelmill.llm import periodic, queries


def smallest(words, least):
    """Every run, period by period."""
    found, seen = [], set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q) and (i, j - i + q) not in seen:
                seen.add((i, j - i + q))
                found.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def drawn(seed, number=300):
    draw = random.Random(seed)
    for _ in range(number):
        words = draw.choices("abcdefgh"[: draw.choice([1, 2, 3, 8])], k=draw.randint(0, 90))
        if words and draw.random() < 0.5:
            a = draw.randrange(len(words))
            p = draw.randint(1, len(words) - a)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
        yield words


def test_lyndon_array():
    draw = random.Random(1)
    for _ in range(800):
        values = draw.choices(range(draw.choice([1, 2, 5])), k=draw.randint(1, 40))
        want = []
        for i in range(len(values)):
            j = i + 1
            while j < len(values) and values[j:] > values[i:]:
                j += 1
            want.append(j - i)
        assert periodic.lyndon(values) == want


@pytest.mark.parametrize("least", [2, 5, 12])
def test_as_all_periods(least):
    texts = list(drawn(least))
    got = periodic.runs_of([" ".join(w).encode() for w in texts], least)
    assert got == [smallest(w, least) for w in texts]


def test_runs_end_with_their_text():
    a = ["x"] * 11
    assert periodic.runs_of([" ".join(a).encode()] * 3) == [[]] * 3
    assert periodic.runs_of([b"x " * 12, None, b"x " * 11, b"x " * 13]) == [[(0, 12, 1)], [], [], [(0, 13, 1)]]


def test_columns_and_edges(spark):
    tail = "one two three " + "a b " * 6 + "a end " + " ".join("pqrst") + " " + " ".join("pqrst") + " p q"
    long = "m n o " * 20_000
    rows = [(1, tail, "r", "c"), (1, tail, "r", "c"), (2, None, "r", "c"), (None, "", "r", "c"), (4, " \t\n", "r", "c"), (5, "A a " * 6, "r", "c"), (6, long, "r", "c")]
    df = spark.createDataFrame(rows, "id long, text string, runs string, _text string").repartition(3)
    got = periodic.find(df).collect()
    assert periodic.find(df).columns == ["id", "text", "_text", "runs", "collapsed"]
    by = {r["id"]: r for r in got}
    assert len(got) == 7 and by[2]["runs"] == [] and by[2]["collapsed"] == "" == by[4]["collapsed"] == by[None]["collapsed"]
    assert [tuple(r) for r in by[1]["runs"]] == [(3, 13, 2), (17, 12, 5)]
    assert by[1]["collapsed"] == "one two three a b end p q r s t"
    assert [tuple(r) for r in by[5]["runs"]] == [(0, 12, 2)] and by[5]["collapsed"] == "A a"
    assert [tuple(r) for r in by[6]["runs"]] == [(0, 60_000, 3)] and by[6]["collapsed"] == "m n o"
    assert periodic.find(df.limit(0)).collect() == []


def test_repeating_tails(spark):
    import zlib

    rows = [(i, " ".join(f"w{j}" for j in range(i % 37))) for i in range(300)] + [(None, "a b"), (-7, None)]
    for r in queries.with_tails(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        given = next(t for i, t in rows if i == r["doc_id"])
        words, code = (given or "").split(), zlib.crc32(str(r["doc_id"]).encode())
        if r["doc_id"] is not None and code % 10 == 0 and words:
            g, n = code // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert (r["text"] or "").split() == words
