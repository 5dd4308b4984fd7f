import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.llm import queries, transcripts
from labelmill.llm.common import table


def test_roles_of_held_out_conversations(spark, folder):
    turns = table(spark, folder, "conversations")
    truth = {}
    for r in turns.orderBy("conv_id", "turn").collect():
        truth.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    lines = queries.marked(turns)
    model = transcripts.fit(lines.where("conv_id % 2 = 0"), "conv_id", "turn", "line", "role")
    out = transcripts.render(transcripts.parse(lines, model, "conv_id", "turn", "line")).collect()
    assert sorted(r["key"] for r in out) == sorted(truth)
    held = [r for r in out if r["key"] % 2]
    right = [r["roles"] == [role for role, _ in truth[r["key"]]] for r in held]
    assert sum(right) >= 0.95 * len(right)
    want = "".join
    for r in out:
        if r["roles"] == [role for role, _ in truth[r["key"]]]:
            assert r["rendered"] == want(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in truth[r["key"]])


@pytest.fixture(scope="module")
def model():
    draw = np.random.default_rng(1)
    move, emit = draw.random((7, 7)), draw.random((7, int(np.prod(transcripts.FEATURES))))
    move[:, 6] = 0
    with np.errstate(divide="ignore"):
        return {"move": np.log(move / move.sum(axis=1, keepdims=True)), "emit": np.log(emit / emit.sum(axis=1, keepdims=True))}


def test_walk_against_all_ways(model):
    draw = random.Random(3)
    for _ in range(5):
        codes = [draw.randrange(model["emit"].shape[1]) for _ in range(5)]
        steps = [transcripts._step(model, c) for c in codes]
        score = lambda way: sum(s[a, b] for s, a, b in zip(steps, (6, *way), way))
        best = max(itertools.product(range(6), repeat=5), key=score)
        assert transcripts._walk(steps, 6, None) == list(best)
        fixed = max((w for w in itertools.product(range(6), repeat=5) if w[-1] == 2), key=score)
        assert transcripts._walk(steps, 6, 2) == list(fixed)
        assert transcripts._product(steps)[6, 2] == pytest.approx(score(fixed))


@pytest.mark.parametrize("span,fan", [(5, 256), (3, 2), (100_000, 256)])
def test_parts_change_nothing(spark, model, monkeypatch, span, fan):
    """A long transcript in one part, in several, and in several levels of parts, has the same states."""
    draw = random.Random(7)
    rows = [(k, i, draw.choice(["User: hi?", "AI: " + "x" * 50, "- so", "plain", "", "y " * 99])) for k in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, text string")
    monkeypatch.setattr(transcripts, "FAN", fan)
    out = transcripts.parse(df, model, "conv_id", "turn", "text", span=span).orderBy("key", "part").collect()
    kind = lambda t: {"U": 2, "A": 3, "-": 4}.get(t[:1], 0)
    for k in (1, 2):
        own = [t for c, _, t in rows if c == k]
        codes = []
        for i, t in enumerate(own):
            place = 0 if i == 0 else 1 if own[i - 1].strip() == "" else 2
            size = 0 if not t else 1 if len(t) < 40 else 2 if len(t) < 120 else 3 if len(t) < 300 else 4
            codes.append(((kind(t) * 3 + place) * 5 + size) * 2 + t.rstrip().endswith("?"))
        states = transcripts._walk([transcripts._step(model, c) for c in codes], 6, None)
        got = [(x["role"], x["opens"]) for r in out if r["key"] == k for x in r["lines"]]
        assert got == [(transcripts.ROLES[s // 2], s % 2 == 0) for s in states]


def test_markers(one):
    for line, kind, rest in [("User: a: b", 2, "a: b"), ("### Human: x", 2, "x"), ("[sys] y", 1, "y"), ("<bot> z", 3, "z"), ("- w", 4, "w"),
                             ("Note: v", 0, "Note: v"), ("a plain line", 0, "a plain line"), ("A: b", 3, "b"), ("", 0, "")]:
        assert one(transcripts.marker(F.col("x")), x=line) == kind, line
        assert one(transcripts.body(F.col("x")), x=line) == rest, line


def test_edges(spark):
    rows = [(1, 0, "User: a", "user", "z"), (1, 1, "AI: b\nc", "assistant", "z"), (1, 1, "AI: b\nc", "assistant", "z"), (None, 0, "User: q", "user", "z"), (2, None, None, None, "z"),
            (3, 0, "User: " + "long " * 50_000, "user", "z"), (4, 0, "", "other", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, role string, part string")
    model = transcripts.fit(df, "conv_id", "turn", "text", "role")
    out = {r["key"]: r for r in transcripts.render(transcripts.parse(df, model, "conv_id", "turn", "text")).collect()}
    assert set(out) == {1, None, 2, 3, 4}
    assert out[1]["rendered"] == "<|im_start|>user\na<|im_end|>\n" + 2 * "<|im_start|>assistant\nb\nc<|im_end|>\n"
    assert out[None]["roles"] == ["user"] and len(out[3]["rendered"]) > 250_000
    empty = transcripts.fit(df.where("conv_id = 9"), "conv_id", "turn", "text", "role")
    assert np.isfinite(empty["move"][:, :6]).all()
    assert transcripts.render(transcripts.parse(df.where("conv_id = 9"), empty, "conv_id", "turn", "text")).collect() == []


def test_numbering_changes_nothing(spark):
    """Turns numbered 0, 1, 2 and 0, 1,000,000, 2,000,000, and any span, give the same tables and the same lines."""
    draw = random.Random(11)
    rows = [(k, i, draw.choice(["User: hi?", "AI: fine\n", "- so\n\nmore", "plain", ""]), draw.choice(["user", "assistant"])) for k in range(12) for i in range(draw.randint(1, 23))]
    seen = []
    for step, span in ((1, 4096), (1_000_000, 4096), (7, 3), (10**15, 4)):
        df = spark.createDataFrame([(k, step * i, t, r) for k, i, t, r in rows], "conv_id int, turn long, text string, role string").repartition(5)
        model = transcripts.fit(df, "conv_id", "turn", "text", "role", span=span)
        found = transcripts.parse(df, model, "conv_id", "turn", "text", span=span).orderBy("key", "part").collect()
        lines = {}
        for r in found:
            assert len(r["lines"]) <= span * 3
            lines.setdefault(r["key"], []).extend(tuple(x) for x in r["lines"])
        seen.append((np.round(model["move"][:, :6], 12).tolist(), np.round(model["emit"], 12).tolist(), lines))
    assert all(s == seen[0] for s in seen[1:])


def test_many_rows_of_one_order(spark):
    df = spark.createDataFrame([(1, None, "same")] * 50 + [(1, 3, f"t{i}") for i in range(50)], "conv_id int, turn long, text string")
    cut = transcripts.parts(df, "conv_id", "turn", "text", span=8).collect()
    assert sorted(len(r["rows"]) for r in cut) == [4] + [8] * 12
