import math
import zlib

import numpy as np

from labelmill.llm import langid, queries


def test_held_out_accuracy(spark, folder):
    out = queries.queries()["op10_naive_bayes_language"](spark, folder).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(out) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)


def slow_grams(text):
    folded = "".join(c if c.isalpha() else " " for c in text.lower())
    folded = " " + " ".join(folded.split()) + " "
    return [folded[i : i + n] for n in langid.ORDERS for i in range(len(folded) - n + 1) if folded[i : i + n].strip()]


def test_grams_match_the_definition():
    texts = ["Hello, wörld", "", "a", "12 x 9", "𝔸bc  d", "...", "end\nof line"]
    found, owner, letters = langid.grams(texts, langid._Letters())
    for i, text in enumerate(texts):
        alone, _, _ = langid.grams([text], langid._Letters())
        assert sorted(found[owner == i]) == sorted(alone)
        assert len(alone) == len(slow_grams(text)), text
        assert letters[i] == sum(c.isalpha() for c in text.lower())


def test_weights_and_scores(spark):
    rows = [("aa bb", "x"), ("ab ab", "x"), ("cc dd cd", "y"), (None, "y"), ("zz", None), ("aa", "x")]
    df = spark.createDataFrame(rows, "text string, lang string")
    model = langid.fit(df)
    assert model["languages"] == ["x", "y"]
    counts = np.full((langid.BUCKETS, 2), langid.SMOOTHING)
    for text, lang in rows:
        if text and lang:
            np.add.at(counts[:, model["languages"].index(lang)], langid.grams([text], langid._Letters())[0], 1)
    assert np.allclose(model["weights"], np.log(counts / counts.sum(axis=0)))
    got = {r["text"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, model).collect()}
    sums = model["weights"][langid.grams(["aa bb"], langid._Letters())[0]].sum(axis=0)
    assert got["aa bb"][0] == "x" and math.isclose(got["aa bb"][1], 1 / (1 + math.exp(sums[1] - sums[0])), rel_tol=1e-9)
    assert got["cc dd cd"][0] == "y" and got[None] == ("und", 0.0)


def test_edges(spark, clash):
    long = "abcd efgh " * 20_000
    df = clash([(1, "abc"), (1, "abc"), (None, None), (2, ""), (3, "12 !?"), (4, long)])
    model = {"languages": [], "weights": np.zeros((langid.BUCKETS, 0))}
    assert {r["lang_pred"] for r in langid.predict(df, model).collect()} == {"und"}
    train = spark.createDataFrame([("abcd", "x", 5), ("wxyz", "y", 5)], "text string, lang string, draw int")
    out = langid.predict(df, langid.fit(train))
    assert out.columns == [*[c for c in df.columns if c != "score"], "lang_pred", "score"]
    got = sorted(((r["doc_id"], r["lang_pred"]) for r in out.collect()), key=str)
    assert got == sorted([(1, "x"), (1, "x"), (None, "und"), (2, "und"), (3, "und"), (4, "x")], key=str)
    empty = langid.fit(train.where("lang is null"))
    assert empty["languages"] == [] and langid.predict(clash([]), empty).collect() == []


def test_bounded_sample(spark):
    rows = [(f"text number {i} of many", "x" if i % 10 else "y") for i in range(3000)]
    df = spark.createDataFrame(rows, "text string, lang string")
    whole, part = langid.fit(df), langid.fit(df, per_language=100)
    grams = langid.grams(["text"], langid._Letters())[0]
    assert part["languages"] == whole["languages"] == ["x", "y"]
    assert np.isfinite(part["weights"][grams]).all() and not np.allclose(part["weights"], whole["weights"])
