import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from labelmill.functions import text as tx

SENTIMENTS = ["positive", "negative", "neutral"]
TOKENS = re.compile(r"\w+|[^\w\s]")


def plain_count(value):
    return len(re.findall(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]", value))


def plain_paragraphs(value, limit, separator="\n\n"):
    done, open_, size = [], "", 0
    for piece in value.split(separator):
        k = plain_count(piece)
        if k + size <= limit:
            open_, size = open_ + separator + piece, size + k
        else:
            if open_:
                done.append(open_.strip())
            open_, size = piece, k
    return done + [open_.strip()] if open_ else done


def plain_sentences(value, limit):
    done, open_, size = [], "", 0
    for piece in re.split(r"(?<=[.!?])\s+", value):
        k = plain_count(piece)
        if k + size <= limit:
            open_, size = open_ + piece, size + k
        else:
            done.append(open_)
            open_, size = piece, k
    return done + [open_] if open_ else done


@pytest.mark.parametrize(
    "value, expected",
    [
        ("@a hi @b_c!", "@user hi @user"), ("mail x@y.z", "mail x@user"), ("lone @ here", "lone @ here"),
        ("@a b", "@user b"), ("no sign", "no sign"), ("@@x", "@user"), (None, None), ("", ""),
    ],
)
def test_mask_mentions(one, value, expected):
    assert one(tx.mask_mentions(F.col("t").cast("string")), t=value) == expected
    if value is not None:
        assert re.sub(r"@\S+", "@user", value) == expected


@pytest.mark.parametrize("value, count", [("a b, c.", 5), ("", 0), (" \n\t", 0), ("snake_case 12!", 3), (None, 0), ("é ü", 2)])
def test_token_count(one, value, count):
    assert one(tx.token_count(F.col("t").cast("string")), t=value) == count


def test_is_lengthy(one):
    assert one(tx.is_lengthy(F.col("t"), 3), t="a b c") == 0
    assert one(tx.is_lengthy(F.col("t"), 3), t="a b c d") == 1
    assert one(tx.is_lengthy(F.col("t").cast("string"), 0), t=None) == 0


@pytest.mark.parametrize(
    "value, word, whitespace, bare",
    [
        ('Answer: "Positive".', "positive", "positive", None),
        ("**neutral** negative", "neutral", "neutral", "negative"),
        ("positive> = positive", "positive", "positive", "positive"),
        ("un-positive ok", "positive", None, None),
        ("positively so", None, None, None),
        ("nothing", None, None, None),
        ("", None, None, None),
        (None, None, None, None),
        ("NEUTRAL x", "neutral", "neutral", "neutral"),
        ("(negative)positive", "negative", None, None),
    ],
)
def test_first_label(one, value, word, whitespace, bare):
    column = F.col("t").cast("string")
    assert one(tx.first_label(column, SENTIMENTS), t=value) == word
    assert one(tx.first_label(column, SENTIMENTS, "whitespace"), t=value) == whitespace
    assert one(tx.first_label(column, SENTIMENTS, "whitespace", False), t=value) == bare


def test_first_label_with_longer_and_odd_labels(one):
    assert one(tx.first_label(F.col("t"), ["joy", "joyful"]), t="so joyful") == "joyful"
    assert one(tx.first_label(F.col("t"), ["n/a"]), t="n/a") == "n/a"
    assert one(tx.first_label(F.col("t"), ["positive", "very_positive"]), t="a very_positive text") == "very_positive"
    assert one(tx.first_label(F.col("t"), ["very_positive"]), t="a positive text") is None
    assert one(tx.first_label(F.col("t"), ["n/a"], "whitespace"), t="(n/a)") == "n/a"
    for mode in ("word", "whitespace"):
        with pytest.raises(ValueError):
            tx.first_label(F.col("t"), ["joy", "two words"], mode)
    with pytest.raises(ValueError):
        tx.first_label(F.col("t"), ["(joy)"], "whitespace")
    with pytest.raises(ValueError):
        tx.first_label(F.col("t"), SENTIMENTS, "fuzzy")


def test_label_by_substring(one):
    assert one(tx.label_by_substring(F.col("t")), t="negative or positive") == "positive"
    assert one(tx.label_by_substring(F.col("t")), t="Positive") == "none"


def test_strip_echo(one):
    assert one(tx.strip_echo(F.col("t"), "="), t="a = b = c") == " c"
    assert one(tx.strip_echo(F.col("t"), "#"), t="abc") == "abc"
    assert one(tx.strip_echo(F.col("t"), F.col("p")), t="say: yes", p="say:") == " yes"
    assert one(tx.strip_echo(F.col("t"), F.col("p")), t="abc", p="") == "abc"


@pytest.mark.parametrize(
    "value, expected",
    [
        ("a b\n\nc d", ["a b\n\nc d"]),
        ("a b\n\nc d e", ["a b", "c d e"]),
        ("a b c d e f\n\ng", ["a b c d e f", "g"]),
        ("a\n\nb c d e f\n\ng", ["a", "b c d e f", "g"]),
        ("a\n\nb c d e f", ["a", "b c d e f"]),
        ("a\n\n\n\nb", ["a\n\n\n\nb"]),
        ("", [""]),
        (" \n ", [""]),
        ("no separator", ["no separator"]),
    ],
)
def test_pack_paragraphs(one, value, expected):
    assert one(tx.pack_paragraphs(F.col("t"), 4), t=value) == expected == plain_paragraphs(value, 4)


def test_long_texts_are_packed_across_blocks(spark, one):
    value = "\n\n".join("w " * (i % 7) + "end." for i in range(2000))
    assert one(tx.pack_paragraphs(F.col("t"), 9), t=value) == plain_paragraphs(value, 9)
    assert one(tx.pack_sentences(F.col("t"), 9), t=value) == plain_sentences(value, 9)
    assert one(tx.pack_paragraphs(F.col("t").cast("string")), t=None) is None


def test_pack_sentences(one):
    value = "One two three four. Five. Six seven! Eight?"
    assert one(tx.pack_sentences(F.col("t"), 5), t=value) == ["One two three four.", "Five.Six seven!", "Eight?"]
    assert one(tx.pack_sentences(F.col("t"), 3), t="a b c d. e.") == ["a b c d.", "e."]
    assert one(tx.pack_sentences(F.col("t"), 3, keep_empty=True), t="a b c d. e.") == ["", "a b c d.", "e."]
    assert plain_sentences("a b c d. e.", 3) == ["", "a b c d.", "e."]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab .!\n", max_size=60), min_size=1, max_size=20), st.integers(1, 6))
def test_packing_equals_the_plain_loops(spark, values, limit):
    df = spark.createDataFrame([(value,) for value in values], "t string")
    rows = df.select(
        "t", tx.pack_paragraphs(F.col("t"), limit).alias("p"), tx.pack_sentences(F.col("t"), limit, True).alias("s")
    ).collect()
    for row in rows:
        assert row["p"] == plain_paragraphs(row["t"], limit)
        assert row["s"] == plain_sentences(row["t"], limit)
        assert all(plain_count(part) <= limit or "\n\n" not in part for part in row["p"])


def test_separator_counts_and_does_not_lead(one):
    for value, limit, want in [("a. b. c. d. e", 5, ["a. b. c", "d. e"]), ("a. b", 2, ["a", "b"]), ("a. b", 3, ["a. b"]), ("a b c. d", 2, ["a b c", "d"]), ("", 5, [""])]:
        got = one(tx.pack_paragraphs(F.col("t"), limit, ". "), t=value)
        assert got == want
        assert all(one(tx.token_count(F.col("t")), t=part) <= limit for part in got if ". " in part)
