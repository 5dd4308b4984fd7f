"""Text expressions: masking, token counts, packing under a token limit, and reading labels out of answers."""

from __future__ import annotations

import re
import string
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The characters Python strips as white space and counts as ASCII punctuation.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
PUNCTUATION = string.punctuation

MENTION = r"(?U)@[^\s\x1c-\x1f]+"
SPACES = r"(?U)[\s\x1c-\x1f]+"
TOKEN = r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
BLOCK_PIECES = 256
SENTENCE_GAP = r"(?U)(?<=[.!?])\s+"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def mask_mentions(text: Column, replacement: str = "@user") -> Column:
    # Texts without the sign are passed on as they are instead of being decoded for the pattern.
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, MENTION, replacement)).otherwise(text)


def token_count(text: Column) -> Column:
    """Words plus single punctuation marks; null text counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def is_lengthy(text: Column, limit: int = 100) -> Column:
    return (token_count(text) > limit).cast("int")


def _pack(pieces: Column, limit: int, glue: str, lead: bool, keep_empty_head: bool, trim: bool) -> Column:
    """Left fold that opens a new segment whenever the next piece would pass the limit.

    Every step of a fold copies its state, so the pieces are folded block by block: the finished segments of a long text
    are copied once per block, not once per piece.
    """
    finish = strip if trim else (lambda segment: segment)
    sized = F.transform(pieces, lambda piece: F.struct(piece.alias("text"), token_count(piece).alias("size")))
    empty = F.expr("cast(array() as array<string>)")
    # No segment is open at first; with a separator between pieces, an empty one is not the same.
    none = F.lit(None).cast("string") if lead else F.lit("")
    start = F.struct(empty.alias("done"), none.alias("open"), F.lit(0).cast("long").alias("size"))
    closed = (lambda open_: open_.isNull()) if lead else (lambda open_: open_ == "")
    between = token_count(F.lit(glue))

    def cut(whole: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / BLOCK_PIECES).cast("int"))
        return F.transform(numbers, lambda number: F.slice(whole, number * BLOCK_PIECES + 1, BLOCK_PIECES))

    # The one-element array binds the sized pieces to a name, so they are counted once.
    blocks = F.get(F.transform(F.array(sized), cut), F.lit(0))

    def step(state: Column, piece: Column) -> Column:
        new = state["size"] + piece["size"]
        if lead:
            new = F.when(closed(state["open"]), piece["size"]).otherwise(new + between)
        fits = new <= limit
        idle = fits if keep_empty_head else fits | closed(state["open"])
        joined = F.concat(state["open"], F.lit(glue), piece["text"])
        if lead:
            joined = F.when(closed(state["open"]), piece["text"]).otherwise(joined)
        return F.struct(
            F.when(idle, state["done"]).otherwise(F.concat(state["done"], F.array(finish(state["open"])))).alias("done"),
            F.when(fits, joined).otherwise(piece["text"]).alias("open"),
            F.when(fits, new).otherwise(piece["size"]).alias("size"),
        )

    def fold_block(state: Column, block: Column) -> Column:
        carried = F.struct(empty.alias("done"), state["open"].alias("open"), state["size"].alias("size"))
        return F.aggregate(
            block,
            carried,
            step,
            lambda inner: F.struct(
                F.concat(state["done"], inner["done"]).alias("done"), inner["open"].alias("open"), inner["size"].alias("size")
            ),
        )

    def close(state: Column) -> Column:
        return F.when(closed(state["open"]), state["done"]).otherwise(
            F.concat(state["done"], F.array(finish(state["open"])))
        )

    return F.aggregate(blocks, start, fold_block, close)


def pack_paragraphs(text: Column, limit: int = 100, separator: str = "\n\n") -> Column:
    """Segments of whole paragraphs with at most ``limit`` tokens, those of the separators between them included; a longer
    paragraph stands alone."""
    pieces = F.split(text, re.escape(separator), -1)
    return _pack(pieces, limit, separator, lead=True, keep_empty_head=False, trim=True)


def pack_sentences(text: Column, limit: int = 100, keep_empty: bool = False) -> Column:
    """Segments of whole sentences joined without a gap; ``keep_empty`` keeps the empty head before a long first one."""
    packed = _pack(F.split(text, SENTENCE_GAP, -1), limit, "", lead=False, keep_empty_head=True, trim=False)
    return packed if keep_empty else F.filter(packed, lambda segment: segment != "")


def _choice(labels: Sequence[str]) -> str:
    return "|".join(re.escape(label) for label in sorted(labels, key=len, reverse=True))


def first_label(answer: Column, labels: Sequence[str], mode: str = "word", trim_punctuation: bool = True) -> Column:
    """The first token of ``answer`` that is one of ``labels``, in lower case, else null.

    ``word`` takes labels that no letter or digit touches, ``whitespace`` takes what stands between white space, with
    punctuation trimmed off unless told otherwise, and ``substring`` takes the first entry of ``labels`` found anywhere.
    A label that the mode can never find is an error.
    """
    if mode == "substring":
        return label_by_substring(answer, labels, None)
    if mode == "word":
        known = [label for label in labels if label.split() == [label]]
        pattern = rf"(?<![\p{{L}}\p{{N}}])(?:{_choice(known)})(?![\p{{L}}\p{{N}}])"
        group = 0
    elif mode == "whitespace":
        known = [label for label in labels if label.split() == [label]]
        if trim_punctuation:
            known = [label for label in known if label == label.strip(PUNCTUATION)]
        edge = f"[{re.escape(PUNCTUATION)}]*" if trim_punctuation else ""
        pattern = rf"(?U)(?<![^\s\x1c-\x1f]){edge}({_choice(known)}){edge}(?![^\s\x1c-\x1f])"
        group = 1
    else:
        raise ValueError(f"mode must be word, whitespace or substring, not {mode!r}")
    if lost := [label for label in labels if label not in known]:
        raise ValueError(f"mode {mode} cannot find {lost}")
    if not known:
        return F.lit(None).cast("string")
    return F.nullif(F.regexp_extract(F.lower(answer), pattern, group), F.lit(""))


def label_by_substring(
    answer: Column, labels: Sequence[str] = ("positive", "negative", "neutral"), default: str | None = "none"
) -> Column:
    """The first entry of ``labels`` that occurs anywhere in ``answer``; case matters."""
    found = F.coalesce(*[F.when(answer.contains(label), F.lit(label)) for label in labels], F.lit(default))
    return found.cast("string")


def strip_echo(raw: Column, delimiter: Column | str) -> Column:
    """What follows the last occurrence of the delimiter, such as the echoed prompt; all of it when there is none."""
    if isinstance(delimiter, str):
        return F.substring_index(raw, delimiter, -1)
    cut = F.call_function("substring_index", raw, delimiter, F.lit(-1))
    return F.when(delimiter == "", raw).otherwise(cut)
