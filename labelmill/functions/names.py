"""Expressions for names, flags and run settings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from labelmill import fixed_values as fixed


def dataset_name(path: Column) -> Column:
    """The file name up to its first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def conversation_id(filename: Column, index: Column) -> Column:
    return F.concat(filename, index)


def marker_name(number: Column) -> Column:
    return F.concat(F.lit("Dialogue"), number.cast("string"))


def speaker_name(number: Column) -> Column:
    return F.concat(F.lit("Speaker_"), number.cast("string"))


def parse_flag(value: Column, strict: bool = True) -> Column:
    """True or false from its usual spellings; other text is an error, or null when not strict."""
    word = F.lower(value.cast("string"))
    other = F.lit(None).cast("boolean")
    if strict:
        message = F.concat(F.lit("Boolean value expected, not "), F.coalesce(word, F.lit("null")))
        other = F.raise_error(message).cast("boolean")
    return F.when(word.isin(*fixed.TRUE_WORDS), True).when(word.isin(*fixed.FALSE_WORDS), False).otherwise(other)


def flag_text(flag: Column) -> Column:
    return F.when(flag, "True").when(~flag, "False")


def run_folder(settings: Mapping[str, Column]) -> Column:
    """``name=value`` pairs joined by dashes, in the given order; numbers that must keep their spelling come as text."""
    pairs = []
    for name, value in settings.items():
        pairs.append(F.concat(F.lit(f"{name}="), value.cast("string")))
    return F.concat_ws("-", *pairs)


def run_name(settings: Mapping[str, object]) -> str:
    """The same for one run whose settings the caller holds."""
    return "-".join(f"{name}={value}" for name, value in settings.items())


def generation_config(
    max_new_tokens: Column,
    temperature: Column,
    repetition_penalty: Column,
    combine_prompts: Column,
    few_shots: Column,
    include_roles: Column | None = None,
) -> Column:
    settings = {
        "max_new_toks": max_new_tokens,
        "temp": temperature,
        "rep_pen": repetition_penalty,
        "combine_prompts": flag_text(combine_prompts),
        "few_shots": flag_text(few_shots),
    }
    if include_roles is not None:
        settings["include_roles"] = flag_text(include_roles)
    return run_folder(settings)


def annotations(emotion_raters: list[Column], sentiment_raters: list[Column]) -> Column:
    return F.struct(F.array(*emotion_raters).alias("emotion"), F.array(*sentiment_raters).alias("sentiment"))


def rounded(score: Column, places: int = 5) -> Column:
    return F.round(score, places)
