"""Prompt expressions: contexts, examples, wrapped texts and chat messages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from labelmill import fixed_values as fixed
from labelmill.functions.text import strip

TARGETS = ("emotion", "sentiment", "emotion_and_sentiment")
WRAP = "<{}> ="
TRAINING_WRAP = "<{}> = "

_CONTEXTS = {
    "emotion": fixed.EMOTION_CONTEXT,
    "sentiment": fixed.SENTIMENT_CONTEXT,
    "emotion_and_sentiment": fixed.EMOTION_SENTIMENT_CONTEXT,
}
_FRAMES = {
    "emotion": fixed.EMOTION_EXAMPLES_FRAME,
    "sentiment": fixed.SENTIMENT_EXAMPLES_FRAME,
    "emotion_and_sentiment": fixed.EMOTION_SENTIMENT_EXAMPLES_FRAME,
}
_ANSWERS = {
    "emotion": list(fixed.EXAMPLE_EMOTIONS),
    "sentiment": list(fixed.EXAMPLE_SENTIMENTS),
    "emotion_and_sentiment": [
        f"{emotion} {sentiment}" for emotion, sentiment in zip(fixed.EXAMPLE_EMOTIONS, fixed.EXAMPLE_SENTIMENTS)
    ],
}


def check_target(target: str, allowed: Sequence[str] = TARGETS) -> str:
    if target not in allowed:
        raise ValueError(f"target must be one of {', '.join(allowed)}, not {target!r}")
    return target


def example_lines(pairs: Sequence[tuple[str, str]], wrap: str = WRAP) -> str:
    return "".join(f"            {wrap.format(text)} {answer}\n" for text, answer in pairs)


def task_context(target: str, shots: int | bool = True, examples: Sequence[tuple[str, str]] | None = None) -> str:
    """The context of a target with the first ``shots`` examples; ``True`` means all of them, 0 none."""
    check_target(target)
    pairs = list(zip(fixed.EXAMPLE_TEXTS, _ANSWERS[target])) if examples is None else list(examples)
    count = len(pairs) if shots is True else int(shots)
    if count <= 0:
        return _CONTEXTS[target]
    head, tail = _FRAMES[target]
    return _CONTEXTS[target] + head + example_lines(pairs[:count]) + tail


def build_prompt(text: Column, context: Column | str, wrap: str = WRAP) -> Column:
    """``context`` followed by the text put into ``wrap``; the context may come from a column or a subquery."""
    head, tail = wrap.split("{}")
    if isinstance(context, str):
        return F.concat(F.lit(context + head), text, F.lit(tail))
    return F.concat(context, F.lit(head), text, F.lit(tail))


def prompt_columns(text: Column, shots: int | bool = True, roles: bool = False, **chat: str) -> dict[str, Column]:
    """The three prompt columns, as plain text or as rendered system and user messages."""
    columns = {}
    for target in TARGETS:
        context = task_context(target, shots)
        if roles:
            columns[f"{target}_prompt"] = render_chat(chat_messages(context, build_prompt(text, "")), **chat)
        else:
            columns[f"{target}_prompt"] = build_prompt(text, context)
    return columns


def headline_prompt(text: Column, answer: Column | None = None) -> Column:
    """Headline in square brackets, with the answer for training or without it for testing."""
    prompt = F.concat(F.lit(fixed.HEADLINE_CONTEXT + "["), text, F.lit("] ="))
    return prompt if answer is None else strip(F.concat(prompt, F.lit(" "), answer))


def chat_messages(system: Column | str, user: Column) -> Column:
    system = F.lit(system) if isinstance(system, str) else system
    return F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )


def render_chat(
    messages: Column,
    start: str = "<|begin_of_text|>",
    message: str = "<|start_header_id|>{role}<|end_header_id|>\n\n{content}<|eot_id|>",
    answer: str = "<|start_header_id|>assistant<|end_header_id|>\n\n",
    trim: bool = True,
) -> Column:
    """One string per message list in a caller-given chat layout, ending where the model is to answer."""
    before, rest = message.split("{role}")
    between, after = rest.split("{content}")

    def one(item: Column) -> Column:
        content = strip(item["content"]) if trim else item["content"]
        return F.concat(F.lit(before), item["role"], F.lit(between), content, F.lit(after))

    return F.concat(F.lit(start), F.array_join(F.transform(messages, one), ""), F.lit(answer))


def label_names(tables: Sequence[tuple[DataFrame, str]], joint: str = " or ") -> Column:
    """The sorted labels seen in any of the (table, column) pairs, joined to one string, as a scalar subquery."""
    seen = tables[0][0].select(F.col(tables[0][1]).cast("string").alias("label"))
    for table, column in tables[1:]:
        seen = seen.unionByName(table.select(F.col(column).cast("string").alias("label")))
    return seen.distinct().agg(F.array_join(F.array_sort(F.collect_list("label")), joint)).scalar()


def fill_labels(template: str, names: Mapping[str, Column | str]) -> Column:
    """The template with every ``{key}`` replaced by its label names."""
    filled = F.lit(template)
    for key, value in names.items():
        filled = F.replace(filled, F.lit("{" + key + "}"), F.lit(value) if isinstance(value, str) else value)
    return filled
