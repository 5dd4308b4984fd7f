import pytest
from pyspark.sql import functions as F

from labelmill import fixed_values as fixed
from labelmill.functions import names, prompts


def test_zero_shot_prompt(one):
    out = one(prompts.build_prompt(F.col("t"), prompts.task_context("sentiment", 0)), t="good > bad")
    assert out == fixed.SENTIMENT_CONTEXT + "<good > bad> ="


def test_few_shot_context():
    context = prompts.task_context("emotion_and_sentiment")
    assert context.startswith(fixed.EMOTION_SENTIMENT_CONTEXT + "\n            For example:\n            <You’ve had")
    assert context.endswith("conditions.> = other neutral\n\n        ")
    assert "\n            <WOW! Drone Delivery Startup, @zipline Raises $25m To Expand Its Operations In Africa> = surprise positive\n" in context


@pytest.mark.parametrize("shots, lines", [(0, 0), (False, 0), (1, 1), (True, 3), (3, 3), (9, 3)])
def test_number_of_examples(shots, lines):
    assert prompts.task_context("emotion", shots).count("> = ") == lines


def test_own_examples():
    context = prompts.task_context("sentiment", 2, [("a", "positive"), ("b", "negative"), ("c", "neutral")])
    assert "<a> = positive\n            <b> = negative\n" in context and "<c>" not in context


def test_trailing_space_only_in_training(one):
    assert one(prompts.build_prompt(F.col("t"), "c ", prompts.TRAINING_WRAP), t="x") == "c <x> = "
    assert one(prompts.build_prompt(F.col("t"), "c "), t="") == "c <> ="


def test_unknown_target():
    with pytest.raises(ValueError):
        prompts.task_context("mood")


def test_prompt_columns(one, spark):
    columns = prompts.prompt_columns(F.lit("hi"), 0)
    assert list(columns) == ["emotion_prompt", "sentiment_prompt", "emotion_and_sentiment_prompt"]
    roles = prompts.prompt_columns(F.lit("hi"), 0, roles=True)
    out = one(roles["emotion_prompt"])
    assert out.startswith("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nYou are an emotional classifier")
    assert out.endswith(
        "<|start_header_id|>user<|end_header_id|>\n\n<hi> =<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"
    )


def test_chat_layout_is_the_callers(one):
    messages = prompts.chat_messages(" be brief ", F.col("t"))
    out = one(prompts.render_chat(messages, "", "[{role}] {content}\n", "[answer]", trim=False), t="x")
    assert out == "[system]  be brief \n[user] x\n[answer]"


def test_headline_prompt(one):
    assert one(prompts.headline_prompt(F.col("t"), F.col("a")), t="Up 3%", a="positive").endswith("\n\n            [Up 3%] = positive")
    assert one(prompts.headline_prompt(F.col("t")), t="Up 3%").endswith("[Up 3%] =")


def test_labels_of_the_data(frame, spark):
    train = frame([("sadness",), ("joy",), (None,)], "label string")
    check = frame([("anger",), ("joy",)], "label string")
    seen = prompts.label_names([(train, "label"), (check, "label")])
    filled = prompts.fill_labels("one of {labels}; again {labels}", {"labels": seen})
    assert spark.range(1).select(filled.alias("out")).first()["out"] == "one of anger or joy or sadness; again anger or joy or sadness"


@pytest.mark.parametrize("value, flag", [("Yes", True), ("t", True), ("1", True), ("FALSE", False), ("n", False), ("0", False)])
def test_parse_flag(one, value, flag):
    assert one(names.parse_flag(F.col("v")), v=value) is flag


def test_parse_flag_errors(one):
    assert one(names.parse_flag(F.col("v"), strict=False), v="maybe") is None
    with pytest.raises(Exception, match="Boolean value expected"):
        one(names.parse_flag(F.col("v")), v="maybe")


def test_names(one):
    assert one(names.dataset_name(F.col("p")), p="data/posts/all.v2.csv") == "all"
    assert one(names.dataset_name(F.col("p")), p="plain") == "plain"
    config = names.generation_config(F.lit(30), F.lit("0.01"), F.lit("1.05"), F.lit(True), F.lit(False), F.lit(True))
    assert one(config) == "max_new_toks=30-temp=0.01-rep_pen=1.05-combine_prompts=True-few_shots=False-include_roles=True"
    assert one(names.conversation_id(F.lit("f.json"), F.lit("7"))) == "f.json7"
    assert one(names.rounded(F.lit(0.1234567))) == 0.12346
