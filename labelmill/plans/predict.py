"""From posts to raw answers and labels."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelmill import fixed_values as fixed
from labelmill.functions.names import run_name
from labelmill.functions.prompts import prompt_columns
from labelmill.operators.scoring import BATCH_ROWS, Scorer, batch_score, extract_labels
from labelmill.sinks.writers import exists, write_predictions
from labelmill.sources.readers import read_csv


def predict_posts(
    posts: DataFrame, scorer_factory: Callable[[], Scorer], combined: bool = True, shots: int | bool = True,
    roles: bool = False, mode: str = "word", batch_size: int = BATCH_ROWS, text: str = "text", **chat: str,
) -> DataFrame:
    """Input columns, raw answers, and the emotion and sentiment read from them; one pass, no shuffle."""
    prompts = prompt_columns(F.col(text), shots, roles, **chat)
    if combined:
        answers = {"emotion_and_sentiment_prompt": fixed.RAW_COLUMN}
    else:
        answers = {"emotion_prompt": fixed.EMOTION_RAW_COLUMN, "sentiment_prompt": fixed.SENTIMENT_RAW_COLUMN}
    asked = posts.withColumns({name: prompts[name] for name in answers})
    scored = batch_score(asked, answers, scorer_factory, batch_size).drop(*answers)
    return extract_labels(scored, combined, mode)


def predict_run(
    spark: SparkSession, data: str, schema: str, root: str, model_id: str, scorer_factory: Callable[[], Scorer],
    settings: Mapping[str, object], dataset: str | None = None, **options,
) -> str:
    """One run: read the posts, predict, and write ``raw.csv`` and ``predictions.csv`` under
    ``<root>/<dataset>/<model>/<settings>``. A run that was written before is left as it is. Returns the folder.
    """
    told = {name: value for name, value in settings.items() if name in ("combined", "shots", "few_shots") and name in options}
    if wrong := [name for name, value in told.items() if options[name] != value]:
        raise ValueError(f"settings and options differ in {wrong}")
    if "few_shots" in settings and bool(options.get("shots", 0)) != bool(settings["few_shots"]):
        raise ValueError("the folder's few_shots and the prompts' shots differ")
    name = dataset or data.rsplit("/", 1)[-1].split(".")[0]
    folder = f"{root}/{name}/{model_id}/{run_name(settings)}"
    if not exists(spark, f"{folder}/predictions.csv/_SUCCESS"):
        posts = read_csv(spark, data, schema)
        columns = [column for column in posts.columns if column != "row_id"]
        scored = predict_posts(posts, scorer_factory, **options)
        write_predictions(scored, f"{folder}/raw.csv", f"{folder}/predictions.csv", columns, mode="overwrite")
    return folder
