"""A corpus pipeline over the documents: each stage reads what its predecessor kept, written as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelmill.llm import decontaminate, langid, passages, queries, segment, simhash
from labelmill.llm.common import table
from labelmill.settle import land

#: Documents whose language is less certain than this go.
CERTAIN = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a letter whose language is told with a probability of ``CERTAIN`` at least."""
    out = langid.predict(docs, langid.fit(docs), lang="_lang_pred", score="_score")
    return out.where((F.col("_lang_pred") != langid.UNKNOWN) & (F.col("_score") >= CERTAIN)).drop("_lang_pred", "_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words or more out of all documents but the first that holds them; nothing but repeats goes."""
    return passages.remove_repeated(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no part of the benchmark to speak of."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode whole texts, decode them again and keep the ids of documents: all of them, marked by whether they came back."""
    return segment.encode_checked(docs, segment.load(queries.PIECES), n=2).drop("n_chars")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("contamination", contamination),
    ("pieces", pieces),
]

#: Trained models, hash families and segmentations cannot be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir))
    return docs
