"""New posts as they arrive: files that were handled before are skipped, as the stream's own checkpoint knows them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelmill.functions.prompts import prompt_columns
from labelmill.functions.text import mask_mentions, pack_paragraphs


def stream_posts(spark: SparkSession, path: str, schema: str, file_format: str = "parquet", **options) -> DataFrame:
    return spark.readStream.format(file_format).schema(schema).options(**options).load(path)


def prepared(posts: DataFrame, shots: int | bool = True, limit: int | None = None, separator: str = "\n\n") -> DataFrame:
    """Mentions masked, texts cut into segments when ``limit`` is given, and the prompt columns; keeps no state."""
    masked = posts.withColumn("text", mask_mentions(F.col("text")))
    if limit is not None:
        columns = [F.col(name) for name in masked.columns if name != "text"]
        segments = F.posexplode(pack_paragraphs(F.col("text"), limit, separator)).alias("seg", "text")
        masked = masked.select(*columns, segments)
    return masked.withColumns(prompt_columns(F.col("text"), shots))


def write_available(df: DataFrame, path: str, checkpoint: str, file_format: str = "parquet") -> None:
    """Handle every file that is there now, once, and stop."""
    stream = df.writeStream.format(file_format).option("checkpointLocation", checkpoint).outputMode("append")
    stream.trigger(availableNow=True).start(path).awaitTermination()
