"""CSV, JSONL and JSON writers. Rows that must keep an order are sorted over all tasks, never in one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelmill import fixed_values as fixed
from labelmill.operators.positions import row_ids
from labelmill.operators.runs import RUN_KEYS, pending
from labelmill.settle import land

CSV_OPTIONS = {
    "header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def write_csv(df: DataFrame, path: str, order_by: Sequence[str] = (), mode: str = "errorifexists", **options) -> None:
    rows = df.orderBy(*order_by) if order_by else df
    rows.write.mode(mode).options(**(CSV_OPTIONS | options)).csv(path)


def write_indexed_csv(df: DataFrame, path: str, order_by: Sequence[str | Column], mode: str = "errorifexists") -> None:
    """CSV with the row number from 0 as a first column without a name."""
    numbered = row_ids(df, order_by, "_index").select("_index", *df.columns).orderBy("_index")
    numbered = numbered.withColumnRenamed("_index", "")
    numbered.write.mode(mode).options(**CSV_OPTIONS, emptyValue="").csv(path)


def write_split_csv(df: DataFrame, path: str, part: str, order_by: Sequence[str], mode: str = "errorifexists") -> None:
    """One folder per value of ``part``; a large part is spread over several files in order."""
    df.orderBy(part, *order_by).write.mode(mode).partitionBy(part).options(**CSV_OPTIONS).csv(path)


def write_jsonl(df: DataFrame, path: str, order_by: Sequence[str] = (), part: str | None = None,
                mode: str = "errorifexists") -> None:
    """One JSON record per line, null fields included; ``part`` routes records to a folder per value."""
    order = [*([part] if part else []), *order_by]
    writer = (df.orderBy(*order) if order else df).write.mode(mode).option("ignoreNullFields", False)
    (writer.partitionBy(part) if part else writer).json(path)


def annotated_posts(df: DataFrame, emotion_raters: Sequence[str], sentiment_raters: Sequence[str],
                    emotion: str = "voted_emotion", sentiment: str = "voted_sentiment") -> DataFrame:
    """Posts as nested records with the voted labels and every rater's own."""
    return df.select(
        "text",
        F.col(emotion).alias("emotion"),
        F.col(sentiment).alias("sentiment"),
        F.struct(
            F.array(*emotion_raters).alias("emotion"), F.array(*sentiment_raters).alias("sentiment")
        ).alias("annotations"),
    )


def report_documents(reports: DataFrame, keys: Sequence[str] = (*RUN_KEYS, "target")) -> DataFrame:
    """One pretty-printed JSON document per run and target, with the lines of the report in their order."""
    quoted = F.expr("substring(to_json(array(label)), 2, length(to_json(array(label))) - 2)")

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'    "{name}": '), value.cast("double").cast("string"))

    block = F.concat(
        F.lit("{\n"),
        F.concat_ws(
            ",\n", field("precision", F.col("precision")), field("recall", F.col("recall")),
            field("f1-score", F.col("f1")), field("support", F.col("support")),
        ),
        F.lit("\n  }"),
    )
    value = F.when(F.col("label") == "accuracy", F.col("f1").cast("string")).otherwise(block)
    lines = reports.select(*keys, F.struct("ordinal", F.concat(F.lit("  "), quoted, F.lit(": "), value).alias("line")).alias("_line"))
    grouped = lines.groupBy(*keys).agg(F.array_sort(F.collect_list("_line")).alias("_lines"))
    joined = F.array_join(F.transform("_lines", lambda line: line["line"]), ",\n")
    return grouped.select(*keys, F.concat(F.lit("{\n"), joined, F.lit("\n}")).alias("document"))


def write_documents(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Each document as a text file in a folder named by its keys."""
    keys = [column for column in documents.columns if column != "document"]
    documents.write.mode(mode).partitionBy(*keys).option("lineSep", "\n").text(path)


def write_predictions(scored: DataFrame, raw_path: str, label_path: str, input_columns: Sequence[str],
                      order_by: Sequence[str] = ("row_id",), mode: str = "errorifexists") -> None:
    """The raw and the label table side by side; answers are landed first, so both hold the same ones."""
    held = land(scored)
    raws = [
        name for name in (fixed.RAW_COLUMN, fixed.EMOTION_RAW_COLUMN, fixed.SENTIMENT_RAW_COLUMN) if name in held.columns
    ]
    ordered = held.orderBy(*order_by)
    write_csv(ordered.select(*input_columns, *raws), raw_path, mode=mode)
    write_csv(ordered.select(*input_columns, fixed.SENTIMENT_COLUMN, fixed.EMOTION_COLUMN), label_path, mode=mode)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stored(like: DataFrame, path: str) -> DataFrame:
    """The Parquet table at ``path``, or an empty one of the same columns when there is none yet."""
    try:
        return like.sparkSession.read.schema(like.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)


def append_missing(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append the rows whose keys the table at ``path`` does not hold yet. A single writer's way; ``versions.append`` is safe against
    repeated and competing ones."""
    pending(df, stored(df, path), keys).write.mode("append").parquet(path)


def write_json_array(df: DataFrame, path: str, order_by: Sequence[str]) -> None:
    """One file that holds one JSON array of the rows, in order, each on a line of its own that begins with the comma.

    One sort; tasks write ordered parts. These are put together by their file system: joined without a copy where it can do that
    (HDFS), else each task copies its part to its place in the file (storage mounted on all machines, ``file:``). No task and
    not the driver handles the whole. The file appears under its name once it is complete; a failed attempt leaves nothing, or a
    hidden folder which goes with the next one. Other stores cannot join files: write JSON lines there.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(conf)
    if files.exists(target):
        raise FileExistsError(path)
    aside = f"{path.rsplit('/', 1)[0]}/_{path.rsplit('/', 1)[-1]}.parts"
    hidden = jvm.org.apache.hadoop.fs.Path(aside)
    files.delete(hidden, True)
    try:
        record = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
        rows = df.orderBy(*order_by).select(record.alias("_json"), F.monotonically_increasing_id().alias("_at"))
        # The first row of a task's part goes without comma; one is put between the parts.
        first = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) == 0
        led = F.concat(F.when(first, "").otherwise(","), "_json")
        rows.select(led.alias("value")).write.option("lineSep", "\n").text(aside)
        parts = sorted((e for e in files.listStatus(hidden) if e.getPath().getName().startswith("part-")), key=lambda e: e.getPath().getName())
        parts = [e for e in parts if e.getLen()]
        pieces: list[tuple[str, int]] = []

        def put(text: str) -> None:
            small = jvm.org.apache.hadoop.fs.Path(f"{aside}/_text-{len(pieces):09d}")
            out = files.create(small, True)
            out.write(bytearray(text.encode()))
            out.close()
            pieces.append((small.toUri().getPath(), len(text.encode())))

        put("[")
        for number, part in enumerate(parts):
            if number:
                put(",")
            pieces.append((part.getPath().toUri().getPath(), part.getLen()))
        put("]\n")
        if files.getUri().getScheme() == "file":
            whole = _copied(spark, pieces, f"{hidden.toUri().getPath()}/_whole")
        else:
            whole = pieces[0][0]
            others = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(pieces) - 1)
            for k, (piece, _) in enumerate(pieces[1:]):
                others[k] = jvm.org.apache.hadoop.fs.Path(piece)
            files.concat(jvm.org.apache.hadoop.fs.Path(whole), others)
        if not files.rename(jvm.org.apache.hadoop.fs.Path(whole), target):
            raise OSError(f"{path} could not be named")
    finally:
        files.delete(hidden, True)


def _copied(spark: SparkSession, pieces: Sequence[tuple[str, int]], whole: str) -> str:
    """Put the pieces behind one another: each is copied by its own task to its place. A repeated task writes the same bytes."""
    import shutil

    places, at = [], 0
    for piece, size in pieces:
        places.append((piece, at))
        at += size
    with open(whole, "wb") as out:
        out.truncate(at)

    def copy(rows):  # noqa: ANN001, ANN202
        for batch in rows:
            for piece, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open(piece, "rb") as own, open(whole, "r+b") as out:
                    out.seek(place)
                    shutil.copyfileobj(own, out, 1 << 20)
            yield batch

    spark.createDataFrame(places, "piece string, place long").repartition(len(places), "place").mapInArrow(copy, "piece string, place long").count()
    return whole
