"""CSV, JSON and text readers.

``row_id`` counts records from 0 in file order. It is found from the position of each record in its file block and the
number of records in the blocks before, so no record is sorted for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window as W, functions as F, types as T

from labelmill.settle import broadcast_if_small, land
from labelmill.sources import ranges as by_ranges

CSV_OPTIONS = {"header": True, "multiLine": True, "escape": '"', "encoding": "UTF-8", "mode": "PERMISSIVE"}

CONVERSATION = "filename string, index string, conversation array<struct<speaker:string,utterance:string>>"
REPORT_LINE = "map<string,string>"
BROADCAST_BLOCKS = 1_000_000
PART_FILE = "/part-[^/]*$"


def with_positions(df: DataFrame, name: str = "row_id", per_file: bool = False) -> DataFrame:
    """Add the position of each record of a text file scan, over all files in path order or inside each file.

    The part files of one folder count as one file. Records are landed together with their place. A second scan could be cut into other blocks when executors come
    and go, and would then give other places.
    """
    blocks = land(
        df.select(
            "*",
            F.col("_metadata.file_path").alias("_path"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_at"),
        )
    )
    sizes = blocks.groupBy("_path", "_block").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    shift = _rows_before(["_path", "_block"], per_file) - F.col("_first")
    return _shifted(blocks, sizes.withColumn("_shift", shift), ["_path", "_block"], "_at", name)


def read_parquet(spark: SparkSession, path: str | Sequence[str], per_file: bool = False) -> DataFrame:
    """Parquet with positions. Its files number their own rows, so only the rows per file have to be counted."""
    paths = [path] if isinstance(path, str) else list(path)
    rows = spark.read.parquet(*paths).select(
        "*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at")
    )
    sizes = rows.groupBy("_path").agg(F.count("*").alias("_rows"))
    return _shifted(rows, sizes.withColumn("_shift", _rows_before(["_path"], per_file)), ["_path"], "_at", "row_id")


def _rows_before(keys: list[str], per_file: bool) -> Column:
    whole_file = F.regexp_replace("_path", PART_FILE, "")
    in_order = W.partitionBy(whole_file).orderBy(*keys) if per_file else W.orderBy(*keys)
    return F.coalesce(F.sum("_rows").over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def _shifted(rows: DataFrame, starts: DataFrame, keys: list[str], at: str, name: str) -> DataFrame:
    """Add the shift of a row's file or block to its place there: one short row per block, broadcast after a count."""
    renamed = starts.select(*[F.col(key).alias(f"_of{key}") for key in keys], "_shift")
    renamed = broadcast_if_small(renamed, BROADCAST_BLOCKS)
    test = [rows[key] == renamed[f"_of{key}"] for key in keys]
    joined = rows.join(renamed, test).withColumn(name, F.col(at) + F.col("_shift"))
    return joined.drop(at, "_shift", *keys, *[f"_of{key}" for key in keys])


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a scan that gives fewer parts than there are cores, before costly work per row; a larger one stays."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType | None = None, row_id: bool = True,
    per_file: bool = False, missing: Sequence[str] = (), ranges: bool = False, **options,
) -> DataFrame:
    """CSV with a header; bytes that are not UTF-8 become U+FFFD. Without a schema the types are inferred.

    With a schema a record with too many fields, or a field that is not of its type, is an error; one with too few ends in
    nulls. ``missing`` lists texts to read as null besides the empty one (``fixed_values.MISSING_WORDS`` holds the usual ones).
    Quoted fields may hold line breaks. Such a file is one task's, unless ``ranges`` is set: then it is read by many tasks, with the same
    records and positions (``sources.ranges``); this takes a schema. ``multiLine=False`` is cheaper where no field holds a break.
    """
    if ranges:
        if schema is None:
            raise ValueError("a file read in ranges needs a schema; read_records takes names from the header")
        df = _csv_in_ranges(spark, path, _schema(schema), row_id, per_file, CSV_OPTIONS | options)
        texts = [name for name, kind in df.dtypes if kind == "string"]
        return df.withColumns({name: F.when(~F.col(name).isin(*missing), F.col(name)) for name in texts}) if missing else df
    reader = spark.read.options(**(CSV_OPTIONS | options))
    df = reader.option("inferSchema", True).csv(path) if schema is None else _checked(reader, path, _schema(schema))
    texts = [name for name, kind in df.dtypes if kind == "string"]
    df = with_positions(df, per_file=per_file) if row_id else df
    if not missing:
        return df
    return df.withColumns({name: F.when(~F.col(name).isin(*missing), F.col(name)) for name in texts})


def read_headerless(
    spark: SparkSession, path: str, names: Sequence[str] = ("sentiment", "text"), row_id: bool = True, ranges: bool = False,
) -> DataFrame:
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    return read_csv(spark, path, schema, row_id, ranges=ranges, header=False)


def read_records(spark: SparkSession, path: str, row_id: bool = True, ranges: bool = False) -> DataFrame:
    """CSV with every field as text; empty fields are empty strings. ``ranges`` as in ``read_csv``."""
    df = spark.read.options(**CSV_OPTIONS, inferSchema=False).csv(path)
    texts = df.columns
    if ranges:
        schema = T.StructType([T.StructField(name, T.StringType()) for name in texts])
        return _csv_in_ranges(spark, path, schema, row_id, False, CSV_OPTIONS).fillna("", subset=texts)
    df = with_positions(df) if row_id else df
    return df.fillna("", subset=texts)


def read_splits(
    spark: SparkSession, root: str, splits: Sequence[str] = ("train", "validation", "test"),
    schema: str | T.StructType | None = None, suffix: str = ".csv",
) -> DataFrame:
    """Named parts of a dataset under one folder, with a ``split`` column and positions inside each part."""
    parts = None
    for split in splits:
        part = read_csv(spark, f"{root}/{split}{suffix}", schema).withColumn("split", F.lit(split))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def read_conversations(spark: SparkSession, path: str, schema: str = CONVERSATION, row_id: bool = True) -> DataFrame:
    """JSONL of conversations without its empty records; positions still count them. A line that is no record is an error."""
    kept = T.StructType([*_schema(schema).fields, T.StructField("_broken", T.StringType())])
    df = spark.read.schema(kept).option("columnNameOfCorruptRecord", "_broken").json(path)
    df = with_positions(df) if row_id else df
    # The literal null is an empty record too.
    broken = F.col("_broken").isNotNull() & (F.trim("_broken") != "null")
    checked = F.when(broken, F.raise_error(F.concat(F.lit("not a record: "), F.left("_broken", F.lit(80))))).otherwise(F.col("conversation"))
    return df.withColumn("conversation", checked).drop("_broken").where(F.col("conversation").isNotNull())


def _csv_in_ranges(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, row_id: bool, per_file: bool, options: dict[str, object],
) -> DataFrame:
    """Each record is parsed on its own by Spark's reader, once it is known where it starts."""
    found = by_ranges.csv_records(spark, path, str(options.get("sep", ",")), str(options.get("quote", '"')))
    header = str(options.get("header", False)).lower() == "true"
    if row_id:
        found = by_ranges.numbered(found, int(header), per_file)
    elif header:
        found = found.where("position > 0")
    text = F.make_valid_utf8(F.col("value").cast("string"))
    # A file with two-sign line breaks has them inside of quotes too; Spark's reader makes them one sign there.
    text = F.when(F.endswith(text, F.lit("\r")), F.replace(F.regexp_replace(text, "\r$", ""), F.lit("\r\n"), F.lit("\n"))).otherwise(text)
    kept = {k: str(v) for k, v in options.items() if k not in ("header", "multiLine", "encoding")} | {"lineSep": "\n"}
    parsed = found.select(*(["row_id"] if row_id else []), F.from_csv(text, _with_spare(schema).toDDL(), kept).alias("_record"))
    df = parsed.select("_record.*", *(["row_id"] if row_id else []))
    return _typed(df, schema, ["row_id"] if row_id else [])


def _with_spare(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(field.name, T.StringType()) for field in schema] + [T.StructField("_spare", T.StringType())])


def _checked(reader: DataFrameReader, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """Records as text with one field to spare, so that nothing that does not fit the schema is dropped unseen."""
    return _typed(reader.option("enforceSchema", True).schema(_with_spare(schema)).csv(path), schema)


def _typed(df: DataFrame, schema: T.StructType, others: Sequence[str] = ()) -> DataFrame:
    """Text fields as the types of the schema; what does not fit is an error."""

    def fail(what: str, seen: Column) -> Column:
        return F.raise_error(F.concat(F.lit(f"{what}: "), F.left(seen, F.lit(80))))

    def typed(field: T.StructField) -> Column:
        raw = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            return raw.alias(field.name)
        value = F.trim(raw).try_cast(field.dataType)
        wrong = raw.isNotNull() & value.isNull()
        return F.when(wrong, fail(f"{field.name} is not {field.dataType.simpleString()}", raw)).otherwise(value).alias(field.name)

    whole = df.where(F.when(F.col("_spare").isNotNull(), fail("a record has too many fields", F.col("_spare"))).otherwise(F.lit(True)))
    return whole.select(*[typed(field) for field in schema], *others)


def _schema(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_json_array(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, row_id: bool = True, ranges: bool = False,
) -> DataFrame:
    """A file that holds one JSON array of records. It is one task's, unless ``ranges`` is set: then it is read by many tasks, with
    the same records and positions; this takes a schema, and a record that does not fit it is an error."""
    if ranges:
        if schema is None:
            raise ValueError("a file read in ranges needs a schema")
        found = by_ranges.json_records(spark, path)
        found = by_ranges.numbered(found) if row_id else found
        record = F.from_json("value", _schema(schema), {"mode": "FAILFAST"}).alias("_record")
        return found.select(*(["row_id"] if row_id else []), record).select("_record.*", *(["row_id"] if row_id else []))
    reader = spark.read.option("multiLine", True)
    df = (reader if schema is None else reader.schema(schema)).json(path)
    return with_positions(df) if row_id else df


def read_lines(spark: SparkSession, path: str, row_id: bool = True) -> DataFrame:
    df = spark.read.text(path)
    return with_positions(df) if row_id else df


def run_of(path: Column) -> dict[str, Column]:
    """Dataset, model and settings from ``<dataset>/<model>/<config>/<file>``, as the folder names are spelled; the file
    may be a folder of part files."""
    parts = F.split(F.regexp_replace(path, PART_FILE, ""), "/")
    names = {"dataset": -4, "model_id": -3, "generation_config": -2}
    return {
        name: F.call_function("url_decode", F.replace(F.element_at(parts, place), F.lit("+"), F.lit("%2B")))
        for name, place in names.items()
    }


def run_files(spark: SparkSession, root: str, file: str = "predictions.csv") -> DataFrame:
    """The run columns and the ``path`` of every run's file; only names are read, not contents."""
    listed = spark.read.format("binaryFile").load(f"{root}/*/*/*/{file}").select(F.regexp_replace("path", PART_FILE, "").alias("path"))
    return listed.distinct().select(*[value.alias(name) for name, value in run_of(F.col("path")).items()], "path")


def find_runs(spark: SparkSession, root: str, file: str = "predictions.csv") -> DataFrame:
    """One row per run folder that holds ``file``."""
    return run_files(spark, root, file).drop("path")


def read_runs(
    spark: SparkSession, root: str | Sequence[str], file: str, schema: str | T.StructType, columns: Sequence[str] | None = None,
    missing: Sequence[str] = (),
) -> DataFrame:
    """The tables of runs as one, with run columns and positions inside each run's file: of all runs under a root, or of the
    files with the given paths. Only ``columns`` are kept, all by default; ``missing`` lists texts to read as null."""
    paths = f"{root}/*/*/*/{file}" if isinstance(root, str) else list(root)
    scan = _checked(spark.read.options(**CSV_OPTIONS), paths, _schema(schema))
    scan = scan if columns is None else scan.select(*columns)
    if missing:
        scan = scan.withColumns({name: F.when(~F.col(name).isin(*missing), F.col(name)) for name, kind in scan.dtypes if kind == "string"})
    named = with_positions(scan.withColumn("_file", F.col("_metadata.file_path")), per_file=True)
    return named.withColumns(run_of(F.col("_file"))).drop("_file")


def read_reports(spark: SparkSession, root: str, file: str = "*_report.json") -> DataFrame:
    """Stored metric reports as long rows: run columns, target, label, precision, recall, f1, support."""
    scan = spark.read.text(f"{root}/*/*/*/{file}", wholetext=True)
    files = scan.select(F.col("_metadata.file_path").alias("_file"), F.col("value").alias("document"))
    target = F.regexp_extract("_file", r"([^/]+)_report\.json$", 1)
    return report_lines(files.withColumns(run_of(F.col("_file")) | {"target": target}).drop("_file"))


def read_documents(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The same from documents stored in folders named by their keys."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in ("document", *keys)])
    return report_lines(spark.read.schema(schema).text(path, wholetext=True))


def report_lines(documents: DataFrame) -> DataFrame:
    """Rows of JSON reports, with the other columns of the documents as keys."""
    keys = [column for column in documents.columns if column != "document"]
    entries = documents.select(
        *keys, F.posexplode(F.map_entries(F.from_json("document", REPORT_LINE))).alias("ordinal", "entry")
    )
    fields = F.from_json("entry.value", "precision double, recall double, `f1-score` double, support double")
    bare = F.expr("try_cast(entry.value as double)")
    # A bare number stands for all three scores of the accuracy line.
    return entries.withColumn("_fields", fields).select(
        *keys, F.col("ordinal").cast("long").alias("ordinal"), F.col("entry.key").alias("label"),
        F.coalesce(F.col("_fields.precision"), bare).alias("precision"),
        F.coalesce(F.col("_fields.recall"), bare).alias("recall"),
        F.coalesce(F.col("_fields")["f1-score"], bare).alias("f1"),
        F.col("_fields.support").alias("support"),
    )
