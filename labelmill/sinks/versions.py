"""Tables that grow by versions: a folder of rows is written aside and published under the next number, or not at all.

``<path>/version=<n>`` folders are the table. Publishing renames a finished folder to the next number and fails if another writer
was first; its rows are then held against the new versions and published under a later number. So a repeated run adds nothing,
and of two competing runs each key is added once. On HDFS and local disks such a rename is one step; a store that copies
instead needs a single writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from labelmill.operators.runs import pending


def _place(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(conf)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The published versions, in order. Only the table's own folder is listed."""
    place, files = _place(spark, path)
    if not files.exists(place):
        return []
    names = [entry.getPath().getName() for entry in files.listStatus(place)]
    return sorted(int(name.removeprefix("version=")) for name in names if name.startswith("version="))


def read_versions(like: DataFrame, path: str, numbers: Sequence[int] | None = None) -> DataFrame:
    """The rows of the given versions, by default of all there are now, with the columns of ``like``."""
    spark = like.sparkSession
    numbers = versions(spark, path) if numbers is None else numbers
    if not numbers:
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(*[f"{path}/version={number:09d}" for number in numbers])


def _publish(spark: SparkSession, staged: str, path: str, number: int) -> bool:
    """Whether the staged folder has become version ``number``; false if there is one already."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    own, target = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(f"{path}/version={number:09d}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(conf).getUri(), conf)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(own, target, none)
    except Py4JJavaError as error:
        if target.getFileSystem(conf).exists(target):
            return False
        raise error
    return True


def append(df: DataFrame, path: str, keys: Sequence[str]) -> int | None:
    """Add the rows whose keys the table does not hold yet, as one new version; its number, or none if nothing was new.

    Of rows of ``df`` with one key the first stays, so keys are distinct in the table. Rows are written once and only filtered
    again if another writer was faster. A run that ends before it publishes leaves the table as it was.
    """
    spark = df.sparkSession
    seen = versions(spark, path)
    rows = pending(df.dropDuplicates(list(keys)), read_versions(df, path, seen), keys)
    while True:
        staged = f"{path}/_staged-{uuid.uuid4().hex}"
        rows.write.parquet(staged)
        held = spark.read.schema(df.schema).parquet(staged)
        place, files = _place(spark, staged)
        now = versions(spark, path)
        fresh = [number for number in now if number not in seen]
        if held.isEmpty():
            files.delete(place, True)
            return None
        if not fresh and _publish(spark, staged, path, (seen[-1] if seen else 0) + 1):
            return (seen[-1] if seen else 0) + 1
        # Others have published since: what they brought is taken out, from the rows that are written already.
        now = versions(spark, path)
        rows = pending(held, read_versions(df, path, [number for number in now if number not in seen]), keys)
        seen = now
