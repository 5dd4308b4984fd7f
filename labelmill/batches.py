"""The size of the batches in which rows travel to Python workers."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Bytes of rows in one batch; a longer row is a batch of its own. A worker holds a batch several times over: as it came, as
#: Python values and as the answer.
BATCH_BYTES = 4_000_000
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_UNITS = {"b": 0, "k": 10, "m": 20, "g": 30}


def small_batches(spark: SparkSession) -> None:
    """From now on no batch of this session takes more than ``BATCH_BYTES`` or so, however many rows a task has, so that the
    memory of Python workers does not grow with the table. A smaller limit that the caller set stays."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", spark.conf.get(_LIMIT).strip().lower()).groups()
    if int(number) << _UNITS[unit[:1] or "b"] > BATCH_BYTES:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))
