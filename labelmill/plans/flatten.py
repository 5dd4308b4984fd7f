"""From conversation records to a sample of utterance segments."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from labelmill.functions.text import pack_paragraphs
from labelmill.operators.dialogs import utterance_rows
from labelmill.operators.sampling import quota_sample
from labelmill.operators.tables import stratum_by_name
from labelmill.settle import broadcast_if_small


def sample_segments(
    conversations: DataFrame, quotas: Mapping[str, float], cap: float, limit: int = 100, separator: str = "\n\n",
    carried: Mapping[str, int] | None = None, carried_size: int = 0, word: str = "singapore",
) -> DataFrame:
    """Marker and segment rows of the conversations a quota walk accepts, with their stratum.

    The walk sees one short row per conversation; the texts are only filtered by its outcome.
    """

    def pack(text):
        return pack_paragraphs(text, limit, separator)

    strata = conversations.withColumn("stratum", stratum_by_name(F.col("filename"), word))
    segments = F.aggregate(
        F.transform("conversation", lambda item: F.size(pack(F.coalesce(item["utterance"], F.lit(""))))),
        F.lit(0),
        lambda total, size: total + size,
    )
    sizes = strata.select("row_id", "stratum", segments.cast("long").alias("size"))
    accepted = quota_sample(sizes, "stratum", "size", quotas, cap, "row_id", carried, carried_size)
    accepted = broadcast_if_small(accepted.select("row_id"))
    return utterance_rows(strata.join(accepted, "row_id", "left_semi"), pack=pack, keep=["stratum"])
