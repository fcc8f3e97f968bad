"""A label and a description of one clip, side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.functions.text import strip, text_or_empty


def pair_emotions(labels: DataFrame, summaries: DataFrame, key: str = "segment_id") -> DataFrame:
    """(key, emotion): what either model said of a segment, blank where one failed; segments without a word of either go.

    ``labels`` has ``label``; ``summaries`` has ``text`` and ``label``.
    """
    left = labels.select(key, strip(text_or_empty("label")).alias("ser_label"))
    right = summaries.select(key, strip(text_or_empty("text")).alias("sec_text"), strip(text_or_empty("label")).alias("sec_label"))
    parts = ("ser_label", "sec_text", "sec_label")
    both = left.join(right, key, "full_outer").select(key, *[F.coalesce(c, F.lit("")).alias(c) for c in parts])
    return both.where(F.concat(*parts) != "").select(key, F.struct(*parts).alias("emotion"))
