"""Zero-filled calendars and other fixed spines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zero_filled(spine: DataFrame, counts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Every row of the spine, with 0 where counts has no such key. The spine is a fixed, small set of keys."""
    return spine.join(counts, key, "left").select(key, *(F.coalesce(c, F.lit(0)).alias(c) for c in columns))
