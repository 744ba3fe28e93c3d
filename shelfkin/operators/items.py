"""Item cleaning: raw catalogue records to one clean row per item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfkin.functions import dates, text
from shelfkin.operators.frames import drop_columns


def drop_adult(df: DataFrame) -> DataFrame:
    """Keep rows not flagged adult; an unknown flag is kept."""
    return df.filter(~F.col("isAdult").eqNullSafe(True))


def fill_sentinel(df: DataFrame) -> DataFrame:
    """Unknown chapter and volume counts become -1."""
    return df.fillna(-1, ["chapters", "volumes"])


def clean_items(raw: DataFrame) -> DataFrame:
    """Title, tags, dates, counts and description cleaned; adult items removed.

    One narrow stage: every step is a projection or a filter, so the whole chain runs next
    to the scan.
    """
    cleaned = raw.withColumns(
        {
            "title": text.clean_title(F.col("title")),
            "tags": text.clean_tags(F.col("tags")),
            "has_end_date": dates.has_end_date(F.col("endDate")),
            "startDate": dates.month_start(F.col("startDate")),
        }
    )
    if "description" in raw.columns:
        cleaned = cleaned.withColumn("description", text.clean_description(F.col("description")))
    return (
        cleaned.transform(fill_sentinel)
        .transform(drop_adult)
        .transform(drop_columns, "endDate", "isAdult")
    )
