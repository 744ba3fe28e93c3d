"""Interaction cleaning: raw read-list records to typed rows that can be joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfkin import schemas
from shelfkin.functions import dates, numbers, text
from shelfkin.operators.frames import conform_schema


def coerce_interactions(df: DataFrame) -> DataFrame:
    """Numbers from text; what does not parse becomes null."""
    columns = ("userId", "mediaId", "score", "progress")
    return df.withColumns({c: numbers.coerce_numeric(F.col(c)) for c in columns})


def drop_unjoinable(df: DataFrame) -> DataFrame:
    """Drop rows that lack either key."""
    return df.dropna(subset=["userId", "mediaId"])


def cast_ids(df: DataFrame) -> DataFrame:
    """Keys to whole numbers, truncating; an infinite key is an error."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("userId", "mediaId")})


def clean_interactions(raw: DataFrame) -> DataFrame:
    """Typed interactions with both keys present; repeated rows are kept."""
    return (
        conform_schema(raw, schemas.RAW_INTERACTION)
        .transform(coerce_interactions)
        .withColumns(
            {
                "status": text.upper_status(F.col("status")),
                "createdAt": dates.epoch_to_ts(numbers.coerce_numeric(F.col("createdAt"))),
            }
        )
        .transform(drop_unjoinable)
        .transform(cast_ids)
        .select(schemas.RAW_INTERACTION.names)
    )
