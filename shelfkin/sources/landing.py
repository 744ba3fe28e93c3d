"""Landed API responses: reading, flattening, the source's own filters, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfkin.operators.frames import first_rows

ROWS_PER_PAGE = 50  # fixed value: the source's page size
MALFORMED = "malformed"  # the response column that takes a line which is not what is declared


def scan_json(
    spark: SparkSession, path: str | list[str], schema: T.StructType, lines: bool = False
) -> DataFrame:
    """JSON files with a declared schema.

    By default each file is one JSON array (UTF-8, byte-order mark allowed), which one task
    must read from end to end; with `lines` the files hold a record per line and are split.
    A record that is no JSON, or not of the declared form, is kept as text in the column
    `malformed` where the schema has one.
    """
    reader = spark.read.schema(schema).option("columnNameOfCorruptRecord", MALFORMED)
    return reader.option("multiLine", not lines).json(path)


def flatten_pages(responses: DataFrame, items: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of every response page, repeated rows included.

    `items` is the path of the page's array; `keep` names response columns to carry along.
    """
    return responses.select(*keep, F.explode(items).alias("row")).select(*keep, "row.*")


def is_popular(min_score: int, min_popularity: int) -> tuple[Column, Column]:
    """The source's two conditions, both strict; a null does not pass."""
    score, popularity = F.col("averageScore") > min_score, F.col("popularity") > min_popularity
    return F.coalesce(score, F.lit(False)), F.coalesce(popularity, F.lit(False))


def source_filter_items(items: DataFrame, min_score: int, min_popularity: int) -> DataFrame:
    """Items strictly above both thresholds."""
    return items.filter(
        (F.col("averageScore") > min_score) & (F.col("popularity") > min_popularity)
    )


def whole_numbers(items: DataFrame, schema: T.StructType) -> DataFrame:
    """Landed items, whose numbers may be written `85.0`, in the types of `schema`.

    A number that is not whole loses what is behind the point.
    """
    kinds = {f.name: f.dataType for f in schema}
    changed = [f for f in items.schema if f.name in kinds and isinstance(f.dataType, T.DoubleType)]
    return items.withColumns({f.name: F.col(f.name).try_cast(kinds[f.name]) for f in changed})


def source_filter_users(df: DataFrame, first_user: int, last_user: int) -> DataFrame:
    """Users in a range, both ends included."""
    return df.filter(F.col("userId").between(first_user, last_user))


def cap_per_user(
    df: DataFrame,
    order: tuple[str, ...] = ("page", "pos"),
    max_pages: int = 1000,
    per_page: int = ROWS_PER_PAGE,
) -> DataFrame:
    """At most `max_pages * per_page` rows per user, the first to arrive."""
    return first_rows(df, "userId", [F.col(c) for c in order], order, max_pages * per_page)


def _failed(responses: DataFrame) -> Column:
    failed = F.col("errors").isNotNull()
    if MALFORMED in responses.columns:
        failed = failed | F.col(MALFORMED).isNotNull()
    if "page" in responses.columns:
        failed = failed | F.col("page").isNull()
    return failed


def response_rows(responses: DataFrame) -> DataFrame:
    """Responses that carry data."""
    return responses.filter(~_failed(responses))


def quarantine(responses: DataFrame) -> DataFrame:
    """Responses that yield no rows: with an error, malformed, or without their page number."""
    return responses.filter(_failed(responses))


def skipped_users(responses: DataFrame) -> DataFrame:
    """Users with a failed response; rows that other pages of theirs brought are kept.

    A malformed response names no user and is found in the quarantine only.
    """
    return quarantine(responses).select("userId").filter("userId IS NOT NULL").distinct()
