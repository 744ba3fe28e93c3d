"""Date expressions.  All results are TIMESTAMP_NTZ, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First and last month start, and largest epoch second, that fit a signed
# 64-bit count of nanoseconds.
FIRST_MONTH = "TIMESTAMP_NTZ '1677-10-01 00:00:00'"
LAST_MONTH = "TIMESTAMP_NTZ '2262-04-01 00:00:00'"
MAX_EPOCH_SECONDS = 9223372036


def has_end_date(end_date: Column) -> Column:
    """1 when a date map is present and none of its values is null, else 0.

    A map keeps a missing key apart from a null one: only keys that are present count.
    """
    any_null = F.exists(F.map_values(end_date), lambda v: v.isNull())
    return F.coalesce((~any_null).cast("int"), F.lit(0))


def month_start(date: Column) -> Column:
    """First day of `{year, month}`; null when either part is null, zero or out of range."""
    year, month = date["year"], date["month"]
    zero = F.lit(0)
    start = F.when(
        year.between(1677, 2262) & month.between(1, 12),
        F.make_timestamp_ntz(
            year.cast("int"), month.cast("int"), F.lit(1), zero, zero, zero.cast("decimal(16,6)")
        ),
    )
    return F.when(start.between(F.expr(FIRST_MONTH), F.expr(LAST_MONTH)), start)


def release_year(start_date: Column) -> Column:
    return F.year(start_date)


def epoch_to_ts(seconds: Column) -> Column:
    """Epoch seconds (double) to a UTC timestamp; out-of-range values become null."""
    zero = F.lit(0)
    offset = F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))
    epoch = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    return F.when(F.abs(seconds) <= MAX_EPOCH_SECONDS, epoch + offset)
