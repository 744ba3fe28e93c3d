"""Numeric expressions: coercion, log scaling, weights, score rounding."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weight of each reading status; a status not listed has no weight.
STATUS_WEIGHTS = {
    "COMPLETED": 1.0,
    "CURRENT": 0.8,
    "PAUSED": 0.5,
    "PLANNING": 0.4,
    "DROPPED": 0.1,
}


def coerce_numeric(text: Column) -> Column:
    """Text to double; unparseable text becomes null, and so does NaN.

    Spark also accepts Java's type suffixes (`1d`, `2f`) and hexadecimal floats (`0x1p3`),
    which are not numbers here.
    """
    java_only = text.rlike(r"(?i)x|(?<!in)[df]\s*$")
    value = F.when(~java_only, text.try_cast("double"))
    return F.nullif(value, F.lit(float("nan")))


def log_popularity(popularity: Column) -> Column:
    return F.log1p(popularity)


def log_chapters(chapters: Column) -> Column:
    """ln(1 + chapters), with the -1 that stands for unknown read as 0."""
    return F.log1p(F.when(chapters == -1, F.lit(0)).otherwise(chapters))


def status_weight(status: Column) -> Column:
    pairs = chain.from_iterable((F.lit(k), F.lit(v)) for k, v in STATUS_WEIGHTS.items())
    return F.create_map(*pairs)[status]


def interaction_strength(weight: Column, score: Column) -> Column:
    return weight * (score / 10)


def round_score(similarity: Column) -> Column:
    """Two decimals: multiply, round half to even, divide (unlike `round` and `bround`)."""
    return F.rint(similarity * 100) / 100


def percent_score(similarity: Column) -> Column:
    """Whole percent, halves rounded up."""
    return F.floor(similarity * 100 + 0.5)
