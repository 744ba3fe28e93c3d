"""Small frame helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SKETCHES = 64  # frequent-item sketches the keys are divided over
TRACKED = 8  # keys tracked by one sketch, for each key that can be hot
MOST_TRACKED = 1_000_000  # fixed value: what Spark allows for one sketch


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns, and fail on a name that is not there (`DataFrame.drop` would not)."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.drop(*names)


def conform_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of `schema`, in its order; those missing are null."""
    present = set(df.columns)
    return df.select(
        *[
            F.col(f.name) if f.name in present else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def _salts(df: DataFrame) -> int:
    """Salts for a hot key: as many as there are shuffle partitions to fill."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sketch_size(partitions: int) -> tuple[int, int]:
    """Keys that one sketch returns, and keys it tracks.

    There are at most as many hot keys as partitions; the sketches share them by hash.
    """
    most = min(max(100, 4 * -(-partitions // SKETCHES)), MOST_TRACKED // TRACKED)
    return most, most * TRACKED


def hot_keys(df: DataFrame, key: str) -> list:
    """Keys (None among them) that hold more rows than a shuffle partition does on average.

    Counted by frequent-item sketches of fixed size, so nothing is shuffled by key and the
    driver sees the keys above the bar, of which there are no more than partitions.
    The sketches may err near it, which only moves the line between salted and unsalted keys:
    both sides of a join use the same list.
    """
    partitions = _salts(df)
    most, tracked = sketch_size(partitions)
    sketch = F.call_function("approx_top_k", F.col(key), F.lit(most), F.lit(tracked))
    bar = df.count() / partitions
    rows = (
        df.groupBy(F.pmod(F.xxhash64(key), F.lit(SKETCHES)).alias("part"))
        .agg(sketch.alias("top"), F.count_if(F.col(key).isNull()).alias("nulls"))
        .select(F.filter("top", lambda entry: entry["count"] > F.lit(bar)).alias("top"), "nulls")
        .collect()
    )
    hot = [entry["item"] for r in rows for entry in r.top if entry["item"] is not None]
    if sum(r.nulls for r in rows) > bar:
        hot.append(None)
    return hot


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    spread_by: Sequence[str],
    how: str = "left",
) -> DataFrame:
    """Equi join that stays balanced when a few keys hold most of the rows of `left`.

    Left rows of a hot key (and of a null key, which matches nothing) are spread over salts
    by the hash of `spread_by`; only the right rows of hot keys are repeated per salt.  The
    right key is dropped from the result.  `left` is read more than once (for its key), so
    it should be a table and not a long plan.  The right side is cut to its keys first: where
    these are few Spark broadcasts them, and a small batch does not move a large catalogue.

    Adaptive execution alone would not do: it splits a skewed partition only where both
    sides of the join come straight from a shuffle, and here the right side often is an
    aggregate.
    """
    keyed = right.withColumnRenamed(right_key, "lookup_key")
    same_key = F.col(left_key) == F.col("lookup_key")
    wanted = left.select(F.col(left_key).alias("wanted_key")).distinct()
    keyed = keyed.join(wanted, F.col("lookup_key") == F.col("wanted_key"), "left_semi")
    hot = hot_keys(left, left_key)
    if not hot:
        return left.join(keyed, same_key, how).drop("lookup_key")
    n = _salts(left)
    values = [k for k in hot if k is not None]
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(n)).cast("int")
    is_spread = F.col(left_key).isNull() | F.col(left_key).isin(values)
    last_salt = F.when(F.col("lookup_key").isin(values), F.lit(n - 1)).otherwise(F.lit(0))
    salted_left = left.withColumn("left_salt", F.when(is_spread, spread).otherwise(F.lit(0)))
    salted_right = keyed.withColumn("right_salt", F.explode(F.sequence(F.lit(0), last_salt)))
    on = same_key & (F.col("left_salt") == F.col("right_salt"))
    return salted_left.join(salted_right, on, how).drop("lookup_key", "left_salt", "right_salt")


def lookup_placed(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, spread_by: Sequence[str]
) -> DataFrame:
    """`lookup_join` (a left join) with a right side that is stored in buckets of its key.

    The right side stays where it is: only `left` is shuffled, to the buckets.  Left rows of hot
    keys would all go to one of them, so these meet a copy of their few right rows instead,
    salted; left rows without a key meet nothing.
    """
    keyed = right.withColumnRenamed(right_key, "lookup_key")
    same_key = F.col(left_key) == F.col("lookup_key")
    hot = hot_keys(left, left_key)
    values = [k for k in hot if k is not None]
    some = left.filter(F.col(left_key).isNotNull())
    cold = some.filter(~F.col(left_key).isin(values)) if values else some
    joined = cold.join(keyed, same_key, "left").drop("lookup_key")
    if values:
        n = _salts(left)
        salted = some.filter(F.col(left_key).isin(values)).withColumn(
            "left_salt", F.pmod(F.xxhash64(*spread_by), F.lit(n)).cast("int")
        )
        copies = keyed.filter(F.col("lookup_key").isin(values)).withColumn(
            "right_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        )
        on = same_key & (F.col("left_salt") == F.col("right_salt"))
        joined = joined.unionByName(salted.join(copies, on, "left").drop("lookup_key", "left_salt", "right_salt"))
    return joined.unionByName(left.filter(F.col(left_key).isNull()), allowMissingColumns=True)


def first_rows(
    df: DataFrame, key: str, order: Sequence[Column], spread_by: Sequence[str], cap: int
) -> DataFrame:
    """At most `cap` rows per key, the first ones in `order`, exact under any skew.

    A row among the first `cap` of its key is also among the first `cap` of its salt, so
    the cap is applied per (key, salt) first, and then to the few rows that are left.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(_salts(df)))
    near = Window.partitionBy(key, "salt").orderBy(*order)
    whole = Window.partitionBy(key).orderBy(*order)
    return (
        df.withColumn("salt", salt)
        .withColumn("place", F.row_number().over(near))
        .filter(F.col("place") <= cap)
        .withColumn("place", F.row_number().over(whole))
        .filter(F.col("place") <= cap)
        .drop("salt", "place")
    )
