"""Item and user features: fit (aggregations) and transform (projections), kept apart.

An item's features are two columns instead of one wide row: `numeric`, five doubles, and
`labels`, the sorted vocabulary positions of its tags and genres.  Plan size then does not
depend on the vocabulary, and a tag and a genre of the same name cannot collide.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from shelfkin.functions import dates, numbers
from shelfkin.operators.frames import drop_columns
from shelfkin.sources.snapshots import stored

LABEL_COLUMNS = ("tags", "genres")
SCALED_COLUMNS = ("popularity", "chapters", "averageScore", "release_year")
NUMERIC_COLUMNS = ("popularity", "chapters", "averageScore", "has_end_date", "release_year")
UNUSED_COLUMNS = ("title", "volumes", "description", "favourites", "meanScore")


class ItemParams(NamedTuple):
    """Fitted state: `vocab(kind, term, index)` and `scaler(col, mean, std)`."""

    vocab: DataFrame
    scaler: DataFrame


def with_release_year(df: DataFrame) -> DataFrame:
    year = dates.release_year(F.col("startDate"))
    return df.withColumn("release_year", year).drop("startDate")


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with a null (or NaN) in any column; an empty array is not null.

    Written as plain predicates, which reach the scan (those of `dropna` do not).
    """
    complete = F.lit(True)
    for field in df.schema:
        complete = complete & F.col(field.name).isNotNull()
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            complete = complete & ~F.isnan(field.name)
    return df.filter(complete)


def prepare_items(clean: DataFrame) -> DataFrame:
    """The complete rows that features are made from, counts on a log scale."""
    return (
        drop_columns(clean, *UNUSED_COLUMNS)
        .transform(with_release_year)
        .transform(drop_incomplete)
        .withColumns(
            {
                "popularity": numbers.log_popularity(F.col("popularity")),
                "chapters": numbers.log_chapters(F.col("chapters")),
            }
        )
    )


def label_terms(df: DataFrame) -> DataFrame:
    """Distinct `(slot, term)` of the label columns, in one pass over the items."""

    def slotted(slot: int, column: str) -> Column:
        label = F.lit(slot).alias("slot")
        return F.transform(column, lambda t: F.struct(label, t.alias("term")))

    terms = [slotted(slot, c) for slot, c in enumerate(LABEL_COLUMNS)]
    exploded = df.select(F.explode(F.concat(*terms)).alias("label")).select("label.*")
    return exploded.filter(F.col("term").isNotNull()).distinct()


def fit_vocab(df: DataFrame) -> DataFrame:
    """Sorted label sets with their positions: tags first, then genres.

    The order is by code point, which is the binary order of strings in Spark.  There is no
    single-task sort: terms are range-partitioned, sorted and numbered within each partition as
    they are written; the offsets are a running sum over one row per partition.
    """
    terms = label_terms(df)
    parts = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = terms.repartitionByRange(parts, "slot", "term").sortWithinPartitions("slot", "term")
    # The upper bits of the number are the partition's, the lower 33 count its rows.
    numbered = stored(ranged.withColumn("number", F.monotonically_increasing_id()), "terms")
    part, within = F.shiftright("number", 33), F.col("number").bitwiseAND((1 << 33) - 1)
    sizes = numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("part").alias("in_part"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset")
    )
    return (
        numbered.join(F.broadcast(offsets), part == F.col("in_part"))  # one row per partition
        .select(
            F.element_at(F.array(*map(F.lit, LABEL_COLUMNS)), F.col("slot") + 1).alias("kind"),
            "term",
            (F.col("offset") + within).cast("int").alias("index"),
        )
    )


def _label_key(kind: Column, term: Column) -> Column:
    """64 bits that stand for a label, so that its text need not be moved."""
    return F.xxhash64(kind, term)


def vocab_keys(vocab: DataFrame) -> DataFrame:
    """`(label_key, index)`; two labels of a vocabulary with one key would stop the job."""
    one = F.when(F.count(F.lit(1)) == 1, F.min("index")).otherwise(
        F.raise_error(F.lit("two labels of the vocabulary share a key"))
    )
    return vocab.groupBy(_label_key(F.col("kind"), F.col("term")).alias("label_key")).agg(one.alias("index"))


def multi_hot(df: DataFrame, vocab: DataFrame, key: str = "id") -> DataFrame:
    """Replace the label columns by `labels`, the sorted positions of the labels present.

    A repeated label counts once and a label outside the vocabulary is ignored.  Labels become
    64-bit keys next to the scan and only these and the row's key meet the vocabulary, in a plain
    join of two tables: a small vocabulary is broadcast by its measured size, and adaptive
    execution splits the rows of a label that most items have.
    """

    def keys(column: str) -> Column:
        present = F.filter(F.array_distinct(column), lambda t: t.isNotNull())
        return F.transform(present, lambda t: _label_key(F.lit(column), t))

    exploded = df.select(F.col(key).alias("labelled"), F.explode(F.concat(*map(keys, LABEL_COLUMNS))).alias("label_key"))
    found = exploded.join(vocab_keys(vocab), "label_key")
    labels = found.groupBy("labelled").agg(F.sort_array(F.collect_list("index")).alias("labels"))
    joined = df.drop(*LABEL_COLUMNS).join(labels, F.col(key) == F.col("labelled"), "left")
    return joined.withColumn(
        "labels", F.coalesce("labels", F.array().cast("array<int>"))
    ).drop("labelled")


def fit_scaler(df: DataFrame) -> DataFrame:
    """Mean and population standard deviation of each scaled column, from one aggregation."""
    stats = df.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in SCALED_COLUMNS],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in SCALED_COLUMNS],
    )
    rows = [
        F.struct(
            F.lit(c).alias("col"),
            F.col(f"{c}_mean").alias("mean"),
            F.col(f"{c}_std").alias("std"),
        )
        for c in SCALED_COLUMNS
    ]
    return stats.select(F.inline(F.array(*rows)))


def apply_scaler(df: DataFrame, scaler: DataFrame) -> DataFrame:
    """(x - mean) / std, with a zero deviation read as 1.

    The parameters are one row per scaled column and reach the tasks as a scalar subquery.
    """
    params = scaler.agg(
        F.map_from_entries(F.collect_list(F.struct("col", F.struct("mean", "std"))))
    ).scalar()

    def scaled(name: str) -> Column:
        std = F.col("scaling")[name]["std"]
        divisor = F.when(std == 0, F.lit(1.0)).otherwise(std)
        return (F.col(name) - F.col("scaling")[name]["mean"]) / divisor

    return df.withColumn("scaling", params).withColumns(
        {c: scaled(c) for c in SCALED_COLUMNS}
    ).drop("scaling")


def _fit(prepared: DataFrame) -> ItemParams:
    return ItemParams(
        vocab=stored(fit_vocab(prepared), "vocab"), scaler=stored(fit_scaler(prepared), "scaler")
    )


def _transform(prepared: DataFrame, params: ItemParams) -> DataFrame:
    return multi_hot(apply_scaler(prepared, params.scaler), params.vocab).select(
        "id",
        F.array(*[F.col(c).cast("double") for c in NUMERIC_COLUMNS]).alias("numeric"),
        "labels",
    )


def fit_item_features(clean: DataFrame) -> ItemParams:
    """Both parameter tables, stored: they are read by every transform."""
    return _fit(stored(prepare_items(clean), "prepared"))


def transform_item_features(clean: DataFrame, params: ItemParams) -> DataFrame:
    """`(id, numeric, labels)` for every complete item, with parameters fitted before."""
    return _transform(stored(prepare_items(clean), "prepared"), params)


def item_features(clean: DataFrame) -> tuple[DataFrame, ItemParams]:
    """Fit on these items and transform them; they are prepared once."""
    prepared = stored(prepare_items(clean), "prepared")
    params = _fit(prepared)
    return _transform(prepared, params), params


def user_features(clean: DataFrame) -> DataFrame:
    """Interactions with the status as its weight, and the strength of each."""
    return (
        drop_columns(clean, "createdAt", "progress")
        .withColumn("status", numbers.status_weight(F.col("status")))
        .withColumn(
            "interaction_strength",
            numbers.interaction_strength(F.col("status"), F.col("score")),
        )
    )
