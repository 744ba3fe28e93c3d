"""Run records, the ledger of stages, and row counts.

Both are kept under the id of their run, so a run that is repeated replaces what it recorded.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfkin.sources.snapshots import listed, read_published, write_published

MODEL_TYPE = "cosine_similarity"  # fixed value: what a training run records about itself


def run_metrics(
    features: DataFrame, vocab: DataFrame, numeric_columns: int, feature_store: str
) -> DataFrame:
    """One row about a training run; the feature count includes the id column."""
    labels = vocab.agg(F.count(F.lit(1)).alias("labels")).scalar()
    return features.agg(F.count(F.lit(1)).alias("num_items")).select(
        F.lit(MODEL_TYPE).alias("model_type"),
        F.lit(feature_store).alias("feature_store"),
        "num_items",
        (labels + F.lit(numeric_columns + 1)).alias("num_features"),
    )


def record_run(metrics: DataFrame, path: str, run_id: str) -> None:
    """Keep the metrics of a run under its id, in place of an earlier record of the same run."""
    write_published(metrics.coalesce(1), f"{path}/{_safe(run_id)}")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The records of all runs, with their `run_id`: one for each run."""
    return _together(spark, path, "run_id")


class StageRows(NamedTuple):
    """What a stage did with one dataset."""

    dataset: str
    rows_in: int | None  # null where the stage does not read the dataset row by row
    rows_out: int
    rejected: int | None = None


def record_stage(spark: SparkSession, path: str, run_id: str, stage: str, rows: Sequence[StageRows]) -> None:
    """Keep what a stage of a run counted while it wrote, in place of an earlier record of it."""
    table = spark.createDataFrame(list(rows), "dataset string, rows_in bigint, rows_out bigint, rejected bigint")
    write_published(table.coalesce(1), f"{path}/{_safe(run_id)}/{_safe(stage)}")


def read_ledger(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """`(stage, dataset, rows_in, rows_out, rejected)` of a run."""
    return _together(spark, f"{path}/{_safe(run_id)}", "stage")


def _safe(name: str) -> str:
    """A name that is one folder."""
    if not name or name.startswith(("_", ".")) or any(c in name for c in "/\\:=*?[]{}"):
        raise ValueError(f"not a name for a run or stage: {name!r}")
    return name


def _together(spark: SparkSession, path: str, column: str) -> DataFrame:
    tables = [
        read_published(spark, f"{path}/{name}").withColumn(column, F.lit(name)) for name in sorted(listed(spark, path))
    ]
    if not tables:
        raise FileNotFoundError(f"nothing recorded in {path}")
    out = tables[0]
    for one in tables[1:]:
        out = out.unionByName(one)
    return out.select(column, *[c for c in out.columns if c != column])


def rows_per_user(df: DataFrame) -> DataFrame:
    return df.groupBy("userId").agg(F.count(F.lit(1)).alias("rows"))


def stage_counts(**stages: DataFrame) -> DataFrame:
    """`(stage, rows)` for each named stage."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("stage"), "rows")
        for name, df in stages.items()
    ]
    out = counted[0]
    for one in counted[1:]:
        out = out.unionAll(one)
    return out
