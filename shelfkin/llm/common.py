"""What the operators here share: tables in the shared folder, Arrow batches, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfkin.sources.snapshots import remove, shared_folder

# Tables that the operator running in this thread will remove, if one is.
_OPEN: ContextVar[list[str] | None] = ContextVar("open", default=None)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster names in `spark.checkpoint.dir`."""
    return f"{shared_folder(spark)}-{name}"


def parts_of(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `size` bytes of text, so that what is made of a part stays small."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Removes what `stored` writes inside the block, but for what is marked as lasting.

    What leaves the block may read lasting tables only.
    """
    made: list[str] = []
    before = _OPEN.set(made)
    try:
        yield
    finally:
        _OPEN.reset(before)
        for path in made:
            remove(spark, path)


def stored(
    df: DataFrame, name: str, codec: str = "snappy", lasting: bool = False, block_bytes: int | None = None
) -> DataFrame:
    """`df` written to the shared folder and read back: computed once, lineage cut.

    Lasting tables are read by a lazy result; they are left to the folder's retention rule.  Tables
    of few large rows want row groups of fewer bytes, as a reader holds a whole one of these.
    """
    path = shared_path(df.sparkSession, name)
    made = _OPEN.get()
    if not lasting and made is not None:
        made.append(path)
    writer = df.write.option("compression", codec)
    if block_bytes is not None:
        writer = writer.option("parquet.block.size", block_bytes)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what runs inside: for tables of few large rows.

    A batch is built outside the heap, in buffers that double as they grow, so large rows by the
    usual number would take far more memory than they hold.  No result depends on it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_of(column: str = "text"):
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column), F.lit("")).alias(column)


def map_batches(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """`rows` applied to every Arrow batch of `df`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield rows(batch)

    return df.mapInArrow(run, schema)


def _mark(edges: DataFrame) -> tuple:
    """Count and hash sum of an edge table, to see whether a round changed it."""
    hashed = F.xxhash64("a", "b").cast("decimal(38,0)")
    row = edges.agg(F.count(F.lit(1)), F.sum(hashed)).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge table (a, b) of longs: rows (node, root), root smallest.

    Alternating large-star and small-star rounds; their number grows with the logarithm of the
    longest chain.  Each round reads and writes tables, so that adaptive execution sees both
    sides of each join as plain shuffles and can split a hub, and so that nothing is recomputed
    when an executor is lost.
    """
    tidy = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stored(tidy.distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low")), "low")
        large = stored(
            both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(),
            "large",
        )
        least = stored(large.groupBy("a").agg(F.min("b").alias("low")), "least")
        small = large.join(least, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = stored(small.unionByName(least.select("a", F.col("low").alias("b"))).distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
