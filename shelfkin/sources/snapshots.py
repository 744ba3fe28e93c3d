"""Files: JSON and parquet, and dated snapshots `{root}/{status}/{dataset}/dt=YYYY-MM-DD`.

A table that may be replaced is written to a folder of its own below its place, `run=ID`, and then
published: an empty file `_published-ORDER-ID` beside it names the run to read, the one with the
greatest order.  Making such a file is atomic on file systems and object stores alike, so a reader
finds the whole old table or the whole new one, and a lost job leaves the old one in place.
"""

from __future__ import annotations

import datetime
import tempfile
import uuid
from collections.abc import Collection, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

# The states a dataset passes through.
RAW, CLEANED, FEATURES, MODELS = "raw", "cleaned", "features", "models"

MANIFEST = "manifest"  # dataset that names the snapshots which belong together
_PUBLISHED, _BUCKETS, _RUN, _DAY = "_published-", "_buckets-", "run=", "dt="


class Snapshot(NamedTuple):
    """One written state of a dataset, whether it is still the one its day shows or not."""

    status: str
    dataset: str
    date: datetime.date
    run: str


def write_json(df: DataFrame, path: str) -> None:
    """One JSON record per line, so that the files can be split when read again."""
    df.write.mode("overwrite").json(path)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _dataset(root: str, status: str, dataset: str) -> str:
    return f"{root.rstrip('/')}/{status}/{dataset}"


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names of what is in a folder; none where there is no folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def published_run(spark: SparkSession, folder: str) -> str | None:
    """The run a folder shows, or none."""
    marks = [name for name in listed(spark, folder) if name.startswith(_PUBLISHED)]
    return max(marks).rsplit("-", 1)[1] if marks else None


def _touch(spark: SparkSession, path: str) -> None:
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(mark, False).close()


def _write_bucketed(df: DataFrame, path: str, key: str) -> None:
    """Rows by the hash of `key`, sorted by it, in as many buckets as a shuffle has partitions.

    Spark makes buckets for tables only, so the folder is one for as long as it is written; an
    empty file keeps the key and the number of buckets.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"shelfkin_{uuid.uuid4().hex}"
    placed = df.repartition(buckets, key)  # a file for each bucket
    placed.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, as the table names their place
    _touch(spark, f"{path}/{_BUCKETS}{buckets}-{key}")


def _scan_run(spark: SparkSession, path: str) -> DataFrame:
    """A run's rows; one in buckets is read as such, so that joins on its key need not move it."""
    mark = next((name for name in listed(spark, path) if name.startswith(_BUCKETS)), None)
    if mark is None:
        return scan_parquet(spark, path)
    buckets, key = mark.removeprefix(_BUCKETS).split("-", 1)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scan_parquet(spark, path).schema)
    name = f"shelfkin_{path.rsplit(_RUN, 1)[1]}"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
        f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def write_published(df: DataFrame, folder: str, key: str | None = None) -> str:
    """Write a run of its own below `folder` and show it from then on; returns the run.

    With `key` the rows are stored in buckets of that column.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    if key is None:
        write_parquet(df, f"{folder}/{_RUN}{run}")
    else:
        _write_bucketed(df, f"{folder}/{_RUN}{run}", key)
    marks = [name for name in listed(spark, folder) if name.startswith(_PUBLISHED)]
    order = 1 + max((int(name.split("-")[1]) for name in marks), default=0)
    _touch(spark, f"{folder}/{_PUBLISHED}{order:012d}-{run}")
    return run


def read_published(spark: SparkSession, folder: str) -> DataFrame:
    run = published_run(spark, folder)
    if run is None:
        raise FileNotFoundError(f"nothing published in {folder}")
    return _scan_run(spark, f"{folder}/{_RUN}{run}")


def _day(root: str, status: str, dataset: str, date: datetime.date) -> str:
    return f"{_dataset(root, status, dataset)}/{_DAY}{date.isoformat()}"


def write_snapshot(
    df: DataFrame, root: str, status: str, dataset: str, date: datetime.date | None = None, key: str | None = None
) -> Snapshot:
    """Store as the snapshot of `date` (today); a second run that day replaces that day only.

    With `key` it is stored in buckets of that column, for lookups that do not move it.

    An empty result is a snapshot too: it leaves a file with the schema and no rows.  What was
    shown before stays readable by name until `remove_superseded`.
    """
    day = date or datetime.date.today()
    return Snapshot(status, dataset, day, write_published(df, _day(root, status, dataset, day), key))


def days(spark: SparkSession, root: str, status: str, dataset: str) -> list[Snapshot]:
    """The published snapshot of every day of a dataset, latest first, from directory listings."""
    names = sorted((n for n in listed(spark, _dataset(root, status, dataset)) if n.startswith(_DAY)), reverse=True)
    dates = [datetime.date.fromisoformat(n.removeprefix(_DAY)) for n in names]
    runs = [published_run(spark, _day(root, status, dataset, d)) for d in dates]
    return [Snapshot(status, dataset, d, run) for d, run in zip(dates, runs) if run is not None]


def latest(spark: SparkSession, root: str, status: str, dataset: str) -> Snapshot:
    """The snapshot of the greatest date; days without a published one are passed over."""
    names = sorted((n for n in listed(spark, _dataset(root, status, dataset)) if n.startswith(_DAY)), reverse=True)
    for name in names:
        date = datetime.date.fromisoformat(name.removeprefix(_DAY))
        run = published_run(spark, _day(root, status, dataset, date))
        if run is not None:
            return Snapshot(status, dataset, date, run)
    raise FileNotFoundError(f"no snapshot of {dataset} under {status}")


def latest_date(spark: SparkSession, root: str, status: str, dataset: str) -> datetime.date:
    """Greatest date of a published snapshot of a dataset."""
    return latest(spark, root, status, dataset).date


def read(spark: SparkSession, root: str, snapshot: Snapshot) -> DataFrame:
    """Exactly this snapshot, also when its day shows another by now."""
    place = _day(root, snapshot.status, snapshot.dataset, snapshot.date)
    return _scan_run(spark, f"{place}/{_RUN}{snapshot.run}")


def read_snapshot(
    spark: SparkSession, root: str, status: str, dataset: str, date: datetime.date
) -> DataFrame:
    """One day of a dataset; only that day's directory is listed and read."""
    return read_published(spark, _day(root, status, dataset, date))


def read_latest(spark: SparkSession, root: str, status: str, dataset: str) -> DataFrame:
    """The latest snapshot of a dataset; an error when there is none."""
    return read(spark, root, latest(spark, root, status, dataset))


def read_days(spark: SparkSession, root: str, status: str, dataset: str) -> DataFrame:
    """Every published day of a dataset, with its date as column `dt`."""
    paths = [f"{_day(root, *s[:3])}/{_RUN}{s.run}" for s in days(spark, root, status, dataset)]
    if not paths:
        raise FileNotFoundError(f"no snapshot of {dataset} under {status}")
    return spark.read.option("basePath", _dataset(root, status, dataset)).parquet(*paths).drop("run")


def write_manifest(
    spark: SparkSession, root: str, status: str, snapshots: Collection[Snapshot], date: datetime.date | None = None
) -> Snapshot:
    """Name the snapshots that belong together; they count as a unit once this is published."""
    rows = [(s.status, s.dataset, s.date, s.run) for s in snapshots]
    table = spark.createDataFrame(rows, "status string, dataset string, date date, run string").coalesce(1)
    return write_snapshot(table, root, status, MANIFEST, date)


def read_manifest(spark: SparkSession, root: str, status: str) -> dict[tuple[str, str], Snapshot]:
    """The snapshots of the latest manifest by (status, dataset): a row for each dataset."""
    rows = read_latest(spark, root, status, MANIFEST).collect()
    return {(r.status, r.dataset): Snapshot(r.status, r.dataset, r.date, r.run) for r in rows}


def remove_superseded(
    spark: SparkSession, root: str, status: str, dataset: str, keep: Collection[Snapshot] = ()
) -> list[Snapshot]:
    """Remove the runs of a dataset that no day shows and that are not in `keep`; returns them.

    `keep` are the snapshots of the manifests still in use.  Not to be run beside a writer of the
    dataset, whose run is not published yet.
    """
    kept = {s.run for s in keep} | {s.run for s in days(spark, root, status, dataset)}
    gone = []
    for name in listed(spark, _dataset(root, status, dataset)):
        place = f"{_dataset(root, status, dataset)}/{name}"
        for run in (r.removeprefix(_RUN) for r in listed(spark, place) if r.startswith(_RUN)):
            if run not in kept:
                remove(spark, f"{place}/{_RUN}{run}")
                gone.append(Snapshot(status, dataset, datetime.date.fromisoformat(name.removeprefix(_DAY)), run))
    return gone


@lru_cache(maxsize=1)
def _temporary_folder() -> str:
    return tempfile.mkdtemp(prefix="shelfkin-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that every executor can reach.

    It lies in the folder the cluster names in `spark.checkpoint.dir`.  Where that is unset, a
    local master gets a temporary one; on a cluster the executors would not see it, so the job
    stops.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _temporary_folder()
    return f"{base.rstrip('/')}/shelfkin-{uuid.uuid4().hex}"


# Folders made by `stored` inside the block that is open, if any: each thread has its own.
_OPEN: ContextVar[list[str] | None] = ContextVar("open", default=None)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Removes what `stored` writes inside the block; for jobs that write their result in it."""
    made: list[str] = []
    before = _OPEN.set(made)
    try:
        yield
    finally:
        _OPEN.reset(before)
        for folder in made:
            remove(spark, folder)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """`df` written to the shared folder and read back: computed once, lineage cut."""
    folder = shared_folder(df.sparkSession)
    made = _OPEN.get()
    if made is not None:
        made.append(folder)
    path = f"{folder}/{name}"
    write_parquet(df, path)
    return scan_parquet(df.sparkSession, path)
