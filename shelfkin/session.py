"""Session settings the jobs are written for, and the package on the workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


@lru_cache(maxsize=1)
def _archive() -> str:
    """This package as a zip file; it must last as long as executors may ask the driver for it."""
    here = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="shelfkin-package-"), f"{here.name}.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(here.rglob("*.py")):
            archive.write(file, file.relative_to(here.parent))
    return path


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, wherever the driver was started.

    `build_session` does so; call it once for a session made otherwise, unless the package is
    installed on the executors.
    """
    spark.sparkContext.addPyFile(_archive())


def build_session(app_name: str = "shelfkin", **extra: str) -> SparkSession:
    """A session with the settings above; on a cluster the master comes from spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark
