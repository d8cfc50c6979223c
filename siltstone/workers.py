"""This package on the Python workers.

Functions that run on Arrow batches are sent to the workers by name, so the workers must be able to import this
package. Where the session was started without it on their path, it is shipped as an archive, once per
application, before the first such function.
"""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="siltstone-code-")
    copy = Path(folder, "copy", package.name)
    shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
    archive = shutil.make_archive(str(Path(folder, package.name)), "zip", copy.parent, package.name)
    sc.addPyFile(archive)
    shutil.rmtree(copy.parent)
    _SHIPPED.add(sc.applicationId)


def ship_to_active() -> None:
    """For functions that become columns, where no rows are at hand: ship to the active session."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)


def with_code(df: DataFrame) -> DataFrame:
    """The same rows; the workers of its session can import this package."""
    ship(df.sparkSession)
    return df
