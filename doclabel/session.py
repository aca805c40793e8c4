"""Session settings the engine is designed for."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
_shipped: dict[str, set[str]] = {}


def get_session(app_name: str = "doclabel", master: str | None = None, **extra: str) -> SparkSession:
    """Build (or fetch) a session; ``extra`` settings override the defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession, folder: str | Path = Path(__file__).resolve().parent) -> None:
    """Send a package folder to the Python workers, once per application.

    Functions sent to executors name their module; workers import it from this
    archive, whether or not the package is installed on their machines.
    """
    folder = Path(folder)
    done = _shipped.setdefault(spark.sparkContext.applicationId, set())
    if str(folder) in done:
        return
    handle, archive = tempfile.mkstemp(prefix=f"{folder.name}-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(archive, "w") as packed:
        for file in sorted(folder.rglob("*.py")):
            packed.write(file, file.relative_to(folder.parent).as_posix())
    spark.sparkContext.addPyFile(archive)
    done.add(str(folder))
