"""Tables written to the shared scratch folder to cut lineage.

A staged table survives the loss of executors, carries true file sizes (so
Spark's own broadcast rule is a size check) and is read column by column.
"""

from __future__ import annotations

import tempfile
import threading
from collections.abc import Callable
from functools import wraps
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}
_passing = threading.local()  # tables written by the functions that run in this thread, innermost last


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder from ``spark.checkpoint.dir``; a local one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="doclabel-")
    return _local_folders[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/doclabel/{name}-{uuid4().hex}"


def stage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as parquet in the scratch folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    for written in getattr(_passing, "open", [])[-1:]:
        written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def passing(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Delete the tables that ``make`` has staged and its result does not read."""

    @wraps(make)
    def made(*args, **kwargs) -> DataFrame:
        _passing.open = [*getattr(_passing, "open", []), []]
        try:
            result = make(*args, **kwargs)
        finally:
            *_passing.open, written = _passing.open
        files = result.inputFiles()
        read = [path for path in written if any(path.split("/")[-1] in file for file in files)]
        for outer in _passing.open[-1:]:
            outer.extend(read)
        spark = result.sparkSession
        for path in written:
            if path not in read:
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        return result

    return made


def spread(df: DataFrame) -> DataFrame:
    """Repartition a freshly read table that has fewer splits than there are cores.

    A corpus of many files has more splits than cores and passes through
    untouched; only a few large row groups are redistributed. Call it right
    after reading: counting the splits of a scan runs nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
