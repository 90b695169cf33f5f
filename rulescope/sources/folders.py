"""Folders of a shared file system, through the reader's own listing.

Listing uses Spark's file source, so it works on every path that Spark can
read, in classic and remote sessions alike.  Spark's DataFrame API has no
delete: that goes through the session's Hadoop file system where the session
has one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def data_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame | None:
    """(path) of every data file below the folders; contents are not read.
    None if a folder does not exist."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return files.select("path")


def partition_values(spark: SparkSession, root: str, names: Sequence[str]) -> list[tuple[str, ...]]:
    """Distinct values of the partition levels that hold data files."""
    files = data_files(spark, root)
    if files is None:
        return []
    pattern = "".join(f"/{n}=([^/]+)" for n in names) + "/"
    values = [F.regexp_extract("path", pattern, i + 1).alias(f"v{i}") for i in range(len(names))]
    # One row per partition, not per file.
    rows = files.where(F.col("path").rlike(pattern)).select(*values).distinct().collect()
    return sorted(tuple(r) for r in rows)


def delete(spark: SparkSession, path: str) -> bool:
    """Remove a folder; returns whether it existed."""
    try:
        context = spark.sparkContext
    except Exception as e:  # a remote session has no context
        raise NotImplementedError("deleting a folder needs a classic Spark session") from e
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(context._jsc.hadoopConfiguration())
    return bool(system.exists(target) and system.delete(target, True))


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that is not needed any more, where the session can."""
    try:
        delete(spark, path)
    except NotImplementedError:
        pass
