"""Intermediate tables in the folder that all executors share.

The cluster names that folder in ``spark.checkpoint.dir``.  A table written
there cuts the lineage and outlives lost executors.  Only on one machine
(a ``local`` master) a temporary folder takes its place where the setting is
missing; on a cluster that is an error.  What was written goes when the
driver's JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a narrow intermediate table that one task writes.
ROWS_A_TASK = 50_000

_fallback: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new, unused folder path under the shared checkpoint folder, deleted when the driver's JVM ends."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _fallback:
            _fallback.append("file://" + tempfile.mkdtemp(prefix="stresslens-"))
        base = _fallback[0]
    path = f"{base.rstrip('/')}/stresslens-{uuid.uuid4().hex}"
    _place(spark, path)[0].deleteOnExit(_place(spark, path)[1])
    return path


def _place(spark: SparkSession, path: str) -> tuple:
    """The file system of a path and the path, as the JVM knows them."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder now."""
    files, there = _place(spark, path)
    files.delete(there, True)


def tasks_for(rows: int) -> int:
    """Tasks to write a narrow table of about so many rows; small tables would else be dealt to as many tasks as large ones."""
    return max(8, rows // ROWS_A_TASK)


def save(df: DataFrame, compression: str = "zstd", tasks: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to a new shared folder, with at most ``tasks`` tasks if given, and read it back."""
    path = folder(df.sparkSession)
    df = df.coalesce(tasks) if tasks else df
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
