"""Tables that a plan reads more than once, written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []
_named: dict[tuple[str, str], str] = {}


def new_folder(spark: SparkSession) -> str:
    """A new, unused path under ``spark.checkpoint.dir``, deleted when the driver's JVM ends.

    Only a ``local`` master may leave the setting out: a temporary folder is used.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _fallback:
            _fallback.append("file://" + tempfile.mkdtemp(prefix="stresslens-core-"))
        base = _fallback[0]
    path = f"{base.rstrip('/')}/stresslens-core-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def session_folder(spark: SparkSession, name: str) -> str:
    """A :func:`new_folder` that stays the same for a name as long as the application runs."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _named:
        _named[key] = new_folder(spark)
    return _named[key]


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to a :func:`new_folder` and read back.

    The lineage ends there, and lost executors don't take it along.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
