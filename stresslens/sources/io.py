"""Readers and writers: permissive JSON lines, wrapped JSON, CSV series, feeds and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stresslens.operators.series import clean_series


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; blank and broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON document; an empty table with the schema if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def wrapped_json(text: Column, name: str, schema: str) -> Column:
    """The value of ``window.NAME = {...};`` in a script."""
    return F.from_json(F.regexp_extract(text, rf"(?s)window\.{name}\s*=\s*(.*?);?\s*$", 1), schema)


def read_wrapped_json(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Scripts that assign a JSON value to a window variable."""
    return spark.read.text(path, wholetext=True).select(wrapped_json(F.col("value"), name, schema).alias("v")).select("v.*")


def read_series_csv(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, d, v) of a two-column CSV file of dates and values; rows without a number are dropped."""
    raw = spark.read.csv(path, header=True).toDF("date", "value").withColumn("key", F.lit(key))
    return clean_series(raw, "key", "date", "value")


def read_feed(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Entries of RSS files: title, link, description, pubDate; one row for each ``row_tag``."""
    schema = "title string, link string, description string, pubDate string"
    return spark.read.format("xml").schema(schema).option("rowTag", row_tag).load(path)


def read_atom(spark: SparkSession, path: str, row_tag: str = "entry") -> DataFrame:
    """Entries of Atom files in the columns of :func:`read_feed`."""
    schema = "title string, link struct<_href:string>, summary string, content string, updated string, published string"
    raw = spark.read.format("xml").schema(schema).option("rowTag", row_tag).load(path)
    return raw.select("title", F.col("link._href").alias("link"), F.coalesce("summary", "content").alias("description"), F.coalesce("published", "updated").alias("pubDate"))


def write_snapshot(df: DataFrame, path: str) -> None:
    """JSON lines, replacing what is there."""
    df.write.mode("overwrite").json(path)


def append_log(spark: SparkSession, log: DataFrame, entries: DataFrame, ts: str, keep: int = 100) -> DataFrame:
    """The newest ``keep`` entries of a log and its additions (a bound of the log)."""
    return log.unionByName(entries).orderBy(F.desc(ts)).limit(keep)
