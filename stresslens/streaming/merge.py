"""Incremental upkeep of a corpus: batches are merged into a table stored by days, of which only the touched parts are rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stresslens.operators.news import dedup_by_key, merge_rows
from stresslens.sources.shared import kept
from stresslens.sources.versioned import VersionLog


class DailyTable:
    """Rows with a unique key and a day, kept for ``keep_days`` before the newest day, stored in parts of ``days_a_part`` days.

    A batch is merged as ``news.merge_rows`` has it: its rows win column by
    column, columns that only the stored row has are kept.  Only parts that
    hold a row of the batch, or held one under another day, are written anew,
    beside the old ones; the next version of the log then names them.  A
    batch whose number isn't greater than the writer's last one was merged
    before and changes nothing, so a stream may repeat its batches.  Rows
    older than the kept days don't come back; parts that are all too old are
    dropped from the version without being read.

    Rows without a key or a day are left out.  Of rows that repeat a key in a
    batch the first by ``order`` counts.  Names starting with ``_part`` and
    ``_keep`` are the table's own.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, day: str, keep_days: int = 365, days_a_part: int = 1):
        self.key, self.day, self.keep_days, self.days_a_part = key, day, keep_days, days_a_part
        self.log = VersionLog(spark, path)

    def _part(self) -> Column:
        return F.floor(F.datediff(F.to_date(self.day), F.lit("1970-01-01").cast("date")) / self.days_a_part).cast("int")

    def _stored(self, spark: SparkSession, state: dict, parts: list[int] | None = None) -> DataFrame:
        """The rows of the version, of some parts only if asked."""
        schema = StructType.fromJson(state["schema"])
        folders = [f for p, f in state["parts"].items() if parts is None or int(p) in parts]
        if not folders:
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(schema).parquet(*[self.log.data(f) for f in folders])
        return rows.where(F.to_date(self.day) >= F.lit(state["oldest"]).cast("date"))

    def read(self, spark: SparkSession) -> DataFrame:
        """The newest version."""
        _, state = self.log.latest()
        if not state:
            raise ValueError(f"nothing was merged into {self.log.folder.path} yet")
        return self._stored(spark, state)

    def merge(self, batch: DataFrame, number: int, writer: str = "stream", order: list[Column] | None = None) -> bool:
        """Merge a batch; False if it was merged before."""
        spark = batch.sparkSession
        version, state = self.log.latest()
        if state and number <= state["applied"].get(writer, -1):
            return False
        usable = batch.where(F.col(self.key).isNotNull() & F.col(self.day).isNotNull())
        rows = kept(dedup_by_key(usable, [self.key], order or [F.col(self.day).desc(), F.xxhash64(*map(F.col, batch.columns))]))
        newest = rows.agg(F.max(F.to_date(self.day)).cast("string")).first()[0]
        newest = max(filter(None, (newest, state.get("newest"))), default=None)
        content = {"applied": state.get("applied", {}) | {writer: number}, "parts": dict(state.get("parts", {})), "newest": newest, "oldest": state.get("oldest"), "schema": state.get("schema", batch.schema.jsonValue())}
        if newest is not None:
            content["oldest"] = str(spark.sql(f"SELECT date_sub(DATE'{newest}', {self.keep_days})").first()[0])
            self._rewrite(spark, rows, version + 1, state, content)
        self.log.commit(version + 1, content)
        return True

    def _rewrite(self, spark: SparkSession, rows: DataFrame, version: int, state: dict, content: dict) -> None:
        parts = {r[0] for r in rows.select(self._part()).distinct().collect()}  # days, not rows
        merged = rows
        if state:
            # a key may be stored under another day: keys and days of the table are read, nothing else
            elsewhere = self._stored(spark, state).select(self.key, self.day).join(rows.select(self.key), self.key, "left_semi")
            parts |= {r[0] for r in elsewhere.select(self._part()).distinct().collect()}
            merged = merge_rows(self._stored(spark, state, sorted(parts)), rows, self.key)
            content["schema"] = merged.schema.jsonValue()
        merged = merged.where(F.to_date(self.day) >= F.lit(content["oldest"]).cast("date")).withColumn("_part", self._part())
        folder = f"v{version:08d}"
        merged.hint("rebalance", "_part").write.mode("overwrite").partitionBy("_part").parquet(self.log.data(folder))
        written = {n[6:]: f"{folder}/{n}" for n in self.log.folder.names(f"data/{folder}") if n.startswith("_part=")}
        first = spark.sql(f"SELECT datediff(DATE'{content['oldest']}', DATE'1970-01-01')").first()[0] // self.days_a_part
        stay = {p: f for p, f in content["parts"].items() if int(p) not in parts}
        content["parts"] = {p: f for p, f in (stay | written).items() if int(p) >= first}

    def vacuum(self) -> list[str]:
        """Delete the folders that the newest version has nothing in."""
        return self.log.vacuum({f.split("/")[0] for f in self.log.latest()[1].get("parts", {}).values()})


def merge_stream(stream: DataFrame, table: DailyTable, checkpoint: str, writer: str = "stream", order: list[Column] | None = None) -> None:
    """Merge all micro-batches of a stream that are there, and stop; repeated batches change nothing."""
    query = stream.writeStream.foreachBatch(lambda batch, number: table.merge(batch, number, writer, order) and None)
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
