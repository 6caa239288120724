"""Event clustering on a stream: open clusters are state, timers close them.

The batch operator (``news.cluster_events``) reads a whole table in order; the
stream keeps, for each topic, only the clusters that an article can still
join.  A micro-batch's rows of a topic are placed in the order of (time, id),
so a stream that comes in the order of time gives the batch's assignment
however it is cut into micro-batches, and goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stresslens.functions.text import event_id
from stresslens.operators.news import BEHIND_H, Clusters

_PROVIDER, _ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ClusterProcessor(StatefulProcessor):
    """Places the articles of a topic into its open clusters.

    State by topic: ``open``, a map from a cluster's number (in the order in
    which clusters began) to (leader, hours of its last article, size,
    centroid), and ``next``, the next number.  A timer of event time stands
    where the last article of the longest-lived cluster is ``BEHIND_H`` hours
    old; clusters that no later article can join are removed when it goes off.
    """

    def __init__(self, leader: str):
        self.leader = leader

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "number long", f"leader {self.leader}, last double, size int, centroid array<double>")
        self.next = handle.getValueState("next", "number long")

    def _load(self) -> Clusters:
        clusters = Clusters()
        for number, value in sorted((k[0], v) for k, v in self.open.iterator()):
            clusters.restore(number, value[0], value[1], int(value[2]), np.array(value[3]))
        clusters.next = self.next.get()[0] if self.next.exists() else 0
        return clusters

    def _save(self, clusters: Clusters, before: dict) -> None:
        now = clusters.open_clusters()
        for number in before.keys() - now.keys():
            self.open.removeKey((number,))
        for number, (leader, last, size, centroid) in now.items():
            if number not in before or before[number][2] != size:
                self.open.updateValue((number,), (leader, last, size, centroid))
        self.next.update((clusters.next,))

    def _set_timer(self, clusters: Clusters) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        lasts = [last for _, last, _, _ in clusters.open_clusters().values()]
        if lasts:
            self.handle.registerTimer(int((max(lasts) + BEHIND_H) * 3_600_000) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["hours", "id"], kind="stable")
        clusters = self._load()
        before = clusters.open_clusters()
        out = [(key[0], id, *clusters.place(id, hours, np.asarray(vec, float))) for id, hours, vec in zip(frame["id"], frame["hours"], frame["vec"], strict=True)]
        self._save(clusters, before)
        self._set_timer(clusters)
        yield pd.DataFrame(out, columns=["topic", "id", "leader", "size"], dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 3_600_000
        for (number,), value in list(self.open.iterator()):
            if value[1] + BEHIND_H < now:
                self.open.removeKey((number,))
        self._set_timer(self._load())
        return iter(())

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession):
    """The session with the state store that map state and timers need, for queries started inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def cluster_stream(articles: DataFrame, delay: str = "4 days") -> DataFrame:
    """(topic, id, event_id, size) of a stream ``articles(topic, ts, id, vec)``, as ``news.cluster_events`` has it.

    Start the query inside :func:`keyed_state`.  Articles that come more than
    ``delay`` after newer ones are dropped as late, as in any stream with a
    watermark; those that come out of order within it are placed when they
    come.  A missing ts is the epoch for a table; in a stream such rows are
    late.  A topic's open clusters must fit in one task: those of the last 96
    hours.
    """
    kind = articles.schema["id"].dataType.simpleString()
    hours = F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600.0
    rows = articles.select("topic", F.col("ts").cast("timestamp").alias("ts"), hours.alias("hours"), "id", F.col("vec").cast("array<double>").alias("vec"))
    found = rows.withWatermark("ts", delay).groupBy("topic").transformWithStateInPandas(
        statefulProcessor=ClusterProcessor(kind), outputStructType=f"topic string, id {kind}, leader {kind}, size int", outputMode="append", timeMode="EventTime"
    )
    return found.select("topic", "id", event_id("topic", "leader").alias("event_id"), "size")


def run_clusters(spark: SparkSession, source: str, schema, path: str, checkpoint: str, delay: str = "4 days") -> None:
    """Cluster the files that came to ``source`` since the last run and add the assignments to the table at ``path``.

    Files are taken in the order in which they came.  A run that is stopped
    anywhere is gone on with by the next: state and offsets are in the
    checkpoint, and the table shows only micro-batches that were committed.
    """
    with keyed_state(spark):
        stream = cluster_stream(spark.readStream.schema(schema).parquet(source), delay)
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
