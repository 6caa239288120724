"""News-like rows: merge and retention, rollups, escalation index, campaigns and event clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stresslens.functions.scalars import momentum
from stresslens.functions.text import event_id
from stresslens.operators.ordered import in_ranges, running_sums


def dedup_by_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert: rows of ``new`` win column by column, columns that only ``old`` has are kept."""
    columns = list(dict.fromkeys(old.columns + new.columns))
    o, n = old.withColumn("_o", F.lit(True)).alias("o"), new.withColumn("_n", F.lit(True)).alias("n")

    def pick(c: str) -> Column:
        if c == key:
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
        if c in new.columns and c in old.columns:
            return F.when(F.col("n._n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        return F.col(f"{'n' if c in new.columns else 'o'}.{c}")

    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*[pick(c).alias(c) for c in columns])


def retain(rows: DataFrame, ts: str, as_of: str, days: int, most: int, tie: str, ascending: bool = False) -> DataFrame:
    """Rows of the last ``days`` before ``as_of``, the newest ``most`` of them (a bound of the store); oldest first if asked."""
    fresh = rows.where(F.col(ts) >= F.date_sub(F.lit(as_of).cast("date"), days).cast(rows.schema[ts].dataType))
    newest = fresh.orderBy(F.desc(ts), F.desc(tie)).limit(most)
    return newest.orderBy(ts, tie) if ascending else newest


def upsert_history(old: DataFrame, new: DataFrame, date: str = "d", keep: int = 365) -> DataFrame:
    """History with the dates of ``new`` replaced, the newest ``keep`` dates (a bound of the store)."""
    rest = old.join(new.select(date), date, "left_anti")
    return rest.unionByName(new).orderBy(F.desc(date)).limit(keep)


def daily_rollup(rows: DataFrame, ts: str, event: str, publisher: str, relevance: str, kinds: dict[str, Column], digits: int = 4) -> DataFrame:
    """Per (day, kind, key): rows, distinct events and publishers, mean and greatest relevance.

    ``kinds`` maps a kind to an array of keys of the row; a row counts once
    under each.
    """

    def tagged(kind: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.cast("string").alias("key")))

    parts = [tagged(kind, keys) for kind, keys in kinds.items()]
    long = rows.select(F.to_date(ts).alias("day"), event, publisher, relevance, F.explode(F.concat(*parts)).alias("k"))
    return long.groupBy("day", "k.kind", "k.key").agg(
        F.count("*").alias("article_count"), F.countDistinct(event).alias("event_count"), F.countDistinct(publisher).alias("publisher_count"),
        F.round(F.avg(relevance), digits).alias("avg_relevance"), F.round(F.max(relevance), 4).alias("max_relevance"),
    )


#: The dimensions of an event that its daily series count.
COUNTED = {"physical_events": "physical_attack", "critical_infrastructure_events": "critical_infrastructure", "attributed_events": "reported_attribution", "military_response_events": "military_response", "explicit_threat_events": "explicit_threat"}


def geopolitical_series(events: DataFrame, day: Column, digits: int = 2) -> DataFrame:
    """Per (day, kind, key): events, those with each of five dimensions, mean and greatest score.

    ``events`` has one row for each event: actors, modalities and targets
    (arrays), attributions (actor, status), dimensions (array), event_score;
    ``day`` is that of its first article.  The kinds are overall,
    actor_mention, reported_attribution, modality and target; an event counts
    once under each key.  Events without a day are left out.
    """

    def tagged(kind: str, keys: Column) -> Column:
        return F.transform(F.filter(F.array_distinct(F.coalesce(keys, F.array().cast("array<string>"))), lambda k: k.isNotNull() & (k != "")), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    said = F.transform("attributions", lambda a: a["actor"])
    kinds = F.concat(
        tagged("overall", F.array(F.lit("geopolitical_hybrid"))), tagged("actor_mention", F.col("actors")), tagged("reported_attribution", said),
        tagged("modality", F.col("modalities")), tagged("target", F.col("targets")),
    )
    score = F.coalesce("event_score", F.lit(0.0))
    flags = [F.coalesce(F.array_contains("dimensions", name), F.lit(False)).alias(column) for column, name in COUNTED.items()]
    long = events.select(day.alias("day"), score.alias("score"), *flags, F.explode(kinds).alias("k")).where("day is not null")
    return long.groupBy("day", "k.kind", "k.key").agg(
        F.count("*").alias("event_count"), *[F.count_if(c).alias(c) for c in COUNTED],
        F.round(F.avg("score"), digits).alias("avg_event_score"), F.round(F.greatest(F.lit(0.0), F.max("score")), digits).alias("max_event_score"),
    )


def event_rollup(rows: DataFrame, event: str, order: list[str], label: str, members: str, measure: str) -> DataFrame:
    """Per event: rows, first and last position, greatest measure, first label, sorted distinct members."""
    first = F.struct(*order)
    return rows.groupBy(event).agg(
        F.count("*").alias("article_count"), F.min(order[0]).alias("first_seen"), F.max(order[0]).alias("last_seen"), F.max(measure).alias("max_measure"),
        F.min_by(label, first).alias("label"), F.array_join(F.array_sort(F.collect_set(members)), ",").alias("members"),
    )


#: Attribution statuses from weak to strong.
STATUSES = ("suspected", "attributed", "disputed")


def strongest(status: Column | str) -> Column:
    """Aggregate: the status of the highest priority."""
    s = F.col(status) if isinstance(status, str) else status
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), s)
    return F.max_by(s, rank)


def top_share_mean(rows: DataFrame, value: str, share: float = 0.25, by: list[str] | None = None, tie: str | None = None) -> DataFrame:
    """Mean of the greatest ceil(share * n) values, at least one."""
    by = by or []
    w = Window.partitionBy(*by)
    order = w.orderBy(F.desc(value), *([tie] if tie else []))
    ranked = rows.withColumns({"_r": F.row_number().over(order), "_n": F.count("*").over(w)})
    return ranked.where(F.col("_r") <= F.greatest(F.lit(1), F.ceil(share * F.col("_n")))).groupBy(*by).agg(F.avg(value).alias("top_mean"), F.count("*").alias("top_n"))


def escalation_index(events: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """One row: severity, density, breadth, response, momentum and their index.

    ``events(last_seen date, score, actors array, responses boolean)``; the
    mean of the highest quarter of scores comes from counts by score.
    """
    day = F.lit(as_of).cast("date")
    recent = events.where((F.col("last_seen") >= F.date_sub(day, days)) & (F.col("last_seen") <= day))
    by_score = recent.groupBy("score").agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.greatest(F.lit(1), F.ceil(0.25 * F.sum("n").over(Window.partitionBy())))
    used = F.greatest(F.lit(0), F.least(F.col("n"), F.col("wanted") - F.col("above")))
    ranked = by_score.select("score", "n", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"), wanted.alias("wanted")).withColumn("used", used)
    severity = ranked.agg((F.sum(F.col("score") * F.col("used")) / F.sum("used")).alias("severity"))
    cap = lambda x: F.least(F.lit(100.0), x)
    counts = recent.agg(
        F.count("*").alias("n"), F.count_if("responses").alias("answered"),
        F.count_if(F.col("last_seen") >= F.date_sub(day, 30)).alias("now"),
        F.count_if((F.col("last_seen") >= F.date_sub(day, 60)) & (F.col("last_seen") < F.date_sub(day, 30))).alias("then"),
    )
    actors = recent.select(F.explode("actors").alias("a")).agg(F.countDistinct("a").alias("actors"))
    one = counts.join(actors).join(severity).select(
        F.coalesce("severity", F.lit(0.0)).alias("severity"), cap(F.col("n") / 20.0 * 100.0).alias("density"), cap(F.col("actors") / 5.0 * 100.0).alias("breadth"),
        cap(F.col("answered") / 8.0 * 100.0).alias("response"), momentum("now", "then").alias("momentum"),
    )
    return one.withColumn("idx", 0.30 * F.col("severity") + 0.20 * F.col("density") + 0.15 * F.col("breadth") + 0.15 * F.col("response") + 0.20 * F.col("momentum"))


def campaigns(rows: DataFrame, actor: str, event: str, ts: str, score: str, limit: int = 10) -> DataFrame:
    """Per actor: distinct events, first and last day, greatest score; the first ``limit`` by events, score and name."""
    per = rows.groupBy(actor).agg(F.countDistinct(event).alias("events"), F.to_date(F.min(ts)).alias("first_seen"), F.to_date(F.max(ts)).alias("last_seen"), F.max(score).alias("max_score"))
    return per.orderBy(F.desc("events"), F.desc("max_score"), actor).limit(limit)


#: Hours that a cluster may lie ahead of or behind an article, and the least cosine.
BEHIND_H, AHEAD_H, LEAST_COSINE = 96.0, -24.0, 0.68


class Clusters:
    """The clusters of one topic that can still be joined, as matrices, numbered in the order in which they began."""

    def __init__(self):
        self.leaders: list = []
        self.numbers: list[int] = []
        self.next = 0
        self.centroids, self.last, self.sizes = np.empty((0, 0)), np.empty(0), np.empty(0, int)

    def restore(self, number: int, leader, last: float, size: int, centroid: np.ndarray) -> None:
        """Add an open cluster, after those that began before it."""
        self.leaders.append(leader)
        self.numbers.append(number)
        self.centroids = np.vstack([self.centroids, centroid]) if self.centroids.size else centroid[None, :].copy()
        self.last, self.sizes = np.append(self.last, last), np.append(self.sizes, size)
        self.next = max(self.next, number + 1)

    def open_clusters(self) -> dict[int, tuple]:
        """(leader, last, size, centroid) by number."""
        return {n: (leader, float(last), int(size), c.tolist()) for n, leader, last, size, c in zip(self.numbers, self.leaders, self.last, self.sizes, self.centroids, strict=True)}

    def place(self, id, at: float, vec: np.ndarray) -> tuple[object, int]:
        """The leader and size of the cluster that the article joins or starts."""
        if len(self.leaders):
            alive = at - self.last <= BEHIND_H
            if not alive.all():
                self.leaders = [x for x, k in zip(self.leaders, alive, strict=True) if k]
                self.numbers = [x for x, k in zip(self.numbers, alive, strict=True) if k]
                self.centroids, self.last, self.sizes = self.centroids[alive], self.last[alive], self.sizes[alive]
        if len(self.leaders):
            cosines = np.where(at - self.last >= AHEAD_H, self.centroids @ vec, -np.inf)
            k = len(cosines) - 1 - int(cosines[::-1].argmax())  # the newest of equals
            if cosines[k] >= LEAST_COSINE:
                moved = (self.centroids[k] * self.sizes[k] + vec) / (self.sizes[k] + 1)
                norm = np.linalg.norm(moved)
                self.centroids[k] = moved / norm if norm > 0 else moved
                self.last[k], self.sizes[k] = max(self.last[k], at), self.sizes[k] + 1
                return self.leaders[k], int(self.sizes[k])
        self.restore(self.next, id, at, 1, vec)
        return id, 1


def cluster_events(articles: DataFrame) -> DataFrame:
    """(topic, id, event_id, size): one-pass leader clustering of ``articles(topic, ts, id, vec)`` within each topic.

    Articles come by (ts, id); a missing ts is the epoch, ids are any strings
    or numbers.  A cluster whose last article lies between 24 hours after and
    96 hours before is a candidate; the best cosine to a centroid joins if it
    reaches 0.68, the newest wins ties.  A centroid is the mean of the unit
    centroid (by its count) and the new vector, made unit length again.

    The order makes it sequential, but no cluster is open over a gap of more
    than 96 hours: a topic is cut there into sessions, which are dealt to
    tasks on their own.  Spark sorts each session's rows, and a task streams
    through them and holds only clusters that can still be joined.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, clusters = None, Clusters()
        for frame in batches:
            out = []
            for topic, session, id, hours, vec in zip(*(frame[c] for c in ("topic", "session", "id", "hours", "vec")), strict=True):
                if (topic, session) != current:
                    current, clusters = (topic, session), Clusters()
                out.append((topic, id, *clusters.place(id, hours, np.asarray(vec, float))))
            yield pd.DataFrame(out, columns=["topic", "id", "leader", "size"])

    rows = articles.select("topic", F.coalesce(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600.0, F.lit(0.0)).alias("hours"), "id", "vec")
    rows = sessions(rows, ["topic"], "hours", "id", BEHIND_H)
    ordered = rows.repartition("topic", "session").sortWithinPartitions("topic", "session", "hours", "id")
    kind = articles.schema["id"].dataType.simpleString()
    found = ordered.mapInPandas(run, f"topic string, id {kind}, leader {kind}, size int")
    return found.select("topic", "id", event_id("topic", "leader").alias("event_id"), "size")


def sessions(rows: DataFrame, by: list[str], at: str, tie: str, gap: float) -> DataFrame:
    """``rows`` with the number of their session: one ends where the next row of the group is more than ``gap`` later.

    Gaps are found between neighbours inside ranges of the order and, from the
    ranges' ends, between ranges.
    """
    ranged = in_ranges(rows, by, [F.col(at), F.col(tie)])
    ends = ranged.groupBy("_range", *by).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    before = F.lag("_last").over(Window.partitionBy(*by).orderBy("_range"))
    ends = ends.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_b_{c}") for c in by], before.alias("_before"))
    same = F.col("_range") == F.col("_r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    joined = ranged.join(ends, same)
    last = F.coalesce(F.lag(at).over(Window.partitionBy("_range", *by).orderBy(at, tie)), F.col("_before"))
    marked = joined.select(*rows.columns, F.when(F.col(at) - last > gap, 1).otherwise(0).cast("long").alias("_new"))
    return running_sums(marked, by, [F.col(at), F.col(tie)], {"session": F.col("_new")}).drop("_new")
