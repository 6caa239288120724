"""Queries over streams and stored tables, and the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stresslens.plans.registry import SQL, register, table
from stresslens.sources import remote
from stresslens.sources.shared import new_folder
from stresslens.sources.versioned import Folder
from stresslens.streaming import clusters
from stresslens.streaming.merge import DailyTable

#: One article after the other within each topic: what is open, the best of it, the cluster joined or begun.
CLUSTERS = """WITH RECURSIVE r AS (
  SELECT label::VARCHAR AS topic, vec_id AS id, vec_id + 1700000000 / 3600.0 AS h, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
s AS (
  SELECT topic, 0::BIGINT AS k, NULL::BIGINT AS id, NULL::BIGINT AS leader, 0::INT AS size, []::STRUCT(l BIGINT, c DOUBLE[], t DOUBLE, n INT)[] AS cl FROM r GROUP BY topic
  UNION ALL
  SELECT topic, k, id, CASE WHEN j THEN b.l ELSE id END, CASE WHEN j THEN b.n + 1 ELSE 1 END,
    CASE WHEN j THEN list_concat(a[:i - 1], [{'l': b.l, 'c': CASE WHEN list_dot_product(m, m) > 0 THEN list_transform(m, lambda z: z / sqrt(list_dot_product(m, m))) ELSE m END,
      't': greatest(b.t, h), 'n': b.n + 1}], a[i + 1:]) ELSE list_append(a, {'l': id, 'c': v, 't': h, 'n': 1::INT}) END
  FROM (SELECT *, list_transform(list_zip(b.c, v), lambda z: (z[1] * b.n + z[2]) / (b.n + 1)) AS m FROM (
    SELECT *, coalesce(list_max(cs) >= 0.68, false) AS j, len(a) - list_position(list_reverse(cs), list_max(cs)) + 1 AS i, a[len(a) - list_position(list_reverse(cs), list_max(cs)) + 1] AS b FROM (
      SELECT *, list_transform(a, lambda x: CASE WHEN h - x.t >= -24 THEN list_dot_product(x.c, v) ELSE -2 END) AS cs FROM (
        SELECT r.*, list_filter(s.cl, lambda x: r.h - x.t <= 96) AS a FROM s JOIN r ON r.topic = s.topic AND r.k = s.k + 1)))))
SELECT topic, id, 'evt_' || substr(sha1(topic || '|' || leader), 1, 16) AS event_id, size FROM s WHERE k > 0"""

#: The batch query has the same result.
SQL["q_cluster_events"] = CLUSTERS


def _articles(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("topic"), F.timestamp_seconds(F.col("vec_id") * 3600 + 1_700_000_000).alias("ts"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec")
    )


@register(CLUSTERS)
def q_cluster_stream(spark, sf):
    """The clustering of q_cluster_events by a stream in four runs, each of which goes on from the checkpoint of the one before."""
    rows, base = _articles(spark, sf), new_folder(spark)
    # quarters of the time that the table spans
    first, last = rows.agg(F.unix_timestamp(F.min("ts")), F.unix_timestamp(F.max("ts"))).first()
    quarter = F.least(F.lit(3), F.floor(4 * (F.unix_timestamp("ts") - first) / max(1, last - first)))
    for k in range(4):
        rows.where(quarter == k).write.mode("append").parquet(f"{base}/in")
        clusters.run_clusters(spark, f"{base}/in", rows.schema, f"{base}/out", f"{base}/check")
    return spark.read.parquet(f"{base}/out")


_ARRIVALS = """WITH a AS (
  SELECT o_orderkey AS k, o_orderkey % 5 AS batch, CAST(o_orderdate AS DATE) AS day, o_totalprice AS price, o_orderstatus AS status FROM orders
  UNION ALL SELECT o_orderkey, 5 + o_orderkey % 5, CAST(o_orderdate AS DATE) - CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 0 END, o_totalprice + 1, 'U' FROM orders WHERE o_orderkey % 3 = 0),
l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY k ORDER BY batch DESC) = 1)"""


@register(f"""{_ARRIVALS} SELECT k AS o_orderkey, day, price, status, o_orderpriority AS priority FROM l JOIN orders ON o_orderkey = k
WHERE day >= (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - 365""")
def q_incremental_merge(spark, sf):
    """Orders come in ten batches, two of them twice; later ones change price, status and day of a third, and leave the priority as it is."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    moved = F.when(F.col("o_orderkey") % 2 == 0, F.date_sub("day", 3)).otherwise(F.col("day"))
    later = orders.where("o_orderkey % 3 = 0").select("o_orderkey", moved.alias("day"), (F.col("price") + 1).alias("price"), F.lit("U").alias("status"))
    stored = DailyTable(spark, new_folder(spark), "o_orderkey", "day", keep_days=365, days_a_part=30)
    for number in (0, 1, 2, 2, 3, 4, 5, 6, 7, 1, 8, 9):
        part = F.col("o_orderkey") % 5 == number % 5
        stored.merge((orders if number < 5 else later).where(part), number)
    return stored.read(spark)


@register("""SELECT substr(o_orderpriority, 1, 1) AS key, count(DISTINCT CAST(o_orderdate AS DATE)) AS observations, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day, false AS failed FROM orders GROUP BY 1
UNION ALL SELECT unnest(['empty', 'broken', 'missing']), 0, NULL, NULL, true""")
def q_remote_series(spark, sf):
    """Series of daily means, written as a CSV file for each priority and scanned with three sources that fail: no header line's rows, no numbers, no file."""
    base = Folder(spark, new_folder(spark))
    means = table(spark, sf, "orders").groupBy(F.substring("o_orderpriority", 1, 1).alias("key"), F.to_date("o_orderdate").alias("DATE")).agg(F.avg("o_totalprice").alias("VALUE"))
    means.repartition("key").sortWithinPartitions("key", "DATE").write.partitionBy("key").option("header", True).csv(base.path)
    sources = {}
    for key in (n for n in base.names() if n.startswith("key=")):
        for k, name in enumerate(n for n in base.names(key) if n.endswith(".csv")):
            sources[f"{key[4:]}{'' if not k else f'/{k}'}"] = f"{base.path}/{key}/{name}"
    base.create("empty.csv", "DATE,VALUE\n")
    base.create("broken.csv", "<html>\n<body>not, a series</body>\n")
    sources |= {n: f"{base.path}/{n}.csv" for n in ("empty", "broken", "missing")}
    rows = remote.scan(spark, "series", sources, attempts=2, pause=0.01)
    return rows.groupBy("key").agg(F.count("d").alias("observations"), F.min("d").alias("first_day"), F.max("d").alias("last_day"), (F.count("error") > 0).alias("failed"))


@register("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT event_type AS source, event_type || ' & ' || event_id AS title, 'http://feed/' || event_id || '?a=1&b=2' AS url, strftime(ts, '%Y-%m-%d %H:%M:%S') AS published, false AS failed FROM e WHERE r <= 100
UNION ALL SELECT unnest(['cut off', 'missing']), NULL, NULL, NULL, true""")
def q_remote_feeds(spark, sf):
    """Feeds of the newest 120 events of each type, scanned with two sources that fail; a scan takes 100 entries of a feed."""
    base = Folder(spark, new_folder(spark))
    newest = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    events = table(spark, sf, "events").withColumn("r", F.row_number().over(newest)).where("r <= 120")
    link = F.concat(F.lit("http://feed/"), F.col("event_id").cast("string"), F.lit("?a=1&amp;b=2"))
    item = F.concat(
        F.lit("<item><title>"), "event_type", F.lit(" &amp;amp; "), F.col("event_id").cast("string"), F.lit("</title><link>"), link, F.lit("</link><pubDate>"),
        F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate></item>"),
    )
    feeds = events.select("event_type", F.struct("r", item.alias("x")).alias("i")).groupBy("event_type").agg(F.array_sort(F.collect_list("i")).alias("items"))
    body = F.concat(F.lit("<rss><channel>"), F.array_join(F.transform("items", lambda i: i["x"]), ""), F.lit("</channel></rss>"))
    feeds.select("event_type", body.alias("value")).repartition("event_type").write.partitionBy("event_type").text(base.path)
    sources = {f[11:]: f"{base.path}/{f}/{n}" for f in base.names() if f.startswith("event_type=") for n in base.names(f) if n.endswith(".txt")}
    base.create("cut.xml", "<rss><channel><item><title>half an ent")
    sources |= {"cut off": f"{base.path}/cut.xml", "missing": f"{base.path}/missing.xml"}
    rows = remote.scan(spark, "feeds", sources, attempts=1)
    return rows.select("source", "title", "url", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"), F.col("error").isNotNull().alias("failed"))
