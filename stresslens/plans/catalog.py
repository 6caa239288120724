"""The registered queries of the core library and the same in DuckDB SQL.

Each query applies library operators to whole driver tables.  Daily means by
order priority and by return flag serve as channels of stress; their gaps are
real gaps.  Results are rounded once, at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stresslens.functions import scalars, text
from stresslens.operators import cells, enrich, graph, intervals, mlp, news, retrieval, scoring, series
from stresslens.plans import registry
from stresslens.sources.shared import kept
from stresslens.streaming import ingest

_register, _t = registry.register, registry.table


def queries() -> dict:
    from stresslens.plans import enrich_catalog, search_catalog, stream_catalog, view_catalog  # noqa: F401, they register on import

    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(registry.SQL)


def _r(*columns: str, digits: int = 6):
    return [F.round(F.col(c), digits).alias(c) for c in columns]


PROFILE = series.Profile(4, 13, 260)
THRESHOLDS = (250_000.0, 350_000.0, 450_000.0)
WEIGHTS = (("1-URGENT", 10.0), ("2-HIGH", 14.0), ("3-MEDIUM", 8.0), ("4-NOT SPECIFIED", 6.0), ("5-LOW", 7.0), ("A", 9.0), ("N", 5.0), ("R", 4.0))
WINDOWS = (("w1", "1995-08-01", "1996-02-28", "1995-11-15"), ("w2", "1997-03-01", "1997-09-30", "1997-06-10"), ("w3", "1999-01-01", "1999-05-31", "1999-03-09"))


def _orders(spark, sf) -> DataFrame:
    return series.daily_mean(_t(spark, sf, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice")


def _ships(spark, sf) -> DataFrame:
    return series.daily_mean(_t(spark, sf, "lineitem"), "l_returnflag", "l_shipdate", "l_extendedprice")


def _total(spark, sf) -> DataFrame:
    return series.daily_mean(_t(spark, sf, "orders").withColumn("all", F.lit("all")), "all", "o_orderdate", "o_totalprice")


def _score_rows(spark, sf) -> DataFrame:
    """(d, score): the daily mean total price, scaled to 0..100."""
    return _total(spark, sf).select("d", F.round(scalars.clamp((F.col("v") - 150_000.0) / 2_000.0), 9).alias("score"))


def _windows(spark) -> DataFrame:
    rows = spark.createDataFrame(list(WINDOWS), "id string, start string, end string, reference string")
    return rows.select("id", *[F.col(c).cast("date").alias(c) for c in ("start", "end", "reference")])


def _weights(spark) -> DataFrame:
    return spark.createDataFrame(list(WEIGHTS), "key string, weight double")


_ORD = "o AS (SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)"
_SHIP = "s AS (SELECT l_returnflag AS key, CAST(l_shipdate AS DATE) AS d, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)"
_TOT = "t AS (SELECT CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS v FROM orders GROUP BY 1)"
_SC = "sc AS (SELECT d, round(greatest(0::DOUBLE, least(100::DOUBLE, (v - 150000) / 2000)), 9) AS score FROM t)"
_WIN = "w AS (SELECT id, s::DATE AS start_d, e::DATE AS end_d, r::DATE AS ref FROM (VALUES " + ", ".join(f"('{i}', '{s}', '{e}', '{r}')" for i, s, e, r in WINDOWS) + ") x(id, s, e, r))"
_WGT = "wt AS (SELECT key, weight::DOUBLE AS weight FROM (VALUES " + ", ".join(f"('{k}', {w})" for k, w in WEIGHTS) + ") x(key, weight))"
#: channels 0..100: order priorities by total price, return flags by price
_CH = f"{_ORD}, {_SHIP}, ch AS (SELECT d, key, round(greatest(0::DOUBLE, least(100::DOUBLE, (v - 150000) / 2000)), 9) AS score FROM o UNION ALL SELECT d, key, round(greatest(0::DOUBLE, least(100::DOUBLE, (v - 30000) / 100)), 9) FROM s)"


def _channels(spark, sf) -> DataFrame:
    one = _orders(spark, sf).select("d", "key", F.round(scalars.clamp((F.col("v") - 150_000.0) / 2_000.0), 9).alias("score"))
    return one.unionByName(_ships(spark, sf).select("d", "key", F.round(scalars.clamp((F.col("v") - 30_000.0) / 100.0), 9).alias("score")))


# --- series -------------------------------------------------------------------------------------


@_register(f"WITH {_ORD} SELECT key, d, round(v, 6) AS v FROM o")
def q_series_daily(spark, sf):
    return _orders(spark, sf).select("key", "d", *_r("v"))


@_register("SELECT event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def q_latest_obs(spark, sf):
    return series.latest(_t(spark, sf, "events"), "event_type", ["ts", "event_id"], "value")


@_register("SELECT event_type AS key, CAST(ts AS DATE) AS d, sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS v FROM events GROUP BY 1, 2")
def q_clean_scan(spark, sf):
    raw = _t(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return series.clean_series(raw, "event_type", "ts", "k").groupBy("key", "d").agg(F.sum("v").alias("v"))


@_register(f"WITH {_TOT}, u AS (SELECT CAST(l_shipdate AS DATE) AS d, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1) SELECT d, round((t.v - u.v) * 100, 6) AS spread FROM t JOIN u USING (d)")
def q_spread_common_dates(spark, sf):
    ships = series.daily_mean(_t(spark, sf, "lineitem").withColumn("all", F.lit("all")), "all", "l_shipdate", "l_extendedprice")
    return series.spread(_total(spark, sf), ships).select("d", *_r("spread"))


@_register(f"""WITH {_ORD}, c AS (SELECT key, d, (v - lag(v) OVER z) * 100 AS step, row_number() OVER z AS r, count(*) OVER (PARTITION BY key) AS n FROM o WINDOW z AS (PARTITION BY key ORDER BY d)),
  e AS (SELECT *, stddev_samp(step) OVER (PARTITION BY key ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(252) AS vol FROM c)
  SELECT key, d, round(vol, 3) AS vol FROM e WHERE r > 20 AND n >= 22""")
def q_realized_vol(spark, sf):
    return series.realized_vol(_orders(spark, sf)).select("key", "d", *_r("vol", digits=3))


_ROLL = f"""{_ORD}, a AS (SELECT key, d, v, list(v) OVER z AS p, stddev_pop(v) OVER z AS sd, row_number() OVER (PARTITION BY key ORDER BY d) AS rn,
    v - lag(v, 4) OVER (PARTITION BY key ORDER BY d) AS d4, v - lag(v, 13) OVER (PARTITION BY key ORDER BY d) AS d13
  FROM o WINDOW z AS (PARTITION BY key ORDER BY d ROWS BETWEEN 259 PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, coalesce(len(p), 0) AS n, list_median(p) AS med FROM a),
c AS (SELECT *, list_median(list_transform(p, lambda x: abs(x - med))) AS mad, CASE WHEN n >= 10 THEN 100.0::DOUBLE * len(list_filter(p, lambda x: x <= v)) / n END AS pct,
  list(d4) OVER z AS p4, list(d13) OVER z AS p13 FROM b WINDOW z AS (PARTITION BY key ORDER BY d ROWS BETWEEN 259 PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, CASE WHEN n >= 10 THEN CASE WHEN mad > 0 THEN (v - med) / (1.4826::DOUBLE * mad) WHEN sd > 0 THEN (v - med) / sd ELSE 0 END END AS z,
  CASE WHEN rn > 9 THEN 100.0::DOUBLE * len(list_filter(p4, lambda x: x <= d4)) / nullif(len(list_filter(p4, lambda x: x IS NOT NULL)), 0) END AS pct4,
  CASE WHEN rn > 18 THEN 100.0::DOUBLE * len(list_filter(p13, lambda x: x <= d13)) / nullif(len(list_filter(p13, lambda x: x IS NOT NULL)), 0) END AS pct13 FROM c)"""


@_register(f"WITH {_ROLL} SELECT key, d, n::INT AS n, round(pct, 6) AS pct FROM r")
def q_rolling_pct_rank(spark, sf):
    return series.rolling(_orders(spark, sf), PROFILE).select("key", "d", "n", *_r("pct"))


@_register(f"WITH {_ROLL} SELECT key, d, round(med, 5) AS med, round(mad, 5) AS mad FROM r")
def q_rolling_median_mad(spark, sf):
    return series.rolling(_orders(spark, sf), PROFILE).select("key", "d", *_r("med", "mad", digits=5))


@_register(f"WITH {_ROLL} SELECT key, d, round(z, 6) AS z, round(CASE WHEN z <= 0.5 THEN 0 WHEN z >= 3 THEN 100 ELSE (z - 0.5) / 2.5 * 100 END, 5) AS risk FROM r")
def q_robust_z(spark, sf):
    return series.rolling(_orders(spark, sf), PROFILE).select("key", "d", *_r("z"), F.round(scalars.z_risk("z"), 5).alias("risk"))


@_register(f"WITH {_ROLL} SELECT key, d, round(pct4, 6) AS pct4, round(pct13, 6) AS pct13 FROM r")
def q_delta_percentile(spark, sf):
    out = series.delta_percentile(_orders(spark, sf), 4, PROFILE, "pct4")
    return series.delta_percentile(out, 13, PROFILE, "pct13").select("key", "d", *_r("pct4", "pct13"))


def _anchor_sql(x: str, t1: float, t2: float, t3: float) -> str:
    return f"(CASE WHEN {x} <= {t1} THEN 0 WHEN {x} <= {t2} THEN ({x} - {t1}) / {t2 - t1} * (100::DOUBLE / 3) WHEN {x} <= {t3} THEN 100::DOUBLE / 3 + ({x} - {t2}) / {t3 - t2} * (100::DOUBLE / 3) ELSE least(100::DOUBLE, 200::DOUBLE / 3 + ({x} - {t3}) / {t3 - t2} * (100::DOUBLE / 3)) END)"


_METRIC = f"""{_ROLL}, m AS (SELECT *, {_anchor_sql('v', *THRESHOLDS)} AS lvl,
  greatest(CASE WHEN pct > 65 THEN (pct - 65) / 35 * 100 ELSE 0 END, CASE WHEN z <= 0.5 OR z IS NULL THEN 0 WHEN z >= 3 THEN 100 ELSE (z - 0.5) / 2.5 * 100 END) AS deviation,
  greatest(CASE WHEN pct4 > 70 THEN (pct4 - 70) / 30 * 100 ELSE 0 END, CASE WHEN pct13 > 70 THEN (pct13 - 70) / 30 * 100 ELSE 0 END) AS velocity FROM r),
dm AS (SELECT key, d, v, CASE WHEN n >= 10 THEN least(100, 0.45::DOUBLE * lvl + 0.30::DOUBLE * deviation + 0.25::DOUBLE * velocity) END AS score FROM m)"""


@_register(f"WITH {_METRIC} SELECT key, d, round(score, 5) AS score FROM dm")
def q_dynamic_metric(spark, sf):
    return series.dynamic_metric(_orders(spark, sf), PROFILE, THRESHOLDS).select("key", "d", *_r("score", digits=5))


@_register(f"SELECT c_custkey, round({_anchor_sql('c_acctbal', 1000.0, 4000.0, 8000.0)}, 6) AS anchored, round(CASE WHEN x <= 65 THEN 0 ELSE least(100, (x - 65) / 35 * 100) END, 6) AS tail FROM (SELECT *, c_acctbal / 100 AS x FROM customer)")
def q_anchor_ramp(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", F.round(scalars.anchor("c_acctbal", 1000.0, 4000.0, 8000.0), 6).alias("anchored"), F.round(scalars.tail_score(F.col("c_acctbal") / 100.0), 6).alias("tail"))


@_register(f"WITH {_TOT}, l AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem), {_WIN} SELECT d FROM t WHERE d >= DATE '1996-01-01' UNION SELECT l.d FROM l JOIN w ON l.d >= least(start_d, ref - 120) AND l.d <= end_d")
def q_sample_calendar(spark, sf):
    ships = _t(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    return scoring.calendar(_total(spark, sf), ships, _windows(spark), "1996-01-01")


@_register(f"""WITH {_METRIC}, l AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem), k AS (SELECT DISTINCT key FROM o), p AS (SELECT k.key, l.d FROM k, l)
SELECT p.key, p.d, dm.d AS seen, round(dm.score, 5) AS score FROM p ASOF LEFT JOIN dm ON p.key = dm.key AND p.d >= dm.d""")
def q_asof_walkforward(spark, sf):
    metric = series.dynamic_metric(_orders(spark, sf), PROFILE, THRESHOLDS).withColumn("seen", F.col("d"))
    probes = _t(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    keys = _t(spark, sf, "orders").select(F.col("o_orderpriority").alias("key")).distinct()
    return series.asof_backward(probes, metric, keys, ["seen", "score"]).select("key", "d", "seen", *_r("score", digits=5))


@_register(f"""WITH {_ORD}, p AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem),
a AS (SELECT p.d, x.v FROM p ASOF LEFT JOIN (SELECT * FROM o WHERE key = '1-URGENT' AND d >= DATE '1998-01-01') x ON p.d >= x.d),
b AS (SELECT p.d, x.v FROM p ASOF LEFT JOIN (SELECT * FROM o WHERE key = '2-HIGH' AND d >= DATE '1996-01-01') x ON p.d >= x.d)
SELECT a.d, CASE WHEN a.v IS NOT NULL THEN 'first' WHEN b.v IS NOT NULL THEN 'second' ELSE 'missing' END AS source, round(coalesce(a.v, b.v), 6) AS v FROM a JOIN b USING (d)""")
def q_regime_fallback(spark, sf):
    o = _orders(spark, sf)
    part = o.where("(key = '1-URGENT' and d >= '1998-01-01') or (key = '2-HIGH' and d >= '1996-01-01')")
    probes = _t(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    seen = series.asof_backward(probes, part, part.select("key").distinct(), ["v"])
    wide = seen.groupBy("d").agg(F.max(F.when(F.col("key") == "1-URGENT", F.col("v"))).alias("a"), F.max(F.when(F.col("key") == "2-HIGH", F.col("v"))).alias("b"))
    label = F.when(F.col("a").isNotNull(), "first").when(F.col("b").isNotNull(), "second").otherwise("missing")
    return wide.select("d", label.alias("source"), F.round(F.coalesce("a", "b"), 6).alias("v"))


# --- fusion and backtest ------------------------------------------------------------------------

_FUSE = f"""{_CH}, {_WGT}, f AS (SELECT d, sum(score * weight) / sum(weight) AS raw_score, sum(weight) AS coverage, count(score) AS available,
  count(*) FILTER (WHERE score >= 45) AS stressed, count(*) FILTER (WHERE score >= 65) AS severe FROM ch JOIN wt USING (key) GROUP BY d),
g AS (SELECT *, CASE WHEN available < 6 THEN 0 WHEN severe >= 6 THEN 8 WHEN stressed >= 6 THEN 5 WHEN stressed >= 4 THEN 2.5 ELSE 0 END::DOUBLE AS bonus FROM f),
h AS (SELECT *, least(100, raw_score + bonus) AS score FROM g)"""


@_register(f"WITH {_FUSE} SELECT d, round(raw_score, 5) AS raw_score, coverage FROM h")
def q_weighted_fusion(spark, sf):
    return scoring.weighted_fusion(_channels(spark, sf), _weights(spark)).select("d", *_r("raw_score", digits=5), "coverage")


@_register(f"WITH {_CH}, mem AS (SELECT * FROM (VALUES ('1-URGENT', 'front'), ('2-HIGH', 'front'), ('3-MEDIUM', 'back'), ('4-NOT SPECIFIED', 'back'), ('5-LOW', 'back'), ('A', 'ship'), ('R', 'ship'), ('1-URGENT', 'ship')) x(key, pillar)) SELECT d, pillar, round(avg(score), 10) AS mean_score FROM ch JOIN mem USING (key) GROUP BY 1, 2")
def q_pillars(spark, sf):
    member = [("1-URGENT", "front"), ("2-HIGH", "front"), ("3-MEDIUM", "back"), ("4-NOT SPECIFIED", "back"), ("5-LOW", "back"), ("A", "ship"), ("R", "ship"), ("1-URGENT", "ship")]
    return scoring.pillars(_channels(spark, sf), spark.createDataFrame(member, "key string, pillar string")).select("d", "pillar", *_r("mean_score", digits=10))


@_register(f"WITH {_FUSE} SELECT d, available, stressed, severe, round(100::DOUBLE * stressed / available, 6) AS breadth, bonus FROM h")
def q_breadth_bonus(spark, sf):
    return scoring.breadth(_channels(spark, sf)).select("d", "available", "stressed", "severe", *_r("breadth"), "bonus")


@_register(f"""WITH {_FUSE}, i AS (SELECT *, CASE WHEN score < 25 THEN 'NORMAL' WHEN score < 45 THEN 'WATCH' WHEN score < 65 THEN 'ELEVATED' WHEN score < 80 THEN 'HIGH' ELSE 'CRITICAL' END AS level FROM h),
 pv AS (SELECT d, coalesce(avg(score) FILTER (WHERE key IN ('1-URGENT', '2-HIGH')), 0) AS c, coalesce(avg(score) FILTER (WHERE key IN ('3-MEDIUM', '4-NOT SPECIFIED')), 0) AS f,
   coalesce(avg(score) FILTER (WHERE key IN ('A', 'N')), 0) AS b, coalesce(avg(score) FILTER (WHERE key = 'R'), 0) AS s FROM ch GROUP BY d)
SELECT i.d, round(score, 5) AS score, level, (CASE WHEN c >= 75 AND f >= 70 AND b >= 60 AND br >= 65 THEN 4 WHEN c >= 55 AND f >= 50 AND (b >= 45 OR br >= 50) THEN 3
  WHEN c >= 40 AND (s >= 45 OR b >= 40 OR br >= 35) THEN 2 WHEN s >= 35 OR b >= 35 THEN 1 ELSE 0 END)::INT AS stage
FROM (SELECT *, 100::DOUBLE * stressed / available AS br FROM i) i JOIN pv ON pv.d = i.d""")
def q_level_stage(spark, sf):
    ch = _channels(spark, sf)
    mean = lambda *keys: F.avg(F.when(F.col("key").isin(*keys), F.col("score")))
    parts = ch.groupBy("d").agg(mean("1-URGENT", "2-HIGH").alias("credit"), mean("3-MEDIUM", "4-NOT SPECIFIED").alias("funding"), mean("A", "N").alias("banking"), mean("R").alias("structural"))
    out = scoring.fused_score(ch, _weights(spark)).join(parts, "d")
    return out.select("d", *_r("score", digits=5), "level", scalars.transmission_stage("credit", "funding", "banking", "structural", "breadth").alias("stage"))


@_register("SELECT l_orderkey, l_linenumber, greatest(l_quantity, l_discount * 1000, l_tax * 500) AS signal FROM lineitem")
def q_max_signal(spark, sf):
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.greatest("l_quantity", F.col("l_discount") * 1000, F.col("l_tax") * 500).alias("signal"))


_EVENTS = f"""{_TOT}, {_SC}, {_WIN}, j AS (SELECT id, ref, d, score FROM sc JOIN w ON d >= start_d AND d <= end_d)"""


@_register(f"WITH {_EVENTS} SELECT id, min(d) FILTER (WHERE score >= 25) AS first_watch, min(d) FILTER (WHERE score >= 45) AS first_elevated, date_diff('day', min(d) FILTER (WHERE score >= 25), ref)::INT AS lead_watch FROM j GROUP BY id, ref")
def q_first_cross_lead(spark, sf):
    return scoring.event_summary(_score_rows(spark, sf), _windows(spark), {"watch": 25.0, "elevated": 45.0}).select("id", "first_watch", "first_elevated", "lead_watch")


@_register(f"WITH {_EVENTS} SELECT id, count(*) AS observations, max(score) AS max_score, arg_min(d, (-score, d)) AS max_score_date, min(d) FILTER (WHERE score >= 65) AS first_high FROM j GROUP BY id")
def q_event_summary(spark, sf):
    return scoring.event_summary(_score_rows(spark, sf), _windows(spark), {"high": 65.0}).select("id", "observations", "max_score", "max_score_date", "first_high")


@_register(f"""WITH {_TOT}, {_SC}, {_WIN}, l AS (SELECT sc.*, EXISTS (SELECT 1 FROM w WHERE sc.d >= start_d AND sc.d <= end_d) AS inside FROM sc), th AS (SELECT unnest([25.0::DOUBLE, 45, 65, 80]) AS threshold)
SELECT threshold, CASE WHEN inside THEN 'inside' ELSE 'outside' END AS segment, count(*) AS n, round(100::DOUBLE * count(*) FILTER (WHERE score >= threshold) / count(*), 6) AS rate FROM l, th GROUP BY 1, 2""")
def q_alert_rates(spark, sf):
    return scoring.alert_rates(_score_rows(spark, sf), _windows(spark), [25.0, 45.0, 65.0, 80.0]).select("threshold", "segment", "n", *_r("rate"))


@_register("SELECT round(quantile_cont(o_totalprice, 0.9), 6) AS p90, round(quantile_cont(o_totalprice, 0.95), 6) AS p95, round(quantile_cont(o_totalprice, 0.99), 6) AS p99 FROM orders")
def q_quantiles(spark, sf):
    return scoring.quantiles(_t(spark, sf, "orders"), "o_totalprice", [0.9, 0.95, 0.99]).select(*_r("p90", "p95", "p99"))


@_register("""WITH x AS (SELECT o_orderkey, (o_custkey % 4)::DOUBLE AS raw, CASE o_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS conf, date_diff('day', CAST(o_orderdate AS DATE), DATE '1996-06-30') AS age FROM orders)
SELECT o_orderkey, round(least(100, raw / 3 * 100) * CASE conf WHEN 'high' THEN 1 WHEN 'medium' THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END * CASE WHEN age > 180 THEN 0.15::DOUBLE WHEN age > 90 THEN 0.4::DOUBLE WHEN age > 60 THEN 0.65::DOUBLE WHEN age > 30 THEN 0.85::DOUBLE ELSE 1 END, 6) AS score FROM x""")
def q_evidence_decay(spark, sf):
    grade = F.get(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("o_custkey") % 3).cast("int"))
    age = F.datediff(F.lit("1996-06-30").cast("date"), F.to_date("o_orderdate"))
    return _t(spark, sf, "orders").select("o_orderkey", F.round(scalars.evidence_decay((F.col("o_custkey") % 4).cast("double"), grade, age), 6).alias("score"))


@_register("SELECT event_id, round(exp(-ln(2) * greatest(date_diff('day', CAST(ts AS DATE), DATE '2024-01-20'), 0) / 21), 6) AS decay FROM events")
def q_recency(spark, sf):
    age = F.datediff(F.lit("2024-01-20").cast("date"), F.to_date("ts"))
    return _t(spark, sf, "events").select("event_id", F.round(scalars.recency_decay(age), 6).alias("decay"))


@_register(f"WITH {_TOT}, {_SC} SELECT d, score FROM sc WHERE d >= DATE '1996-01-01' AND d <= DATE '1998-12-31' AND score >= 20 ORDER BY d DESC LIMIT 365")
def q_history_filter(spark, sf):
    return _score_rows(spark, sf).where("d >= '1996-01-01' and d <= '1998-12-31' and score >= 20").orderBy(F.desc("d")).limit(365)


@_register(f"WITH {_TOT}, {_SC}, n AS (SELECT d, score + 1 AS score FROM sc WHERE d >= DATE '1997-01-01'), u AS (SELECT * FROM sc WHERE d <= DATE '1997-06-30' AND d NOT IN (SELECT d FROM n) UNION ALL SELECT * FROM n) SELECT d, round(score, 8) AS score FROM u ORDER BY d DESC LIMIT 365")
def q_upsert_history(spark, sf):
    rows = _score_rows(spark, sf)
    new = rows.where("d >= '1997-01-01'").select("d", (F.col("score") + 1).alias("score"))
    return news.upsert_history(rows.where("d <= '1997-06-30'"), new).select("d", *_r("score", digits=8))


@_register("""WITH a AS (SELECT event_id, ts, value FROM events WHERE event_id % 3 <> 0), b AS (SELECT event_id, ts, value + 1 AS value FROM events WHERE event_id % 2 = 0),
m AS (SELECT coalesce(b.event_id, a.event_id) AS event_id, coalesce(b.ts, a.ts) AS ts, CASE WHEN b.event_id IS NOT NULL THEN b.value ELSE a.value END AS value FROM a FULL JOIN b ON a.event_id = b.event_id)
SELECT event_id, round(value, 6) AS value FROM m WHERE ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 5000""")
def q_retention_merge(spark, sf):
    e = _t(spark, sf, "events").select("event_id", "ts", "value")
    merged = news.merge_rows(e.where("event_id % 3 <> 0"), e.where("event_id % 2 = 0").withColumn("value", F.col("value") + 1), "event_id")
    return news.retain(merged, "ts", "2024-01-20", 10, 5000, "event_id").select("event_id", *_r("value"))


# --- text ---------------------------------------------------------------------------------------

_WS = r"[ \t\n\r\x0b\f]+"


@_register("SELECT substr(sha256(lower(text) || '|' || lower(source) || '|' || lang), 1, 24) AS key, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def q_dedup_docs(spark, sf):
    d = _t(spark, sf, "documents").withColumn("key", text.article_id("text", "source", "lang"))
    sizes = d.groupBy("key").agg(F.count("*").alias("n"))
    return news.dedup_by_key(d, ["key"], [F.col("doc_id")]).join(sizes, "key").select("key", "doc_id", "n")


_TITLE = "t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) || ' - ' || regexp_extract(url, '//([^/]*)', 1) AS title FROM pages)"


@_register(rf"WITH {_TITLE} SELECT page_id, trim(regexp_replace(title, '\s+-\s+[^-]{{1,80}}$', '')) AS title, coalesce(nullif(trim(regexp_extract(title, '\s+-\s+([^-]{{1,80}})$', 1)), ''), 'feed') AS publisher FROM t")
def q_canonical_title(spark, sf):
    title = F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(" - "), F.regexp_extract("url", "//([^/]*)", 1))
    return _t(spark, sf, "pages").select("page_id", title.alias("title")).select("page_id", text.canonical_title("title").alias("title"), text.publisher("title", F.lit("feed")).alias("publisher"))


def _html_sql() -> str:
    out = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
    for entity, char in text.ENTITIES.items():
        quoted = char.replace("'", "''")
        out = f"replace({out}, '{entity}', '{quoted}')"
    return out


@_register(rf"SELECT page_id, sha256(trim(regexp_replace({_html_sql()}, '[ \t\n\r]+', ' ', 'g'))) AS digest FROM pages")
def q_html_text(spark, sf):
    return _t(spark, sf, "pages").select("page_id", F.sha2(text.html_text("html"), 256).alias("digest"))


@_register(rf"""WITH n AS (SELECT doc_id, lower(trim(regexp_replace(text, '[ \t\n\r\x0b\f]+', ' ', 'g'))) AS b FROM documents)
SELECT doc_id, len(regexp_extract_all(b, '[a-z0-9_./%-]+'))::INT AS n_tokens,
 CASE WHEN contains(b, 'of the') THEN 8 ELSE 0 END + CASE WHEN contains(b, 'the') THEN 2 + least(3, 0.25::DOUBLE * ((length(b) - length(replace(b, 'the', ''))) // 3)) ELSE 0 END
  + CASE WHEN contains(b, 'und') THEN 2 + least(3, 0.25::DOUBLE * ((length(b) - length(replace(b, 'und', ''))) // 3)) ELSE 0 END AS score FROM n""")
def q_lexical_score(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.size(text.tokens("text")).alias("n_tokens"), text.lexical_score("text", "of the", ["the", "und"]).alias("score"))


LEXICON = {"article": ["the", "der"], "join": ["and", "und", "et"], "tion": ["tion"]}


@_register(r"""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])(the|der)($|[^a-z0-9])') THEN 'article' END,
 CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])(and|und|et)($|[^a-z0-9])') THEN 'join' END, CASE WHEN contains(lower(text), 'tion') THEN 'tion' END) AS hits FROM documents""")
def q_lexicon_match(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.array_join(text.lexicon_matches("text", LEXICON), ",").alias("hits"))


# --- vectors and retrieval ----------------------------------------------------------------------


@_register("""WITH c AS (SELECT vec_id AS topic, embedding AS e FROM embeddings WHERE vec_id < 8), s AS (SELECT x.vec_id, topic, round(list_inner_product(x.embedding::DOUBLE[], c.e::DOUBLE[]), 6) AS sim FROM embeddings x, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, topic) AS rn, max(sim) OVER (PARTITION BY vec_id) AS best FROM s)
SELECT vec_id, topic, sim FROM r WHERE (rn <= 3 AND sim >= 0.3) OR (rn = 1 AND best < 0.3)""")
def q_topic_top3(spark, sf):
    e = _t(spark, sf, "embeddings")
    topics = e.where("vec_id < 8").select(F.col("vec_id").alias("topic"), F.col("embedding").alias("vec"))
    none = F.array().cast("array<bigint>")
    scored = e.withColumn("topics", enrich.pack_descriptors(topics).scalar())
    return scored.select("vec_id", F.explode(enrich.chosen_topics(enrich.topic_scores(F.col("embedding"), F.col("topics"), none, 6))).alias("c")).select("vec_id", "c.topic", "c.sim")


def _queries(spark, sf, every: int = 100) -> DataFrame:
    return _t(spark, sf, "embeddings").where(f"vec_id % {every} = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


_KNN = """k AS (SELECT qid, id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM (
  SELECT q.vec_id AS qid, v.vec_id AS id, round(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS dist FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0))"""


@_register(f"WITH {_KNN} SELECT qid, id, dist, rank::INT AS rank FROM k WHERE rank <= 10")
def q_knn(spark, sf):
    vectors = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieval.knn(_queries(spark, sf), vectors, 10).select("qid", "id", "dist", "rank")


@_register(f"WITH {_KNN.replace('% 100', '% 20')} SELECT qid, id, dist, rank::INT AS rank FROM k WHERE rank <= 10")
def q_knn_twentieth(spark, sf):
    """q_knn for every row whose id is divisible by 20."""
    vectors = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieval.knn(_queries(spark, sf, 20), vectors, 10).select("qid", "id", "dist", "rank")


@_register(f"WITH {_KNN.replace('% 100', '% 20')} SELECT qid, id, dist, rank::INT AS rank FROM k WHERE rank <= 10")
def q_knn_cells(spark, sf):
    """q_knn_twentieth by cells: the same rows from a part of the distances."""
    vectors = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return cells.knn_cells(_queries(spark, sf, 20), vectors, 10)[0].select("qid", "id", "dist", "rank")


_OPEN = "CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + (o_orderkey % 400)::INT AS b FROM orders"


@_register(f"""WITH s AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem), o AS (SELECT o_orderkey, {_OPEN})
SELECT o_orderkey, count(*) AS days, min(d) AS first_day, max(d) AS last_day FROM o JOIN s ON d BETWEEN a AND b GROUP BY 1""")
def q_interval_join(spark, sf):
    """Ship days inside each order's interval, by bins: every order is an interval of up to 400 days."""
    opened = F.to_date("o_orderdate")
    orders = _t(spark, sf, "orders").select("o_orderkey", opened.alias("a"), F.date_add(opened, (F.col("o_orderkey") % 400).cast("int")).alias("b"))
    days = _t(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    pairs = intervals.interval_join(days, orders, intervals.day_number("d"), intervals.day_number("a"), intervals.day_number("b"))
    return pairs.groupBy("o_orderkey").agg(F.count("*").alias("days"), F.min("d").alias("first_day"), F.max("d").alias("last_day"))


@_register(f"""WITH w AS (SELECT {_OPEN} WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 16 = 0)
SELECT CAST(ts AS DATE) - 9497 AS d, EXISTS (SELECT 1 FROM w WHERE CAST(ts AS DATE) - 9497 BETWEEN a AND b) AS inside, count(*) AS n FROM events GROUP BY ALL""".replace("o_orderkey % 400", "o_orderkey % 3"))
def q_inside_any(spark, sf):
    """Event days, moved to the time of the orders, and whether some urgent order's short interval holds them."""
    opened = F.to_date("o_orderdate")
    urgent = _t(spark, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_orderkey % 16 = 0").select(opened.alias("a"), F.date_add(opened, (F.col("o_orderkey") % 3).cast("int")).alias("b"))
    days = _t(spark, sf, "events").select(F.date_sub(F.to_date("ts"), 9497).alias("d"))
    found = intervals.inside_any(days, urgent, intervals.day_number("d"), intervals.day_number("a"), intervals.day_number("b"))
    return found.groupBy("d", "inside").agg(F.count("*").alias("n"))


TERMS = ((1, "the"), (1, "tion"), (2, "de"), (2, "la"), (3, "und"))


def _bm25(spark, sf) -> DataFrame:
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.split(F.lower("text"), r"[^\p{L}0-9]+").alias("words"))
    asked = spark.createDataFrame(list(TERMS), "qid int, term string")
    return retrieval.top(retrieval.bm25(asked, docs).withColumn("score", F.round("score", 6)), 60, [F.desc("score"), F.col("id")])


_BM25 = r"""dw AS (SELECT doc_id AS id, regexp_split_to_array(lower(text), '[^\p{L}0-9]+') AS words FROM documents), st AS (SELECT count(*) AS n, avg(len(words)) AS m FROM dw),
qt AS (SELECT * FROM (VALUES """ + ", ".join(f"({q}, '{t}')" for q, t in TERMS) + """) x(qid, term)), tf AS (SELECT id, size, term, count(*) AS tf FROM (SELECT id, len(words) AS size, unnest(words) AS term FROM dw) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), bm AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / m))), 6) AS score
 FROM tf JOIN dfq USING (term) JOIN qt USING (term), st GROUP BY 1, 2), bk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm)"""


@_register(f"WITH {_BM25} SELECT qid::INT AS qid, id, score FROM bk WHERE rank <= 60")
def q_bm25(spark, sf):
    return _bm25(spark, sf).select("qid", "id", "score")


@_register(f"""WITH {_BM25}, pg AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id DESC) AS rank FROM bm),
u AS (SELECT qid, id, rank FROM bk WHERE rank <= 60 UNION ALL SELECT qid, id, rank FROM pg WHERE rank <= 30), f AS (SELECT qid, id, sum(1::DOUBLE / (60 + rank)) AS rrf, count(*) AS lists FROM u GROUP BY 1, 2)
SELECT qid::INT AS qid, id, round(rrf, 9) AS rrf, lists FROM f""")
def q_rrf(spark, sf):
    one = _bm25(spark, sf)
    docs = retrieval.top(retrieval.bm25(spark.createDataFrame(list(TERMS), "qid int, term string"), _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.split(F.lower("text"), r"[^\p{L}0-9]+").alias("words"))).withColumn("score", F.round("score", 6)), 30, [F.desc("score"), F.desc("id")])
    return retrieval.rrf([one, docs]).select("qid", "id", F.round("rrf", 9).alias("rrf"), "lists")


_HYBRID = """WITH q AS (SELECT vec_id AS qid, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
c AS (SELECT qid, vec_id AS id, (label = qid % 10)::INT * 8::DOUBLE + vec_id % 3 AS lex, round(list_inner_product(embedding::DOUBLE[], e::DOUBLE[]), 6) AS sim FROM embeddings, q),
f AS (SELECT *, round(0.45::DOUBLE * least(1, lex / 12) + 0.55::DOUBLE * greatest(0, least(1, sim)), 6) AS final FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, lex DESC, id) AS rank FROM f WHERE final > 0)
SELECT qid, id, final, rank::INT AS rank FROM r WHERE rank <= 10"""


def _hybrid(spark, sf, every: int) -> DataFrame:
    here = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.when(k == F.col("label"), 8.0).otherwise(0.0))
    rows = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.concat(here, F.array((F.col("vec_id") % 3).cast("double"))).alias("lv"))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.when(k == F.col("qid") % 10, 1.0).otherwise(0.0))
    queries = _queries(spark, sf, every).withColumn("lq", F.concat(wanted, F.array(F.lit(1.0))))
    return retrieval.hybrid_search(queries, rows, 10).select("qid", "id", "final", "rank")


@_register(_HYBRID)
def q_hybrid_search(spark, sf):
    return _hybrid(spark, sf, 100)


@_register(_HYBRID.replace("% 100", "% 20"))
def q_hybrid_search_twentieth(spark, sf):
    """q_hybrid_search for every row whose id is divisible by 20."""
    return _hybrid(spark, sf, 20)


@_register("""WITH s AS (SELECT p_partkey, CASE WHEN lower(p_name) = 'part' THEN 100 ELSE 0 END + CASE WHEN contains(lower(p_type), 'steel') THEN 2.25::DOUBLE ELSE 0 END + p_size % 5 AS score FROM part)
SELECT p_partkey, score FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 4""")
def q_fuzzy_lookup(spark, sf):
    score = F.when(F.lower("p_name") == "part", 100.0).otherwise(0.0) + F.when(F.contains(F.lower("p_type"), F.lit("steel")), 2.25).otherwise(0.0) + F.col("p_size") % 5
    return _t(spark, sf, "part").select("p_partkey", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "p_partkey").limit(4)


# --- rollups ------------------------------------------------------------------------------------


@_register("""WITH k AS (SELECT CAST(ts AS DATE) AS day, 'type' AS kind, event_type AS key, event_id, user_id, value FROM events UNION ALL SELECT CAST(ts AS DATE), 'k', json_extract_string(props, '$.k'), event_id, user_id, value FROM events)
SELECT day, kind, key, count(*) AS article_count, count(DISTINCT event_id) AS event_count, count(DISTINCT user_id) AS publisher_count, round(max(value), 4) AS max_relevance FROM k GROUP BY 1, 2, 3""")
def q_daily_rollup(spark, sf):
    kinds = {"type": F.array("event_type"), "k": F.array(F.get_json_object("props", "$.k"))}
    return news.daily_rollup(_t(spark, sf, "events"), "ts", "event_id", "user_id", "value", kinds).drop("avg_relevance")


@_register("SELECT conv_id, count(*) AS article_count, min(turn) AS first_seen, max(turn) AS last_seen, max(length(text))::INT AS max_measure, arg_min(role, (turn, text)) AS label, array_to_string(list_sort(list_distinct(list(role))), ',') AS members FROM conversations GROUP BY 1")
def q_event_rollup(spark, sf):
    rows = _t(spark, sf, "conversations").withColumn("size", F.length("text"))
    return news.event_rollup(rows, "conv_id", ["turn", "text"], "role", "role", "size")


@_register("""WITH s AS (SELECT user_id, value > 40 AS flag, CASE WHEN value < 5 THEN 'suspected' WHEN value < 30 THEN 'attributed' WHEN value >= 60 THEN 'disputed' END AS status FROM events)
SELECT user_id, bool_or(flag) AS flag, arg_max(status, CASE status WHEN 'suspected' THEN 1 WHEN 'attributed' THEN 2 ELSE 3 END) FILTER (WHERE status IS NOT NULL) AS status FROM s GROUP BY 1""")
def q_flag_priority_rollup(spark, sf):
    status = F.when(F.col("value") < 5, "suspected").when(F.col("value") < 30, "attributed").when(F.col("value") >= 60, "disputed")
    rows = _t(spark, sf, "events").select("user_id", (F.col("value") > 40).alias("flag"), status.alias("status"))
    return rows.groupBy("user_id").agg(F.bool_or("flag").alias("flag"), news.strongest("status").alias("status"))


@_register("""WITH e AS (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events), k AS (SELECT day, 'overall' AS kind, 'all' AS key, user_id FROM e UNION SELECT day, 'type', event_type, user_id FROM e UNION SELECT day, 'parity', (user_id % 2)::VARCHAR, user_id FROM e)
SELECT day, kind, key, count(*) AS event_count FROM k GROUP BY 1, 2, 3""")
def q_multi_kind_series(spark, sf):
    kinds = {"overall": F.array(F.lit("all")), "type": F.array("event_type"), "parity": F.array((F.col("user_id") % 2).cast("string"))}
    return news.daily_rollup(_t(spark, sf, "events"), "ts", "user_id", "user_id", "value", kinds).select("day", "kind", "key", "event_count")


@_register("""WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, round(avg(o_totalprice), 4) AS top_mean, count(*) AS top_n FROM r WHERE r <= greatest(1, ceil(0.25 * n)) GROUP BY 1""")
def q_top_quartile(spark, sf):
    return news.top_share_mean(_t(spark, sf, "orders"), "o_totalprice", by=["o_orderpriority"], tie="o_orderkey").select("o_orderpriority", *_r("top_mean", digits=4), "top_n")


@_register("""WITH e AS (SELECT CAST(ts AS DATE) AS d, event_type, round(least(100, value), 2) AS score, value > 50 AS r FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-28' - 90 AND CAST(ts AS DATE) <= DATE '2024-01-28'),
q AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS rn, count(*) OVER () AS n FROM e), s AS (SELECT avg(score) AS severity FROM q WHERE rn <= greatest(1, ceil(0.25 * n))),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE r) AS a, count(*) FILTER (WHERE d >= DATE '2024-01-28' - 30) AS now, count(*) FILTER (WHERE d < DATE '2024-01-28' - 30) AS bef, count(DISTINCT event_type) AS k FROM e)
SELECT round(severity, 5) AS severity, round(0.30::DOUBLE * severity + 0.20::DOUBLE * least(100, n / 20 * 100) + 0.15::DOUBLE * least(100, k / 5 * 100) + 0.15::DOUBLE * least(100, a / 8 * 100) + 0.20::DOUBLE * CASE WHEN bef > 0 THEN least(100, greatest(0, 50 + 50 * (now / bef - 1))) WHEN now > 0 THEN 100 ELSE 0 END, 5) AS idx FROM c, s""")
def q_escalation_index(spark, sf):
    rows = _t(spark, sf, "events").select(F.to_date("ts").alias("last_seen"), F.round(F.least(F.lit(100.0), F.col("value")), 2).alias("score"), F.array("event_type").alias("actors"), (F.col("value") > 50).alias("responses"))
    return news.escalation_index(rows, "2024-01-28").select(*_r("severity", "idx", digits=5))


@_register("SELECT user_id, count(DISTINCT event_id) AS events, CAST(min(ts) AS DATE) AS first_seen, CAST(max(ts) AS DATE) AS last_seen, max(value) AS max_score FROM events GROUP BY 1 ORDER BY events DESC, max_score DESC, user_id LIMIT 10")
def q_campaigns(spark, sf):
    return news.campaigns(_t(spark, sf, "events"), "user_id", "event_id", "ts", "value")


# --- graph --------------------------------------------------------------------------------------


def _graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    t = lambda n: _t(spark, sf, n)
    nodes = graph.nodes_of(t("customer"), "customer", "c_custkey", "c_name")
    for kind, table, key, label in (("supplier", "supplier", "s_suppkey", "s_name"), ("nation", "nation", "n_nationkey", "n_name"), ("region", "region", "r_regionkey", "r_name")):
        nodes = nodes.unionByName(graph.nodes_of(t(table), kind, key, label))
    edges = graph.edges_of(t("customer"), "LIVES_IN", ("customer", "c_custkey"), ("nation", "c_nationkey"))
    edges = edges.unionByName(graph.edges_of(t("supplier"), "BASED_IN", ("supplier", "s_suppkey"), ("nation", "s_nationkey")))
    return nodes, edges.unionByName(graph.edges_of(t("nation"), "PART_OF", ("nation", "n_nationkey"), ("region", "n_regionkey")))


_EDGES = """e AS (SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst, 'LIVES_IN' AS rel FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'BASED_IN' FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'PART_OF' FROM nation)"""


@_register(f"WITH {_EDGES} SELECT src, dst, rel, 1::DOUBLE AS weight FROM e")
def q_graph_edges(spark, sf):
    return _graph(spark, sf)[1]


@_register(f"WITH {_EDGES} SELECT 'edge' AS part, rel AS name, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'node', 'customer', count(*) FROM customer UNION ALL SELECT 'node', 'supplier', count(*) FROM supplier UNION ALL SELECT 'node', 'nation', count(*) FROM nation UNION ALL SELECT 'node', 'region', count(*) FROM region")
def q_graph_stats(spark, sf):
    return graph.stats(*_graph(spark, sf))


@_register("""WITH x AS (SELECT o_custkey, o_orderkey AS src, o_orderdate AS a, lead(o_orderkey) OVER z AS dst, lead(o_orderdate) OVER z AS b FROM orders WINDOW z AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, src, dst, round(date_diff('second', a, b) / 86400, 2) AS gap_days FROM x WHERE dst IS NOT NULL""")
def q_precedes(spark, sf):
    return graph.precedes(_t(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


@_register(f"""WITH RECURSIVE {_EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), h AS (SELECT 'region:1' AS id, 0 AS hop UNION ALL SELECT b.dst, hop + 1 FROM h JOIN b ON b.src = h.id WHERE hop < 2),
m AS (SELECT id, min(hop)::INT AS hop FROM h GROUP BY 1) SELECT id, hop FROM m ORDER BY hop, id LIMIT 500""")
def q_khop(spark, sf):
    roots = _t(spark, sf, "region").where("r_regionkey = 1").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("id"))
    return graph.k_hop(_graph(spark, sf)[1], roots, 2)


# --- evaluation ---------------------------------------------------------------------------------


def _judged(spark, sf) -> DataFrame:
    docs = _t(spark, sf, "documents").select("doc_id", (F.pmod(F.col("n_chars") * 37 + F.col("doc_id"), F.lit(1000)) / 1000.0).alias("score"))
    return _t(spark, sf, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id")


_JUDGED = "j AS (SELECT doc_id, quality AS y, ((n_chars * 37 + doc_id) % 1000) / 1000 AS score FROM labels JOIN documents USING (doc_id))"


@_register(f"WITH {_JUDGED} SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5 ELSE 0 END), 6) AS auc FROM j p, j n WHERE p.y = 1 AND n.y = 0")
def q_auc(spark, sf):
    return scoring.roc_auc(_judged(spark, sf), "score", "y").select(*_r("auc"))


@_register(f"WITH {_JUDGED}, r AS (SELECT y, sum(y) OVER z AS hits, row_number() OVER z AS rank FROM j WINDOW z AS (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)) SELECT round(sum(hits::DOUBLE / rank) FILTER (WHERE y = 1) / count(*) FILTER (WHERE y = 1), 6) AS ap FROM r")
def q_ap(spark, sf):
    return scoring.average_precision(_judged(spark, sf), "score", "y", "doc_id").select(*_r("ap"))


@_register(f"WITH {_JUDGED} SELECT round(avg((score - y) * (score - y)), 6) AS brier, count(*) FILTER (WHERE score >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND y = 0) AS tn, count(*) FILTER (WHERE score < 0.5 AND y = 1) AS fn FROM j")
def q_brier_confusion(spark, sf):
    rows = _judged(spark, sf).withColumn("g", F.lit(0))
    brier = rows.agg(F.round(F.avg((F.col("score") - F.col("y")) * (F.col("score") - F.col("y"))), 6).alias("brier"))
    return scoring.confusion(rows, F.col("score") >= 0.5, "y", ["g"]).join(brier).select("brier", "tp", "fp", "tn", "fn")


@_register(f"""WITH {_JUDGED}, g AS (SELECT round(0.2::DOUBLE + i * 0.01::DOUBLE, 6) AS threshold FROM range(0, 61) x(i)), c AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND y = 1)::DOUBLE / count(*) FILTER (WHERE y = 1) AS recall,
 count(*) FILTER (WHERE score >= threshold AND y = 0)::DOUBLE / count(*) FILTER (WHERE y = 0) AS fpr FROM j, g GROUP BY 1), b AS (SELECT *, round((recall + 1 - fpr) / 2, 4) AS balanced FROM c)
SELECT threshold, balanced, round(recall, 6) AS recall, round(fpr, 6) AS fpr FROM b ORDER BY balanced DESC, round(fpr, 9), threshold LIMIT 1""")
def q_threshold_sweep(spark, sf):
    return scoring.threshold_sweep(_judged(spark, sf), "score", "y", 0.2, 0.8, 61).select("threshold", "balanced", *_r("recall", "fpr"))


_LAYERS = [([[0.5, -0.25], [0.75, 0.125], [-0.5, 0.25]], [0.1, -0.2]), ([[1.5], [-0.75]], [0.05])]
_P = "1 / (1 + exp(-(0.05::DOUBLE + 1.5::DOUBLE * tanh(0.1::DOUBLE + 0.5::DOUBLE * a + 0.75::DOUBLE * b - 0.5::DOUBLE * c) - 0.75::DOUBLE * tanh(-0.2::DOUBLE - 0.25::DOUBLE * a + 0.125::DOUBLE * b + 0.25::DOUBLE * c))))"


@_register(f"WITH x AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings), p AS (SELECT vec_id, {_P} AS p, 0.5::DOUBLE AS q FROM x) SELECT vec_id, round(p, 6) AS p, round((p + q) / 2, 6) AS mean, round(abs(p - q) / 2, 6) AS sd FROM p")
def q_mlp_forward(spark, sf):
    p = _t(spark, sf, "embeddings").select("vec_id", mlp.forward(F.col("embedding"), _LAYERS).alias("p"))
    mean, sd = mlp.ensemble([F.col("p"), F.lit(0.5)])
    return p.select("vec_id", *_r("p"), F.round(mean, 6).alias("mean"), F.round(sd, 6).alias("sd"))


@_register(f"""WITH x AS (SELECT vec_id, embedding[1]::DOUBLE AS a0, embedding[2]::DOUBLE AS b0, embedding[3]::DOUBLE AS c0, unnest([0, 1, 2, 3]) AS f FROM embeddings),
y AS (SELECT vec_id, f, CASE WHEN f = 0 THEN 0 ELSE a0 END AS a, CASE WHEN f = 1 THEN 0 ELSE b0 END AS b, CASE WHEN f = 2 THEN 0 ELSE c0 END AS c FROM x), p AS (SELECT vec_id, f, {_P} AS p FROM y),
d AS (SELECT z.vec_id, z.f AS feature, round(w.p - z.p, 6) AS delta FROM p z JOIN p w ON z.vec_id = w.vec_id AND w.f = 3 WHERE z.f < 3), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(delta) DESC, feature) AS rn FROM d)
SELECT vec_id, feature::INT AS feature, delta FROM r WHERE rn <= 2""")
def q_sensitivity(spark, sf):
    rows = _t(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("x"))
    return mlp.sensitivity(rows, "vec_id", "x", 3, _LAYERS, 2).select("vec_id", "feature", "delta")


_F = "fe AS (SELECT d, max(score) FILTER (WHERE key = '1-URGENT') AS a, max(score) FILTER (WHERE key = '2-HIGH') AS b, max(score) FILTER (WHERE key = 'A') AS c FROM ch GROUP BY d)"


@_register(f"WITH {_CH}, {_F} SELECT d, round(coalesce(a, 0) / 100, 10) AS f0, round(coalesce(b, 0) / 100, 10) AS f1, round(coalesce(c, 0) / 100, 10) AS f2, (a IS NULL)::INT::DOUBLE AS m0, (b IS NULL)::INT::DOUBLE AS m1, CASE WHEN d < DATE '1997-01-01' THEN 'train' WHEN d < DATE '1999-01-01' THEN 'validation' ELSE 'holdout' END AS part FROM fe")
def q_features(spark, sf):
    pick = lambda k, n: F.max(F.when(F.col("key") == k, F.col("score"))).alias(n)
    wide = _channels(spark, sf).groupBy("d").agg(pick("1-URGENT", "a"), pick("2-HIGH", "b"), pick("A", "c")).withColumn("x", mlp.features(["a", "b", "c"]))
    part = F.when(F.col("d") < "1997-01-01", "train").when(F.col("d") < "1999-01-01", "validation").otherwise("holdout")
    return wide.select("d", *[F.round(F.get("x", F.lit(i)), 10).alias(f"f{i}") for i in range(3)], F.get("x", F.lit(3)).alias("m0"), F.get("x", F.lit(4)).alias("m1"), part.alias("part"))


_CAND = f"{_WGT}, mv AS (SELECT x.key AS donor, y.key AS taker, x.key || '>' || y.key AS candidate FROM wt x, wt y WHERE x.key <> y.key AND x.weight - 1 >= 4 AND y.weight + 1 <= 18), cw AS (SELECT candidate, key, weight + CASE WHEN key = donor THEN -1 WHEN key = taker THEN 1 ELSE 0 END AS weight FROM mv, wt)"


@_register(f"WITH {_CH}, {_CAND}, z AS (SELECT candidate, d, round(sum(score * weight) / sum(weight), 6) AS score FROM ch JOIN cw USING (key) GROUP BY 1, 2), {_WIN}, l AS (SELECT z.*, EXISTS (SELECT 1 FROM w WHERE z.d >= start_d - 60 AND z.d <= end_d)::INT AS label FROM z), c AS (SELECT candidate, count(*) AS n, count(*) FILTER (WHERE score >= 45 AND label = 1)::DOUBLE / count(*) FILTER (WHERE label = 1) AS recall, count(*) FILTER (WHERE score >= 45 AND label = 0)::DOUBLE / count(*) FILTER (WHERE label = 0) AS fpr FROM l GROUP BY 1) SELECT candidate, n, round(recall, 4) AS recall, round(fpr, 4) AS fpr FROM c")
def q_objective(spark, sf):
    candidates = scoring.candidate_weights(_weights(spark))
    joined = _channels(spark, sf).join(candidates, "key")
    scored = joined.groupBy("candidate", "d").agg(F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 6).alias("score"))
    labelled = scoring.label_rows(scored, _windows(spark))
    sizes = scored.groupBy("candidate").agg(F.count("*").alias("n"))
    return scoring.confusion(labelled, F.col("score") >= 45, "label", ["candidate"]).join(sizes, "candidate").select("candidate", "n", *_r("recall", "fpr", digits=4))


#: Weight of the network in the baseline, and the two mixes one step of it away.
NETWORK, MIXES = 0.35, (0.30, 0.40)


def _candidate_scores(spark, sf) -> DataFrame:
    """(candidate, d, score) of all one-point transfers, two mixes and the baseline, on days with enough coverage.

    The network is the fixed one of q_mlp_forward over three channels.
    """
    weights, channels = _weights(spark), kept(_channels(spark, sf))
    same = lambda name, share: weights.select(F.lit(name).alias("candidate"), "key", "weight", F.lit(share).alias("share"))
    candidates = scoring.candidate_weights(weights).withColumn("share", F.lit(NETWORK)).unionByName(same("baseline", NETWORK))
    for share in MIXES:
        candidates = candidates.unionByName(same(f"network {share:.2f}", share))
    days = scoring.breadth(channels, "d").select("d", "bonus").join(scoring.weighted_fusion(channels, weights).select("d", "coverage"), "d")
    total = sum(w for _, w in WEIGHTS)
    days = days.where(F.col("coverage") >= 0.55 * total).select("d", "bonus")
    pick = lambda k: F.max(F.when(F.col("key") == k, F.col("score"))).alias(k)
    keys = ["1-URGENT", "2-HIGH", "A"]
    wide = channels.groupBy("d").agg(*map(pick, keys)).toDF("d", "a", "b", "c").withColumn("x", mlp.features(["a", "b", "c"]))
    days = days.join(wide.select("d", (100.0 * mlp.forward(F.col("x"), _LAYERS)).alias("network")), "d")
    rule = channels.join(candidates, "key").groupBy("candidate", "share", "d").agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("raw"))
    mixed = (1.0 - F.col("share")) * scalars.clamp(F.col("raw") + F.col("bonus")) + F.col("share") * F.col("network")
    return rule.join(days, "d").select("candidate", "d", F.round(mixed, 9).alias("score"))


def _calibrated(scored: DataFrame, windows: DataFrame) -> DataFrame:
    """The candidates judged on the days up to 1998, the last window kept out."""
    return scoring.evaluate_candidates(scored.where("d < '1999-01-01'"), windows, windows.where("start < '1999-01-01'"), "baseline")


@_register()
def q_candidate_objective(spark, sf):
    """All one-point transfers and two mixes against the baseline: objective and guardrails, up to 1998, the last window kept out."""
    out = _calibrated(_candidate_scores(spark, sf), _windows(spark))
    return out.select("candidate", *_r("threshold", "auc", "ap", "event_recall", "fpr", "objective", "d_objective", "d_fpr", "d_peak"), F.array_join("reasons", ", ").alias("reasons"), "passes")


@_register()
def q_train_mlp(spark, sf):
    rows = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), (F.col("label") < 3).cast("int").alias("y"))
    return mlp.train_ensemble(rows, [11, 29, 47]).select("seed", "n", "n_validation", "epochs", "loss")


@_register()
def q_cluster_events(spark, sf):
    rows = _t(spark, sf, "embeddings").select(F.col("label").cast("string").alias("topic"), F.timestamp_seconds(F.col("vec_id") * 3600 + 1_700_000_000).alias("ts"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return news.cluster_events(rows)


@_register("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM (SELECT DISTINCT ts, event_id, event_type FROM events) GROUP BY 1, 2")
def q_stream_dedup(spark, sf):
    return ingest.daily_counts(ingest.dedup_stream(_t(spark, sf, "events"), "ts", ["event_id"]), "ts", "event_type")
