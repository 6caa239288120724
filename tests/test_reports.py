"""Sweeps, quantiles, state documents, stored vectors, lookups and the corpus's graph against naive Python."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stresslens.operators import filters, newsgraph, retrieval, scoring, sketches
from stresslens.sources.vectors import VectorCache


@pytest.mark.parametrize(("low", "high", "steps", "digits"), [(0.2, 0.8, 61, 4), (20.0, 80.0, 121, None), (0.0, 1.0, 2, 4)])
def test_sweep_against_a_loop(spark, low, high, steps, digits):
    rng = random.Random(steps)
    span = high - low
    rows = [(rng.choice("ab"), rng.choice([low - span, high + span, low, high, round(low + span * rng.randrange(2 * steps) / (2 * steps - 2), 6), low + span * rng.random()]), rng.randrange(2)) for _ in range(400)] + [("a", None, 1)]
    got = {r["g"]: r for r in scoring.threshold_sweep(spark.createDataFrame(rows, "g string, s double, y int"), "s", "y", low, high, steps, ["g"], digits).collect()}
    for g in "ab":
        mine, best = [(s, y) for h, s, y in rows if h == g], None
        pos, neg = sum(y for _, y in mine), sum(1 - y for _, y in mine)
        for k in range(steps):
            t = round(low + k * (span / (steps - 1)), 6)
            recall, fpr = (sum(s is not None and s >= t and y == want for s, y in mine) / n for want, n in ((1, pos), (0, neg)))
            balanced = (recall + 1 - fpr) / 2
            key = (balanced if digits is None else round(balanced + 1e-12, digits), -round(fpr, 9), -t)
            best = max(best or (key, t, recall, fpr), (key, t, recall, fpr))
        assert (got[g]["threshold"], round(got[g]["recall"], 9), round(got[g]["fpr"], 9)) == (best[1], round(best[2], 9), round(best[3], 9))


def test_quantiles_against_numpy(spark):
    rng = random.Random(8)
    values = [rng.choice([1.0, 2.5, rng.random() * 50]) for _ in range(333)]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    got = scoring.quantiles(rows, "v", [0.0, 0.1, 0.5, 0.99, 1.0]).first()
    assert np.allclose(list(got), np.quantile(values, [0.0, 0.1, 0.5, 0.99, 1.0]))
    assert list(scoring.quantiles(rows.where("v is null"), "v", [0.5]).first()) == [None]
    assert list(scoring.quantiles(rows.where("v = 2.5").limit(1), "v", [0.3]).first()) == [2.5]


def test_state_documents(spark):
    whole = {"decision": "keep", "candidate_count": 3, "baseline": {"auc": 0.5}, "top_candidates": ["a", "b"], "unknown": 1}
    rows = spark.createDataFrame([(1, json.dumps(whole)), (2, None), (3, ""), (4, "{}"), (5, "{broken"), (6, "[1]")], "id int, doc string").withColumn("state", F.lit("clash"))
    got = {r["id"]: r for r in filters.state_documents(rows.drop("state"), "doc", filters.AGENT_STATE).collect()}
    assert [k for k in got if got[k]["available"]] == [1]
    assert (got[1]["decision"], got[1]["candidate_count"], got[1]["top_candidates"], json.loads(got[1]["baseline"])) == ("keep", 3, ["a", "b"], {"auc": 0.5})
    assert all(v is None for k in (2, 3, 4, 5, 6) for v in list(got[k])[2:])


def test_vectors_are_made_once(spark, tmp_path):
    embed = lambda text: F.array(F.length(text).cast("double"))
    cache = VectorCache(spark, f"file://{tmp_path}/vectors", "length", embed)
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "bb"), (4, None), (5, "")], "id int, text string").withColumn("v", F.lit("clash"))
    got, made = cache.vectors(rows, "text")
    assert made == 3 and {r["id"]: r["v"] for r in got.collect()} == {1: [1.0], 2: [2.0], 3: [2.0], 4: [0.0], 5: [0.0]}
    version = cache.log.latest()
    assert cache.vectors(rows, "text")[1] == 0 and cache.log.latest() == version
    more = spark.createDataFrame([(6, "ccc"), (7, "a")], "id int, text string")
    got, made = cache.vectors(more, "text")
    assert made == 1 and {r["id"]: r["v"] for r in got.collect()} == {6: [3.0], 7: [1.0]}
    other = VectorCache(spark, f"file://{tmp_path}/vectors", "other", embed)
    assert other.vectors(more, "text")[1] == 2 and cache.vectors(rows.limit(0), "text")[1] == 0


def test_event_lookup(spark):
    events = spark.createDataFrame([("gfc", "Global  Financial crisis"), ("euro", "Euro area debt crisis"), ("z", None)], "key string, body string")
    asked = spark.createDataFrame([(1, "financial crisis"), (2, "EURO"), (3, "nothing"), (4, "crisis"), (5, ""), (6, None)], "qid int, text string")
    got = {r["qid"]: r for r in retrieval.event_lookup(asked, events).collect()}
    assert {k: got[k]["key"] for k in got} == {1: "gfc", 2: "euro", 3: None, 4: "euro", 5: None, 6: None}
    assert got[3]["available"] == ["euro", "gfc", "z"] and got[1]["score"] == 8 + 2.25 * 2 and not got[6]["found"]


COLUMNS = "seq long, doc_id string, title string, url string, published_at string, publisher string, source_name string, trust double, relevance double, event_id string, event_label string, score double, geopolitical boolean, " + ", ".join(
    f"{c} array<string>" for c in ("topics", "indicators", "entities", "actors", "targets", "modalities", "responses", "channels")
) + ", attributions array<struct<actor:string,status:string>>"


def naive_edges(rows):
    edges = {}
    put = lambda src, dst, rel, w=1.0: edges.__setitem__((src, dst, rel), round(w, 4))
    for r in rows:
        article, event = f"article:{r['doc_id']}", f"event:{r['event_id'] or 'unclustered'}"
        put(article, f"source:{r['publisher'] or r['source_name'] or 'unknown'}", "PUBLISHED_BY", r["trust"] or 0.5)
        put(article, event, "EVIDENCE_FOR", r["relevance"] or 0.0)
        if r["published_at"]:
            put(event, f"day:{r['published_at'][:10]}", "OBSERVED_ON")
        for name, prefix, rel, src, w in (("topics", "topic", "ABOUT", event, r["relevance"] or 0.0), ("indicators", "indicator", "IMPACTS", event, r["relevance"] or 0.0), ("entities", "entity", "MENTIONS", article, 1.0)):
            for x in r[name] or []:
                put(src, f"{prefix}:{x}", rel, w)
        if r["geopolitical"]:
            for name, prefix, rel, src in (("actors", "actor", "MENTIONS_ACTOR", article), ("targets", "target", "TARGETS", event), ("modalities", "modality", "USES_MODALITY", event), ("responses", "response", "ASSOCIATED_RESPONSE", event), ("channels", "indicator", "POTENTIAL_MARKET_CHANNEL", event)):
                for x in r[name] or []:
                    put(src, f"{prefix}:{x}", rel)
            for a, _ in r["attributions"] or []:
                put(event, f"actor:{a}", "REPORTED_ATTRIBUTION")
    return edges


def test_last_writes_of_the_graph(spark):
    rng = random.Random(6)
    some = lambda *of: rng.choice([None, [], rng.sample(of, rng.randint(1, len(of)))])
    rows = [{
        "seq": k, "doc_id": f"d{k % 70}", "title": f"t{k}", "url": None, "published_at": rng.choice([None, f"2024-01-{1 + k % 20:02d}T00:00:00Z"]), "publisher": rng.choice([None, "p1", "p2"]), "source_name": rng.choice([None, "s"]),
        "trust": rng.choice([None, 0.0, 0.25, 0.9]), "relevance": rng.choice([None, 0.123456, 0.5]), "event_id": rng.choice([None, "e1", "e2", "e3"]), "event_label": rng.choice([None, f"l{k}"]), "score": 1.0, "geopolitical": rng.choice([None, True, False]),
        "topics": some("a", "b"), "indicators": some("x"), "entities": some("n", "m"), "actors": some("u", "v"), "targets": some("g"), "modalities": some("c", "d"), "responses": some("r"), "channels": some("x", "y"),
        "attributions": rng.choice([None, [("u", "suspected")], [("v", "reported_attributed"), ("u", "suspected")]]),
    } for k in range(120)]
    table = spark.createDataFrame([tuple(r.values()) for r in rows], COLUMNS).repartition(5)
    nodes, edges = newsgraph.article_writes(table)
    got = {(r["src"], r["dst"], r["rel"]): r["weight"] for r in newsgraph.last_edges(edges).collect()}
    assert got == naive_edges(rows)
    labels = {r["id"]: r["label"] for r in newsgraph.last_nodes(nodes).collect()}
    assert set(labels) == {end for src, dst, _ in got for end in (src, dst)}
    last = {f"event:{r['event_id'] or 'unclustered'}": r["event_label"] or r["title"] for r in rows} | {f"article:{r['doc_id']}": r["title"] for r in rows}
    assert all(labels[k] == v for k, v in last.items())


def test_campaigns_and_episodes(spark):
    events = spark.createDataFrame([("e1", 3, [("a", "reported_attributed"), ("b", "suspected")]), ("e2", 1, [("a", "reported_attribution_disputed")]), ("e3", 2, None)], "event_id string, first_seen int, attributions array<struct<actor:string,status:string>>")
    nodes, edges = newsgraph.campaign_writes(events)
    assert {(r["src"], r["rel"], r["dst"]) for r in edges.collect()} == {("campaign:a", "REPORTED_ACTOR_THREAD", "actor:a"), ("campaign:a", "HAS_EVENT", "event:e1"), ("campaign:a", "HAS_EVENT", "event:e2"), ("event:e2", "CAMPAIGN_PRECEDES", "event:e1")}
    assert {r["label"] for r in nodes.where("kind = 'Campaign'").collect()} == {"a reported-attribution thread"}
    windows = spark.createDataFrame([("w1", None, "2008"), ("w2", "Second", "2001")], "id string, name string, start string")
    nodes, edges = newsgraph.episode_writes(windows, {"w1": ("banking", ["x", "y"])})
    assert {(r["src"], r["rel"], r["dst"]) for r in edges.collect()} == {
        ("historical:w1", "ABOUT", "topic:banking"), ("historical:w1", "IMPACTS", "indicator:x"), ("historical:w1", "IMPACTS", "indicator:y"), ("historical:w2", "ABOUT", "topic:systemic_crisis"), ("historical:w2", "PRECEDES", "historical:w1")}
    assert {r["label"] for r in nodes.where("kind = 'HistoricalEpisode'").collect()} == {"w1", "Second"}


def test_sketches_of_days_merge(spark):
    rows = spark.range(30_000).select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 12).cast("int")).alias("d"), (F.pmod(F.xxhash64("id"), F.lit(9000))).alias("u"), (F.col("id") % 7).alias("t"), (F.col("id") % 1000).cast("double").alias("v"))
    days = sketches.daily_sketches(rows, F.col("d"), ["u", "t"], "v")
    whole = F.lit("all")
    got = sketches.estimates(sketches.merged(days, whole, ["u", "t"]), ["u", "t"], [0.1, 0.5]).first()
    users = rows.select("u").distinct().count()
    assert got["rows"] == 30_000 and got["n_t"] == 7 and abs(got["n_u"] - users) < 0.06 * users
    assert abs(got["p10"] - 100) < 30 and abs(got["p50"] - 500) < 30
    small = days.where("day < '2024-01-03'")
    exact = rows.where("d < '2024-01-03'").select("t").distinct().count()
    assert sketches.estimates(sketches.merged(small, whole, ["u", "t"]), ["t"], []).first()["n_t"] == exact
    odd = spark.createDataFrame([(None, 1, 1.0), ("2024-01-01", None, None)], "d string, u int, v double")
    one = sketches.estimates(sketches.daily_sketches(odd, F.to_date("d"), ["u"], "v"), ["u"], [0.5]).collect()
    assert [(r["rows"], r["n_u"], r["p50"]) for r in one] == [(1, 0, None)]


def test_counters_while_writing(spark, tmp_path):
    rows = spark.range(100).withColumn("x", F.when(F.col("id") % 3 == 0, F.col("id")))
    seen = filters.write_observed(rows, f"file://{tmp_path}/t", {"known": F.col("x").isNotNull(), "big": F.col("x") > 50})
    assert seen == {"rows": 100, "known": 34, "big": 17} and spark.read.parquet(f"{tmp_path}/t").count() == 100
    assert filters.as_views({"t": rows}, "seen_") == ["seen_t"] and spark.sql("SELECT count(x) FROM seen_t").first()[0] == 34


def test_many_distinct_values_are_counted_exactly(spark):
    many = (1 << sketches.LG) + 1000
    rows = spark.range(4 * many).select((F.col("id") % 2).cast("int").alias("d"), (F.col("id") % many).alias("u"), (F.col("id") % 3).cast("string").alias("t"))
    rows = rows.select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).alias("d"), F.when(F.col("u") > 0, F.col("u")).alias("u"), "t", F.lit(1.0).alias("v"))
    whole = F.floor(F.datediff("day", F.lit("1970-01-01").cast("date")) / 7)
    read = sketches.estimates(sketches.merged(sketches.daily_sketches(rows, F.col("d"), ["u", "t"], "v"), whole, ["u", "t"]), ["u", "t"], [0.5])
    got = sketches.exact_counts(read, sketches.daily_values(rows, F.col("d"), ["u", "t"]), whole, ["u", "t"]).collect()
    assert [(r["rows"], r["n_u"], r["n_t"], r["p50"]) for r in got] == [(4 * many, many - 1, 3, 1.0)]


def test_weeks_with_many_users(spark, tmp_path):
    from stresslens.plans import catalog

    events = spark.range(12_000).select(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 40).cast("timestamp_ntz").alias("ts"), (F.col("id") % 5500).alias("user_id"), F.lit("click").alias("event_type"), F.when(F.col("id") < 6000, F.col("id") / 10).alias("value"))
    events.write.parquet(f"file://{tmp_path}/events.parquet")
    got = catalog.queries()["q_daily_sketches"](spark, f"file://{tmp_path}").collect()
    want = events.groupBy(F.floor(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")) / 7).alias("part")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("u")).collect()
    assert max(r["u"] for r in want) > 1 << sketches.LG
    assert sorted((r["part"], r["rows"], r["n_user_id"], r["n_event_type"], r["median_in_bounds"]) for r in got) == sorted((r["part"], r["n"], r["u"], 1, True) for r in want)
