"""Enrichment, ordered values, clustering, lookups, sources and streams against naive Python."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stresslens.functions import text
from stresslens.operators import enrich, filters, graph, news, ordered, retrieval, scoring
from stresslens.sources import io
from stresslens.streaming import ingest

ACTORS = {"Atlantis": ["atlantis", "atl"], "Lemuria": ["lemurian"], "Mu": ["mu"]}
CUES = {"attributed": ["blamed"], "suspected": ["suspect"], "disputed": ["denied"]}


def naive_positions(body, alias, bounded):
    short = bounded and alias.isascii() and sum(c.isalnum() for c in alias) <= 3
    pattern = rf"(?<![a-z0-9]){re.escape(alias)}(?![a-z0-9])" if short else re.escape(alias)
    return [m.start() for m in re.finditer(pattern, body)]


def naive_attributions(said):
    body = said.lower()
    actors = sorted({(p, k) for k, found in ACTORS.items() for a in found for p in naive_positions(body, a, True)})
    near = {}
    for cue, found in CUES.items():
        for a in found:
            for at in naive_positions(body, a, False):
                reach = [(abs(p - at), k) for p, k in actors if abs(p - at) <= 100]
                near.setdefault(cue, set()).update(k for d, k in reach if d == min(reach)[0])
    a, s, d = (near.get(c, set()) for c in ("attributed", "suspected", "disputed"))
    return {(k, "reported_attribution_disputed" if k in a and k in d else "reported_attributed" if k in a else "suspected") for k in a | s}


def test_attributions_against_naive(spark):
    rng = random.Random(4)
    words = ["atlantis", "atl", "lemurian", "mu", "museum", "blamed", "suspects", "denied", "x" * 40, "the", "and"]
    rows = [(str(k), " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for k in range(120)] + [("none", None), ("empty", "")]
    df = spark.createDataFrame(rows, "id string, said string")
    got = {}
    for r in enrich.attributions(df, "id", "said", ACTORS, CUES).collect():
        got.setdefault(r["id"], set()).add((r["actor"], r["status"]))
    assert got == {k: found for k, t in rows if (found := naive_attributions(t or ""))}


def test_severity_and_flags(spark):
    taxonomy = {"actors": {"NATO": ["nato"], "Poland": ["poland"], "Russia": ["russia"]}, "modalities": {"sabotage": ["sabotage"], "cyber_attack": ["hack"]}, "targets": {"energy": ["pipeline"]}, "responses": {"sanctions": ["sanction"]}, "cues": {"attributed": ["blames"], "suspected": ["suspect"], "disputed": ["denies"]}, "transmission": {"sabotage": ["oil"], "energy": ["oil", "gas"]}}
    rows = spark.createDataFrame([
        (1, "NATO and Poland: Russia blames sabotage of the pipeline, sanctions follow", "Ministry of X", "markets"), (2, "pipeline repaired", "Wire", "markets"), (3, "Russia and the pipeline", "Wire", "eu_gas"), (4, None, None, None),
    ], "id int, said string, publisher string, theme string")
    got = {r["id"]: r for r in enrich.enrich(rows, "id", "said", taxonomy, F.col("publisher"), F.col("theme")).collect()}
    assert got[1]["geopolitical"] and got[1]["score"] == 18 + 16 + 12 + 10 + 12 + 8 and got[1]["channels"] == ["gas", "oil"] and got[1]["source_class"] == "official_primary"
    assert [got[k]["geopolitical"] for k in (2, 3, 4)] == [False, True, False] and got[3]["source_class"] == "official_discovery_query"
    events = enrich.event_rollup(enrich.enrich(rows.withColumn("event", F.lit("e")), "id", "said", taxonomy, F.col("publisher"), F.col("theme")), "event", "id", "id", "said", "publisher")
    one = events.collect()
    assert len(one) == 1 and one[0]["article_count"] == 2 and one[0]["actors"] == ["NATO", "Poland", "Russia"] and one[0]["event_score"] == 76.0


def test_topics_are_lifted_by_aliases(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], ["b"]), (2, [0.6, 0.8], []), (3, [-1.0, 0.0], [])], "id int, vec array<double>, hits array<string>")
    descriptors = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [-0.1, 0.0])], "topic string, vec array<double>")
    got = {r["id"]: r for r in enrich.classify(rows, "vec", F.col("hits"), descriptors, {"a": ["x", "w"], "b": ["x", "y"]}).collect()}
    assert (got[1]["topics"], got[1]["relevance"], got[1]["indicators"]) == (["a", "b"], 1.0, ["w", "x", "y"])
    assert got[2]["topics"] == ["a"] and got[2]["relevance"] == 0.8
    assert got[3]["topics"] == ["b"] or got[3]["topics"] == ["a"]  # none reaches the floor: the best alone


def test_running_sums_and_sessions(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b"]), rng.randint(0, 40), k, rng.randint(-3, 9)) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, at int, id int, v int")
    got = {r["id"]: r["total"] for r in ordered.running_sums(df, ["g"], [F.col("at"), F.col("id")], {"total": F.col("v")}).collect()}
    for g, at, k, _ in rows:
        assert got[k] == sum(v for h, t, i, v in rows if h == g and (t, i) <= (at, k))
    found = {r["id"]: r["session"] for r in news.sessions(df.where("g = 'a'").withColumn("at", F.col("at") * 1.0), ["g"], "at", "id", 1.0).collect()}
    last, session = None, 0
    for _, at, k, _ in sorted((r for r in rows if r[0] == "a"), key=lambda r: (r[1], r[2])):
        session += last is not None and at - last > 1.0
        last = at
        assert found[k] == session


def naive_clusters(rows):
    clusters, out = [], {}
    for _, at, k, v in sorted(rows, key=lambda r: (r[1], r[2])):
        best, mine = None, None
        for c in reversed(clusters):
            if -24 <= at - c["last"] <= 96 and (best is None or float(c["c"] @ v) > best):
                best, mine = float(c["c"] @ v), c
        if mine is None or best < 0.68:
            mine = {"c": v.copy(), "n": 0, "last": at, "leader": k}
            clusters.append(mine)
        else:
            moved = (mine["c"] * mine["n"] + v) / (mine["n"] + 1)
            mine["c"] = moved / np.linalg.norm(moved)
        mine["n"], mine["last"] = mine["n"] + 1, max(mine["last"], at)
        out[k] = mine["leader"]
    return out


def test_clusters_against_naive(spark):
    rng = np.random.default_rng(3)
    centres, rows = rng.normal(size=(6, 8)), []
    for k in range(240):
        v = centres[k % 6] + rng.normal(scale=0.55, size=8)
        rows.append(("t", float(rng.integers(0, 2000)), f"id{k:03d}", v / np.linalg.norm(v)))
    df = spark.createDataFrame([(t, h, k, v.tolist()) for t, h, k, v in rows], "topic string, h double, id string, vec array<double>").withColumn("ts", F.timestamp_seconds(F.col("h") * 3600))
    got = {r["id"]: r["event_id"] for r in news.cluster_events(df).collect()}
    want = naive_clusters(rows)
    assert len(set(want.values())) < len(want)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == x) for x in set(m.values()))
    assert groups(got) == groups(want)
    assert news.cluster_events(df.withColumn("ts", F.lit(None).cast("timestamp"))).count() == 240


def test_fuzzy_lookup_stages(spark):
    items = spark.createDataFrame([("fed", "Policy Rate", "central bank target"), ("repo", "funding market", "secured overnight repo")], "key string, name string, body string")
    asked = spark.createDataFrame([(1, " FED "), (2, "repo stress"), (3, "zzz")], "qid int, text string")
    got = {r["qid"]: (r["found_by"], r["key"]) for r in retrieval.fuzzy_lookup(asked, items).collect()}
    assert got == {1: ("exact", "fed"), 2: ("lexical", "repo"), 3: ("not found", None)}
    similar = retrieval.fuzzy_lookup(asked.where("qid = 3"), items, F.when(F.col("item.key") == "repo", 0.4).otherwise(0.1)).first()
    assert (similar["found_by"], similar["key"]) == ("similar", "repo")


def test_hashed_vectors_have_unit_length(spark):
    rows = spark.createDataFrame([(["a", "b", "a"],), ([],)], "words array<string>")
    lengths = [sum(x * x for x in r["v"]) for r in rows.select(retrieval.hashed_vector(F.col("words"), 16).alias("v")).collect()]
    assert lengths == [pytest.approx(1.0), 0.0]


def test_text_details(spark):
    row = spark.range(1).select(
        text.html_text(F.lit("<p>a &#233;&#x1F600; &amp; &#99999999999; b</p>")).alias("html"), text.language(F.lit("ja-JP")).alias("lang"), text.trust(F.lit(None)).alias("trust"),
        text.query_url("http://x?q={query}&l=en", F.lit("a b&c")).alias("url"), text.truncated(F.lit("abcdef"), 3).alias("short"),
    ).first()
    assert row["html"] == "a é😀 & &#99999999999; b"
    assert (row["lang"], row["trust"], row["url"], row["short"]) == ("ja", 0.72, "http://x?q=a+b%26c&l=en", "abc")


def test_filters_refuse_bad_dates(spark):
    rows = spark.createDataFrame([("2020-01-01", 50.0, 2), ("2020-02-01", None, 3), ("2020-03-01", 70.0, None)], "d string, score double, stage int").withColumn("d", F.col("d").cast("date"))
    assert [str(r["d"]) for r in filters.history(rows, score=(40.0, None)).collect()] == ["2020-03-01", "2020-01-01"]
    assert [str(r["d"]) for r in filters.history(rows, stage=(1, None), newest_first=False).collect()] == ["2020-01-01", "2020-02-01"]
    with pytest.raises(ValueError):
        filters.history(rows, start="yesterday")


def test_accepted_candidate_and_changes(spark):
    judged = spark.createDataFrame([("a", 0.5, True), ("b", 0.7, True), ("c", 0.9, False)], "candidate string, objective double, passes boolean")
    first = scoring.accepted(judged)
    assert [r["candidate"] for r in first.collect()] == ["b"]
    weights = spark.createDataFrame([("x", 5.0), ("y", 6.0)], "key string, weight double")
    moved = spark.createDataFrame([("b", "x", 4.0), ("b", "y", 6.0), ("a", "x", 9.0)], "candidate string, key string, weight double")
    assert [tuple(r) for r in scoring.config_changes(weights, moved, first).collect()] == [("x", 5.0, 4.0)]


def test_neighbourhood_resolves_names(spark):
    nodes = spark.createDataFrame([("event:1", "event", "1"), ("topic:a", "topic", "a"), ("day:z", "day", "z")], "id string, kind string, label string")
    edges = spark.createDataFrame([("event:1", "topic:a", "ABOUT", 1.0), ("day:z", "event:9", "ON", 1.0)], "src string, dst string, rel string, weight double")
    seen, among = graph.neighbourhood(nodes, edges, spark.createDataFrame([("1",)], "name string"), ["event", "topic"])
    assert sorted(r["id"] for r in seen.collect()) == ["event:1", "topic:a"] and among.count() == 1


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\nnot json\n{"k": 2}\n')
    assert sorted(r["k"] for r in io.read_jsonl(spark, f"file://{tmp_path}/a.jsonl", "k int").collect()) == [1, 2]
    assert io.read_json(spark, f"file://{tmp_path}/absent.json", "k int").count() == 0
    (tmp_path / "b.json").write_text(json.dumps({"k": 3}))
    assert io.read_json(spark, f"file://{tmp_path}/b.json", "k int").first()["k"] == 3
    (tmp_path / "c.js").write_text('window.STATE = {"k": 4,\n "z": {"a": 1}};\n')
    assert io.read_wrapped_json(spark, f"file://{tmp_path}/c.js", "STATE", "k int, z struct<a:int>").first()["z"]["a"] == 1
    (tmp_path / "d.csv").write_text("date,value\n2020-01-01,1.5\n2020-01-02,.\n2020-01-03,\n")
    assert [(str(r["d"]), r["v"]) for r in io.read_series_csv(spark, f"file://{tmp_path}/d.csv", "x").collect()] == [("2020-01-01", 1.5)]
    (tmp_path / "e.xml").write_text("<rss><channel><item><title>T</title><link>L</link></item></channel></rss>")
    (tmp_path / "f.xml").write_text('<feed><entry><title>A</title><link href="http://a"/><summary>S</summary><updated>2020-01-01T00:00:00Z</updated></entry></feed>')
    assert io.read_feed(spark, f"file://{tmp_path}/e.xml").first()["title"] == "T"
    atom = io.read_atom(spark, f"file://{tmp_path}/f.xml").first()
    assert (atom["title"], atom["link"], atom["description"]) == ("A", "http://a", "S")
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "t int, v string")
    io.write_snapshot(rows, f"file://{tmp_path}/out")
    assert sorted(tuple(r) for r in spark.read.schema("t int, v string").json(f"file://{tmp_path}/out").collect()) == [(1, "x"), (2, "y")]
    assert [r["t"] for r in io.append_log(spark, rows, spark.createDataFrame([(3, "z")], "t int, v string"), "t", 2).collect()] == [3, 2]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(k % 7, f"2024-01-0{1 + k % 3} 10:00:00", "a" if k % 2 else "b") for k in range(40)], "id int, at string, kind string").withColumn("ts", F.to_timestamp("at")).drop("at")
    rows = rows.dropDuplicates(["id", "ts", "kind"])
    rows.unionByName(rows).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    ingest.run_to_table(ingest.dedup_stream(stream, "ts", ["id", "ts", "kind"], "10 days"), f"{tmp_path}/out", f"{tmp_path}/check")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select(*rows.columns).collect())
    assert got == sorted(tuple(r) for r in rows.collect())


def test_typed_graph_reads_texts_once(spark):
    from stresslens.plans import catalog

    for name in ("q_typed_edges", "q_typed_nodes"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "documents.parquet" not in plan, name  # what was enriched is kept without its texts


def test_article_graph_against_naive(spark):
    kinds = "id long, source string, event string, day string, title string, topics array<string>, indicators array<string>, entities array<string>, actors array<string>, targets array<string>, modalities array<string>, responses array<string>, channels array<string>"
    said = "attributions array<struct<actor:string,status:string>>"
    articles = spark.createDataFrame([(1, "s", "e", "d", "a", ["t"], ["i"], ["x", "y"], ["p"], ["u"], [], None, ["i"]), (2, None, "e", None, "b", ["t"], None, [], ["p"], [], [], [], [])], kinds)
    events = spark.createDataFrame([("e", "event e", ["u"], ["m"], [], ["i"], [("p", "suspected"), ("q", "suspected")])], f"event_id string, label string, targets array<string>, modalities array<string>, responses array<string>, channels array<string>, {said}")
    nodes, edges = graph.article_graph(articles, events)
    assert sorted(map(tuple, nodes.collect())) == sorted([
        ("article:1", "article", "a"), ("article:2", "article", "b"), ("source:s", "source", "s"), ("day:d", "day", "d"), ("event:e", "event", "event e"), ("topic:t", "topic", "t"),
        ("indicator:i", "indicator", "i"), ("entity:x", "entity", "x"), ("entity:y", "entity", "y"), ("actor:p", "actor", "p"), ("target:u", "target", "u"),
    ])
    assert sorted((r["src"], r["dst"], r["rel"], r["weight"]) for r in edges.collect()) == sorted([
        ("article:1", "source:s", "PUBLISHED_BY", 1.0), ("article:1", "event:e", "EVIDENCE_FOR", 1.0), ("article:2", "event:e", "EVIDENCE_FOR", 1.0), ("event:e", "day:d", "OBSERVED_ON", 1.0),
        ("event:e", "topic:t", "ABOUT", 2.0), ("event:e", "indicator:i", "IMPACTS", 1.0), ("article:1", "entity:x", "MENTIONS", 1.0), ("article:1", "entity:y", "MENTIONS", 1.0),
        ("article:1", "actor:p", "MENTIONS_ACTOR", 1.0), ("article:2", "actor:p", "MENTIONS_ACTOR", 1.0), ("event:e", "target:u", "TARGETS", 1.0), ("event:e", "modality:m", "USES_MODALITY", 1.0),
        ("event:e", "indicator:i", "POTENTIAL_MARKET_CHANNEL", 1.0), ("event:e", "actor:p", "REPORTED_ATTRIBUTION", 1.0), ("event:e", "actor:q", "REPORTED_ATTRIBUTION", 1.0),
    ])
