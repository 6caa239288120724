"""Property graphs as two tables: nodes (id, kind, label) and edges (src, dst, rel, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stresslens.operators.ordered import next_rows


def nodes_of(rows: DataFrame, kind: str, key: Column | str, label: Column | str) -> DataFrame:
    """Nodes of one kind, one for each key; the greatest label wins."""
    k = F.col(key) if isinstance(key, str) else key
    name = F.col(label) if isinstance(label, str) else label
    return rows.select(F.concat_ws(":", F.lit(kind), k.cast("string")).alias("id"), F.lit(kind).alias("kind"), name.cast("string").alias("label")).groupBy("id", "kind").agg(F.max("label").alias("label"))


def edges_of(rows: DataFrame, rel: str, src: tuple[str, Column | str], dst: tuple[str, Column | str], weight: Column | None = None) -> DataFrame:
    """Edges of one relation between (kind, key) pairs; repeats add up their weights."""
    end = lambda e: F.concat_ws(":", F.lit(e[0]), (F.col(e[1]) if isinstance(e[1], str) else e[1]).cast("string"))
    w = F.lit(1.0) if weight is None else weight
    return rows.select(end(src).alias("src"), end(dst).alias("dst"), F.lit(rel).alias("rel"), w.cast("double").alias("w")).groupBy("src", "dst", "rel").agg(F.sum("w").alias("weight"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by node kind and by relation."""
    n = nodes.groupBy(F.lit("node").alias("part"), F.col("kind").alias("name")).agg(F.count("*").alias("n"))
    return n.unionByName(edges.groupBy(F.lit("edge").alias("part"), F.col("rel").alias("name")).agg(F.count("*").alias("n")))


def precedes(rows: DataFrame, group: str, ts: str, key: str) -> DataFrame:
    """Chain of consecutive rows of each group: (group, src, dst, gap_days)."""
    chain = rows.select(group, F.col(key).alias("src"), F.col(ts).alias("a"))
    nxt = next_rows(chain, [group], ["a", "src"], {"src": "dst", "a": "b"})  # in ranges, so that a hot group spreads
    gap = (F.unix_timestamp(F.col("b").cast("timestamp")) - F.unix_timestamp(F.col("a").cast("timestamp"))) / 86400.0
    return nxt.where("dst is not null").select(group, "src", "dst", F.round(gap, 2).alias("gap_days"))


def k_hop(edges: DataFrame, roots: DataFrame, hops: int = 2, most: int = 500) -> DataFrame:
    """(id, hop): nodes within ``hops`` (1 to 3) undirected steps of ``roots(id)``, each at its least distance.

    One join for each hop; a hop's frontier leaves out what was seen before.
    The first ``most`` by (hop, id) stay (a limit of the answer), roots first.
    """
    hops = min(3, max(1, hops))
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = roots.select("id", F.lit(0).alias("hop")).distinct()
    frontier = seen
    for hop in range(1, hops + 1):
        step = frontier.join(both, frontier.id == both.src).select(F.col("dst").alias("id")).distinct()
        frontier = step.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen.orderBy("hop", "id").limit(most)


def induced(edges: DataFrame, visited: DataFrame) -> DataFrame:
    """The edges with both ends among ``visited(id)``."""
    ids = visited.select("id")
    return edges.join(ids, edges.src == ids.id, "left_semi").join(ids, F.col("dst") == ids.id, "left_semi")


def from_arrays(rows: DataFrame, rel: str, src: tuple[str, Column | str], kind: str, values: str, weight: Column | None = None) -> DataFrame:
    """Edges from each row to every element of one of its array columns, as nodes of a kind."""
    w = F.lit(1.0) if weight is None else weight
    own = F.col(src[1]) if isinstance(src[1], str) else src[1]
    return edges_of(rows.select(own.alias("_s"), F.explode(values).alias("_v"), w.alias("_w")), rel, (src[0], "_s"), (kind, "_v"), F.col("_w"))


def article_graph(articles: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of enriched articles and their events.

    ``articles`` (id, source, event, day, title, topics, indicators, entities,
    actors, targets, modalities, responses, attributions, channels) and
    ``events`` (event_id, label, actors, ..., attributions).  Sources,
    evidence, entities and actors hang on articles; days, topics, indicators
    and all else on events.  Where both name a node the label of the greatest
    text wins; ``newsgraph`` has weights, metadata and the last write.
    """
    end = lambda kind, key: F.concat_ws(":", F.lit(kind), key.cast("string"))
    node = lambda kind, key, label: F.struct(end(kind, key).alias("id"), F.lit(kind).alias("kind"), label.cast("string").alias("label"))
    edge = lambda src, dst, rel: F.struct(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"))
    each = lambda column, make: F.coalesce(F.transform(column, make), F.array())
    known = lambda column, part: F.filter(F.array(part), lambda _: F.col(column).isNotNull())
    nodes_in = lambda kind, column: each(column, lambda k: node(kind, k, k))
    edges_in = lambda src, rel, kind, column: each(column, lambda k: edge(src, end(kind, k), rel))
    # all that a row writes in one projection, so that it is read once and combined before it is shuffled
    spread = lambda rows, parts: rows.select(F.explode(F.concat(*parts)).alias("w")).select("w.*")

    kinds = (("topic", "topics"), ("indicator", "indicators"), ("entity", "entities"), ("actor", "actors"), ("target", "targets"), ("modality", "modalities"), ("response", "responses"), ("indicator", "channels"))
    parts = [F.array(node("article", F.col("id"), F.col("title"))), *[known(c, node(c, F.col(c), F.col(c))) for c in ("source", "day")]]
    parts += [nodes_in(kind, column) for kind, column in kinds]
    nodes = spread(articles, parts).unionByName(events.select(node("event", F.col("event_id"), F.col("label")).alias("w")).select("w.*"))

    article, event = end("article", F.col("id")), end("event", F.col("event"))
    parts = [known("source", edge(article, end("source", F.col("source")), "PUBLISHED_BY")), F.array(edge(article, event, "EVIDENCE_FOR")), known("day", edge(event, end("day", F.col("day")), "OBSERVED_ON"))]
    parts += [edges_in(src, rel, kind, column) for rel, kind, column, src in (
        ("ABOUT", "topic", "topics", event), ("IMPACTS", "indicator", "indicators", event), ("MENTIONS", "entity", "entities", article), ("MENTIONS_ACTOR", "actor", "actors", article))]
    of = end("event", F.col("event_id"))
    more = [edges_in(of, rel, kind, column) for rel, kind, column in (
        ("TARGETS", "target", "targets"), ("USES_MODALITY", "modality", "modalities"), ("ASSOCIATED_RESPONSE", "response", "responses"), ("POTENTIAL_MARKET_CHANNEL", "indicator", "channels"))]
    more.append(each("attributions", lambda a: edge(of, end("actor", a["actor"]), "REPORTED_ATTRIBUTION")))
    edges = spread(articles, parts).unionByName(spread(events, more))
    return nodes.groupBy("id", "kind").agg(F.max("label").alias("label")), edges.groupBy("src", "dst", "rel").agg(F.count("*").cast("double").alias("weight"))


def campaign_edges(events: DataFrame, ts: str = "first_seen") -> DataFrame:
    """Edges of campaigns: the thread to its actor and its events, and each event to the next of the same actor.

    Only attributed or disputed actors have a campaign.  ``events`` has
    event_id, ``ts`` and attributions (actor, status).
    """
    said = events.select("event_id", ts, F.explode("attributions").alias("a")).where(F.col("a.status") != "suspected").select("event_id", ts, F.col("a.actor").alias("actor"))
    thread = edges_of(said.select("actor").distinct(), "REPORTED_ACTOR_THREAD", ("campaign", "actor"), ("actor", "actor"))
    has = edges_of(said, "HAS_EVENT", ("campaign", "actor"), ("event", "event_id"))
    pairs = next_rows(said, ["actor"], [ts, "event_id"], {"event_id": "next"}).where("next is not null").select("event_id", "next").distinct()
    return thread.unionByName(has).unionByName(edges_of(pairs, "CAMPAIGN_PRECEDES", ("event", "event_id"), ("event", "next")))


def episodes(windows: DataFrame, topics: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """Nodes of historical episodes ``windows(id, name, start, end, group)`` and edges to the topics of their group, and in time."""
    found = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in topics.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))]), F.col("group")), F.array().cast("array<string>"))
    rows = windows.withColumn("_topics", found)
    about = from_arrays(rows, "ABOUT", ("episode", "id"), "topic", "_topics")
    after = F.lead("id").over(Window.orderBy("start", "id"))  # a dimension of some dozens of rows
    chain = rows.select("id", after.alias("next")).where("next is not null")
    nodes = nodes_of(rows, "episode", "id", "name").unionByName(nodes_of(rows.select(F.explode("_topics").alias("k")), "topic", "k", "k"))
    return nodes, about.unionByName(edges_of(chain, "PRECEDES", ("episode", "id"), ("episode", "next")))


def resolve(nodes: DataFrame, names: DataFrame, prefixes: list[str]) -> DataFrame:
    """(id): the nodes that ``names(name)`` mean: as they are, or with one of the prefixes, the first that exists."""
    tried = F.array(F.col("name"), *[F.concat(F.lit(f"{p}:"), F.col("name")) for p in prefixes])
    asked = names.select("name", F.posexplode(tried).alias("place", "id"))
    return asked.join(nodes.select("id"), "id", "left_semi").groupBy("name").agg(F.min_by("id", "place").alias("id")).select("id").distinct()


def neighbourhood(nodes: DataFrame, edges: DataFrame, names: DataFrame, prefixes: list[str], hops: int = 2, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """Nodes within some steps of the named ones, and the edges among them."""
    seen = k_hop(edges, resolve(nodes, names, prefixes), hops, most)
    return seen, induced(edges, seen)
