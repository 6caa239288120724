"""The graph of a news corpus: nodes and edges with weights and metadata, of which the last write of each key stays.

Every row of the corpus writes nodes and edges; where rows write the same
node, or the same relation between two nodes, the row that comes last in the
corpus's order decides label, weight and metadata.  All writes of a row are
made in one projection and the last ones found by one aggregation with
partial results, so hot nodes (a source, a day, a topic) are combined before
they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stresslens.operators.enrich import REPORTED
from stresslens.operators.ordered import next_rows
from stresslens.sources.shared import kept

_META = "map<string,string>"
#: What a row without trust, an event without topic and an episode without a known group get.
DEFAULT_TRUST, NO_TOPIC, NO_GROUP = 0.5, "unclassified", "systemic_crisis"


def _meta(**values: Column | str) -> Column:
    """Metadata of those values that aren't null."""
    if not values:
        return F.create_map().cast(_META)
    pairs = [x for k, v in values.items() for x in (F.lit(k), (F.lit(v) if isinstance(v, str) else v).cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def _node(kind: str, prefix: str, key: Column, label: Column | None = None, **meta) -> Column:
    text = key.cast("string")
    return F.struct(F.concat(F.lit(f"{prefix}:"), text).alias("id"), F.lit(kind).alias("kind"), (text if label is None else label).alias("label"), _meta(**meta).alias("meta"))


def _edge(src: Column, dst: Column, rel: str, weight: Column | float = 1.0, **meta) -> Column:
    w = F.lit(weight) if isinstance(weight, float) else weight
    return F.struct(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"), F.round(w.cast("double"), 4).alias("weight"), _meta(**meta).alias("meta"))


def _at(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), key.cast("string"))


def _if(known: Column, *parts: Column) -> Column:
    """An array of the parts where ``known`` holds, else an empty one."""
    return F.filter(F.array(*parts), lambda _: F.coalesce(known, F.lit(False)))


def _each(column: Column, make) -> Column:
    return F.coalesce(F.transform(F.filter(column, lambda x: x.isNotNull()), make), F.array())


def _nodes(column: Column, kind: str, prefix: str) -> Column:
    return _each(column, lambda x: _node(kind, prefix, x))


def _edges(column: Column, src: Column, prefix: str, rel: str, weight: Column | float, **meta) -> Column:
    return _each(column, lambda x: _edge(src, _at(prefix, x), rel, weight, **meta))


#: (array column, kind, prefix, relation, whether the article or the event has the relation).
_PLAIN = (("topics", "Topic", "topic", "ABOUT", "event"), ("indicators", "Indicator", "indicator", "IMPACTS", "event"), ("entities", "Entity", "entity", "MENTIONS", "article"))
_FLAGGED = (
    ("actors", "Actor", "actor", "MENTIONS_ACTOR", "article"), ("targets", "Target", "target", "TARGETS", "event"), ("modalities", "Modality", "modality", "USES_MODALITY", "event"),
    ("responses", "Response", "response", "ASSOCIATED_RESPONSE", "event"), ("channels", "Indicator", "indicator", "POTENTIAL_MARKET_CHANNEL", "event"),
)


def _writes(rows: DataFrame) -> DataFrame:
    """(seq, nodes, edges): what each row of the corpus writes, in the order in which it writes."""
    c = F.col
    source, day = F.coalesce("publisher", "source_name", F.lit("unknown")), F.nullif(F.substring(F.coalesce(c("published_at").cast("string"), F.lit("")), 1, 10), F.lit(""))
    event = F.coalesce(c("event_id").cast("string"), F.lit("unclustered"))
    ends = {"article": _at("article", c("doc_id")), "event": _at("event", event)}
    relevance, trust = F.coalesce("relevance", F.lit(0.0)), F.when(F.coalesce("trust", F.lit(0.0)) == 0, DEFAULT_TRUST).otherwise(c("trust"))
    flagged = F.coalesce("geopolitical", F.lit(False))
    nodes = [
        F.array(
            _node("Article", "article", c("doc_id"), c("title"), published_at=c("published_at"), url=c("url")), _node("Source", "source", source),
            _node("Event", "event", event, F.coalesce("event_label", "title"), geopolitical=flagged, geopolitical_event_score=c("score")),
        ),
        _if(day.isNotNull(), _node("Day", "day", day)),
    ]
    edges = [
        F.array(_edge(ends["article"], _at("source", source), "PUBLISHED_BY", trust), _edge(ends["article"], ends["event"], "EVIDENCE_FOR", relevance, published_at=c("published_at"))),
        _if(day.isNotNull(), _edge(ends["event"], _at("day", day), "OBSERVED_ON")),
    ]
    for column, kind, prefix, rel, end in _PLAIN:
        weight = relevance if end == "event" else 1.0
        nodes.append(_nodes(c(column), kind, prefix))
        edges.append(_edges(c(column), ends[end], prefix, rel, weight))
    only = lambda column: F.when(flagged, c(column))
    for column, kind, prefix, rel, end in _FLAGGED:
        meta = {"hypothetical": "true"} if rel == "POTENTIAL_MARKET_CHANNEL" else {}
        nodes.append(_nodes(only(column), kind, prefix))
        edges.append(_edges(only(column), ends[end], prefix, rel, 1.0, **meta))
    said = F.filter(only("attributions"), lambda a: a["actor"].isNotNull())
    nodes.append(_each(said, lambda a: _node("Actor", "actor", a["actor"])))
    edges.append(_each(said, lambda a: _edge(ends["event"], _at("actor", a["actor"]), "REPORTED_ATTRIBUTION", attribution_status=a["status"])))
    return rows.select("seq", F.concat(*nodes).alias("nodes"), F.concat(*edges).alias("edges"))


def last_nodes(written: DataFrame) -> DataFrame:
    """(id, kind, label, meta) of writes ``(seq, place, id, kind, label, meta)``: the last one of each id."""
    last = F.max_by(F.struct("kind", "label", "meta"), F.struct("seq", "place"))
    return written.groupBy("id").agg(last.alias("n")).select("id", "n.*")


def last_edges(written: DataFrame) -> DataFrame:
    """(src, dst, rel, weight, meta) of writes ``(seq, place, src, dst, rel, weight, meta)``: the last one of each relation of two nodes."""
    last = F.max_by(F.struct("weight", "meta"), F.struct("seq", "place"))
    return written.groupBy("src", "dst", "rel").agg(last.alias("e")).select("src", "dst", "rel", "e.*")


def article_writes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Writes of nodes and edges by the rows of a corpus; see :func:`news_graph` for their columns."""
    written = _writes(rows)
    spread = lambda c: written.select("seq", F.posexplode(c).alias("place", "w")).select("seq", "place", "w.*")
    return spread("nodes"), spread("edges")


def chains(rows: DataFrame) -> DataFrame:
    """PRECEDES edges from each event to the next one whose first topic is the same, by their first day; in one order of ranges, so a hot topic spreads."""
    event = F.coalesce(F.col("event_id").cast("string"), F.lit("unclustered"))
    first = rows.groupBy(event.alias("event")).agg(
        F.min(F.to_timestamp("published_at")).alias("at"), F.min_by(F.coalesce(F.get("topics", F.lit(0)), F.lit(NO_TOPIC)), "seq").alias("topic")
    )
    pairs = next_rows(first.where("at is not null"), ["topic"], ["at", "event"], {"at": "next_at", "event": "next"})
    gap = F.round((F.unix_timestamp("next_at") - F.unix_timestamp("at")) / 86400.0, 2)
    return pairs.where("next is not null").select(_edge(_at("event", F.col("event")), _at("event", F.col("next")), "PRECEDES", gap_days=gap, topic=F.col("topic")).alias("w")).select("w.*")


def campaign_writes(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of campaigns: threads of events (event_id, first_seen, attributions) in which an actor is reported as responsible.

    Edges run from the campaign to the actor and its events, and from event to
    next event; if several actors have the same two events one after the
    other, the greatest name is in the metadata.
    """
    said = events.select("event_id", "first_seen", F.explode("attributions").alias("a")).where(F.col("a.status").isin(*REPORTED[1:]) & F.col("a.actor").isNotNull())
    said = said.select(F.col("a.actor").alias("actor"), F.col("event_id").cast("string").alias("event"), "first_seen").distinct()
    actors = said.select("actor").distinct()
    label = F.concat("actor", F.lit(" reported-attribution thread"))
    nodes = actors.select(F.explode(F.array(_node("Campaign", "campaign", F.col("actor"), label), _node("Actor", "actor", F.col("actor")))).alias("w")).select("w.*")
    campaign = _at("campaign", F.col("actor"))
    threads = actors.select(_edge(campaign, _at("actor", F.col("actor")), "REPORTED_ACTOR_THREAD").alias("w"))
    has = said.select(_edge(campaign, _at("event", F.col("event")), "HAS_EVENT").alias("w"))
    pairs = next_rows(said, ["actor"], ["first_seen", "event"], {"event": "next"}).where("next is not null").groupBy("event", "next").agg(F.max("actor").alias("actor"))
    follow = pairs.select(_edge(_at("event", F.col("event")), _at("event", F.col("next")), "CAMPAIGN_PRECEDES", actor=F.col("actor")).alias("w"))
    return nodes, threads.unionByName(has).unionByName(follow).select("w.*")


def episode_writes(windows: DataFrame, known: dict[str, tuple[str, list[str]]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of historical episodes ``windows(id, name, start)``: to the topic and the indicators that ``known`` has for an id, and in time.

    An id that isn't known is about ``NO_GROUP`` and impacts nothing.
    """
    table = F.create_map(*[x for k, (topic, of) in known.items() for x in (F.lit(k), F.struct(F.lit(topic).alias("topic"), F.array(*map(F.lit, of)).cast("array<string>").alias("indicators")))])
    found = F.try_element_at(table, F.col("id").cast("string"))
    rows = windows.select("id", "name", "start", F.coalesce(found["topic"], F.lit(NO_GROUP)).alias("topic"), F.coalesce(found["indicators"], F.array().cast("array<string>")).alias("indicators"))
    episode = _at("historical", F.col("id"))
    name = F.coalesce("name", F.col("id").cast("string"))
    nodes = F.concat(F.array(_node("HistoricalEpisode", "historical", F.col("id"), name, start=F.col("start")), _node("Topic", "topic", F.col("topic"))), _nodes(F.col("indicators"), "Indicator", "indicator"))
    edges = F.concat(F.array(_edge(episode, _at("topic", F.col("topic")), "ABOUT")), _edges(F.col("indicators"), episode, "indicator", "IMPACTS", 1.0))
    after = next_rows(rows.select("id", "start", F.lit(0).alias("all")), ["all"], ["start", "id"], {"id": "next"}).where("next is not null")
    chain = after.select(_edge(episode, _at("historical", F.col("next")), "PRECEDES").alias("w"))
    return rows.select(F.explode(nodes).alias("w")).select("w.*"), rows.select(F.explode(edges).alias("w")).unionByName(chain).select("w.*")


def news_graph(rows: DataFrame, events: DataFrame, windows: DataFrame, known: dict[str, tuple[str, list[str]]]) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, label, meta) and edges (src, dst, rel, weight, meta) of a corpus, its campaigns and the historical episodes.

    ``rows``: seq (unique, the corpus's order), doc_id, title, url,
    published_at (ISO text), publisher, source_name, trust, relevance,
    event_id, event_label, score, geopolitical, and the arrays topics,
    indicators, entities, actors, targets, modalities, responses, channels
    and attributions (actor, status); any but seq and doc_id may be null.
    ``events`` and ``windows`` are those of :func:`campaign_writes` and
    :func:`episode_writes`.  What campaigns and episodes write comes after the rows.
    """
    rows, events = kept(rows), kept(events)  # each is read several times
    node_writes, edge_writes = article_writes(rows)
    last = F.lit(2**62).alias("seq")
    for turn, (nodes, edges) in enumerate((campaign_writes(events), (None, chains(rows)), episode_writes(windows, known))):
        later = [last, F.lit(turn).alias("place")]
        if nodes is not None:
            node_writes = node_writes.unionByName(nodes.select(*later, "*"))
        edge_writes = edge_writes.unionByName(edges.select(*later, "*"))
    return last_nodes(node_writes), last_edges(edge_writes)
