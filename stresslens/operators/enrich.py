"""Enrichment of news-like rows: topics, entities, actors, reported attributions, flags and severity.

Taxonomies are plain dicts that the caller passes (key to aliases, topic to
indicators, ...), some dozens of entries; they become literals of the plan,
so rows are enriched in one projection.  Only attributions, which need the
nearest of many positions, leave the row: positions are exploded and met in
one window for each row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stresslens.functions.scalars import cosine
from stresslens.functions.text import alias_pattern, lexicon_matches


def _texts(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _lookup(mapping: dict[str, list[str]]) -> Column:
    """A literal map of arrays."""
    parts = [x for key, values in mapping.items() for x in (F.lit(key), _texts(values))]
    return F.create_map(*parts).cast("map<string,array<string>>")


def expand(keys: Column, mapping: dict[str, list[str]]) -> Column:
    """Sorted distinct values of several keys of a mapping; unknown keys have none."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(keys, lambda k: F.coalesce(F.try_element_at(_lookup(mapping), k), none)))))


#: The similarity that an alias counts for, the least of a chosen topic, and how many are chosen.
ALIAS_SIMILARITY, LEAST_SIMILARITY, MOST_TOPICS = 0.58, 0.30, 3


def pack_descriptors(descriptors: DataFrame) -> DataFrame:
    """One row: ``descriptors(topic, vec)`` as an array of (topic, vecs), topics in order.  A taxonomy, some dozens of rows."""
    per = descriptors.groupBy("topic").agg(F.collect_list("vec").alias("vecs"))
    return per.agg(F.array_sort(F.collect_list(F.struct("topic", "vecs"))).alias("topics"))


def topic_scores(vec: Column, topics: Column, hits: Column, digits: int | None = None) -> Column:
    """(topic, sim) of each topic: its best descriptor, at least 0.58 where ``hits`` (matched topics) has it; rounded if asked."""

    def best(t: Column) -> Column:
        sim = F.array_max(F.transform(t["vecs"], lambda d: cosine(vec, d)))
        lifted = F.when(F.array_contains(hits, t["topic"]), F.greatest(sim, F.lit(ALIAS_SIMILARITY))).otherwise(sim)
        return F.struct(t["topic"].alias("topic"), (lifted if digits is None else F.round(lifted, digits)).alias("sim"))

    return F.transform(topics, best)


def chosen_topics(scores: Column, most: int = MOST_TOPICS, least: float = LEAST_SIMILARITY) -> Column:
    """The first ``most`` topics by similarity (ties by topic) that reach ``least``, or else the first alone."""
    ordered = F.array_sort(F.transform(scores, lambda s: F.struct((-s["sim"]).alias("down"), s["topic"].alias("topic"))))
    back = lambda rows: F.transform(rows, lambda s: F.struct(s["topic"].alias("topic"), (-s["down"]).alias("sim")))
    passing = lambda rows: F.filter(F.slice(rows, 1, most), lambda s: s["sim"] >= least)
    return _let(back(ordered), lambda rows: F.when(F.size(passing(rows)) > 0, passing(rows)).otherwise(F.slice(rows, 1, 1)))


def classify(rows: DataFrame, vec: str, hits: Column, descriptors: DataFrame, indicators: dict[str, list[str]]) -> DataFrame:
    """``rows`` with topics, relevance (the best chosen similarity, 4 places) and indicators (those of the topics).

    ``hits``: topics whose alias the text holds.  The descriptors are one
    array value of the plan: no row meets another.
    """
    packed = pack_descriptors(descriptors)
    scored = rows.withColumn("_topics", packed.scalar()).withColumn("_chosen", chosen_topics(topic_scores(F.col(vec), F.col("_topics"), hits)))
    names = F.transform("_chosen", lambda s: s["topic"])
    relevance = F.round(F.coalesce(F.array_max(F.transform("_chosen", lambda s: s["sim"])), F.lit(0.0)), 4)
    return scored.withColumns({"topics": names, "relevance": relevance, "indicators": expand(names, indicators)}).drop("_topics", "_chosen")


def entities(text: Column | str, lexicon: dict[str, list[str]], publisher: Column | str | None = None) -> Column:
    """Sorted entities of which an alias occurs anywhere in the text, and the publisher."""
    found = lexicon_matches(text, lexicon, bounded=False)
    if publisher is None:
        return found
    name = F.col(publisher) if isinstance(publisher, str) else publisher
    own = F.when(F.coalesce(name, F.lit("")) != "", F.array(name)).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_union(found, own))


def relevant(relevance: Column, trust: Column, geopolitical: Column) -> Column:
    """Whether a row is kept: flagged, or relevant enough; trusted sources need less."""
    return F.coalesce(geopolitical, F.lit(False)) | (relevance >= F.when(trust >= 0.95, 0.20).otherwise(0.25))


def positions(body: Column, alias: str, bounded: bool = True) -> Column:
    """Where an alias stands in a lower-case text (from 0, not overlapping), short aliases between word limits."""
    pattern = alias_pattern(alias) if bounded else re.escape(alias.lower())
    step = lambda acc, p: F.struct((acc["at"] + F.length(p) + len(alias)).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.length(p))).alias("out"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return _let(F.split(body, pattern, -1), lambda pieces: F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), zero, step, lambda acc: acc["out"]))


def mentions(rows: DataFrame, id: str, text: str, lexicon: dict[str, list[str]], bounded: bool = True) -> DataFrame:
    """(id, key, pos): every position of every alias, once."""
    body = F.lower(F.coalesce(F.col(text), F.lit("")))

    def keyed(key: str, alias: str) -> Column:
        return F.transform(positions(body, alias, bounded), lambda p: F.struct(F.lit(key).alias("key"), p.alias("pos")))

    found = [keyed(key, alias) for key, aliases in sorted(lexicon.items()) for alias in aliases]
    return rows.select(F.col(id).alias("id"), F.explode(F.concat(*found)).alias("m")).select("id", "m.key", "m.pos").distinct()


def nearest_mentions(actors: DataFrame, cues: DataFrame, reach: int = 100) -> DataFrame:
    """(id, cue, pos, actor): the nearest ``actors(id, key, pos)`` of each of ``cues(id, key, pos)`` within ``reach``; ties all.

    One order for each text: the nearest position on either side is the last
    one before and the first one after.
    """
    at = actors.repartition("id").groupBy("id", "pos").agg(F.sort_array(F.collect_set("key")).alias("actors"))
    both = at.select("id", "pos", F.struct(F.col("pos").alias("at"), "actors").alias("there"), F.lit(None).cast("string").alias("cue")).unionByName(
        cues.select("id", "pos", F.lit(None).cast("struct<at:int,actors:array<string>>").alias("there"), F.col("key").alias("cue"))
    )
    order = Window.partitionBy("id").orderBy("pos")
    before = F.last("there", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("there", ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing))
    met = both.select("id", "pos", "cue", before.alias("before"), after.alias("after")).where("cue is not null")
    back, ahead = F.col("pos") - F.col("before.at"), F.col("after.at") - F.col("pos")
    near = F.least(back, ahead)
    none = F.array().cast("array<string>")
    side = lambda distance, name: F.when(distance == near, F.col(f"{name}.actors")).otherwise(none)
    best = met.where(near <= reach).select("id", "cue", "pos", F.array_union(F.coalesce(side(back, "before"), none), F.coalesce(side(ahead, "after"), none)).alias("found"))
    return best.select("id", "cue", "pos", F.explode("found").alias("actor"))


#: Reported statuses from weak to strong.
REPORTED = ("suspected", "reported_attributed", "reported_attribution_disputed")


def attributions(rows: DataFrame, id: str, text: str, actors: dict[str, list[str]], cues: dict[str, list[str]]) -> DataFrame:
    """(id, actor, status): actors to whom a text attributes something.

    ``cues`` has the keys attributed, suspected and disputed.  An actor near a
    cue of the first kind is attributed (disputed if also near one of the
    third), else suspected; actors near disputing cues alone are left out.
    """
    near = nearest_mentions(mentions(rows, id, text, actors), mentions(rows, id, text, cues, bounded=False))
    has = lambda cue: F.bool_or(F.col("cue") == cue)
    per = near.groupBy("id", "actor").agg(has("attributed").alias("a"), has("suspected").alias("s"), has("disputed").alias("d"))
    status = F.when(F.col("a") & F.col("d"), REPORTED[2]).when(F.col("a"), REPORTED[1]).otherwise(REPORTED[0])
    return per.where("a or s").select("id", "actor", status.alias("status"))


#: Which keys count for which dimension, and border words.
PHYSICAL = ("sabotage", "explosive_drone", "drone_incursion", "airspace_violation", "missile_incursion", "arson", "infrastructure_interference", "assassination_plot")
CRITICAL = ("critical_infrastructure", "energy", "transport", "military_logistics", "military_facility", "civil_aviation", "undersea_infrastructure", "communications", "government")
MILITARY = ("air_intercept", "military_alert")
DIPLOMATIC = ("sanctions", "diplomatic_expulsion", "consulate_closure", "collective_statement")
EUROPEAN = ("Germany", "Poland", "Romania", "France", "United Kingdom", "EU", "NATO")
CORE = ("Russia", "NATO", "EU", "Ukraine")
BORDER_WORDS = ("cross-border", "across europe", "border", "国境", "欧州各国")
THEMES = ("geopolitics_", "nato_", "eu_")
OFFICIAL = ("NATO", "Council of the EU", "European Council", "European Commission", "Bundesregierung", "Federal Government", "Ministry", "Government")
#: Points of each dimension and of some modalities.
DIMENSION_POINTS = {
    "physical_attack": 18.0, "critical_infrastructure": 16.0, "alliance_proximity": 12.0, "cross_border": 10.0,
    "reported_attribution": 12.0, "military_response": 10.0, "diplomatic_response": 8.0, "explicit_threat": 14.0,
}
MODALITY_POINTS = {"cyber_attack": 8.0, "information_operation": 4.0, "economic_coercion": 6.0}


def source_class(publisher: Column, theme: Column) -> Column:
    """official_primary, official_discovery_query or news_report, from markers in the publisher and the theme's beginning."""
    name = F.lower(F.coalesce(publisher, F.lit("")))
    official = F.exists(_texts([m.lower() for m in OFFICIAL]), lambda m: F.contains(name, m))
    return F.when(official, "official_primary").when(F.coalesce(theme, F.lit("")).rlike("^(nato_|eu_)"), "official_discovery_query").otherwise("news_report")


def geopolitical(modalities: Column, attributed: Column, theme: Column, targets: Column, responses: Column, actors: Column) -> Column:
    """Whether a row is about conflict between states; ``attributed`` is the number of attributions."""
    aimed = (F.size(targets) > 0) & ((F.size(responses) > 0) | F.arrays_overlap(actors, _texts(CORE)))
    themed = F.coalesce(theme, F.lit("")).rlike("^(" + "|".join(THEMES) + ")")
    return (F.size(modalities) > 0) | (F.coalesce(attributed, F.lit(0)) > 0) | themed | aimed


def crosses_borders(body: Column) -> Column:
    """Whether a lower-case text has a word of borders."""
    return F.exists(_texts(BORDER_WORDS), lambda w: F.contains(body, w))


def dimensions(body: Column, actors: Column, modalities: Column, targets: Column, responses: Column, reported: Column, borders: Column | None = None) -> dict[str, Column]:
    """The eight dimensions as booleans; ``body`` is the lower-case text, ``reported`` whether anything is attributed, ``borders`` whether :func:`crosses_borders` holds, if it is known."""
    any_of = lambda keys, values: F.arrays_overlap(keys, _texts(values))
    borders = crosses_borders(body) if borders is None else borders
    return {
        "physical_attack": any_of(modalities, PHYSICAL), "critical_infrastructure": any_of(targets, CRITICAL),
        "alliance_proximity": any_of(actors, EUROPEAN) | any_of(targets, ("military_logistics", "military_facility")),
        "cross_border": (F.size(F.array_intersect(actors, _texts(EUROPEAN))) >= 2) | borders, "reported_attribution": F.coalesce(reported, F.lit(False)),
        "military_response": any_of(responses, MILITARY), "diplomatic_response": any_of(responses, DIPLOMATIC),
        "explicit_threat": F.array_contains(modalities, "military_threat"),
    }


def severity(dims: dict[str, Column], modalities: Column) -> Column:
    """Points of the dimensions and modalities that hold, 100 at most."""
    points = [F.when(dims[n], p).otherwise(0.0) for n, p in DIMENSION_POINTS.items()]
    points += [F.when(F.array_contains(modalities, n), p).otherwise(0.0) for n, p in MODALITY_POINTS.items()]
    return F.round(F.least(F.lit(100.0), sum(points[1:], points[0])), 1)


def enrich(rows: DataFrame, id: str, text: str, taxonomy: dict[str, dict[str, list[str]]], publisher: Column, theme: Column) -> DataFrame:
    """``rows`` with actors, modalities, targets, responses, attributions, dimensions, flag, channels, source_class and score.

    ``taxonomy`` has the lexicons actors, modalities, targets, responses and
    cues, and the mapping transmission (modality or target to channels).
    """
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    said = attributions(rows, id, text, taxonomy["actors"], taxonomy["cues"])
    said = said.groupBy(F.col("id").alias("_said_by")).agg(F.array_sort(F.collect_list(F.struct("actor", "status"))).alias("attributions"))
    found = rows.withColumns({kind: lexicon_matches(F.col(text), taxonomy[kind]) for kind in ("actors", "modalities", "targets", "responses")})
    # what needs the text is known before the join: it is shuffled only where the caller asks for it
    found = found.withColumn("_borders", crosses_borders(body)).join(said, F.col(id) == F.col("_said_by"), "left").drop("_said_by")
    keys = {kind: F.col(kind) for kind in ("actors", "modalities", "targets", "responses")}
    reported = F.exists("attributions", lambda a: a["status"].isin(*REPORTED[1:]))
    dims = dimensions(body, **keys, reported=reported, borders=F.col("_borders"))
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in sorted(dims.items())]), lambda n: n.isNotNull())
    flag = geopolitical(keys["modalities"], F.size(F.coalesce("attributions", F.array().cast("array<struct<actor:string,status:string>>"))), theme, keys["targets"], keys["responses"], keys["actors"])
    return found.withColumns({
        "geopolitical": flag, "dimensions": names, "channels": expand(F.array_union(F.col("modalities"), F.col("targets")), taxonomy["transmission"]),
        "source_class": source_class(publisher, theme), "score": severity(dims, keys["modalities"]),
    }).drop("_borders")


def _union(column: str) -> Column:
    """Aggregate: sorted distinct elements of an array column."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(column))))


def event_rollup(rows: DataFrame, event: str, ts: str, doc: str, label: str, publisher: str) -> DataFrame:
    """Events of enriched, flagged rows: counts, times, first label, unions of sets, strongest status by actor, score.

    Sets are united from distinct arrays, which are few; the strongest status
    is found by actor before it is gathered.
    """
    flagged = rows.where("geopolitical").withColumn("_event", F.coalesce(F.col(event).cast("string"), F.col(doc).cast("string"))).where("_event is not null")
    base = flagged.groupBy("_event").agg(
        F.min_by(label, F.struct(ts, doc)).alias("label"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("article_count"),
        F.countDistinct(publisher).alias("publisher_count"), *[_union(c).alias(c) for c in ("actors", "modalities", "targets", "responses", "channels", "dimensions")], F.max("score").alias("event_score"),
    )
    rank = F.array_position(_texts(REPORTED), F.col("a.status"))
    per = flagged.select("_event", F.explode("attributions").alias("a")).groupBy("_event", F.col("a.actor").alias("actor")).agg(F.max_by(F.col("a.status"), rank).alias("status"))
    said = per.groupBy("_event").agg(F.array_sort(F.collect_list(F.struct("actor", "status"))).alias("attributions"))
    return base.join(said, "_event", "left").withColumnRenamed("_event", "event_id")


def channel_union(events: DataFrame, column: str = "channels") -> DataFrame:
    """One row: all values of an array column over all rows, sorted."""
    return events.select(F.explode(column).alias("c")).distinct().agg(F.array_sort(F.collect_list("c")).alias(column))


def campaign_threads(events: DataFrame, limit: int = 10) -> DataFrame:
    """Per actor with a reported attribution: events, times, greatest score, unions of sets, strongest status; the first ``limit`` (a top list)."""
    threads = events.select("*", F.explode("attributions").alias("a")).where(F.col("a.status").isin(*REPORTED[1:]))
    rank = F.array_position(_texts(REPORTED), F.col("a.status"))
    per = threads.groupBy(F.col("a.actor").alias("actor")).agg(
        F.countDistinct("event_id").alias("events"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("event_score").alias("max_score"),
        _union("modalities").alias("modalities"), _union("targets").alias("targets"), _union("responses").alias("responses"), F.max_by(F.col("a.status"), rank).alias("status"),
    )
    return per.orderBy(F.desc("events"), F.desc("max_score"), "actor").limit(limit)
