"""Queries over enrichment operators, and the same in DuckDB SQL.

The documents stand for articles; aliases are syllables of their invented
prose, so every lexicon finds something.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stresslens.functions import text
from stresslens.operators import aliases, enrich
from stresslens.plans.registry import register, table

TAXONOMY = {
    "actors": {"Germany": ["tion"], "Poland": ["heit", "keit"], "NATO": ["eaux"], "Russia": ["ando"], "Norway": ["thou"]},
    "modalities": {"sabotage": ["ungsch"], "cyber_attack": ["ererth"], "military_threat": ["iblean"], "economic_coercion": ["entenu"]},
    "targets": {"energy": ["menten"], "transport": ["lichver"], "military_facility": ["ciónes"]},
    "responses": {"sanctions": ["nesser"], "air_intercept": ["ichein"], "consulate_closure": ["ouelle"]},
    "cues": {"attributed": ["erst", "ouai"], "suspected": ["hest"], "disputed": ["ndre"]},
    "transmission": {"sabotage": ["energy_prices", "shipping"], "cyber_attack": ["payments"], "energy": ["energy_prices"], "transport": ["shipping"]},
}
TOPICS = {"t0": ["rates", "credit"], "t1": ["credit"], "t2": [], "t3": ["energy", "rates"], "t4": ["fx"], "t5": ["fx", "banks"], "t6": ["banks"], "t7": ["credit", "energy"]}


def _values(name: str, columns: str, rows: list) -> str:
    quoted = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)
    return f"{name} AS (SELECT * FROM (VALUES {quoted}) x({columns}))"


_IND = _values("ind", "topic, indicator", [(t, i) for t, found in TOPICS.items() for i in found])


@register(f"""WITH {_IND}, de AS (SELECT 't' || (vec_id % 8) AS topic, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 16),
s AS (SELECT v.vec_id, v.label, topic, CASE WHEN v.vec_id % 5 = 0 AND topic = 't' || (label % 8) THEN greatest(max(list_inner_product(v.embedding::DOUBLE[], e)), 0.58::DOUBLE) ELSE max(list_inner_product(v.embedding::DOUBLE[], e)) END AS sim FROM embeddings v, de GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, topic) AS rn, max(sim) OVER (PARTITION BY vec_id) AS best FROM s), c AS (SELECT * FROM r WHERE (rn <= 3 AND sim >= 0.3) OR (rn = 1 AND best < 0.3))
SELECT vec_id, string_agg(topic, ',' ORDER BY rn) AS topics, round(max(sim), 4) AS relevance,
  coalesce((SELECT string_agg(i, ',' ORDER BY i) FROM (SELECT DISTINCT indicator AS i FROM ind JOIN c d USING (topic) WHERE d.vec_id = c.vec_id)), '') AS indicators FROM c GROUP BY 1""")
def q_topic_indicators(spark, sf):
    rows = table(spark, sf, "embeddings")
    descriptors = rows.where("vec_id < 16").select(F.concat(F.lit("t"), (F.col("vec_id") % 8).cast("string")).alias("topic"), F.col("embedding").alias("vec"))
    hits = F.when(F.col("vec_id") % 5 == 0, F.array(F.concat(F.lit("t"), (F.col("label") % 8).cast("string")))).otherwise(F.array().cast("array<string>"))
    out = enrich.classify(rows, "embedding", hits, descriptors, TOPICS)
    return out.select("vec_id", F.array_join("topics", ",").alias("topics"), "relevance", F.array_join("indicators", ",").alias("indicators"))


def _matches(kind: str) -> str:
    cases = [f"CASE WHEN {' OR '.join(f'contains(t, {a!r})' for a in aliases)} THEN '{key}' END" for key, aliases in sorted(TAXONOMY[kind].items())]
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


_ALIASES = _values("al", "kind, key, alias", [(kind, key, a) for kind in ("actors", "cues") for key, aliases in TAXONOMY[kind].items() for a in aliases])
_POSITIONS = f"""{_ALIASES}, dt AS (SELECT doc_id, lower(text) AS t FROM documents),
pc AS (SELECT doc_id, kind, key, alias, unnest(string_split(t, alias)) AS piece, generate_subscripts(string_split(t, alias), 1) AS i, len(string_split(t, alias)) AS n FROM dt, al WHERE contains(t, alias)),
ps AS (SELECT DISTINCT doc_id, kind, key, pos FROM (SELECT doc_id, kind, key, i, n, (sum(length(piece) + length(alias)) OVER (PARTITION BY doc_id, kind, key, alias ORDER BY i) - length(alias))::INT AS pos FROM pc) WHERE i < n)"""
_NEAR = f"""{_POSITIONS}, nr AS (SELECT c.doc_id, c.key AS cue, c.pos, a.key AS actor, rank() OVER (PARTITION BY c.doc_id, c.key, c.pos ORDER BY abs(a.pos - c.pos)) AS r
  FROM ps c JOIN ps a ON c.doc_id = a.doc_id AND c.kind = 'cues' AND a.kind = 'actors' AND abs(a.pos - c.pos) <= 100),
st AS (SELECT doc_id, actor, bool_or(cue = 'attributed') AS a, bool_or(cue = 'suspected') AS s, bool_or(cue = 'disputed') AS d FROM nr WHERE r = 1 GROUP BY 1, 2),
ar AS (SELECT doc_id, actor, CASE WHEN a AND d THEN 'reported_attribution_disputed' WHEN a THEN 'reported_attributed' ELSE 'suspected' END AS status FROM st WHERE a OR s)"""


@register(f"WITH {_POSITIONS} SELECT doc_id, kind, key, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM ps GROUP BY 1, 2, 3")
def q_alias_positions(spark, sf):
    docs, parts = table(spark, sf, "documents"), []
    for kind in ("actors", "cues"):
        parts.append(enrich.mentions(docs, "doc_id", "text", TAXONOMY[kind], bounded=kind == "actors").withColumn("kind", F.lit(kind)))
    both = parts[0].unionByName(parts[1])
    return both.groupBy(F.col("id").alias("doc_id"), "kind", "key").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@register(f"WITH {_POSITIONS} SELECT doc_id, kind, key, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM ps GROUP BY 1, 2, 3")
def q_alias_automaton(spark, sf):
    """q_alias_positions by one automaton a kind: a text is read once for all aliases."""
    docs = table(spark, sf, "documents")
    parts = [aliases.mentions(docs, "doc_id", "text", TAXONOMY[kind], bounded=kind == "actors").withColumn("kind", F.lit(kind)) for kind in ("actors", "cues")]
    both = parts[0].unionByName(parts[1])
    return both.groupBy(F.col("id").alias("doc_id"), "kind", "key").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@register(f"WITH {_NEAR} SELECT doc_id, cue, pos, string_agg(DISTINCT actor, ',' ORDER BY actor) AS actors FROM nr WHERE r = 1 GROUP BY 1, 2, 3")
def q_nearest_actor(spark, sf):
    docs = table(spark, sf, "documents")
    near = enrich.nearest_mentions(enrich.mentions(docs, "doc_id", "text", TAXONOMY["actors"]), enrich.mentions(docs, "doc_id", "text", TAXONOMY["cues"], bounded=False))
    return near.groupBy(F.col("id").alias("doc_id"), "cue", "pos").agg(F.array_join(F.array_sort(F.collect_set("actor")), ",").alias("actors"))


@register(f"WITH {_NEAR} SELECT doc_id, actor, status FROM ar")
def q_attribution(spark, sf):
    return enrich.attributions(table(spark, sf, "documents"), "doc_id", "text", TAXONOMY["actors"], TAXONOMY["cues"]).withColumnRenamed("id", "doc_id")


def _any(column: str, keys: tuple) -> str:
    return f"list_has_any({column}, [{', '.join(repr(k) for k in keys)}])"


_TRANSMIT = _values("tr", "item, channel", [(k, c) for k, found in TAXONOMY["transmission"].items() for c in found])
_DIMS = {
    "physical_attack": _any("modalities", enrich.PHYSICAL), "critical_infrastructure": _any("targets", enrich.CRITICAL),
    "alliance_proximity": f"({_any('actors', enrich.EUROPEAN)} OR {_any('targets', ('military_logistics', 'military_facility'))})",
    "cross_border": f"(len(list_intersect(actors, [{', '.join(repr(k) for k in enrich.EUROPEAN)}])) >= 2 OR " + " OR ".join(f"contains(t, '{w}')" for w in enrich.BORDER_WORDS) + ")",
    "reported_attribution": "coalesce(rep, FALSE)", "military_response": _any("responses", enrich.MILITARY), "diplomatic_response": _any("responses", enrich.DIPLOMATIC),
    "explicit_threat": "list_contains(modalities, 'military_threat')",
}
_GEO = f"""{_NEAR}, {_TRANSMIT}, said AS (SELECT doc_id, count(*) AS n_said, bool_or(status <> 'suspected') AS rep, string_agg(actor || '=' || status, ',' ORDER BY actor) AS attributions FROM ar GROUP BY 1),
ex AS (SELECT d.doc_id, lang, source, lower(text) AS t, {_matches('actors')} AS actors, {_matches('modalities')} AS modalities, {_matches('targets')} AS targets, {_matches('responses')} AS responses
  FROM (SELECT *, lower(text) AS t FROM documents) d),
ge AS (SELECT ex.*, n_said, rep, attributions, len(modalities) > 0 OR coalesce(n_said, 0) > 0 OR source = 'src7' OR (len(targets) > 0 AND (len(responses) > 0 OR {_any('actors', enrich.CORE)})) AS geopolitical,
  list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in sorted(_DIMS.items()))}], lambda x: x IS NOT NULL) AS dims,
  coalesce((SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT channel AS c FROM tr WHERE list_contains(modalities, item) OR list_contains(targets, item))), '') AS channels FROM ex LEFT JOIN said ON said.doc_id = ex.doc_id),
sv AS (SELECT *, round(least(100, {' + '.join(f"CASE WHEN list_contains(dims, '{n}') THEN {p}::DOUBLE ELSE 0 END" for n, p in enrich.DIMENSION_POINTS.items())}
  + {' + '.join(f"CASE WHEN list_contains(modalities, '{n}') THEN {p}::DOUBLE ELSE 0 END" for n, p in enrich.MODALITY_POINTS.items())}), 1) AS score FROM ge)"""


def _enriched(spark, sf, **more):
    docs = table(spark, sf, "documents").withColumns(more)
    theme = F.when(F.col("source") == "src7", "eu_energy").otherwise("markets")
    publisher = F.when(F.col("source") == "src3", "Ministry of Prose").otherwise(F.col("source"))
    return enrich.enrich(docs, "doc_id", "text", TAXONOMY, publisher, theme)


@register(f"""WITH {_GEO} SELECT doc_id, array_to_string(actors, ',') AS actors, array_to_string(modalities, ',') AS modalities, array_to_string(targets, ',') AS targets, array_to_string(responses, ',') AS responses,
  coalesce(attributions, '') AS attributions, geopolitical, array_to_string(dims, ',') AS dimensions, channels, score, CASE WHEN source = 'src3' THEN 'official_primary' WHEN source = 'src7' THEN 'official_discovery_query' ELSE 'news_report' END AS source_class FROM sv""")
def q_severity(spark, sf):
    out = _enriched(spark, sf)
    said = F.array_join(F.transform(F.coalesce("attributions", F.array().cast("array<struct<actor:string,status:string>>")), lambda a: F.concat(a["actor"], F.lit("="), a["status"])), ",")
    joined = [F.array_join(c, ",").alias(c) for c in ("actors", "modalities", "targets", "responses", "dimensions", "channels")]
    return out.select("doc_id", *joined, said.alias("attributions"), "geopolitical", "score", "source_class")


_UNION = lambda c: f"coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT unnest({c}) AS x FROM gx i WHERE i.ev = o.ev)), '') AS {c}"
_EVENTS = f"""{_GEO}, gx AS (SELECT *, (doc_id % 150)::VARCHAR AS ev FROM sv WHERE geopolitical),
pr AS (SELECT (ar.doc_id % 150)::VARCHAR AS ev, actor, max(CASE status WHEN 'suspected' THEN 1 WHEN 'reported_attributed' THEN 2 ELSE 3 END) AS p FROM ar GROUP BY 1, 2),
eo AS (SELECT o.ev AS event_id, min(doc_id) AS first_doc, count(*) AS article_count, count(DISTINCT source) AS publisher_count, {_UNION('actors')}, {_UNION('modalities')}, {_UNION('targets')}, max(score) AS event_score,
  coalesce((SELECT string_agg(actor || '=' || p, ',' ORDER BY actor) FROM pr WHERE pr.ev = o.ev), '') AS attributions FROM gx o GROUP BY o.ev)"""


def _geo_events(spark, sf, rows=None):
    rows = (_enriched(spark, sf) if rows is None else rows).withColumn("ev", F.col("doc_id") % 150).withColumn("seen", F.col("doc_id"))
    return enrich.event_rollup(rows, "ev", "seen", "doc_id", "doc_id", "source")


@register(f"WITH {_EVENTS} SELECT * FROM eo")
def q_geo_events(spark, sf):
    rank = lambda a: F.array_position(F.array(*map(F.lit, enrich.REPORTED)), a["status"]).cast("string")
    said = F.array_join(F.transform(F.coalesce("attributions", F.array().cast("array<struct<actor:string,status:string>>")), lambda a: F.concat(a["actor"], F.lit("="), rank(a))), ",")
    sets = [F.array_join(c, ",").alias(c) for c in ("actors", "modalities", "targets")]
    return _geo_events(spark, sf).select("event_id", F.col("first_seen").alias("first_doc"), "article_count", "publisher_count", *sets, "event_score", said.alias("attributions"))


@register(f"""WITH {_EVENTS}, th AS (SELECT actor, ev, p FROM pr WHERE p >= 2 AND ev IN (SELECT event_id FROM eo)) SELECT actor, count(*) AS events, min(first_doc) AS first_seen, max(event_score) AS max_score, max(p) AS strongest
FROM th JOIN eo ON eo.event_id = th.ev GROUP BY 1 ORDER BY events DESC, max_score DESC, actor LIMIT 10""")
def q_campaign_threads(spark, sf):
    rank = F.array_position(F.array(*map(F.lit, enrich.REPORTED)), F.col("status")).cast("int")
    return enrich.campaign_threads(_geo_events(spark, sf)).select("actor", "events", "first_seen", "max_score", rank.alias("strongest"))


@register(f"WITH {_GEO} SELECT array_to_string(list_sort(list_distinct(flatten(list(string_split(channels, ',')) FILTER (WHERE channels <> '' AND geopolitical)))), ',') AS channels FROM sv")
def q_channel_union(spark, sf):
    return enrich.channel_union(_geo_events(spark, sf)).select(F.array_join("channels", ",").alias("channels"))


_ENTITY = {"Alpha Bank": ["ther", "heit"], "Beta Fund": ["ouai"], "Gamma Trust": ["ciones", "ando"]}


@register("WITH t AS (SELECT doc_id, source, lower(text) AS t FROM documents) SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(t, {a!r})' for a in v)} THEN '{k}' END" for k, v in _ENTITY.items()) + ", nullif(source, '')], lambda x: x IS NOT NULL))), ',') AS entities FROM t")
def q_entities(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(enrich.entities("text", _ENTITY, "source"), ",").alias("entities"))


@register("""WITH r AS (SELECT doc_id, (n_chars % 50) / 100 AS rel, CASE WHEN doc_id % 4 = 0 THEN 0.97::DOUBLE ELSE 0.7::DOUBLE END AS trust, contains(lower(text), 'ungsch') AS geo FROM documents)
SELECT doc_id FROM r WHERE geo OR rel >= CASE WHEN trust >= 0.95 THEN 0.20::DOUBLE ELSE 0.25::DOUBLE END""")
def q_relevance_filter(spark, sf):
    rows = table(spark, sf, "documents")
    geo = F.size(text.lexicon_matches("text", {"sabotage": ["ungsch"]})) > 0
    kept = enrich.relevant(F.col("n_chars") % 50 / 100.0, F.when(F.col("doc_id") % 4 == 0, 0.97).otherwise(0.7), geo)
    return rows.where(kept).select("doc_id")
