"""Queries over retrieval, lookup and graph search, and the same in DuckDB SQL.

Documents are articles and the embeddings of the same number are their
vectors; every document whose id is divisible by 20 and has one is a query.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stresslens.functions import text
from stresslens.operators import retrieval
from stresslens.operators.blockindex import BlockIndex
from stresslens.plans.registry import register, table
from stresslens.sources.shared import kept, new_folder, session_folder

_WORDS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"
_SEARCH = rf"""dw AS (SELECT doc_id AS id, {_WORDS.format("concat_ws(' ', text, source)")} AS words FROM documents), st AS (SELECT count(*) AS n, avg(len(words)) AS m FROM dw),
tf AS (SELECT id, size, term, count(*) AS tf FROM (SELECT id, len(words) AS size, unnest(words) AS term FROM dw) GROUP BY 1, 2, 3), dft AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
qw AS (SELECT doc_id AS qid, list_filter({_WORDS.format("text")}, lambda w: length(w) >= 2) AS w FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id % 20 = 0),
qt AS (SELECT qid, term FROM (SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY i) AS r FROM (SELECT qid, term, min(i) AS i FROM (SELECT qid, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM qw) GROUP BY 1, 2)) WHERE r <= 12),
bm AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / m))), 6) AS score FROM tf JOIN dft USING (term) JOIN qt USING (term), st GROUP BY 1, 2),
lx AS (SELECT * FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm) WHERE rank <= 60),
kn AS (SELECT * FROM (SELECT qid, id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM (SELECT q.vec_id AS qid, v.vec_id AS id, round(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS dist FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT qid FROM qw))) WHERE rank <= 60),
fu AS (SELECT qid, id, sum(1::DOUBLE / (60 + rank)) AS rrf, count(*) AS lists FROM (SELECT qid, id, rank FROM lx UNION ALL SELECT qid, id, rank FROM kn) GROUP BY 1, 2),
fi AS (SELECT qid, id, lists, round(rrf + 0.08::DOUBLE * exp(-ln(2) * (id % 60) / 21) / 100 + 0.04::DOUBLE * coalesce(CASE WHEN id % 7 <> 0 THEN (id % 10) / 10 END, 0.5) / 100, 9) AS final FROM fu)"""


def _search(spark, sf, limit: int):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    index = BlockIndex(spark, session_folder(spark, f"documents of {sf}"))  # one index for all queries of the session
    index.ensure(docs.select("id", retrieval.index_words("text", "source").alias("words")))
    asked = docs.where("id % 20 = 0").join(vectors, "id").select(F.col("id").alias("qid"), retrieval.query_words("text").alias("words"), F.col("v").alias("q"))
    meta = docs.select("id", (F.col("id") % 60).alias("age_days"), F.when(F.col("id") % 7 != 0, F.col("id") % 10 / 10.0).alias("trust"))
    return retrieval.search_news(index, vectors, meta, asked, limit)


@register(f"WITH {_SEARCH} SELECT qid, id, lists, final, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, id) AS rank FROM fi) WHERE rank <= 10")
def q_search_news(spark, sf):
    return _search(spark, sf, 10).select("qid", "id", "lists", "final", "rank")


@register(f"WITH {_SEARCH}, ra AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, id) AS rank FROM fi) SELECT qid, id, rank::INT AS rank FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY final DESC, id) AS rank FROM ra WHERE rank <= 40 AND id % 3 = 0) WHERE rank <= 10")
def q_filter_after_ranking(spark, sf):
    return retrieval.after_ranking(_search(spark, sf, 40), F.col("id") % 3 == 0, 10).select("qid", "id", "rank")


_CROSS = f"""{_SEARCH}, sx AS (SELECT * FROM (SELECT qid, id::VARCHAR AS id, row_number() OVER (PARTITION BY qid ORDER BY final DESC, lex DESC, id) AS rank FROM (SELECT *, round(0.45::DOUBLE * least(1, lex / 12) + 0.55::DOUBLE * greatest(0, least(1, sim)), 6) AS final FROM (
  SELECT q.vec_id AS qid, v.vec_id AS id, CASE WHEN q.label = v.label THEN 10::DOUBLE ELSE 0 END AS lex, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS sim FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT qid FROM qw))) WHERE final > 0) WHERE rank <= 20),
nx AS (SELECT qid, id::VARCHAR AS id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, id) AS rank FROM fi) WHERE rank <= 20)"""


def _structured(spark, sf, limit: int):
    rows = table(spark, sf, "embeddings")
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.when(k == F.col("label"), 1.0).otherwise(0.0))
    items = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.transform(one_hot, lambda x: 10.0 * x).alias("lv"))
    docs = table(spark, sf, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("vec_id"))
    asked = rows.join(docs, "vec_id", "left_semi").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), one_hot.alias("lq"))
    return retrieval.hybrid_search(asked, items, limit)


@register(f"""WITH {_CROSS}, bo AS (SELECT qid, 'structured' AS domain, id, rank AS domain_rank, 0 AS o FROM sx UNION ALL SELECT qid, 'news', id, rank, 1 FROM nx)
SELECT qid, domain, id, domain_rank::INT AS domain_rank, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY domain_rank, o, id) AS rank FROM bo) WHERE rank <= 15""")
def q_cross_domain(spark, sf):
    lists = {"structured": _structured(spark, sf, 20), "news": _search(spark, sf, 20)}
    return retrieval.cross_domain(lists, 15).select("qid", "domain", "id", "domain_rank", "rank")


@register(f"""WITH {_CROSS}, sd AS (SELECT qid, node AS id, row_number() OVER (PARTITION BY qid ORDER BY best, node) AS rank FROM (SELECT qid, 'source:' || source AS node, min(rank) AS best FROM nx JOIN documents ON doc_id = id::BIGINT WHERE source IS NOT NULL GROUP BY 1, 2)),
al AS (SELECT qid, 'doc:' || id AS id, rank, 'nodes' AS s FROM sx UNION ALL SELECT qid, 'doc:' || id, rank, 'news' FROM nx UNION ALL SELECT qid, id, rank, 'seeds' FROM sd),
fg AS (SELECT qid, id, round(sum(1::DOUBLE / (60 + rank)), 9) AS rrf, string_agg(DISTINCT s, ',' ORDER BY s) AS sources FROM al GROUP BY 1, 2)
SELECT qid, id, rrf, sources, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, id) AS rank FROM fg) WHERE rank <= 12""")
def q_graph_search(spark, sf):
    as_node = lambda ranked: ranked.select("qid", F.concat(F.lit("doc:"), F.col("id").cast("string")).alias("id"), "rank", F.lit(None).cast("double").alias("sim"))
    news = kept(_search(spark, sf, 20).select("qid", "id", "rank"))  # read twice
    seeds = table(spark, sf, "documents").where("source is not null").select(F.col("doc_id").alias("id"), F.concat(F.lit("source:"), "source").alias("node"))
    lists = {"nodes": as_node(_structured(spark, sf, 20)), "news": as_node(news), "seeds": retrieval.seeded(news, seeds)}
    return retrieval.fused_sources(lists, 12).select("qid", "id", "rrf", F.array_join("sources", ",").alias("sources"), "rank")


_NORM = r"lower(trim(regexp_replace({}, '[ \t\n\r\x0b\f]+', ' ', 'g')))"


@register(rf"""WITH it AS (SELECT n_nationkey::VARCHAR AS key, n_name AS name, CASE n_nationkey % 5 WHEN 0 THEN 'small red widget' WHEN 1 THEN 'brass gear' WHEN 2 THEN 'steel ring' WHEN 3 THEN 'blue bolt' ELSE 'large green plate' END AS body FROM nation),
qu AS (SELECT p_partkey AS qid, {_NORM.format("CASE WHEN p_partkey % 40 = 0 THEN 'Nation_' || (p_partkey // 40 % 30) ELSE p_name END")} AS phrase FROM part WHERE p_partkey % 20 = 0),
sc AS (SELECT qid, key, lower(name) = phrase OR key = phrase AS exact, b, phrase, regexp_extract_all(phrase, '[a-z0-9_./%-]+') AS terms FROM qu, (SELECT *, {_NORM.format("concat_ws(' ', key, name, body)")} AS b FROM it)),
s2 AS (SELECT qid, key, exact, CASE WHEN contains(b, phrase) THEN 8 ELSE 0 END + coalesce(list_sum(list_transform(terms, lambda t: CASE WHEN contains(b, t) THEN 2 + least(3, 0.25::DOUBLE * ((length(b) - length(replace(b, t, ''))) // length(t))) ELSE 0 END)), 0) AS lex FROM sc),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY exact DESC, lex DESC, key) AS rank FROM s2)
SELECT qid, max(CASE WHEN rank = 1 THEN CASE WHEN exact THEN 'exact' WHEN lex > 0 THEN 'lexical' ELSE 'not found' END END) AS found_by, max(CASE WHEN rank = 1 AND (exact OR lex > 0) THEN key END) AS key, string_agg(CASE WHEN rank BETWEEN 2 AND 4 THEN key END, ',' ORDER BY rank) AS alternatives FROM r WHERE rank <= 4 GROUP BY 1""")
def q_fuzzy_stages(spark, sf):
    goods = F.get(F.array(*map(F.lit, ("small red widget", "brass gear", "steel ring", "blue bolt", "large green plate"))), F.col("n_nationkey") % 5)
    items = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name"), goods.alias("body"))
    asked = F.when(F.col("p_partkey") % 40 == 0, F.concat(F.lit("Nation_"), (F.floor(F.col("p_partkey") / 40) % 30).cast("string"))).otherwise(F.col("p_name"))
    queries = table(spark, sf, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("qid"), asked.alias("text"))
    return retrieval.fuzzy_lookup(queries, items).select("qid", "found_by", "key", F.array_join("alternatives", ",").alias("alternatives"))


ALIASES = {"red": ["crimson", "scarlet"], "ring": ["band"], "widget": ["gadget", "band"]}


@register(r"""WITH t AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9_./%-]+') AS w FROM part),
x AS (SELECT p_partkey, list_concat(list_concat(list_concat(w, CASE WHEN list_contains(w, 'red') THEN ['crimson', 'scarlet'] ELSE [] END), CASE WHEN list_contains(w, 'ring') THEN ['band'] ELSE [] END), CASE WHEN list_contains(w, 'widget') THEN ['gadget', 'band'] ELSE [] END) AS a FROM t)
SELECT p_partkey, array_to_string(a, ' ') AS words FROM x""")
def q_alias_expansion(spark, sf):
    found = text.expand_aliases(text.tokens("p_name"), ALIASES)
    return table(spark, sf, "part").select("p_partkey", F.array_join(found, " ").alias("words"))


@register(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(concat_ws(' ', text, source))), '[\p{L}\p{N}]+')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS n FROM w GROUP BY 1""")
def q_postings(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), retrieval.index_words("text", "source").alias("words"))
    return retrieval.build_index(docs)[0].groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


_TOP10 = "SELECT qid, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm) WHERE rank <= 10"


def _indexed(spark, sf):
    """(documents as (id, words), the words of every twentieth as (qid, term))."""
    docs = table(spark, sf, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), retrieval.index_words("text", "source").alias("words"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    asked = docs.where("doc_id % 20 = 0").join(vectors, "doc_id", "left_semi").select(F.col("doc_id").alias("qid"), F.explode(retrieval.query_words("text")).alias("term"))
    return rows, asked


@register(f"WITH {_SEARCH} {_TOP10}")
def q_index_search(spark, sf):
    """BM25 over the stored index by blocks: built once, found unchanged by its second call, most blocks not opened."""
    rows, asked = _indexed(spark, sf)
    index = BlockIndex(spark, new_folder(spark))
    index.ensure(rows)
    index.ensure(rows)
    return index.search(asked, 10).select("qid", "id", "score", "rank")


@register(f"WITH {_SEARCH.replace('FROM documents), st AS', 'FROM documents WHERE doc_id % 10 <> 4), st AS')} {_TOP10}")
def q_index_segments(spark, sf):
    """The same after documents came in five segments, some twice, a tenth was deleted, and small segments were merged."""
    rows, asked = _indexed(spark, sf)
    index = BlockIndex(spark, new_folder(spark))
    index.ensure(rows.where("id % 5 = 0"))
    for k in (1, 2, 3, 4):
        again = (F.col("id") % 5 == k - 1) & (F.col("id") % 7 == 0)
        index.add(rows.where((F.col("id") % 5 == k) | again))
    index.delete(rows.where("id % 10 = 4").select("id"))
    index.merge_segments()
    return index.search(asked, 10).select("qid", "id", "score", "rank")
