"""Hybrid retrieval: exact nearest vectors, BM25, reciprocal-rank fusion and metadata rerank.

Queries come as tables (qid, ...) so that many are answered in one job.
Ranks are cut inside Spark (a window group limit keeps k rows of each task
and query), candidates are never collected.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stresslens.functions.scalars import clamp, recency_decay
from stresslens.functions.text import normalise, occurrences, tokens
from stresslens.sources.shared import kept

#: Candidates of each ranked list, and the fusion constant.
LIST, RRF = 60, 60


def top(rows: DataFrame, k: int, order: list[Column], by: str = "qid") -> DataFrame:
    """The first k rows of each query with their rank."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def in_blocks(queries: DataFrame, rows: DataFrame, qid: str = "qid", id: str = "id", sizes: tuple[int, int] = (4096, 16384)) -> tuple[DataFrame, DataFrame]:
    """Both tables dealt to numbered blocks (qb, vb), each query block beside each block of rows.

    Neither side is broadcast: a task holds one block of about ``sizes`` queries
    and rows, and their number grows with both tables.  Each table is dealt as
    often as the other has blocks, and each pair of blocks returns the first rows
    of each query, so blocks are as large as a task can hold.
    """
    nq, nv = (max(1, -(-df.count() // size)) for df, size in zip((queries, rows), sizes, strict=True))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    return queries.select("*", dealt(qid, nq).alias("qb"), every(nv).alias("vb")), rows.select("*", every(nq).alias("qb"), dealt(id, nv).alias("vb"))


def _nearest(left: pd.DataFrame, right: pd.DataFrame, k: int, digits: int) -> pd.DataFrame:
    """The k nearest of ``right`` for each of ``left`` by exact distances, ties after rounding by id."""
    out = []
    if len(left) and len(right):
        ids, v = right["id"].to_numpy(), np.stack(right["v"].to_numpy()).astype(float)
        square = (v * v).sum(1)
        for qid, q in zip(left["qid"], left["q"], strict=True):
            q = np.asarray(q, float)
            rough = square - 2 * (v @ q) + q @ q
            at = np.arange(len(ids))
            if len(ids) > k:
                limit = np.sqrt(max(0.0, np.partition(rough, k - 1)[k - 1])) + 2 * 10.0**-digits
                at = np.flatnonzero(rough <= limit * limit + 1e-9 * (1 + q @ q + square))
            dist = np.sqrt(((v[at] - q) ** 2).sum(1))
            first = np.lexsort((ids[at], np.round(dist, digits)))[:k]
            out.append(pd.DataFrame({"qid": qid, "id": ids[at][first], "dist": dist[first]}))
    return pd.concat(out) if out else pd.DataFrame({"qid": [], "id": [], "dist": []})


def knn(queries: DataFrame, vectors: DataFrame, k: int = LIST, digits: int = 6) -> DataFrame:
    """(qid, id, dist, sim, rank): the k nearest ``vectors(id, v)`` of each of ``queries(qid, q)``.

    Distances are rounded before ranking so that ties break by id.  Blocks of
    queries meet blocks of vectors; k of each pair of blocks are merged.
    """
    q, v = in_blocks(queries.select("qid", "q").where("q is not null"), vectors.select("id", "v").where("v is not null"))
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, dist double"
    pairs = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(lambda a, b: _nearest(a, b, k, digits), kinds)
    near = top(pairs.withColumn("dist", F.round("dist", digits)), k, [F.col("dist"), F.col("id")])
    return near.withColumn("sim", clamp(1.0 - F.col("dist") * F.col("dist") / 2.0, -1.0, 1.0))


def _latin_fold() -> tuple[str, str]:
    """Latin letters with marks and what is left without them, by the rule of canonical decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(c, base) for c, base in pairs if base != c]
    return "".join(c for c, _ in pairs), "".join(base for _, base in pairs)


def index_words(*fields: Column | str) -> Column:
    """The words of several fields for full-text search: lower case, Latin marks folded, runs of letters and digits."""
    joined = F.concat_ws(" ", *[F.col(f) if isinstance(f, str) else f for f in fields])
    return F.regexp_extract_all(F.translate(F.lower(joined), *_latin_fold()), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_words(text: Column | str, most: int = 12) -> Column:
    """The first distinct words of a query, of two characters or more (a limit of the query)."""
    return F.slice(F.array_distinct(F.filter(index_words(text), lambda w: F.length(w) >= 2)), 1, most)


def build_index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored tables (term, id, size, tf) and one row (n_docs, mean_size) of ``docs(id, words)``: what BM25 reads."""
    sized = docs.select("id", F.size("words").alias("size"), "words")
    postings = kept(sized.select("id", "size", F.explode("words").alias("term")).groupBy("term", "id", "size").agg(F.count("*").alias("tf")))
    return postings, kept(sized.agg(F.count("*").alias("n_docs"), F.avg("size").alias("mean_size")))


def _weighted(tf: DataFrame, queries: DataFrame, stats: DataFrame, k1: float, b: float) -> DataFrame:
    """(qid, id, score) from occurrences of query terms ``tf(term, id, size, tf)``."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n, mean = stats.select("n_docs").scalar(), stats.select("mean_size").scalar()
    idf = F.log(1.0 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * F.col("size") / mean))
    return tf.join(df, "term").join(queries.select("qid", "term"), "term").groupBy("qid", "id").agg(F.sum(weight).alias("score"))


def search_index(index: tuple[DataFrame, DataFrame], queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, id, score) of ``queries(qid, term)`` over a stored index, higher is better; texts aren't read."""
    postings, stats = index
    asked = queries.select("term").distinct()
    return _weighted(postings.join(asked, "term", "left_semi"), queries, stats, k1, b)


def bm25(queries: DataFrame, docs: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, id, score) of ``docs(id, words)`` for the terms of ``queries(qid, term)``, higher is better.

    For a few queries without an index: texts are read once, and only the
    occurrences of query terms leave the row.
    """
    asked = queries.agg(F.collect_set("term").alias("asked"))  # the words of a few queries
    known = docs.select("id", F.size("words").alias("size"), "words", asked.scalar().alias("asked"))
    found = F.transform(F.array_intersect("asked", "words"), lambda t: F.struct(t.alias("term"), F.size(F.filter("words", lambda w: w == t)).cast("long").alias("tf")))
    hits = kept(known.select("id", "size", found.alias("hits")))
    stats = hits.agg(F.count("*").alias("n_docs"), F.avg("size").alias("mean_size"))
    return _weighted(hits.select("id", "size", F.explode("hits").alias("h")).select("id", "size", "h.term", "h.tf"), queries, stats, k1, b)


def rrf(lists: list[DataFrame]) -> DataFrame:
    """(qid, id, rrf, lists): ranked lists (qid, id, rank) fused by the sum of 1 / (60 + rank)."""
    both = None
    for one in lists:
        part = one.select("qid", "id", "rank")
        both = part if both is None else both.unionByName(part)
    return both.groupBy("qid", "id").agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("rrf"), F.count("*").alias("lists"))


def rerank(fused: DataFrame, meta: DataFrame, limit: int) -> DataFrame:
    """Fused candidates with ``meta(id, age_days, trust)``: a little for recency and trust, then the first ``limit``."""
    bonus = 0.08 * recency_decay("age_days") / 100.0 + 0.04 * F.coalesce("trust", F.lit(0.5)) / 100.0
    scored = fused.join(meta, "id").withColumn("final", F.round(F.col("rrf") + bonus, 9))
    return top(scored, limit, [F.desc("final"), F.col("id")])


def search_news(index, vectors: DataFrame, meta: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(qid, id, rrf, lists, final, rank): full text and nearest vectors, fused and reranked.

    ``queries(qid, words, q)``, an index of :func:`build_index` or a
    ``blockindex.BlockIndex``, ``vectors(id, v)`` and ``meta(id, age_days,
    trust)``.  Each list holds ``LIST`` hits of a
    query; the limit lies between 1 and 50.
    """
    terms = queries.select("qid", F.explode("words").alias("term")).distinct()
    if isinstance(index, tuple):
        lexical = top(search_index(index, terms).withColumn("score", F.round("score", 6)), LIST, [F.desc("score"), F.col("id")])
    else:
        lexical = index.search(terms, LIST)
    near = knn(queries.select("qid", "q"), vectors, LIST)
    return rerank(rrf([lexical, near]), meta, min(50, max(1, limit)))


def after_ranking(ranked: DataFrame, keep: Column, limit: int) -> DataFrame:
    """Ranked rows that pass a filter, of four times the limit (50 at most): fewer may come back than asked for."""
    return top(ranked.where(F.col("rank") <= min(50, 4 * limit)).where(keep).drop("rank"), limit, [F.desc("final"), F.col("id")])


def hybrid_rank(candidates: DataFrame, limit: int, lexical: float = 0.45, semantic: float = 0.55) -> DataFrame:
    """Candidates (qid, id, lex, sim): weighted mix of min(1, lex / 12) and the clipped similarity, best first.

    Weights are normalised; both zero means lexical only.  Scores of zero or
    less are dropped.
    """
    wl, ws = _shares(lexical, semantic)
    mixed = wl * F.least(F.lit(1.0), F.col("lex") / 12.0) + ws * clamp(F.col("sim"), 0.0, 1.0)
    scored = candidates.withColumn("final", F.round(mixed, 6)).where("final > 0")
    return top(scored, limit, [F.desc("final"), F.desc("lex"), F.col("id")])


def _shares(lexical: float, semantic: float) -> tuple[float, float]:
    lexical, semantic = max(0.0, lexical), max(0.0, semantic)
    total = lexical + semantic
    return (lexical / total, semantic / total) if total > 0 else (1.0, 0.0)


def hybrid_search(queries: DataFrame, rows: DataFrame, limit: int, lexical: float = 0.45, semantic: float = 0.55) -> DataFrame:
    """The first ``limit`` of ``rows(id, v, lv)`` for each of ``queries(qid, q, lq)`` by :func:`hybrid_rank`.

    lq and lv are short vectors of lexical features whose product is the
    lexical score.  Blocks of queries meet blocks of rows as matrices, and only
    rows that can still be among the first of their block leave it.
    """
    wl, ws = _shares(lexical, semantic)
    left, right = in_blocks(queries.select("qid", "q", "lq"), rows.select("id", "v", "lv"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            stack = lambda frame, c: np.stack(frame[c].to_numpy()).astype(float)
            q, lq, v, lv, ids = stack(a, "q"), stack(a, "lq"), stack(b, "v"), stack(b, "lv"), b["id"].to_numpy()
            for begin in range(0, len(a), 128):  # the products of some queries at a time
                sims, lex = q[begin : begin + 128] @ v.T, lq[begin : begin + 128] @ lv.T
                clipped = np.clip(sims, 0.0, 1.0)
                mixed = wl * np.minimum(1.0, lex / 12.0) + ws * clipped
                for k, qid in enumerate(a["qid"][begin : begin + 128]):
                    # rounding comes later: what lies within two units of the last place is still in, of equal rows only the first
                    at = np.arange(len(ids))
                    if len(ids) > limit:
                        edge = np.partition(mixed[k], -limit)[-limit]
                        near = np.flatnonzero(np.abs(mixed[k] - edge) <= 2e-6)
                        equal = np.unique(np.stack([clipped[k][near], lex[k][near]], 1), axis=0, return_inverse=True)[1].ravel()
                        order = np.lexsort((ids[near], equal))
                        place = np.arange(len(near)) - np.searchsorted(equal[order], equal[order])
                        at = np.concatenate([np.flatnonzero(mixed[k] > edge + 2e-6), near[order[place < limit]]])
                    out.append(pd.DataFrame({"qid": qid, "id": ids[at], "lex": lex[k][at], "sim": sims[k][at]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "id": [], "lex": [], "sim": []})

    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, lex double, sim double"
    near = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(best, kinds)
    return hybrid_rank(near.withColumn("sim", F.round("sim", 6)), limit, lexical, semantic)


def cross_domain(lists: dict[str, DataFrame], limit: int) -> DataFrame:
    """Ranked lists of several domains merged by reciprocal rank; earlier domains first on ties."""
    both = None
    for order, (domain, one) in enumerate(lists.items()):
        part = one.select("qid", F.lit(domain).alias("domain"), F.col("id").cast("string").alias("id"), F.col("rank").alias("domain_rank"), F.lit(order).alias("domain_order"))
        both = part if both is None else both.unionByName(part)
    both = both.withColumn("rrf", 1.0 / (RRF + F.col("domain_rank")))
    return top(both, limit, [F.desc("rrf"), F.col("domain_order"), F.col("domain_rank"), F.col("id")]).drop("domain_order")


def hashed_vector(words: Column, size: int = 64) -> Column:
    """A deterministic stand-in for an embedding: counts of word hashes in ``size`` cells, unit length (zero stays zero)."""
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    cells = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    counts = lambda found: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(found, lambda c: c == i)).cast("double"))
    norm = lambda raw: F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda raw: once(norm(raw), lambda n: F.transform(raw, lambda x: F.when(n > 0, x / n).otherwise(0.0)))
    return once(cells, lambda found: once(counts(found), unit))


def fused_sources(lists: dict[str, DataFrame], limit: int) -> DataFrame:
    """Ranked lists (qid, id, rank, sim) of several sources fused: summed reciprocal ranks, sources that named it, best sim."""
    both = None
    for source, one in lists.items():
        part = one.select("qid", F.col("id").cast("string").alias("id"), "rank", F.col("sim").cast("double").alias("sim"), F.lit(source).alias("source"))
        both = part if both is None else both.unionByName(part)
    fused = both.groupBy("qid", "id").agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("rrf"), F.array_sort(F.collect_set("source")).alias("sources"), F.max("sim").alias("sim"))
    return top(fused.withColumn("rrf", F.round("rrf", 9)), limit, [F.desc("rrf"), F.col("id")])


def seeded(hits: DataFrame, seeds: DataFrame) -> DataFrame:
    """(qid, id, rank, sim): graph nodes that ranked hits (qid, id, rank) point to by ``seeds(id, node)``, at their best rank."""
    per = hits.join(seeds.withColumnRenamed("id", "hit"), F.col("id") == F.col("hit")).groupBy("qid", F.col("node").alias("node")).agg(F.min("rank").alias("best"))
    order = Window.partitionBy("qid").orderBy("best", "node")
    return per.select("qid", F.col("node").alias("id"), F.row_number().over(order).alias("rank"), F.lit(None).cast("double").alias("sim"))


def query_score(body: Column, phrase: Column, terms: Column) -> Column:
    """The lexical score of a normalised text for a query column: 8 for the phrase, up to 5 for each term in it."""
    each = F.transform(terms, lambda t: occurrences(body, t))
    points = F.aggregate(each, F.lit(0.0), lambda s, n: s + F.when(n > 0, 2.0 + F.least(F.lit(3.0), 0.25 * n)).otherwise(0.0))
    return F.when((phrase != "") & F.contains(body, phrase), 8.0).otherwise(0.0) + points


#: Least similarity that finds an item by its vector, and the alternatives offered.
LEAST_FOUND, ALTERNATIVES = 0.30, 3


def fuzzy_lookup(queries: DataFrame, items: DataFrame, similarity: Column | None = None) -> DataFrame:
    """(qid, found_by, key, alternatives) of ``queries(qid, text)`` among ``items(key, name, body)``.

    Stages: exact key or name, best lexical score, best similarity of at
    least 0.30 (``similarity``, a column over ``q`` and ``item``, if given),
    else ``not found``.  Alternatives are the next three by lexical score.
    Items are a dimension of some dozens of rows: one array value of the plan.
    """
    packed = items.agg(F.array_sort(F.collect_list(F.struct(*items.columns))).alias("items"))
    asked = queries.withColumns({"phrase": normalise("text"), "terms": tokens("text")}).withColumn("item", F.explode(packed.scalar()))
    body = normalise(F.concat_ws(" ", F.col("item.key").cast("string"), F.col("item.name"), F.col("item.body")))
    exact = (normalise(F.col("item.key").cast("string")) == F.col("phrase")) | (normalise(F.col("item.name")) == F.col("phrase"))
    scored = asked.select("qid", F.col("item.key").alias("key"), exact.alias("exact"), query_score(body, F.col("phrase"), F.col("terms")).alias("lex"), (F.lit(0.0) if similarity is None else similarity).alias("sim"))
    order = Window.partitionBy("qid").orderBy(F.desc("exact"), F.desc("lex"), F.desc("sim"), "key")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 1 + ALTERNATIVES)
    nearest = scored.groupBy("qid").agg(F.max_by("key", F.struct("sim", "lex")).alias("near_key"), F.max("sim").alias("near"))
    per = ranked.groupBy("qid").agg(F.min_by(F.struct("key", "exact", "lex"), "rank").alias("first"), F.array_sort(F.collect_list(F.struct("rank", "key"))).alias("all")).join(nearest, "qid")
    found_by = F.when(F.col("first.exact"), "exact").when(F.col("first.lex") > 0, "lexical").when(F.col("near") >= LEAST_FOUND, "similar").otherwise("not found")
    key = F.when(found_by.isin("exact", "lexical"), F.col("first.key")).when(found_by == "similar", F.col("near_key"))
    others = F.transform(F.filter("all", lambda a: a["rank"] > 1), lambda a: a["key"])
    return per.select("qid", found_by.alias("found_by"), key.alias("key"), others.alias("alternatives"))


def event_lookup(queries: DataFrame, events: DataFrame) -> DataFrame:
    """(qid, found, key, score) of ``queries(qid, text)`` among ``events(key, body)``: the event with the best lexical score, the smallest key on ties.

    Not found if no score is above zero; then ``available`` lists all keys.
    Events are a dimension of some dozens of rows, as in :func:`fuzzy_lookup`.
    """
    packed = events.agg(F.array_sort(F.collect_list(F.struct("key", normalise("body").alias("body")))).alias("items"))
    asked = queries.withColumns({"phrase": normalise("text"), "terms": tokens("text")}).withColumn("items", packed.scalar())
    scored = F.transform("items", lambda e: F.struct((-query_score(e["body"], F.col("phrase"), F.col("terms"))).alias("less"), e["key"].alias("key")))
    best = asked.select("qid", "items", F.array_min(scored).alias("b"))
    found = F.coalesce(F.col("b.less") < 0, F.lit(False))
    return best.select(
        "qid", found.alias("found"), F.when(found, F.col("b.key")).alias("key"), F.when(found, -F.col("b.less")).alias("score"),
        F.when(~found, F.transform("items", lambda e: e["key"])).alias("available"),
    )
