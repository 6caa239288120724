"""The stored block index against BM25 over the same documents, through adding, deleting and merging."""

import random

from pyspark.sql import functions as F

from stresslens.operators import blockindex, retrieval

WORDS = [f"w{k}" for k in range(60)]


def documents(rng, ids):
    rows = []
    for k in ids:
        n = 0 if k % 17 == 3 else rng.randint(1, 40)
        rows.append((k, [WORDS[min(59, int(rng.expovariate(0.12)))] for _ in range(n)] if k % 23 else None))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, words array<string>")


def hits(found):
    return sorted((r["qid"], r["rank"], r["id"], r["score"]) for r in found.collect())


def full(spark, rows, terms, k):
    docs = frame(spark, [(i, w or []) for i, w in rows])
    scored = retrieval.bm25(terms, docs).withColumn("score", F.round("score", blockindex.DIGITS))
    return hits(retrieval.top(scored, k, [F.desc("score"), F.col("id")]))


def test_lifecycle_equals_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blockindex, "BLOCK", 8)
    rng = random.Random(3)
    index = blockindex.BlockIndex(spark, f"file://{tmp_path}/index")
    asked = [(q, t) for q in range(12) for t in rng.sample(WORDS, 4)] + [(99, "absent"), (3, "absent"), (4, None), (None, "w1"), (5, "w0"), (5, "w0")]
    terms = spark.createDataFrame(asked, "qid int, term string")
    plain = spark.createDataFrame(sorted({a for a in asked if None not in a}), "qid int, term string")
    live = {}

    def check(k=5):
        got, counted = index.search_counted(terms, k)
        rows = hits(got)
        assert [r[:3] for r in rows] == [r[:3] for r in full(spark, list(live.items()), plain, k)]
        assert index.counts()["docs"] == len(live) and index.counts()["words"] == sum(len(w or []) for w in live.values())
        return counted

    first = documents(rng, range(300))
    assert index.ensure(frame(spark, first)) and not index.ensure(frame(spark, first).orderBy(F.rand(1)))
    live.update(first)
    check()
    more = documents(rng, range(280, 420))  # 20 of them replace documents that are there
    index.add(frame(spark, [*more, (None, ["w1"])]))
    live.update(more)
    check(1)
    index.delete(spark.createDataFrame([(k,) for k in [*range(0, 420, 7), 5000]], "id long"))
    for k in range(0, 420, 7):
        del live[k]
    counted = {r["qid"]: (r["blocks"], r["opened"]) for r in check().collect()}
    assert all(opened <= blocks for blocks, opened in counted.values())
    for start in (500, 520, 540):
        part = documents(rng, [*range(start, start + 18), 1, 2])
        index.add(frame(spark, part))
        live.update(part)
    check()
    before = index.counts()["segments"]
    merged = index.merge_segments(2)
    assert len(merged) >= 3 and index.counts()["segments"] < before
    check()
    assert set(merged) <= set(index.vacuum())
    check(30)
    # another search of the same index writes nothing to it
    version = index.log.latest()
    check()
    assert index.log.latest() == version
    again = frame(spark, list(live.items()))
    assert index.ensure(again) and not index.ensure(again)
    check()


def test_empty_index(spark, tmp_path):
    index = blockindex.BlockIndex(spark, f"file://{tmp_path}/index")
    terms = spark.createDataFrame([(1, "a")], "qid int, term string")
    assert index.search(terms, 5).count() == 0
    assert index.ensure(frame(spark, [])) and not index.ensure(frame(spark, []))
    assert index.search(terms, 5).count() == 0
    index.add(frame(spark, [(1, ["a", None, "a"]), (2, None)]))
    assert [(r["id"], r["rank"]) for r in index.search(terms, 5).collect()] == [(1, 1)]


def test_most_blocks_stay_closed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blockindex, "BLOCK", 16)
    rng = random.Random(5)
    # a rare word beside frequent ones: blocks without it can't reach the first places
    rows = [(k, ["the", "of"] * rng.randint(1, 8) + [f"r{k % 50}"] * rng.randint(1, 3) + [f"u{k}"]) for k in range(3000)]
    index = blockindex.BlockIndex(spark, f"file://{tmp_path}/index")
    index.ensure(frame(spark, rows))
    terms = spark.createDataFrame([(q, t) for q in range(8) for t in ("the", f"u{q * 301}", f"r{q}")], "qid int, term string")
    found, counted = index.search_counted(terms, 3)
    assert [r[:3] for r in hits(found)] == [r[:3] for r in full(spark, rows, terms, 3)]
    assert counted.agg(F.sum("opened") / F.sum("blocks")).first()[0] < 0.5


def test_scores_stay_in_their_tasks(spark, tmp_path, monkeypatch):
    # every query meets every document: neither the pairs nor those that tie may be written or shuffled
    written = []

    def counting(df):
        out = kept(df)
        written.append(out.count())
        return out

    kept = blockindex.kept
    monkeypatch.setattr(blockindex, "kept", counting)
    index = blockindex.BlockIndex(spark, f"file://{tmp_path}/index")
    index.ensure(frame(spark, [(k, ["the", f"w{k % 3}"]) for k in range(3000)]))
    terms = spark.createDataFrame([(q, t) for q in range(60) for t in ("the", f"w{q % 3}")], "qid int, term string")
    assert [r[:3] for r in hits(index.search(terms, 5))] == [(q, r + 1, q % 3 + 3 * r) for q in range(60) for r in range(5)]
    # 5 hits and a line of counts for each query and chunk
    assert max(written) <= 60 * 6 * 2


def test_deletions_meet_their_blocks_in_chunks(spark, tmp_path, monkeypatch):
    # blocks with deletions and those merged are dealt once: no plan joins blocks, and no pairs of queries and documents are written
    written, joins = [], []

    def counting(df):
        joins.append("Join LeftOuter" in df._jdf.queryExecution().optimizedPlan().toString())
        out = kept(df)
        written.append(out.count())
        return out

    kept = blockindex.kept
    index = blockindex.BlockIndex(spark, f"file://{tmp_path}/index")
    for start in (0, 1000, 2000, 3000, 4000):
        index.add(frame(spark, [(k, ["the", f"w{k % 3}"]) for k in range(start, start + 1000)]))
    index.delete(spark.createDataFrame([(k,) for k in range(0, 5000, 30)], "id long"))
    assert index.merge_segments()
    index.delete(spark.createDataFrame([(k,) for k in (3, 5, 4999)], "id long"))
    monkeypatch.setattr(blockindex, "kept", counting)
    terms = spark.createDataFrame([(q, t) for q in range(60) for t in ("the", f"w{q % 3}")], "qid int, term string")
    live = [k for k in range(5000) if k % 30 and k not in (3, 5, 4999)]
    want = [(q, r + 1, k) for q in range(60) for r, k in enumerate([k for k in live if k % 3 == q % 3][:5])]
    assert [r[:3] for r in hits(index.search(terms, 5))] == want
    assert max(written) <= 60 * 6 * 2 and not any(joins)


def test_graph_search_ranks_the_news_once(spark):
    from stresslens.plans import catalog

    plan = catalog.queries()["q_graph_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "dist" not in plan  # no neighbours are left to find: what was found is kept for both lists
