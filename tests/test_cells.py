"""Nearest neighbours by cells, and hybrid search over many ties, against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from stresslens.operators import cells, retrieval


def table(spark, points, ids=None):
    return spark.createDataFrame([(int(i), p.tolist()) for i, p in zip(ids if ids is not None else range(len(points)), points, strict=True)], "id long, v array<double>")


def brute(points, queries, k):
    out = []
    for qid, q in queries:
        dist = np.round(np.sqrt(((points - q) ** 2).sum(1)), 6)
        out += [(qid, int(i), r + 1) for r, i in enumerate(np.lexsort((np.arange(len(points)), dist))[:k])]
    return sorted(out)


def found(rows):
    return sorted((r["qid"], r["id"], r["rank"]) for r in rows.collect())


def test_cells_give_all_pairs_with_fewer_distances(spark, monkeypatch):
    monkeypatch.setattr(cells, "PIECE", 40)
    gen = np.random.default_rng(1)
    centres = gen.normal(size=(12, 8)) * 4
    points = np.concatenate([centres[gen.integers(12, size=900)] + gen.normal(size=(900, 8)) * 0.4, np.repeat(centres[:1], 150, axis=0), gen.normal(size=(50, 8)) * 9])
    queries = [(q, points[q]) for q in range(0, len(points), 20)] + [(5000, np.zeros(8)), (5001, np.full(8, 100.0))]
    asked = spark.createDataFrame([(q, v.tolist()) for q, v in queries] + [(None, [0.0] * 8), (7000, None)], "qid long, q array<double>")
    rows, counted = cells.knn_cells(asked, table(spark, points), 7)
    assert found(rows) == brute(points, queries, 7)
    compared = counted.agg(F.sum("compared")).first()[0]
    assert compared < 0.5 * len(queries) * len(points)
    assert found(rows) == found(retrieval.knn(asked.where("qid is not null"), table(spark, points), 7))


def test_cells_of_few_and_no_vectors(spark):
    asked = spark.createDataFrame([(1, [0.0, 1.0])], "qid long, q array<double>")
    few = table(spark, np.array([[0.0, 1.0], [3.0, 1.0], [0.0, 1.0]]))
    assert found(cells.knn_cells(asked, few, 10)[0]) == [(1, 0, 1), (1, 1, 3), (1, 2, 2)]
    assert cells.knn_cells(asked, few.limit(0), 10)[0].count() == 0
    assert cells.knn_cells(asked.limit(0), few, 10)[0].count() == 0
    # one place that all vectors share, and centres that are far from everything
    same = table(spark, np.ones((300, 2)))
    assert found(cells.knn_cells(asked, same, 5, np.array([[50.0, 50.0], [-50.0, 0.0]]))[0]) == [(1, k, k + 1) for k in range(5)]


def test_hybrid_search_cuts_ties_in_the_block(spark):
    asked = spark.createDataFrame([(q, [1.0, 0.0], [1.0]) for q in range(3)], "qid long, q array<double>, lq array<double>")
    rows = spark.createDataFrame([(k, [1.0, 0.0] if k < 2900 else [0.6, 0.8], [3.0]) for k in range(3000)], "id long, v array<double>, lv array<double>")
    got = retrieval.hybrid_search(asked, rows, 4)
    assert sorted((r["qid"], r["id"], r["rank"]) for r in got.collect()) == [(q, k, k + 1) for q in range(3) for k in range(4)]
    assert {round(r["final"], 6) for r in retrieval.hybrid_search(asked, rows, 4, -3.0, 1.0).collect()} == {1.0}


def test_hybrid_blocks_return_few_rows(spark, monkeypatch):
    rng, left = np.random.default_rng(3), []
    rows = [(k, rng.normal(size=4).tolist(), [float(k % 2)]) for k in range(2500)]
    items = spark.createDataFrame(rows, "id long, v array<double>, lv array<double>")
    asked = items.where("id < 600").select(F.col("id").alias("qid"), F.col("v").alias("q"), F.col("lv").alias("lq"))
    rank = retrieval.hybrid_rank
    monkeypatch.setattr(retrieval, "hybrid_rank", lambda near, *more: left.append(near.count()) or rank(near, *more))
    got = {}
    for r in retrieval.hybrid_search(asked, items, 5).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    v = np.array([r[1] for r in rows])
    for q in (0, 131, 599):  # in several slices of the queries
        lex = np.array([(k % 2) * (q % 2) for k in range(2500)])
        final = np.round(0.45 * np.minimum(1, lex / 12) + 0.55 * np.clip(np.round(v @ v[q], 6), 0, 1), 6)
        want = sorted(range(2500), key=lambda k: (-final[k], -lex[k], k))[:5]
        assert [i for _, i in sorted(got[q])] == want
    assert left[0] <= 600 * 5 * 5 / 2  # one block of rows, and a few that may tie



def test_tables_are_dealt_a_few_times(spark):
    queries, rows = spark.range(5000).select(F.col("id").alias("qid")), spark.range(60_000)
    left, right = retrieval.in_blocks(queries, rows)
    assert left.count() <= 4 * 5000 and right.count() <= 2 * 60_000



def test_neighbours_of_a_block_are_cut_before_they_leave_it(spark, monkeypatch):
    rng, seen = np.random.default_rng(4), []
    points = spark.createDataFrame([(k, rng.normal(size=3).tolist()) for k in range(4000)], "id long, v array<double>")
    top = retrieval.top
    monkeypatch.setattr(retrieval, "top", lambda rows, *more: seen.append(rows.count()) or top(rows, *more))
    asked = points.where("id < 100").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    assert retrieval.knn(asked, points, 40).count() == 100 * 40
    assert seen == [100 * 40]
