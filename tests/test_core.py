"""Definitions against naive Python, published figures, and rows that must not look ahead."""

import datetime
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from stresslens.functions import scalars, text
from stresslens.operators import graph, mlp, news, retrieval, scoring, series
from stresslens.plans import catalog


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("p", "want"), [(50.0, 0.0), (65.0, 0.0), (82.5, 50.0), (100.0, 100.0), (None, None)])
def test_tail_score(spark, p, want):
    assert one(spark, scalars.tail_score(F.lit(p).cast("double"))) == want


def test_clamp_keeps_missing(spark):
    assert one(spark, scalars.clamp(F.lit(None).cast("double"))) is None
    assert one(spark, scalars.clamp(F.lit(140.0))) == 100.0


@pytest.mark.parametrize(("x", "want"), [(0.5, 0.0), (1.5, 100 / 6), (2.0, 100 / 3), (3.0, 200 / 3), (4.0, 100.0), (9.0, 100.0)])
def test_anchor(spark, x, want):
    assert one(spark, scalars.anchor(F.lit(x), 1.0, 2.0, 3.0)) == pytest.approx(want)


def test_levels_and_stage(spark):
    assert [one(spark, scalars.level_word(F.lit(x))) for x in (24.9, 25.0, 45.0, 65.0, 80.0)] == ["NORMAL", "WATCH", "ELEVATED", "HIGH", "CRITICAL"]
    assert one(spark, scalars.level_word(F.lit(None).cast("double"))) == "NO DATA"
    stage = scalars.transmission_stage(F.lit(23.2), F.lit(20.9), F.lit(30.2), F.lit(53.9), F.lit(22.2))
    assert one(spark, stage) == 1


def test_evidence_decay_published(spark):
    assert one(spark, scalars.evidence_decay(F.lit(2.0), F.lit("medium"), F.lit(42))) == pytest.approx(48.17, abs=0.01)
    assert one(spark, scalars.evidence_decay(F.lit(2.0), F.lit("high"), F.lit(42))) == pytest.approx(56.67, abs=0.01)


def test_momentum_published(spark):
    assert one(spark, scalars.momentum(F.lit(102), F.lit(58))) == pytest.approx(87.93, abs=0.01)


def test_py_round_ties(spark):
    rows = spark.createDataFrame([(0.35,), (17.65,), (None,)], "x double").select(scalars.py_round(1)("x").alias("x"))
    assert [r["x"] for r in rows.collect()] == [0.3, 17.6, None]


def test_fusion_published(spark):
    scores = [2.3, 0.0, 67.2, 8.9, 3.7, 50.2, 12.1, 0.0, 35.3, 56.7, 56.7, 48.2, None]
    weights = [10, 14, 10, 8, 8, 10, 8, 6, 7, 6, 8, 5, 40]
    rows = spark.createDataFrame([("d", str(k), s) for k, s in enumerate(scores)], "d string, key string, score double")
    dim = spark.createDataFrame([(str(k), float(w)) for k, w in enumerate(weights)], "key string, weight double")
    got = scoring.weighted_fusion(rows, dim).first()
    assert got["raw_score"] == pytest.approx(26.765) and got["coverage"] == 100.0


def _naive(values, i, lookback):
    past = values[max(0, i - lookback + 1) : i]
    if len(past) < series.LEAST:
        return None, None
    med = statistics.median(past)
    mad = statistics.median([abs(x - med) for x in past])
    sd = statistics.pstdev(past)
    z = (values[i] - med) / (1.4826 * mad) if mad else (values[i] - med) / sd if sd else 0.0
    return 100 * sum(x <= values[i] for x in past) / len(past), z


def _series(spark, values):
    return spark.createDataFrame([("k", k, float(v)) for k, v in enumerate(values)], "key string, d int, v double")


def test_rolling_against_naive(spark):
    rng = random.Random(1)
    values = [rng.choice([1, 2, 3, 5, 8]) + rng.random() * rng.choice([0, 1]) for _ in range(80)] + [4.0] * 30
    got = series.rolling(_series(spark, values), series.Profile(2, 5, 25)).orderBy("d").collect()
    for i, row in enumerate(got):
        pct, z = _naive(values, i, 25)
        assert row["pct"] == (pct if pct is None else pytest.approx(pct))
        assert row["z"] == (z if z is None else pytest.approx(z))


def test_metric_never_looks_ahead(spark):
    rng = random.Random(2)
    values = [rng.gauss(10, 3) for _ in range(60)]
    profile, limits = series.Profile(2, 5, 20), (8.0, 11.0, 14.0)
    full = {r["d"]: r["score"] for r in series.dynamic_metric(_series(spark, values), profile, limits).collect()}
    cut = {r["d"]: r["score"] for r in series.dynamic_metric(_series(spark, values[:40]), profile, limits).collect()}
    assert all(full[d] == s for d, s in cut.items())
    assert all(s is None or 0 <= s <= 100 for s in full.values())


def test_asof_keeps_null_rows(spark):
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 4, None), ("b", 3, 7.0)], "key string, d int, v double")
    probes = spark.createDataFrame([(2,), (5,)], "d int")
    got = {(r["key"], r["d"]): r["v"] for r in series.asof_backward(probes, rows, rows.select("key").distinct(), ["v"]).collect()}
    assert got == {("a", 2): 5.0, ("a", 5): None, ("b", 2): None, ("b", 5): 7.0}


def test_auc_and_ap_against_pairs(spark):
    rng = random.Random(3)
    rows = [(k, rng.randint(0, 9) / 10, rng.randint(0, 1)) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, s double, y int")
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert scoring.roc_auc(df, "s", "y").first()["auc"] == pytest.approx(want)
    ranked = sorted(rows, key=lambda r: (-r[1], r[0]))
    hits, total = 0, 0.0
    for k, r in enumerate(ranked, 1):
        hits += r[2]
        total += r[2] * hits / k
    assert scoring.average_precision(df, "s", "y", "id").first()["ap"] == pytest.approx(total / len(pos))


def test_candidates_objective_and_guardrails(spark):
    rng = random.Random(6)
    day = datetime.date(2020, 1, 1)
    days = [day + datetime.timedelta(k) for k in range(120)]
    spans = [("a", days[20], days[30]), ("b", days[80], days[85])]
    windows = spark.createDataFrame(spans, "id string, start date, end date")
    inside = [int(any(s - datetime.timedelta(60) <= d <= e for _, s, e in spans)) for d in days]
    scores = {"base": [rng.randint(15, 85) for _ in days]}
    scores["good"] = [min(100, v + 15 * y) for v, y in zip(scores["base"], inside)]
    scores["bad"] = [v - 20 * y for v, y in zip(scores["base"], inside)]
    rows = [(c, d, float(v)) for c, vs in scores.items() for d, v in zip(days, vs)]
    got = {r["candidate"]: r for r in scoring.evaluate_candidates(spark.createDataFrame(rows, "candidate string, d date, score double"), windows, windows, "base").collect()}

    def naive(vs):
        pos, neg = [v for v, y in zip(vs, inside) if y], [v for v, y in zip(vs, inside) if not y]
        auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
        hits, ap = 0, 0.0
        for k, (_, _, y) in enumerate(sorted(zip([-v for v in vs], days, inside)), 1):
            hits += y
            ap += y * hits / k
        rates = lambda t: (sum(p >= t for p in pos) / len(pos), sum(n >= t for n in neg) / len(neg))
        t = max((20 + k / 2 for k in range(121)), key=lambda t: (round((rates(t)[0] + 1 - rates(t)[1]) / 2, 12), -round(rates(t)[1], 9), -t))
        peaks = [max(v for v, d in zip(vs, days) if s <= d <= e) for _, s, e in spans]
        recall = sum(p >= t for p in peaks) / 2
        return 0.35 * auc + 0.25 * ap / len(pos) + 0.2 * recall + 0.2 * (1 - rates(t)[1]), t, recall, peaks

    base = naive(scores["base"])
    for c, vs in scores.items():
        want = naive(vs)
        assert (got[c]["objective"], got[c]["threshold"], got[c]["event_recall"]) == pytest.approx(want[:3])
        assert got[c]["d_objective"] == pytest.approx(want[0] - base[0])
        assert got[c]["d_peak"] == min(a - b for a, b in zip(want[3], base[3]))
    assert "objective" in got["bad"]["reasons"] and "event peak" in got["bad"]["reasons"] and not got["bad"]["passes"]


def test_merge_and_retain(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, x string, old int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", 6)], "id int, x string, new int")
    got = {r["id"]: (r["x"], r["old"], r["new"]) for r in news.merge_rows(old, new, "id").collect()}
    assert got == {1: ("a", 10, None), 2: (None, 20, 5), 3: ("c", None, 6)}


def test_short_aliases_need_word_limits(spark):
    hit = lambda s: one(spark, text.lexicon_matches(F.lit(s), {"eu": ["EU"], "repo": ["repo"]}))
    assert hit("the EU, a report") == ["eu", "repo"]
    assert hit("neutral") == []


def test_k_hop_and_chain(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "b")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "id string")
    got = {r["id"]: r["hop"] for r in graph.k_hop(edges, roots, 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_rrf(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "qid int, id int, rank int")
    b = spark.createDataFrame([(1, 8, 1)], "qid int, id int, rank int")
    got = {r["id"]: r["rrf"] for r in retrieval.rrf([a, b]).collect()}
    assert got[8] == pytest.approx(1 / 62 + 1 / 61) and got[7] == pytest.approx(1 / 61)


def test_knn_in_blocks(spark):
    rng = random.Random(8)
    vecs = [(k, [rng.gauss(0, 1) for _ in range(4)] if k % 7 else [1.0, 0.0, 0.0, 0.0]) for k in range(1400)]
    v = spark.createDataFrame(vecs, "id long, v array<double>")
    q = v.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    found = retrieval.knn(q, v, 5)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    got = {}
    for r in found.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["dist"], r["id"]))
    assert set(got) == set(range(0, 1400, 20))
    for k, near in got.items():
        want = sorted((round(math.dist(vecs[k][1], x), 6), i) for i, x in vecs)[:5]
        assert [i for _, i in near] == [i for _, i in want] and [d for d, _ in near] == pytest.approx([d for d, _ in want])


def test_every_twentieth_row_is_asked(spark, tmp_path):
    rows = [(k, [float(k % 9), 1.0], k % 10) for k in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("q_knn_twentieth", "q_hybrid_search_twentieth"):
        asked = catalog.queries()[name](spark, str(tmp_path)).select("qid").distinct().collect()
        assert {r["qid"] for r in asked} == set(range(0, 200, 20))


def test_cluster_events(spark):
    rows = [("t", 0, 1, [1.0, 0.0]), ("t", 3600, 2, [0.9, 0.1]), ("t", 7200, 3, [0.0, 1.0]), ("u", 0, 4, [1.0, 0.0]), ("t", 500 * 3600, 5, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "topic string, s long, id long, vec array<double>").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["event_id"] for r in news.cluster_events(df).collect()}
    assert got[1] == got[2] and len({got[1], got[3], got[4], got[5]}) == 4


def test_training_learns(spark):
    rng = random.Random(5)
    rows = [(k, [x := rng.gauss(0, 1), rng.gauss(0, 1)], int(x > 0)) for k in range(200)]
    got = mlp.train_ensemble(spark.createDataFrame(rows, "id int, x array<double>, y int"), [1, 2]).collect()
    assert {r["seed"] for r in got} == {1, 2} and all(r["loss"] < 0.45 for r in got)


def test_training_keeps_the_best_validated_weights(spark):
    rng = random.Random(4)
    noise = [(k, [rng.gauss(0, 1) for _ in range(6)], rng.randint(0, 1)) for k in range(120)]
    for r in mlp.train_ensemble(spark.createDataFrame(noise, "id int, x array<double>, y int"), [1, 2]).collect():
        assert r["n"] + r["n_validation"] == 120 and r["n_validation"] > 0
        assert len(r["weights"]) == 6 * 12 + 12 + 12 * 6 + 6 + 6 + 1
        assert 341 <= r["epochs"] <= 1400 and r["epochs"] % 10 in (0, 1)


def test_training_follows_the_schedule():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(80, 5)), rng.integers(0, 2, 80).astype(float)
    xv, yv = rng.normal(size=(40, 5)), rng.integers(0, 2, 40).astype(float)
    weights, loss, epochs = mlp._train(x, y, xv, yv, 7)
    model = mlp._unpack(np.array(weights), 5, mlp.HIDDEN)
    assert epochs < 1400 and mlp._loss(yv, mlp._forward(model, xv)[-1], min(8.0, (y == 0).sum() / (y > 0).sum())) == pytest.approx(loss)
