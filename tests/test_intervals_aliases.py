"""Interval joins by bins and the alias automaton against plain loops and the older forms."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from stresslens.functions.text import alias_pattern
from stresslens.operators import aliases, enrich, intervals, ordered, scoring


def test_covers_are_exact(spark):
    rng = random.Random(1)
    spans = [(a, a + rng.choice([0, 1, 6, 7, 8, 63, 64, 65, 500, 5000, 70_000])) for a in (rng.randint(-3000, 3000) for _ in range(120))] + [(5, 4), (-8, -1), (0, 8**9 * 3)]
    rows = spark.createDataFrame(spans, "a long, b long").select("a", "b", intervals.cover(F.col("a"), F.col("b")).alias("bins")).collect()
    for r in rows:
        covered = sorted((x["bin"] * 8 ** x["level"], (x["bin"] + 1) * 8 ** x["level"]) for x in r["bins"])
        assert len(covered) <= 14 * intervals.LEVELS
        if r["a"] > r["b"]:
            assert not covered
        else:
            assert covered[0][0] == r["a"] and covered[-1][1] == r["b"] + 1 and all(x[1] == y[0] for x, y in zip(covered, covered[1:], strict=False))


def test_interval_join_against_windows(spark):
    rng = random.Random(2)
    points = spark.createDataFrame([(k, rng.randint(0, 4000)) for k in range(300)] + [(900, None), (901, 17), (901, 17)], "p int, at int")
    spans = [(k, a, a + int(rng.expovariate(1 / 300))) for k, a in enumerate(rng.randint(-50, 3900) for _ in range(400))] + [(500, None, 4), (501, 9, 2), (502, 0, 0)]
    table = spark.createDataFrame(spans, "w int, start int, stop int")
    got = intervals.interval_join(points, table, F.col("at"), F.col("start"), F.col("stop"))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    want = points.join(table, F.col("at").between(F.col("start"), F.col("stop")))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    inside = {(r["p"], r["at"]): r["inside"] for r in intervals.inside_any(points, table.where("w % 40 = 0"), F.col("at"), F.col("start"), F.col("stop")).collect()}
    some = [s for s in spans if s[0] % 40 == 0]
    assert all(v == any(a is not None and b is not None and at is not None and a <= at <= b for _, a, b in some) for (_, at), v in inside.items()) and len(inside) == 302
    assert intervals.interval_join(points, table.limit(0), F.col("at"), F.col("start"), F.col("stop")).count() == 0


def test_a_hundred_thousand_intervals(spark):
    days = spark.range(2000).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    start = F.date_add(F.lit("2000-01-01").cast("date"), F.pmod(F.xxhash64("id"), F.lit(2000)).cast("int"))
    windows = spark.range(100_000).select(F.col("id"), start.alias("start"), F.date_add(start, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(30)).cast("int")).alias("end"))
    got = intervals.interval_join(days, windows, intervals.day_number("d"), intervals.day_number("start"), intervals.day_number("end"))
    want = scoring.in_windows(days, windows)
    sums = [F.count("*"), F.bit_xor(F.xxhash64("d", "id"))]
    assert got.agg(*sums).first() == want.agg(*sums).first()


def test_automaton_equals_patterns(spark):
    rng = random.Random(3)
    words = ["un", "EU", "u.s.", "bank", "bankrupt", "bank run", "rup", "é", "ecb", "aa", "naïve", "日銀", "a b"]
    lexicon = {f"k{k}": rng.sample(words, 3) for k in range(6)} | {"none": [""]}
    texts = [" ".join(rng.choice([*words, "aaa", "funds", "bankbank", "eu-", "x"]) for _ in range(30)) for _ in range(60)] + [None, "", "aaaa", "EU.eu eu2 2eu"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("key", F.lit("clash")).withColumn("pos", F.lit("clash"))
    usable = {k: [a for a in v if a] for k, v in lexicon.items() if any(v)}
    for bounded in (True, False):
        got = Counter(map(tuple, aliases.mentions(rows, "id", "text", lexicon, bounded).collect()))
        assert got == Counter(map(tuple, enrich.mentions(rows, "id", "text", usable, bounded).collect())) and max(got.values()) == 1
    found = {r["id"]: r["entities"] for r in aliases.entities(rows, "id", "text", usable).collect()}
    assert found == {r["id"]: r["e"] for r in rows.select("id", enrich.entities("text", usable).alias("e")).where("size(e) > 0").collect()}


def test_five_thousand_aliases(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
    lexicon = {f"k{k}": [word(), word()] for k in range(2500)}
    texts = [" ".join(word() for _ in range(200)) for _ in range(20)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {(i, key, m.start()) for i, t in enumerate(texts) for key, names in lexicon.items() for a in names for m in re.finditer(alias_pattern(a), t)}
    assert {tuple(r) for r in aliases.mentions(rows, "id", "text", lexicon).collect()} == want


def test_next_rows_across_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "x", None]), rng.randrange(90), k) for k in range(400)]
    got = {r["id"]: r["after"] for r in ordered.next_rows(spark.createDataFrame(rows, "g string, at int, id int"), ["g"], ["at", "id"], {"id": "after"}).collect()}
    for g in ("hot", "x", None):
        mine = sorted((at, k) for h, at, k in rows if h == g)
        assert all(got[a[1]] == b[1] for a, b in zip(mine, mine[1:], strict=False)) and got[mine[-1][1]] is None
