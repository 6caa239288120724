"""Streams and stored tables against the batch operators and naive Python."""

import random
from collections import Counter
from datetime import date, datetime, timedelta

import numpy as np
import pytest

from stresslens.operators import news
from stresslens.streaming import clusters
from stresslens.streaming.merge import DailyTable, merge_stream


def articles(spark, n=240, topics=3):
    rng, gen = random.Random(4), np.random.default_rng(4)
    centres, at, rows = gen.normal(size=(5, 6)), datetime(2024, 1, 1), []
    for k in range(n):
        at += timedelta(hours=rng.choice([0, 1, 5, 30, 110]))
        vec = centres[rng.randrange(5)] + gen.normal(size=6) * 0.35
        rows.append((f"t{rng.randrange(topics)}", at, f"a{k:04d}", (vec / np.linalg.norm(vec)).tolist()))
    return spark.createDataFrame(rows, "topic string, ts timestamp, id string, vec array<double>"), rows


def test_stream_of_articles_equals_batch_over_restarts(spark, tmp_path):
    table, rows = articles(spark)
    want = Counter(tuple(r) for r in news.cluster_events(table).collect())
    cut = [0, 40, 41, 150, len(rows)]
    for k, (start, stop) in enumerate(zip(cut, cut[1:], strict=False)):
        # a run for each file: all but the first go on from the checkpoint
        spark.createDataFrame(rows[start:stop], table.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        clusters.run_clusters(spark, f"{tmp_path}/in", table.schema, f"{tmp_path}/out", f"{tmp_path}/check")
        assert spark.read.parquet(f"{tmp_path}/out").count() == stop, k
    clusters.run_clusters(spark, f"{tmp_path}/in", table.schema, f"{tmp_path}/out", f"{tmp_path}/check")
    assert Counter(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == want
    state = spark.read.format("statestore").option("path", f"{tmp_path}/check").option("stateVarName", "open").load()
    held = state.select("user_map_value.*").collect()
    newest = max(r[1] for r in rows).timestamp() / 3600
    assert held and len(held) < len({r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()})
    assert min(r["last"] for r in held) > newest - 2 * news.BEHIND_H - 120  # closed clusters are gone


def merged(old, batch, keep):
    """What a table of (key, day, a, b) is after a batch of (key, day, a, c)."""
    out = {k: dict(v) for k, v in old.items()}
    for row in batch:
        out.setdefault(row["key"], {"b": None}).update(row)
    newest = max(v["day"] for v in out.values())
    return {k: v for k, v in out.items() if v["day"] >= newest - timedelta(days=keep)}


@pytest.mark.parametrize("days_a_part", [1, 7])
def test_batches_merge_into_touched_parts_only(spark, tmp_path, days_a_part):
    rng, first = random.Random(days_a_part), date(2024, 1, 1)
    table = DailyTable(spark, f"file://{tmp_path}/table", "key", "day", 30, days_a_part)
    day = lambda k: first + timedelta(days=k)
    base = [{"key": f"k{k}", "day": day(rng.randrange(30)), "a": k, "b": f"b{k}"} for k in range(60)]
    assert table.merge(spark.createDataFrame(base, "key string, day date, a int, b string"), 0)
    want = merged({}, base, 30)

    def check():
        got = {r["key"]: {c: v for c, v in r.asDict().items()} for r in table.read(spark).collect()}
        assert {k: {c: v.get(c) for c in ("key", "day", "a", "b", "c")} for k, v in want.items()} == {k: {c: v.get(c) for c in ("key", "day", "a", "b", "c")} for k, v in got.items()}

    check()
    for number in range(1, 5):
        batch = [{"key": f"k{rng.randrange(70)}", "day": day(rng.randrange(3) + 8 * number), "a": -number, "c": number} for _ in range(6)]
        batch = list({r["key"]: r for r in batch}.values())
        before = table.log.latest()[1]["parts"]
        frame = spark.createDataFrame(batch, "key string, day date, a int, c int")
        touched = {(r["day"] - date(1970, 1, 1)).days // days_a_part for r in batch} | {(want[r["key"]]["day"] - date(1970, 1, 1)).days // days_a_part for r in batch if r["key"] in want}
        assert table.merge(frame, number)
        want = merged(want, batch, 30)
        check()
        after = table.log.latest()[1]["parts"]
        assert all(after[p] == before[p] for p in after.keys() & before.keys() if int(p) not in touched)
        version = table.log.latest()
        assert not table.merge(frame, number) and not table.merge(frame, 0) and table.log.latest() == version
    table.vacuum()
    check()
    empty = spark.createDataFrame([], "key string, day date, a int, c int")
    assert table.merge(empty, 9) and not table.merge(empty, 9)
    check()


def test_a_stream_merges_and_late_rows_come_in(spark, tmp_path):
    schema, first = "key string, day date, v int", date(2024, 5, 1)
    table = DailyTable(spark, f"file://{tmp_path}/table", "key", "day", 365, 7)
    rows = [[("a", first, 1), ("b", first, 2)], [("a", first + timedelta(days=300), 3), ("c", first + timedelta(days=299), 4)], [("d", first + timedelta(days=2), 5), ("e", first - timedelta(days=90), 6), (None, first, 7), ("f", None, 8)]]
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        merge_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), table, f"{tmp_path}/check")
    got = {(r["key"], r["v"]) for r in table.read(spark).collect()}
    assert got == {("a", 3), ("b", 2), ("c", 4), ("d", 5)}
    version = table.log.latest()[0]
    # a checkpoint that was lost: the stream begins anew, and its batches are known
    merge_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), table, f"{tmp_path}/other")
    assert table.log.latest()[0] == version and {(r["key"], r["v"]) for r in table.read(spark).collect()} == got
