"""Scans of sources that can fail, and what each of them gives."""

from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from stresslens.sources import remote

RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>feed</title>
<item><title>Bank &amp;amp; bond - Paper</title><description>&lt;p&gt;Some &lt;b&gt;text&lt;/b&gt;&lt;/p&gt;</description><link> http://a/1 </link><pubDate>Tue, 02 Jan 2024 10:00:00 +0200</pubDate></item>
<item><title> </title><link>http://a/2</link></item>
<item><title>No date</title><pubDate>yesterday</pubDate></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Entry</title><link href="http://b/1"/><summary>S</summary><updated>2024-03-01T00:30:00Z</updated></entry></feed>"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "good.csv").write_text("DATE,V\n2024-01-02,1.5\n2024-01-03,.\n2024-01-04,\nx,2\n2024-01-05,2.5\n2024-01-06\n")
    (tmp_path / "empty.csv").write_text("DATE,V\n")
    (tmp_path / "broken.csv").write_bytes(b"DATE,V\n\xff\xfe\x00,1\n")
    (tmp_path / "rss.xml").write_text(RSS)
    (tmp_path / "atom.xml").write_text(ATOM)
    (tmp_path / "cut.xml").write_text(RSS[:200])
    (tmp_path / "none.xml").write_text("<rss><channel/></rss>")
    (tmp_path / "many.xml").write_text("<rss>" + "".join(f"<item><title>t{k}</title></item>" for k in range(130)) + "</rss>")
    return lambda *names: {n: f"file://{tmp_path}/{n}" for n in names}


def test_series_that_fail_are_rows(spark, folder):
    got = remote.scan(spark, "series", folder("good.csv", "empty.csv", "broken.csv", "missing.csv"), pause=0.01).collect()
    rows = [(r["key"], r["d"], r["v"]) for r in got if r["error"] is None]
    assert sorted(rows) == [("good.csv", date(2024, 1, 2), 1.5), ("good.csv", date(2024, 1, 5), 2.5)]
    errors = {r["key"]: r["error"].split(":")[0] for r in got if r["error"]}
    assert errors == {"empty.csv": "ValueError", "broken.csv": "UnicodeDecodeError", "missing.csv": "URLError"} and len(got) == 5
    assert remote.scan(spark, "series", {}).count() == 0
    assert remote.scan(spark, "series", folder("good.csv", "empty.csv")).rdd.getNumPartitions() == 2


def test_feeds_that_fail_are_rows(spark, folder):
    got = remote.scan(spark, "feeds", folder("rss.xml", "atom.xml", "cut.xml", "none.xml", "many.xml"), attempts=1)
    per = {r["source"]: (r["n"], r["errors"]) for r in got.groupBy("source").agg(F.count("title").alias("n"), F.count("error").alias("errors")).collect()}
    assert per == {"rss.xml": (2, 0), "atom.xml": (1, 0), "cut.xml": (0, 1), "none.xml": (0, 1), "many.xml": (100, 0)}
    rows = {r["title"]: r for r in got.withColumn("at", F.unix_timestamp("published")).where("source in ('rss.xml', 'atom.xml')").collect()}
    bank = rows["Bank & bond - Paper"]
    assert (bank["summary"], bank["url"], bank["at"]) == ("Some text", "http://a/1", datetime(2024, 1, 2, 8, tzinfo=timezone.utc).timestamp())
    assert rows["No date"]["at"] is None and rows["Entry"]["url"] == "http://b/1"


def test_attempts_wait_longer_each_time():
    waits, calls = [], []

    class Answer:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

        def read(self):
            return b"ok"

    def opened(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("not yet")
        return Answer()

    assert remote.fetch("u", opened=opened, sleep=waits.append) == b"ok" and waits == [0.6, 1.2]
    calls.clear()
    with pytest.raises(OSError):
        remote.fetch("u", attempts=2, opened=opened, sleep=waits.append)


def test_a_stream_reads_every_source_in_each_round(spark, folder, tmp_path):
    for rounds, total in ((1, 3), (1, 3), (3, 9)):  # the second run finds nothing new, the third goes on from the checkpoint
        stream = remote.scan_stream(spark, "series", folder("good.csv", "missing.csv"), rounds=rounds, attempts=1)
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").start()
        query.processAllAvailable()
        query.stop()
        assert spark.read.parquet(f"{tmp_path}/out").count() == total
