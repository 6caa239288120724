"""Scans of many sources in one job, as Python data sources: one partition a source, retries, failures as rows.

Two formats, registered by :func:`register`: ``stress_series`` (two-column
CSV of dates and values) and ``stress_feeds`` (RSS and Atom).  Both read, in
the tasks, ``http:``, ``https:`` and ``file:`` addresses and those that
Arrow's file systems open (``hdfs:``, ``s3:``, ``gs:``); a source
that can't be read, or from which nothing comes, gives one row with its error
and never fails the job.  Both can be read as a stream: an offset counts how
often the list was gone through, and a micro-batch reads every source once.
"""

from __future__ import annotations

import calendar
import csv
import email.utils
import html
import io
import json
import re
import time
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Seconds of the first pause and of a timeout, attempts, entries of a feed, characters of a summary.
PAUSE, TIMEOUT, ATTEMPTS, ENTRIES, SUMMARY = 0.6, 20.0, 3, 100, 1200


class SourcePartition(InputPartition):
    """One source: its name, its address, and on a stream the round."""

    def __init__(self, name: str, url: str, turn: int = 0):
        self.name, self.url, self.turn = name, url, turn


def _opened(url: str, timeout: float):
    if url.partition(":")[0] in ("http", "https", "file"):
        return urllib.request.urlopen(url, timeout=timeout)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(url)
    return system.open_input_stream(path)


def fetch(url: str, attempts: int = ATTEMPTS, pause: float = PAUSE, opened: Callable = _opened, sleep: Callable = time.sleep) -> bytes:
    """The bytes of an address; after a failure the next attempt waits ``pause`` longer than the one before."""
    for attempt in range(1, attempts + 1):
        try:
            with opened(url, timeout=TIMEOUT) as answer:
                return answer.read()
        except Exception:
            if attempt == attempts:
                raise
            sleep(pause * attempt)
    raise ValueError("no attempt was asked for")


def series_rows(body: bytes) -> list[tuple[date, float]]:
    """(date, value) of a CSV text with a header; rows without a date or a number are dropped."""
    out = []
    for row in list(csv.reader(io.StringIO(body.decode("utf-8"))))[1:]:
        try:
            out.append((date.fromisoformat(row[0].strip()), float(row[1])))
        except (IndexError, ValueError):
            continue
    if not out:
        raise ValueError("no observations")
    return out


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def _plain(text: str | None) -> str:
    """A text without tags, entities replaced, white space collapsed."""
    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", text or "")).split())


def _when(text: str | None) -> datetime | None:
    """The time of a date as RSS (RFC 822) or Atom (ISO 8601) writes it; None if it is neither."""
    try:
        parsed = email.utils.parsedate_tz(text or "")
        if parsed:
            return datetime.fromtimestamp(calendar.timegm(parsed[:6] + (0, 0, 0)) - (parsed[9] or 0), timezone.utc)
        stamp = datetime.fromisoformat((text or "").strip())
        return stamp if stamp.tzinfo else stamp.replace(tzinfo=timezone.utc)
    except (ValueError, OverflowError):
        return None


def feed_rows(body: bytes) -> list[tuple[str, str, str, datetime | None]]:
    """(title, summary, link, published) of the first entries of an RSS or Atom document; those without a title are dropped."""
    entries = [e for e in ET.fromstring(body).iter() if _local(e.tag) in ("item", "entry")]
    out = []
    for entry in entries[:ENTRIES]:
        parts: dict[str, ET.Element] = {}
        for child in entry:
            parts.setdefault(_local(child.tag), child)
        text = lambda *names: next((parts[n].text for n in names if n in parts and parts[n].text), None)  # noqa: E731, B023
        title = _plain(text("title"))
        if title:
            link = text("link") or (parts["link"].get("href", "") if "link" in parts else "")
            out.append((title, _plain(text("summary", "description", "content"))[:SUMMARY], link.strip(), _when(text("pubdate", "published", "updated", "date"))))
    if not entries:
        raise ValueError("no entries")
    return out


class _Settings:
    """What readers need: the list of (name, address) and how to try."""

    parse: Callable
    width: int

    def __init__(self, options: dict):
        listed = json.loads(options["sources"])
        self.sources = sorted(listed.items()) if isinstance(listed, dict) else [tuple(pair) for pair in listed]
        self.attempts, self.pause = int(options.get("attempts", ATTEMPTS)), float(options.get("pause", PAUSE))
        self.parse, self.width = PARSERS[options["kind"]]

    def rows(self, part: SourcePartition) -> Iterator[tuple]:
        """The rows of a source, or the row of its error."""
        try:
            for row in self.parse(fetch(part.url, self.attempts, self.pause)):
                yield part.name, *row, None
        except Exception as error:  # whatever goes wrong with a source is a row of the result
            yield (part.name, *[None] * self.width, f"{type(error).__name__}: {error}"[:500])


PARSERS = {"series": (series_rows, 2), "feeds": (feed_rows, 4)}


class _Reader(DataSourceReader):
    def __init__(self, settings: _Settings):
        self.settings = settings

    def partitions(self):
        return [SourcePartition(*source) for source in self.settings.sources] or [SourcePartition("", "")]

    def read(self, partition):
        return self.settings.rows(partition) if partition.name or partition.url else iter(())


class _StreamReader(DataSourceStreamReader):
    """Every micro-batch is one more round of all sources, as long as ``rounds`` aren't through."""

    def __init__(self, settings: _Settings, rounds: int):
        self.settings, self.rounds, self.at = settings, rounds, 0

    def initialOffset(self):
        return {"round": 0}

    def latestOffset(self):
        self.at = min(self.rounds, self.at + 1)
        return {"round": self.at}

    def partitions(self, start, end):
        self.at = max(self.at, end["round"])
        return [SourcePartition(*source, turn) for turn in range(start["round"], end["round"]) for source in self.settings.sources]

    def read(self, partition):
        return self.settings.rows(partition)

    def commit(self, end):
        pass


class _Source(DataSource):
    kind: str

    def _settings(self) -> _Settings:
        return _Settings(dict(self.options) | {"kind": self.kind})

    def reader(self, schema):
        return _Reader(self._settings())

    def streamReader(self, schema):
        return _StreamReader(self._settings(), int(self.options.get("rounds", 1)))


class SeriesSource(_Source):
    kind = "series"

    @classmethod
    def name(cls):
        return "stress_series"

    def schema(self):
        return "key string, d date, v double, error string"


class FeedSource(_Source):
    kind = "feeds"

    @classmethod
    def name(cls):
        return "stress_feeds"

    def schema(self):
        return "source string, title string, summary string, url string, published timestamp, error string"


def register(spark: SparkSession) -> None:
    """Make both formats known to the session."""
    for source in (SeriesSource, FeedSource):
        spark.dataSource.register(source)


def scan(spark: SparkSession, kind: str, sources: dict[str, str], **options) -> DataFrame:
    """All sources (name to address) of a kind, ``series`` or ``feeds``: their rows, and a row with ``error`` for each that failed."""
    register(spark)
    reader = spark.read.format(f"stress_{kind}").option("sources", json.dumps(sources))
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()


def scan_stream(spark: SparkSession, kind: str, sources: dict[str, str], rounds: int = 1, **options) -> DataFrame:
    """The same as a stream that goes through all sources ``rounds`` times, once in each micro-batch."""
    register(spark)
    reader = spark.readStream.format(f"stress_{kind}").option("sources", json.dumps(sources)).option("rounds", str(rounds))
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()
