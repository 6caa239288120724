"""WARC archives with revisit records for payloads that are there already.

Only headers (id, digest, size) are shuffled by payload digest to find each
payload's original; revisit records refer to it and hold no payload.  The
archives are written by Spark's own text writer, one record a row, so task
retries and lost executors leave no half-written files, and any file system
that Spark knows will do.  They are read as a stream of pieces between blank
lines, which a parser puts together by the lengths that records state, so a
task holds one record, not a file.  Record ids and dates are set anew.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stresslens.llm import scratch

#: Payloads shorter than this (bytes) are always written out.
SHORTEST = 100
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = "\r\n"
_BLANK = b"\r\n\r\n"


def headers(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest) of each page; a null html is an empty payload."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        F.sha2(body.cast("binary"), 256).alias("payload_digest"),
    )


def resolve_revisits(heads: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(page_id, payload_digest, refers_to): payloads of pages that revisit one, and the page whose response holds it.

    ``heads`` is a stored table.  Minima are taken before the shuffle, and
    the join is between two stored tables, so a digest of any number of pages
    is split across tasks.  Rows come once.
    """
    long_ones = heads.where((F.col("payload_bytes") >= shortest) & F.col("page_id").isNotNull())
    originals = scratch.save(
        long_ones.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "refers_to")
    )
    return long_ones.join(originals, "payload_digest").where("page_id <> refers_to").select("page_id", "payload_digest", "refers_to").distinct()


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:stresslens:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def _header_value(value: Column) -> Column:
    """A value that can't end its line."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\x00-\x20\x7f]", "%20")


def _records(pages: DataFrame, date: str) -> Column:
    """The text of each page's record; the writer adds the two line ends that close it."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "),
        F.octet_length(body).cast("string"), F.lit(_CRLF * 2),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, body))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(_CRLF))
    return F.concat(
        F.lit("WARC/1.1" + _CRLF),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _header_value(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _record_id(F.col("refers_to"))), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_CRLF),
        block,
    )


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", shortest: int = SHORTEST) -> None:
    """Write a record for each row of ``pages(page_id, url, html)`` to gzipped WARC files under ``path``.

    A null url is an empty header, a null html an empty payload.  Rows with a
    null page_id are responses.  Rows that repeat a page_id are decided each
    by its own payload; equal rows alike.  An empty table writes no records.
    Bodies meet their decision in one join by (page_id, digest), and are
    written from there: each task writes one file.
    """
    revisits = scratch.save(resolve_revisits(scratch.save(headers(pages)), shortest))
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.sha2(body.cast("binary"), 256).alias("payload_digest"))
    decided = rows.join(revisits, ["page_id", "payload_digest"], "left")
    decided.select(_records(pages, date).alias("value")).write.option("lineSep", _CRLF * 2).option("compression", "gzip").text(path)


class RecordParser:
    """Puts the pieces between blank lines together to records (headers, block).

    Lengths, not blank lines, end a block, so what looks like a record inside
    a payload stays there.
    """

    def __init__(self):
        self.head: dict[str, str] | None = None
        self.parts: list[bytes] = []
        self.held = self.length = 0

    def feed(self, piece: bytes) -> list[tuple[dict[str, str], bytes]]:
        """The records that this piece (and the blank line after it) completes."""
        self.parts += [piece, _BLANK]
        self.held += len(piece) + len(_BLANK)
        done = []
        while self.held >= self.length:
            data = b"".join(self.parts)
            if self.head is not None:
                done.append((self.head, data[: self.length]))
                data, self.head, self.length = data[self.length :], None, 0
            data = data.lstrip(b"\r\n")
            if data and not data.startswith(b"WARC/"):
                raise ValueError("no record starts where the last one ended")
            if data:
                head, _, data = data.partition(_BLANK)
                self.head = dict(line.split(": ", 1) for line in head.decode().split(_CRLF)[1:])
                self.length = int(self.head["Content-Length"])
            self.parts, self.held = [data], len(data)
            if self.head is None:
                break
        return done

    def close(self) -> None:
        if self.head is not None:
            raise ValueError("the last record is cut off")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records under ``path``: page_id, url, record_type, refers_to, payload_digest, payload (null for revisits).

    A gzipped file isn't split: its pieces come in order, and files one after the other.
    """
    page = re.compile(r"<urn:stresslens:page:(-?\d+)>")

    def number(value: str | None) -> int | None:
        found = page.fullmatch(value or "")
        return int(found[1]) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload"]

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        parser, rows, size = RecordParser(), [], 0
        for batch in batches:
            for piece in batch.column(0):
                for head, block in parser.feed(piece.as_py()):
                    payload = block[block.index(_BLANK) + len(_BLANK) :] if head["WARC-Type"] == "response" else None
                    rows.append((number(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"], number(head.get("WARC-Refers-To")), head["WARC-Payload-Digest"].partition(":")[2], payload))
                    size += len(block)
                if size > 1 << 22:
                    yield batch_of(rows)
                    rows, size = [], 0
        parser.close()
        if rows:
            yield batch_of(rows)

    pieces = spark.read.option("lineSep", _CRLF * 2).option("pathGlobFilter", "*.gz").text(path).select(F.col("value").cast("binary"))
    return pieces.mapInArrow(run, "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload binary")


def describe_archives(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest are those of the full payload: counted on a response's
    own payload, and taken for a revisit from the response of that digest
    that it refers to.
    """
    own = scratch.save(
        records.select(
            "page_id", "record_type", "refers_to", F.col("payload_digest").alias("stated"), F.octet_length("payload").cast("long").alias("payload_bytes"),
            F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)).alias("payload_digest"),
        )
    )
    revisits = own.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "stated")
    responses = own.where("record_type = 'response'")
    wanted = scratch.save(revisits.select("refers_to", "stated").distinct())
    originals = responses.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated"), "payload_bytes", "payload_digest")
    originals = scratch.save(originals.join(wanted, ["refers_to", "stated"], "left_semi").distinct())
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(*columns).unionByName(revisits.join(originals, ["refers_to", "stated"], "left").select(*columns))
