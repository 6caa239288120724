"""Substring dedup: hashed units of lines, grouped globally, keeping the earliest occurrence.

A line is the first unit: every later equal line goes, however short.
Passages are also pasted into the middle of lines, where no two lines are
equal, so lines are cut further at content-defined places: after each word
pair whose hash is the smallest of some window of ``WINDOW`` neighbours.  Such cuts depend on the words around them only, so
equal passages are cut alike wherever they stand, and every repeat of
``2 * WINDOW`` words more than ``least_words`` has that many in equal units.

Units are normalised (ASCII case folded, white space dropped), grouped by
their 96-bit digest over all documents, lines with lines and cuts with cuts, and the
earliest by (doc_id, position) is kept.  Later lines are removed, and runs of
later cuts with at least ``least_words`` words; spans that meet are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stresslens.llm import scratch
from stresslens.llm.words import hash_texts, mix, text_bytes

WINDOW = 12
LEAST_WORDS = 26
#: Bits of a unit's kind: a cut, a whole line, or (a line without cuts) both.
CUT, LINE = 1, 2


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each window of ``width``, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[:-step], values[step:])
        done += step
    return values


def cut_after(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of words that end a unit: pair hashes that are the smallest of a window."""
    if len(hashes) < 2 * window:
        return np.empty(0, np.int64)
    pairs = mix(hashes[1:] + mix(hashes[:-1]))
    low = _slide(pairs, window, np.minimum)
    top = np.iinfo(np.uint64).min
    padded = np.concatenate([np.full(window - 1, top, np.uint64), low, np.full(window - 1, top, np.uint64)])
    return np.flatnonzero(_slide(padded, window, np.maximum) == pairs) + 1


def _firsts(ends: np.ndarray) -> np.ndarray:
    """First word of each unit, from the last words of all."""
    return np.concatenate([[0], ends[:-1] + 1])


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, word, start, stop, n_words, digest, second, kind) of each cut and line.

    word is the place of the unit's first word; start and stop are bytes of
    the text; digest and second are a 96-bit digest of the unit; text_hash
    tells apart the texts of rows that repeat a doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(9)]
            data, offsets = text_bytes(batch.column(1))
            ids, texts = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            held = 0
            for row, hashes, starts in hash_texts(batch.column(1)):
                if not len(hashes):
                    continue
                text = data[offsets[row] : offsets[row + 1]]
                breaks = np.flatnonzero(text == 10)
                line_ends = np.searchsorted(starts, breaks) - 1
                line_ends = np.unique(np.append(line_ends[line_ends >= 0], len(hashes) - 1))
                ends = np.unique(np.concatenate([cut_after(hashes), line_ends]))
                firsts, line_firsts = _firsts(ends), _firsts(line_ends)
                whole = np.isin(firsts, line_firsts) & np.isin(ends, line_ends)
                cut_up = ~np.isin(line_firsts, firsts[whole])
                for first, end, kind in ((firsts, ends, np.where(whole, CUT | LINE, CUT)), (line_firsts, line_ends, np.full(len(line_ends), LINE))):
                    counts = end - first + 1
                    place = (np.arange(len(hashes)) - np.repeat(first, counts)).astype(np.uint64)
                    placed = mix(hashes + place * np.uint64(0x9E3779B97F4A7C15))
                    sums = (np.add.reduceat(x, first) for x in (placed, placed * placed))
                    digests = [mix(x + counts.astype(np.uint64)).view(np.int64) for x in sums]
                    digests[1] = digests[1] >> 32
                    stops = np.append(starts[first[1:]], len(text))
                    parts = (np.full(len(end), ids[row], np.int64), np.full(len(end), texts[row], np.int32), first, starts[first], stops, counts, *digests, kind)
                    used = cut_up if end is line_ends else slice(None)
                    for column, part in zip(out, parts, strict=True):
                        column.append(part[used])
                    held += len(parts[0][used])
                    if not cut_up.any():
                        break
                if held > 1 << 17:
                    yield _batch(out)
                    out, held = [[] for _ in range(9)], 0
            if held:
                yield _batch(out)

    def _batch(out: list[list[np.ndarray]]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int8())
        columns = [pa.array(np.concatenate(c)).cast(k) for c, k in zip(out, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "word", "start", "stop", "n_words", "digest", "second", "kind"])

    text = F.col("text").cast("string")
    usable = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), hash_of(text).alias("text_hash")).where("doc_id is not null")
    return usable.mapInArrow(run, "doc_id bigint, text_hash int, word int, start int, stop int, n_words int, digest bigint, second int, kind tinyint")


def hash_of(text: Column) -> Column:
    """32 bits of a text's hash, which together with a doc_id tell texts apart."""
    return F.shiftright(F.xxhash64(text), 32).cast("int")


def repeated_spans(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The spans to remove: doc_id, text_hash, start, stop (bytes of the text), n_words, first_doc_id.

    A span holds whole lines that are repeated, runs of repeated cuts with at
    least ``least_words`` words, or both where they meet.  first_doc_id is the
    document that keeps the span's first unit.  Null and blank texts and rows
    with a null doc_id have no units.  Rows that repeat a doc_id with other
    texts are texts of their own, ranked by text_hash; of rows that repeat a
    doc_id with the same text each is taken for the document, so spans come
    once.  An empty table gives no rows.
    """
    table = units(docs)  # read twice; hashing a text again costs less than keeping its units
    rank, own = F.struct("doc_id", "text_hash", "word"), ["doc_id", "text_hash"]
    is_cut, is_line = (F.col("kind").bitwiseAND(bit) != 0 for bit in (CUT, LINE))
    found = [agg for name, kind in (("cut", is_cut), ("line", is_line)) for agg in (F.min(F.when(kind, rank)).alias(f"min_{name}"), F.count_if(kind).alias(f"{name}s"))]
    firsts = table.groupBy("digest", "second").agg(*found).where("cuts > 1 or lines > 1")
    firsts = scratch.save(firsts.select("digest", "second", "min_cut", "min_line"))
    later = scratch.save(
        table.join(firsts, ["digest", "second"])
        .select(
            *own, "word", "start", "stop", "n_words",
            F.when(is_cut & (rank > F.col("min_cut")), F.col("min_cut.doc_id")).alias("cut_doc"),
            F.when(is_line & (rank > F.col("min_line")), F.col("min_line.doc_id")).alias("line_doc"),
        )
        .where("cut_doc is not null or line_doc is not null").distinct()
    )
    # documents with long runs of repeats hold few rows here, so one task per document suffices
    by_doc = Window.partitionBy(*own).orderBy("word")
    cuts = later.where("cut_doc is not null").withColumn("run", F.col("word") + F.col("n_words") - F.sum("n_words").over(by_doc))
    runs = (
        cuts.groupBy(*own, "run")
        .agg(F.min("word").alias("word"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n_words").alias("n_words"), F.min_by("cut_doc", "word").alias("first_doc_id"))
        .where(F.col("n_words") >= least_words)
        .drop("run")
    )
    lines = later.where("line_doc is not null").select(*own, "word", "start", "stop", F.col("n_words").cast("long").alias("n_words"), F.col("line_doc").alias("first_doc_id"))
    end = F.col("word") + F.col("n_words")
    spans = runs.select(*lines.columns).unionByName(lines).withColumn("end", end)
    by_place = Window.partitionBy(*own).orderBy("word", "end", "first_doc_id").rowsBetween(Window.unboundedPreceding, -1)
    apart = F.when(F.col("word") <= F.max("end").over(by_place), 0).otherwise(1)
    upto = by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        spans.withColumn("apart", apart).withColumn("span", F.sum("apart").over(upto))
        .groupBy(*own, "span")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max("end") - F.min("word")).cast("long").alias("n_words"), F.min(F.struct("word", "first_doc_id"))["first_doc_id"].alias("first_doc_id"))
        .drop("span")
    )


def _kept(text: Column, spans: Column) -> Column:
    """Segments (start, stop) of the text's bytes that lie outside sorted, disjoint spans."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))
    step = lambda acc, s: F.struct(
        s["stop"].alias("at"), F.when(s["start"] > acc["at"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), s["start"].alias("stop"))))).otherwise(acc["out"]).alias("out")
    )
    tail = lambda acc: F.when(acc["at"] < F.octet_length(text), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), F.octet_length(text).alias("stop"))))).otherwise(acc["out"])
    return F.aggregate(spans, zero, step, tail)


def dedup_units(docs: DataFrame, least_words: int = LEAST_WORDS, segments: str = "segments") -> DataFrame:
    """``docs`` without later repeats: its columns with ``text`` cleaned, and ``segments`` (replaced if there is one).

    segments maps the cleaned text to the original: the byte ranges kept, in
    order.  Documents without repeats (and null texts) are unchanged.  Rows
    that repeat a doc_id are each cleaned by their own text's spans.
    """
    spans = repeated_spans(docs, least_words).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    spans = scratch.save(spans.withColumnsRenamed({"doc_id": "span_doc", "text_hash": "span_hash"}))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(spans, (F.col("row.doc_id").cast("bigint") == F.col("span_doc")) & (hash_of(F.col("row.text").cast("string")) == F.col("span_hash")), "left")
    raw = F.col("row.text").cast("binary")
    rows = rows.select("row", _kept(F.col("row.text"), F.coalesce("spans", none)).alias("segments"))
    joined = F.decode(F.aggregate("segments", F.lit(b""), lambda acc, s: F.concat(acc, F.substring(raw, s["start"] + 1, s["stop"] - s["start"]))), "UTF-8")
    text = F.when(F.col("row.text").isNotNull(), joined)
    kept = [(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c.lower() != segments.lower()]
    return rows.select(*kept, F.col("segments").alias(segments))
