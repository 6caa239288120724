"""I-Match document fingerprints from built-in functions only.

The lexicon holds the terms whose document frequency lies in a band of
inverse document frequency.  Of terms in at least a share ``low`` of N
documents there are at most (mean distinct terms of a document) / ``low``,
whatever N is, so the lexicon is one array value of bounded size.  A
document's terms inside the lexicon, sorted and distinct, are hashed once for
each randomised lexicon: in each of ``FAMILIES`` families the lexicon is
halved ``LEVELS`` times by the bits of the terms' hashes, and every half
gives one hash.  One more hash, of all distinct terms, tells apart texts
without any term of the lexicon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stresslens.llm import scratch
from stresslens.llm.quality import let, words_of

#: Share of documents that hold a term of the lexicon: at least, at most.
LOW, HIGH = 0.01, 0.2
FAMILIES, LEVELS = 6, 10


def terms_of(text: Column) -> Column:
    """Distinct 64-bit hashes of the lower-cased words of a text."""
    return F.transform(F.array_distinct(words_of(F.lower(text))), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row: the sorted hashes of the terms in at least ``low`` and at most ``high`` of the documents, and in two."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counts = docs.select(F.explode(terms_of(text)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    total = docs.agg(F.count("*").alias("docs")).scalar()
    band = counts.where((F.col("n") >= low * total) & (F.col("n") <= high * total) & (F.col("n") > 1))
    return band.agg(F.array_sort(F.collect_list("term")).alias("terms"))


def fingerprint(terms: Column, inside: Column) -> Column:
    """The hash of all distinct terms, and ``FAMILIES`` * ``LEVELS`` + 1 of those inside the lexicon.

    ``inside`` is sorted, as the lexicon is.  Null where a lexicon has none of the terms.
    """

    def digest(values: Column) -> Column:
        return F.when(F.size(values) > 0, F.xxhash64(values))

    def family(k: int) -> Column:
        def halve(acc: Column, level: Column) -> Column:
            bit = lambda t: F.getbit(t, level + k * LEVELS) == 0
            return let(F.filter(acc["terms"], bit), lambda half: F.struct(half.alias("terms"), F.concat(acc["out"], F.array(digest(half))).alias("out")))

        start = F.struct(inside.alias("terms"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, halve, lambda acc: acc["out"])

    return F.concat(F.array(digest(F.array_sort(terms)), digest(inside)), *[family(k) for k in range(FAMILIES)])


def as_text(hashes: Column) -> Column:
    """A fingerprint as a string: hexadecimal hashes joined by commas, empty where there is none."""
    return F.array_join(F.transform(hashes, lambda h: F.coalesce(F.lower(F.hex(h)), F.lit(""))), ",")


def likeness(one: Column, two: Column) -> Column:
    """Share of equal hashes among the lexicons of which either document has terms; 1 if neither has any."""
    same = F.aggregate(F.zip_with(one, two, lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    either = F.aggregate(F.zip_with(one, two, lambda a, b: F.when(a.isNull() & b.isNull(), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    return F.when(either == 0, F.lit(1.0)).otherwise(same / either)


def fingerprints(docs: DataFrame, lexicon_table: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs``: its columns in ``row`` and ``hashes``, its fingerprint.

    The lexicon is built from the ``text`` column of ``docs`` unless given (a
    table of :func:`lexicon`).  Null counts as empty; texts without words
    have all-null hashes; equal texts have equal fingerprints; an empty table
    gives no rows.
    """
    terms = (scratch.save(lexicon(docs)) if lexicon_table is None else lexicon_table).scalar()
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), terms_of(body).alias("terms"))
    rows = rows.select("row", "terms", F.array_intersect(terms, F.col("terms")).alias("inside"))
    return rows.select("row", fingerprint(F.col("terms"), F.col("inside")).alias("hashes"))


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) for each distinct doc_id of ``ids``: the next smaller one, the largest for the smallest.

    A null is one more id, below all others.  Ids are dealt to ranges and
    sorted there; only the ends of the ranges, one row for each, meet in one
    task.
    """
    spark = ids.sparkSession
    down = F.col("doc_id").desc_nulls_last()
    dealt = ids.select("doc_id").distinct().repartitionByRange(spark.sparkContext.defaultParallelism * 4, down)
    ranges = scratch.save(dealt.select("doc_id", F.spark_partition_id().alias("part")))
    top = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")
    ends = ranges.groupBy("part").agg(F.max(top).alias("top"))
    follow = Window.orderBy(F.desc("top"))
    ends = scratch.save(ends.select("part", F.coalesce(F.lead("top").over(follow), F.first("top").over(follow)).alias("next_top")))
    inside = F.lead(top).over(Window.partitionBy("part").orderBy(down))
    return ranges.select("doc_id", "part", inside.alias("inside")).join(ends, "part").select("doc_id", F.coalesce("inside", "next_top")["doc_id"].alias("next_id"))
