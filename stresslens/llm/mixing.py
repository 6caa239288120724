"""Mixing sources to target weights by hash thresholds, without sorting documents.

Each document has a 60-bit hash of its id.  A source that must give a part
of its words takes the documents below a threshold.  The threshold is found
digit by digit: sizes are summed by source and hash digit, the digit in
which the running sum crosses the budget is the boundary bucket, and only
its documents are written for the next histogram.  So a narrow table of
(source, hash, size) is read twice, a 4096th of it for the third digit, and
so on; one document at the boundary at most is left.  Where rows repeat an id
(or have none), the boundary may be a hash that many of them share; they are
then told apart by a second hash, of their texts, in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stresslens.llm import scratch
from stresslens.llm.quality import words_of

#: Bits of a hash digit, and of the whole hash.
DIGIT, BITS = 12, 60
#: A document is used this often at most.
EPOCHS = 3


def hash_of(key: Column) -> Column:
    """A 60-bit hash that any SQL engine can compute: the first 15 hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=(1, 2, 3)) -> DataFrame:
    """Targets of ``sizes(source, source_size)``, with (whole, rest): full uses and the words beyond.

    Sources in code point order, null last, get the weights in turn.  They
    share all words; a source stops at three times its size and what it
    can't take goes to the others by weight.  Ordered by size over weight,
    the sources that stop come first, so one running sum finds the level.
    The input is aggregated: one row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)))
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * EPOCHS
    ranked = ranked.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.sum("weight").over(every).alias("weights"),
        F.coalesce(F.sum(cap).over(before), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"),
    )
    stops = cap * (F.col("weights") - F.col("weight_before")) <= F.col("weight") * (F.col("total") - F.col("cap_before"))
    ranked = ranked.withColumn("stops", stops)
    ranked = ranked.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("stops"), cap)).over(every), F.lit(0)).alias("stopped"),
        F.coalesce(F.sum(F.when(F.col("stops"), F.col("weight"))).over(every), F.lit(0.0)).alias("stopped_weight"),
    )
    share = F.col("weight") * (F.col("total") - F.col("stopped")) / (F.col("weights") - F.col("stopped_weight"))
    target = F.when(F.col("stops"), cap.cast("double")).otherwise(share)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(F.lit(0))
    return (
        ranked.withColumn("target", target)
        .withColumn("whole", whole)
        .select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))
    )


def tie_hash(text: Column) -> Column:
    """A 60-bit hash that tells apart rows with the same id."""
    return F.shiftrightunsigned(F.xxhash64(text), 64 - BITS)


def boundaries(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source the hash at which its budget is reached: (source, at, left_over, bucket, rows).

    ``sized(source, hash, size)``.  Nested histograms: each level sums the
    boundary bucket of the level above, written anew, by the next digit of the
    hash.  At the last level the bucket is a single hash value, held by so
    many rows of so many words; left_over is what they may still give.
    """
    rows = sized
    state = scratch.save(targets.select("source", F.col("rest").cast("double").alias("rest"), F.lit(0).cast("long").alias("low")).where("rest > 0"))
    for shift in range(BITS - DIGIT, -1, -DIGIT):
        joined = rows.withColumnRenamed("source", "s").join(state, F.col("s").eqNullSafe(F.col("source")))
        if shift < BITS - DIGIT:
            boundary = joined.where(F.shiftright("hash", shift + DIGIT) == F.shiftright("low", shift + DIGIT))
            joined = scratch.save(boundary.select("source", "rest", "low", "hash", "size"))
            rows = joined.select("source", "hash", "size")
        digits = joined.groupBy("source", "rest", "low", F.shiftright("hash", shift).alias("digit")).agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
        ordered = Window.partitionBy("source").orderBy("digit")
        running = digits.select("*", (F.sum("size").over(ordered) - F.col("size")).alias("under"))
        crossed = running.where((F.col("under") <= F.col("rest")) & (F.col("rest") < F.col("under") + F.col("size")))
        step = crossed.select("source", F.shiftleft("digit", shift).alias("at"), (F.col("rest") - F.col("under")).alias("left_over"), F.col("size").alias("bucket"), "rows")
        if shift:
            state = scratch.save(step.select("source", F.col("left_over").alias("rest"), F.col("at").alias("low")))
        else:
            return scratch.save(step)


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, at, tie_at): rows with a hash below ``at``, or with it and a tie below ``tie_at``, are used once more.

    ``sized(source, hash, tie, size)``.  The last value of all is in if that
    brings the sum nearer to the budget.
    """
    after = lambda at: at + F.when(F.col("bucket") - F.col("left_over") < F.col("left_over"), 1).otherwise(0)
    found = boundaries(sized.select("source", "hash", "size"), targets)
    whole = found.where("rows = 1").select("source", after(F.col("at")).alias("at"), F.lit(0).cast("long").alias("tie_at"))
    tied = found.where("rows > 1")
    if tied.isEmpty():
        return whole
    same = F.col("s").eqNullSafe(F.col("source")) & (F.col("hash") == F.col("at"))
    inside = scratch.save(sized.withColumnRenamed("source", "s").join(tied.select("source", "at"), same).select("source", F.col("tie").alias("hash"), "size"))
    ends = boundaries(inside, tied.select("source", F.col("left_over").alias("rest"))).select(F.col("source").alias("s"), after(F.col("at")).alias("tie_at"))
    parted = tied.join(ends, F.col("s").eqNullSafe(F.col("source")), "left").select("source", "at", F.coalesce("tie_at", F.lit(0)).alias("tie_at"))
    return whole.unionByName(parted)


def mix(docs: DataFrame, weights=(1, 2, 3)) -> DataFrame:
    """Per row of ``docs``: its columns in ``row``, size, source_size, target and uses (0 to 3).

    ``docs`` has doc_id, text and source, each may be null: a null text has
    no words, null is a source of its own (the last).  Rows that repeat a
    doc_id (or have none) share its hash and are told apart by their texts;
    rows that repeat both are used alike.  A source without words has target
    0.  An empty table gives no rows.  Reruns agree.
    """
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("source").cast("string").alias("source"),
        hash_of(F.col("doc_id")).alias("hash"),
        tie_hash(F.col("text").cast("string")).alias("tie"),
        F.size(words_of(F.col("text").cast("string"))).cast("long").alias("size"),
    )
    narrow = scratch.save(sized.select("source", "hash", "tie", "size"))
    targets = scratch.save(source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights))
    cuts = scratch.save(targets.join(thresholds(narrow, targets).withColumnRenamed("source", "s"), F.col("s").eqNullSafe(F.col("source")), "left").drop("s"))
    plan = cuts.withColumnRenamed("source", "s")
    below = (F.col("hash") < F.col("at")) | ((F.col("hash") == F.col("at")) & (F.col("tie") < F.col("tie_at")))
    extra = F.when((F.col("rest") > 0) & below, 1).otherwise(0)
    return sized.join(plan, F.col("s").eqNullSafe(F.col("source")), "left").select(
        "row", "size", "source_size", "target", (F.col("whole") + extra).cast("int").alias("uses")
    )


def mixed(docs: DataFrame, weights=(1, 2, 3)) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is used, with its columns."""
    return mix(docs, weights).where("uses > 0").select("row", F.explode(F.sequence(F.lit(1), "uses"))).select("row.*")
