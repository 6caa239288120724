"""What filters cost together: removals of every coalition, steps of every order, exact Shapley values.

A document fails a set of the five filters, a five-bit mask.  Counts by
(part, mask) are all that orders can depend on: what a coalition of filters
removes is the number of documents whose mask meets it.  For each part the
removals of all 32 coalitions are tabulated; a step of an order is the
difference of two of them.  Shapley values solve the least-squares problem
with the Shapley kernel as weights under the constraint that they add up to
what all filters remove; its normal equations are solved in rationals, so
120 times a value is a whole number and equals the sum over all orders.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stresslens.llm import scratch
from stresslens.llm.quality import let, words_of

FILTERS = "ABCDE"
COALITIONS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Counts tabulated for each coalition.
MEASURES = ("n", "good", "toxic")
_DUPLICATE = 1 << FILTERS.index("E")


def fail_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; null counts as empty."""
    body = F.coalesce(text.cast("string"), F.lit(""))

    def bits(words: Column) -> Column:
        n, distinct = F.size(words), F.size(F.array_distinct(words))
        few = F.when(n < 200, 1).otherwise(0)
        repeated = F.when(100 * distinct < 50 * n, 2).otherwise(0)
        return few + repeated

    capitals = F.length(body) - F.length(F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    shouting = F.when(100 * capitals > 2 * F.length(body), 4).otherwise(0)
    marked = F.when(body.rlike(r"[#$%&*|]"), 8).otherwise(0)
    return (let(words_of(body), bits) + shouting + marked).cast("int")


def masked_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail.

    A document fails E if a smaller doc_id has its text.  Copies are counted
    by (text digest, doc_id) before anything is shuffled further, the
    smallest doc_id of a digest is a minimum that is aggregated in place, and
    it meets the rows by digest *and* doc_id, so a group of copies of any
    size spreads.  Rows without a doc_id have no smaller one and no label.
    A doc_id that labels repeat counts as good or toxic if any row says so.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)).alias("digest"), fail_mask(F.col("text")).alias("mask"),
    )
    cells = scratch.save(rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")))
    known = cells.where("doc_id is not null")
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    judged = known.join(firsts, ["digest", "doc_id"], "left").select("doc_id", "part", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + _DUPLICATE).alias("mask"), "n")
    judged = judged.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    said = lambda c: F.max(F.when(F.col(c).cast("int") == 1, 1).otherwise(0)).alias(c)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(said("quality"), said("toxic")).where("quality = 1 or toxic = 1")
    marked = judged.join(marks, "doc_id", "left")
    share = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias("good" if c == "quality" else c)
    counts = marked.groupBy("part", "mask").agg(F.sum("n").alias("n"), share("quality"), share("toxic"))
    nameless = cells.where("doc_id is null").groupBy("part", "mask").agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return counts.unionByName(nameless).groupBy("part", "mask").agg(*[F.sum(m).alias(m) for m in MEASURES])


def coalition_table(counts: DataFrame) -> DataFrame:
    """Per part: its totals, and for each measure an array of what each of the 32 coalitions removes."""
    removed = lambda m, s: F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(m))), F.lit(0))
    tables = [F.array(*[removed(m, s) for s in range(COALITIONS)]).alias(m) for m in MEASURES]
    return counts.groupBy("part").agg(F.sum("n").alias("total"), *tables)


def solve(matrix: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """The solution of a regular linear system, in rationals."""
    rows = [[*line, value] for line, value in zip(matrix, right, strict=True)]
    size = len(rows)
    for k in range(size):
        pivot = next(r for r in range(k, size) if rows[r][k] != 0)
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [v / rows[k][k] for v in rows[k]]
        for r in range(size):
            if r != k and rows[r][k] != 0:
                rows[r] = [v - rows[r][k] * p for v, p in zip(rows[r], rows[k], strict=True)]
    return [line[-1] for line in rows]


def shapley_values(removed: list[int], players: int = len(FILTERS)) -> list[Fraction]:
    """Shapley values of the game ``removed`` (value of each coalition, by bit mask).

    Least squares of v(S) against the sum of the values in S over all proper
    coalitions, with weights (p - 1) / (C(p, s) s (p - s)), under the
    constraint that all values add up to v(all); the multiplier is the last
    unknown of the normal equations.
    """
    full = (1 << players) - 1
    matrix = [[Fraction(0)] * (players + 1) for _ in range(players + 1)]
    right = [Fraction(0)] * (players + 1)
    for s in range(1, full):
        size = s.bit_count()
        weight = Fraction(players - 1, comb(players, size) * size * (players - size))
        members = [i for i in range(players) if s >> i & 1]
        for i in members:
            right[i] += weight * removed[s]
            for j in members:
                matrix[i][j] += weight
    for i in range(players):
        matrix[i][players] = matrix[players][i] = Fraction(1)
    right[players] = Fraction(removed[full])
    return solve(matrix, right)[:players]


def _steps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    full = COALITIONS - 1
    for frame in frames:
        for row in frame.itertuples(index=False):
            n, good, toxic = (list(map(int, getattr(row, m))) for m in MEASURES)
            over_orders = [int(v * len(ORDERS)) for v in shapley_values(n)]
            out = []
            for order in ORDERS:
                before = 0
                for step, letter in enumerate(order, 1):
                    k = FILTERS.index(letter)
                    after = before | 1 << k
                    gone = n[after] - n[before]
                    out.append((
                        row.part, order, step, row.total - n[after], gone, n[1 << k] - gone, n[full] - n[full ^ 1 << k],
                        good[after] - good[before], toxic[after] - toxic[before], over_orders[k],
                    ))
                    before = after
            yield pd.DataFrame(out, columns=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step of that order.

    ``docs`` has doc_id, text and source (null text: empty; null source: the
    part ''), ``labels`` doc_id, quality and toxic; other columns are not
    read, whatever their names.  Rows are counted one by one: equal rows
    count each, rows with one doc_id and one text are no copies of each
    other, and rows with a null doc_id neither fail E nor carry a label.  An
    empty ``docs`` has no parts and gives no rows.  What leaves the executors'
    partial sums is at most parts x 32 rows.
    """
    parts = coalition_table(masked_counts(docs, labels))
    kinds = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return parts.mapInPandas(_steps, kinds)
