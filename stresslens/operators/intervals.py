"""Joins of points and intervals by bins of several sizes, without a nested loop.

An interval of whole numbers (days, seconds) is cut into the fewest aligned
bins of 1, 8, 64, ... numbers that cover it exactly: at most 14 bins of each
size, however long it is.  A point lies in one bin of each size that occurs.
So the join is one of equal keys, each pair is found once, and no condition
is left to be checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stresslens.sources.shared import kept

#: Bits by which bins grow, and the sizes that there are: the largest bin has 8 ** 9 numbers.
BITS, LEVELS = 3, 10


def day_number(date: Column | str) -> Column:
    """Days since 1970 of a date."""
    return F.datediff(F.to_date(date), F.lit("1970-01-01").cast("date")).cast("long")


def cover(first: Column, last: Column) -> Column:
    """The bins (level, bin) that cover ``first`` to ``last``, both included; none if ``last`` is smaller or either is null."""
    up = lambda x, level: -F.shiftright(-x, BITS * level)
    down = lambda x, level: F.shiftright(x, BITS * level)
    end = last + 1
    parts = []
    for level in range(LEVELS):
        low, high = up(first, level), down(end, level)
        span = lambda a, b, level=level: F.when(a < b, F.transform(F.sequence(a, b - 1), _as_bin(level))).otherwise(F.array())
        if level == LEVELS - 1:
            parts.append(span(low, high))
            continue
        low_up, high_up = up(first, level + 1), down(end, level + 1)
        whole = low_up < high_up
        ends = F.concat(span(low, F.shiftleft(low_up, BITS)), span(F.shiftleft(high_up, BITS), high))
        parts.append(F.when(whole, ends).otherwise(span(low, high)))
    return F.when(first <= last, F.concat(*parts)).otherwise(F.array())


def _as_bin(level: int):
    return lambda x: F.struct(F.lit(level).alias("level"), x.alias("bin"))


def interval_join(points: DataFrame, intervals: DataFrame, at: Column, first: Column, last: Column) -> DataFrame:
    """Every row of ``points`` beside every row of ``intervals`` whose ``first`` to ``last`` holds its ``at``; all three are whole numbers.

    Column names of the two tables must differ; rows with a null number or an
    empty interval match nothing, equal rows match each.  A point is copied
    once for each size of bin in use, an interval once for each of its bins.
    """
    binned = kept(intervals.select(F.struct(*[F.col(f"`{c}`") for c in intervals.columns]).alias("interval"), F.explode(cover(first.cast("long"), last.cast("long"))).alias("b")).select("interval", "b.level", "b.bin"))
    levels = sorted(r[0] for r in binned.select("level").distinct().collect())  # LEVELS numbers at most
    if not levels:
        return points.join(intervals, F.lit(False))
    place = at.cast("long")
    mine = F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright(place, BITS * level).alias("bin")) for level in levels])
    dealt = points.select(F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("point"), place.alias("place"), F.explode(mine).alias("b")).where("place is not null").select("point", "b.level", "b.bin")
    return dealt.join(binned, ["level", "bin"]).select("point.*", "interval.*")


def inside_any(points: DataFrame, intervals: DataFrame, at: Column, first: Column, last: Column) -> DataFrame:
    """``points`` with ``inside``: whether an interval holds their number; each distinct number is looked up once."""
    ends = intervals.select(first.cast("long").alias("_first"), last.cast("long").alias("_last")).distinct()
    found = interval_join(points.select(at.cast("long").alias("_at")).distinct(), ends, F.col("_at"), F.col("_first"), F.col("_last")).select("_at").distinct()
    return points.join(found, at.cast("long") == F.col("_at"), "left").select(*[F.col(f"`{c}`") for c in points.columns], F.col("_at").isNotNull().alias("inside"))
