"""Running values over long ordered tables, without one task for a whole order.

Rows are range-partitioned by (group, order) and written once; each range
works on its own, and what passes from range to range is one row for each
range and group.  A hot group or a long series is so spread over ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stresslens.sources.shared import kept


def in_ranges(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``rows`` as a stored table with ``_range``: the range of (by, order) that each lies in, numbered in order."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *by, *order)
    return kept(dealt.select("*", F.spark_partition_id().alias("_range")))


def _same(by: list[str]) -> Column:
    same = F.col("_range") == F.col("_r")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{k}"))
    return same


def _carried(per: DataFrame, by: list[str], value: list[Column]) -> DataFrame:
    """(_r, _b0, ..., values): what each range takes over from the ranges before it."""
    return per.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_b{k}") for k, c in enumerate(by)], *value)


def running_sums(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each of ``sums``, the sum over the rows of the group up to and with the row."""
    ranged = in_ranges(rows.withColumns(sums), by, order)
    per = ranged.groupBy("_range", *by).agg(*[F.sum(n).alias(n) for n in sums])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    taken = _carried(per, by, [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums])
    here = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.select(*rows.columns, "_range", *[F.sum(n).over(here).alias(n) for n in sums])
    return inside.join(taken, _same(by)).select(*rows.columns, *[(F.col(n) + F.col(f"_before_{n}")).alias(n) for n in sums])


def last_so_far(rows: DataFrame, by: list[str], order: list[Column], value: str) -> DataFrame:
    """``rows`` with ``value`` replaced by the last one of the group that isn't null, up to and with the row; ``order`` are plain columns."""
    ranged = in_ranges(rows, by, order)
    here = Window.partitionBy("_range", *by).orderBy(*order)
    inside = ranged.withColumn(value, F.last(value, ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    at_end = inside.select("_range", *by, value, F.row_number().over(Window.partitionBy("_range", *by).orderBy(*[o.desc() for o in order])).alias("_n")).where("_n = 1")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    taken = _carried(at_end, by, [F.last(value, ignorenulls=True).over(before).alias("_taken")])
    return inside.join(taken, _same(by)).select(*[F.coalesce(value, "_taken").alias(value) if c == value else F.col(c) for c in rows.columns])


def placed(rows: DataFrame, by: list[str], order: list[Column], place: str) -> DataFrame:
    """``rows`` with their place (1, 2, ...) in the order of their group."""
    return running_sums(rows, by, order, {place: F.lit(1).cast("long")})


def next_rows(rows: DataFrame, by: list[str], order: list[str], taken: dict[str, str]) -> DataFrame:
    """``rows`` with values of the next row of their group (column to new name), null for the last; order and values are plain columns."""
    ranged = in_ranges(rows, by, [F.col(c) for c in order])
    value = F.struct(*[F.col(c).alias(n) for c, n in taken.items()])
    here = Window.partitionBy("_range", *by).orderBy(*order)
    inside = ranged.withColumn("_next", F.lead(value).over(here))
    starts = ranged.groupBy("_range", *by).agg(F.min_by(value, F.struct(*order)).alias("_first"))
    after = Window.partitionBy(*by).orderBy("_range")
    joined = inside.join(_carried(starts, by, [F.lead("_first").over(after).alias("_after")]), _same(by))
    return joined.select(*rows.columns, *[F.coalesce(F.col("_next"), F.col("_after"))[n].alias(n) for n in taken.values()])
