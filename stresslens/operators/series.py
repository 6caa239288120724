"""Rolling statistics over ordered series, in long form (key, date, value).

No frame reaches past the current row, so no result depends on later
observations.  Look-backs are computed in pieces of a series with a margin
of the rows before, so a long series is the work of many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stresslens.functions.scalars import anchor, clamp, tail_score, z_risk
from stresslens.operators.ordered import last_so_far, placed

#: Observations that a rolling sample needs.
LEAST = 10


@dataclass(frozen=True)
class Profile:
    """Steps of the short and medium change, and the rolling look-back (rows)."""

    short: int
    medium: int
    lookback: int


#: Profiles by frequency.
DAILY, WEEKLY, MONTHLY = Profile(5, 20, 1260), Profile(4, 13, 260), Profile(1, 3, 60)


def clean_series(raw: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """(key, d, v) without rows whose value isn't a number."""
    v = F.expr(f"try_cast(`{value}` as double)")
    return raw.select(F.col(key).alias("key"), F.col(date).cast("date").alias("d"), v.alias("v")).where(F.col("v").isNotNull())


def daily_mean(raw: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """(key, d, v): the mean of each day."""
    return raw.groupBy(F.col(key).alias("key"), F.to_date(ts).alias("d")).agg(F.avg(value).alias("v"))


def latest(series: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The last value of each key by ``order``."""
    return series.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def by_date(key: str = "key", date: str = "d") -> Window:
    return Window.partitionBy(key).orderBy(date)


#: Rows of a series that one task takes at once, at least.
PIECE = 8192


#: Numbers of a block of windows that are sorted at once.
_BLOCK = 1 << 19


def _windows(v: np.ndarray, first: int, lookback: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of positions from ``first``: (position, the values there, the windows of up to lookback - 1 values strictly before each)."""
    width = max(1, lookback - 1)
    padded = np.concatenate([np.full(width, np.nan), v])
    every = np.lib.stride_tricks.sliding_window_view(padded, width)
    step = max(1, _BLOCK // width)
    for start in range(first, len(v), step):
        stop = min(len(v), start + step)
        yield start, v[start:stop], every[start:stop]


def _nullable(values: np.ndarray, known: np.ndarray) -> list:
    return [x if k else None for x, k in zip(values.tolist(), known.tolist(), strict=True)]


def _statistics(v: np.ndarray, first: int, lookback: int) -> dict[str, list]:
    """n, pct, med, mad, sd and z of each value from position ``first`` against the look-back strictly before it.

    Whole blocks of windows are sorted together; missing values sort last.
    """
    out = {n: [] for n in ("n", "pct", "med", "mad", "sd", "z")}
    for _, x, windows in _windows(v, first, lookback):
        ordered, row = np.sort(windows, axis=1), np.arange(len(x))
        n = (ordered == ordered).sum(axis=1)
        some = n > 0
        middle = lambda a: (a[row, np.maximum(n - 1, 0) // 2] + a[row, np.minimum(n // 2, a.shape[1] - 1)]) / 2.0  # noqa: E731, B023
        med = middle(ordered)
        mad = middle(np.sort(np.abs(ordered - med[:, None]), axis=1))
        count = np.maximum(n, 1)
        mean = np.nansum(ordered, axis=1) / count
        sd = np.sqrt(np.nansum((ordered - mean[:, None]) ** 2, axis=1) / count)
        judged = (n >= LEAST) & (x == x)
        pct = 100.0 * (ordered <= x[:, None]).sum(axis=1) / count
        with np.errstate(divide="ignore", invalid="ignore"):
            z = np.where(mad > 0, (x - med) / (1.4826 * mad), np.where(sd > 0, (x - med) / sd, 0.0))
        out["n"] += n.tolist()
        for name, values, known in (("pct", pct, judged), ("med", med, some), ("mad", mad, some), ("sd", sd, some), ("z", z, judged)):
            out[name] += _nullable(values, known)
    return out


def _delta_shares(v: np.ndarray, place: np.ndarray, first: int, lookback: int, steps: int) -> list[float | None]:
    """Percentile of the change over ``steps`` rows among the changes of the look-back before it."""
    change = np.full(len(v), np.nan)
    change[steps:] = v[steps:] - v[:-steps]
    out = []
    for start, x, windows in _windows(change, first, lookback):
        n = (windows == windows).sum(axis=1)
        share = 100.0 * (windows <= x[:, None]).sum(axis=1) / np.maximum(n, 1)
        out += _nullable(share, (np.asarray(place[start : start + len(x)]) > steps + 5) & (x == x) & (n > 0))
    return out


def _by_pieces(series: DataFrame, profile: Profile, deltas: dict[str, int], whole: bool) -> DataFrame:
    """``series`` with rolling statistics (if ``whole``) and percentiles of changes, computed in pieces of each series.

    Rows get their place in the series; a piece of consecutive places also
    gets the rows before it that its look-back reaches, so a long series is
    the work of many tasks.
    """
    margin = profile.lookback + max([0, *deltas.values()])
    size = max(PIECE, margin)
    rows = placed(series, ["key"], [F.col("d").asc()], "_place")
    piece = F.floor((F.col("_place") - 1) / size)
    near_end = F.col("_place") > (piece + 1) * size - margin
    pieces = F.when(near_end, F.array(piece, piece + 1)).otherwise(F.array(piece))
    dealt = rows.withColumn("_own", piece).withColumn("_piece", F.explode(pieces))

    added = [f"{n} {'int' if n == 'n' else 'double'}" for n in ("n", "pct", "med", "mad", "sd", "z")] if whole else []
    added += [f"`{n}` double" for n in deltas]
    names = [f.name for f in series.schema.fields]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_place")
        v, place = frame["v"].to_numpy(float), frame["_place"].to_numpy()
        first = int((frame["_own"] < frame["_piece"]).sum())
        out = frame.iloc[first:][names].reset_index(drop=True)
        columns = _statistics(v, first, profile.lookback) if whole else {}
        columns |= {n: _delta_shares(v, place, first, profile.lookback, k) for n, k in deltas.items()}
        for n, values in columns.items():
            out[n] = pd.array(values, "Int32") if n == "n" else pd.Series(values, dtype=float)
        return out

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in series.schema.fields), *added])
    found = dealt.groupBy("key", "_piece").applyInPandas(run, kinds)
    return found.select(*names, *[F.nanvl(c, F.lit(None).cast("double")).alias(c) if c != "n" else F.col(c) for c in found.columns if c not in names])


def rolling(series: DataFrame, profile: Profile) -> DataFrame:
    """``series(key, d, v)`` with n, pct, med, mad, sd and robust z of v against its own past.

    The past is the look-back strictly before the row, missing values left
    out.  z is (v - med) / (1.4826 mad); a zero mad falls back on the
    population deviation, a zero deviation gives 0, and short samples give
    null.
    """
    return _by_pieces(series, profile, {}, True)


def delta_percentile(series: DataFrame, steps: int, profile: Profile, out: str) -> DataFrame:
    """Percentile of the change over ``steps`` rows among the changes of the look-back; needs more than steps + 5 rows."""
    return _by_pieces(series, profile, {out: steps}, False)


def dynamic_metric(series: DataFrame, profile: Profile, thresholds: tuple[float, float, float]) -> DataFrame:
    """``series`` with level, deviation, velocity and score: 0.45, 0.30 and 0.25 of the three, null for short samples."""
    out = _by_pieces(series, profile, {"pct_short": profile.short, "pct_medium": profile.medium}, True)
    none = lambda c: F.coalesce(c, F.lit(0.0))
    out = out.withColumns({
        "level": anchor("v", *thresholds),
        "deviation": F.greatest(none(tail_score("pct")), none(z_risk("z"))),
        "velocity": F.greatest(none(tail_score("pct_short", 70.0)), none(tail_score("pct_medium", 70.0))),
    })
    score = clamp(0.45 * F.col("level") + 0.30 * F.col("deviation") + 0.25 * F.col("velocity"))
    return out.withColumn("score", F.when(F.col("n") >= LEAST, score))


def realized_vol(series: DataFrame, window: int = 20) -> DataFrame:
    """(key, d, vol): deviation of the last one-step changes in basis points, annualised; from row ``window`` + 1."""
    change = series.withColumns({"step": (F.col("v") - F.lag("v").over(by_date())) * 100.0, "row": F.row_number().over(by_date()), "rows": F.count("*").over(Window.partitionBy("key"))})
    vol = F.stddev_samp("step").over(by_date().rowsBetween(-(window - 1), 0)) * F.sqrt(F.lit(252.0))
    return change.withColumn("vol", vol).where((F.col("row") > window) & (F.col("rows") >= window + 2)).select("key", "d", "vol")


def spread(one: DataFrame, two: DataFrame, scale: float = 100.0) -> DataFrame:
    """(d, spread) of two (d, v) series on their common dates."""
    return one.select("d", F.col("v").alias("a")).join(two.select("d", F.col("v").alias("b")), "d").select("d", ((F.col("a") - F.col("b")) * scale).alias("spread"))


def yield_curve(long: Column, short: Column) -> Column:
    """Difference of two yields in basis points."""
    return (long - short) * 100.0


def asof_backward(probes: DataFrame, series: DataFrame, keys: DataFrame, value: list[str]) -> DataFrame:
    """For each probe date ``probes(d)`` and key of ``keys(key)`` the last row of ``series`` up to that date.

    The row is carried as a struct, so a row whose value is null is still the
    last one and no older value takes its place.  One union in ranges of
    (key, date); keys without a row so far give nulls.
    """
    seen = series.select("key", "d", F.struct(*value).alias("row"), F.lit(0).alias("probe"))
    asked = keys.crossJoin(probes.select("d")).select("key", "d", F.lit(None).cast(seen.schema["row"].dataType).alias("row"), F.lit(1).alias("probe"))
    both = last_so_far(seen.unionByName(asked), ["key"], [F.col("d"), F.col("probe")], "row")
    return both.where("probe = 1").select("key", "d", *[F.col(f"row.{c}").alias(c) for c in value])
