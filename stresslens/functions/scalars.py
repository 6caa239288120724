"""Scalar scoring functions as Column expressions.  Missing stays missing: null in, null out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clamp(x: Column | str, low: float = 0.0, high: float = 100.0) -> Column:
    """x limited to [low, high]; null stays null (greatest and least alone would skip it)."""
    x = _col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def level_word(score: Column | str) -> Column:
    """NORMAL below 25, WATCH below 45, ELEVATED below 65, HIGH below 80, else CRITICAL; null is NO DATA."""
    s = _col(score)
    return (
        F.when(s.isNull(), "NO DATA").when(s < 25, "NORMAL").when(s < 45, "WATCH").when(s < 65, "ELEVATED").when(s < 80, "HIGH").otherwise("CRITICAL")
    )


def tail_score(percentile: Column | str, start: float = 65.0) -> Column:
    """0 up to ``start``, then linear to 100."""
    p = _col(percentile)
    return F.when(p <= start, F.lit(0.0)).otherwise(clamp((p - start) / (100.0 - start) * 100.0))


def z_risk(z: Column | str) -> Column:
    """0 up to z = 0.5, 100 from z = 3, linear between."""
    z = _col(z)
    return F.when(z <= 0.5, F.lit(0.0)).when(z >= 3.0, F.lit(100.0)).when(z.isNotNull(), (z - 0.5) / 2.5 * 100.0)


def anchor(x: Column | str, t1: float, t2: float, t3: float) -> Column:
    """Piecewise linear: 0 up to t1, a third of 100 at t2, two thirds at t3, 100 one more span above."""
    x = _col(x)
    third = 100.0 / 3.0
    span = max(t3 - t2, 1e-9)
    return (
        F.when(x <= t1, F.lit(0.0))
        .when(x <= t2, (x - t1) / max(t2 - t1, 1e-9) * third)
        .when(x <= t3, third + (x - t2) / span * third)
        .otherwise(clamp(2 * third + (x - t3) / span * third))
    )


def recency_decay(age_days: Column | str, half_life: float = 21.0) -> Column:
    """Exponential decay of an age in days; ages below 0 count as 0, a missing age gives 0."""
    age = _col(age_days)
    return F.when(age.isNull(), F.lit(0.0)).otherwise(F.exp(-F.log(F.lit(2.0)) * F.greatest(age.cast("double"), F.lit(0.0)) / half_life))


#: Confidence factors, and freshness by age in days (older than: factor).
CONFIDENCE = {"high": 1.0, "medium": 0.85, "low": 0.70}
FRESHNESS = ((180, 0.15), (90, 0.40), (60, 0.65), (30, 0.85))


#: Fixed value: freshness of a finding whose date can't be read.
UNREADABLE = 0.70


def evidence_decay(raw: Column | str, confidence: Column | str, age_days: Column | str, stated: Column | None = None) -> Column:
    """Score of a graded finding (0 to 3) after its confidence and its age; a missing age counts as fresh.

    ``stated`` is the date as it was written, if it is known: where there is
    one but no age could be read from it, the finding counts as 0.70 fresh.
    """
    age = _col(age_days)
    fresh = F.lit(1.0) if stated is None else F.when(age.isNull() & stated.isNotNull() & (stated != ""), UNREADABLE).otherwise(F.lit(1.0))
    for days, factor in reversed(FRESHNESS):
        fresh = F.when(age > days, F.lit(factor)).otherwise(fresh)
    grade = F.lit(CONFIDENCE["low"])
    for word in ("medium", "high"):
        grade = F.when(_col(confidence) == word, F.lit(CONFIDENCE[word])).otherwise(grade)
    return clamp(_col(raw) / 3.0 * 100.0) * grade * fresh


def momentum(recent: Column | str, before: Column | str) -> Column:
    """50 plus half the relative change of counts, clamped; without earlier ones 100 if there are recent ones, else 0."""
    r, b = _col(recent), _col(before)
    return F.when(b > 0, clamp(50.0 + 50.0 * (r / b - 1.0))).when(r > 0, F.lit(100.0)).otherwise(F.lit(0.0))


def transmission_stage(credit: Column | str, funding: Column | str, banking: Column | str, structural: Column | str, breadth: Column | str) -> Column:
    """Stage 0 to 4; the first rule that holds wins, missing inputs count as 0."""
    c, f, b, s, w = (F.coalesce(_col(x), F.lit(0.0)) for x in (credit, funding, banking, structural, breadth))
    return (
        F.when((c >= 75) & (f >= 70) & (b >= 60) & (w >= 65), 4)
        .when((c >= 55) & (f >= 50) & ((b >= 45) | (w >= 50)), 3)
        .when((c >= 40) & ((s >= 45) | (b >= 40) | (w >= 35)), 2)
        .when((s >= 35) | (b >= 35), 1)
        .otherwise(0)
    )


def sync_bonus(available: Column | str, stressed: Column | str, severe: Column | str) -> Column:
    """Extra points when many channels are stressed at once; needs six channels."""
    a, t, v = _col(available), _col(stressed), _col(severe)
    return F.when(a < 6, F.lit(0.0)).when(v >= 6, F.lit(8.0)).when(t >= 6, F.lit(5.0)).when(t >= 4, F.lit(2.5)).otherwise(F.lit(0.0))


def sigmoid(x: Column | str) -> Column:
    """Logistic function of x limited to ±35."""
    return 1.0 / (1.0 + F.exp(-clamp(x, -35.0, 35.0)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Dot product of two arrays, accumulated in double; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance of two arrays."""
    square = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(F.zip_with(_col(a), _col(b), square), F.lit(0.0), lambda s, x: s + x))


def format_value(x: Column | str, suffix: str = "", digits: int = 2) -> Column:
    """A value as text with its unit; N/A if it is missing."""
    return F.coalesce(F.concat(F.format_string(f"%.{digits}f", _col(x).cast("double")), F.lit(suffix)), F.lit("N/A"))


def py_round(digits: int):
    """Half-even rounding of the binary value, as the language of the workers rounds; an Arrow function.

    Built-in rounding works on the decimal notation and differs on ties that
    binary fractions can't hold; use this only where a published figure must
    be met to the last digit.
    """

    @F.pandas_udf("double")
    def rounded(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else round(v, digits))

    return rounded
