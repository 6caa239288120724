"""Fusion of channel scores, backtests over labelled windows, and evaluation of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stresslens.functions.scalars import clamp, level_word, sync_bonus
from stresslens.operators.ordered import running_sums
from stresslens.sources.shared import kept


def weighted_fusion(scores: DataFrame, weights: DataFrame, by: str = "d") -> DataFrame:
    """Per ``by``: the mean of the channel scores by weight over channels that have one, and the weight covered.

    ``scores(by, key, score)``, ``weights(key, weight)``.  Missing channels
    are left out, never counted as zero.
    """
    joined = scores.join(weights, "key")
    covered = F.sum(F.when(F.col("score").isNotNull(), F.col("weight")))
    return joined.groupBy(by).agg((F.sum(F.col("score") * F.col("weight")) / covered).alias("raw_score"), F.coalesce(covered, F.lit(0.0)).alias("coverage"))


def breadth(scores: DataFrame, by: str = "d", stressed: float = 45.0, severe: float = 65.0) -> DataFrame:
    """Per ``by``: channels available, stressed and severe, the stressed share (percent) and the bonus."""
    counts = scores.groupBy(by).agg(
        F.count("score").alias("available"), F.count_if(F.col("score") >= stressed).alias("stressed"), F.count_if(F.col("score") >= severe).alias("severe")
    )
    share = F.when(F.col("available") > 0, 100.0 * F.col("stressed") / F.col("available"))
    return counts.withColumns({"breadth": share, "bonus": sync_bonus("available", "stressed", "severe")})


def fused_score(scores: DataFrame, weights: DataFrame, by: str = "d") -> DataFrame:
    """Fusion and breadth together: raw_score, coverage, counts, bonus, score and level."""
    both = weighted_fusion(scores, weights, by).join(breadth(scores.join(weights.select("key"), "key"), by), by)
    both = both.withColumn("score", clamp(F.col("raw_score") + F.col("bonus")))
    return both.withColumn("level", level_word("score"))


def pillars(scores: DataFrame, membership: DataFrame, by: str = "d") -> DataFrame:
    """Mean score of each pillar's channels; ``membership(key, pillar)``, a channel may be in several."""
    return scores.join(membership, "key").groupBy(by, "pillar").agg(F.avg("score").alias("mean_score"))


def in_windows(rows: DataFrame, windows: DataFrame, date: str = "d", lead_days: int = 0) -> DataFrame:
    """Rows joined to every window (id, start, end) that holds their date, opened ``lead_days`` early.

    Windows are a table of some dozens of intervals; each row meets them in
    one pass.
    """
    inside = (F.col(date) >= F.date_sub("start", lead_days)) & (F.col(date) <= F.col("end"))
    return rows.join(windows, inside)


def label_rows(rows: DataFrame, windows: DataFrame, date: str = "d", lead_days: int = 60) -> DataFrame:
    """``rows`` with label 1 for dates inside any window, opened early, else 0."""
    days = in_windows(rows.select(date).distinct(), windows, date, lead_days).select(date).distinct().withColumn("label", F.lit(1))
    return rows.join(days, date, "left").fillna({"label": 0})


def calendar(anchor_dates: DataFrame, daily_dates: DataFrame, windows: DataFrame, start: str, lead_days: int = 120) -> DataFrame:
    """Dates (d) to evaluate: the anchor's from ``start``, and daily ones near each window."""
    near = daily_dates.join(windows, (F.col("d") >= F.least("start", F.date_sub("reference", lead_days))) & (F.col("d") <= F.col("end")))
    return anchor_dates.where(F.col("d") >= F.lit(start).cast("date")).select("d").union(near.select("d")).distinct()


def event_summary(rows: DataFrame, windows: DataFrame, thresholds: dict[str, float], stages: tuple[int, ...] = ()) -> DataFrame:
    """Per window: observations, peak score and its first date, and for each threshold the first date and lead days.

    With ``stages``, ``rows`` also have a stage: its maximum, and for each of
    them the first date at or above it.  Windows without observations are left
    out.
    """
    joined = in_windows(rows, windows)
    first = {name: F.min(F.when(F.col("score") >= t, F.col("d"))).alias(f"first_{name}") for name, t in thresholds.items()}
    staged = [F.max("stage").alias("max_stage"), *[F.min(F.when(F.col("stage") >= k, F.col("d"))).alias(f"first_stage_{k}") for k in stages]] if stages else []
    out = joined.groupBy("id", "reference").agg(
        F.count("*").alias("observations"), F.max("score").alias("max_score"),
        F.min_by("d", F.struct((-F.col("score")).alias("s"), F.col("d"))).alias("max_score_date"), *first.values(), *staged,
    )
    return out.withColumns({f"lead_{name}": F.datediff("reference", f"first_{name}") for name in (*thresholds, *(f"stage_{k}" for k in stages))})


def alert_rates(rows: DataFrame, windows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Share (percent) of rows at or above each threshold, inside and outside of all windows."""
    inside = label_rows(rows, windows, lead_days=0)
    long = inside.select("label", "score", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return long.groupBy("threshold", F.when(F.col("label") == 1, "inside").otherwise("outside").alias("segment")).agg(
        F.count("*").alias("n"), (100.0 * F.count_if(F.col("score") >= F.col("threshold")) / F.count("*")).alias("rate")
    )


def quantiles(rows: DataFrame, value: str, points: list[float]) -> DataFrame:
    """One row: exact, linearly interpolated quantiles p<percent>; null without values.

    Values are counted, the counts added up in ranges of their order, and each
    point looks for the two values beside it: no task holds all of them.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count("*").alias("n"))
    upto = kept(running_sums(counts.withColumn("all", F.lit(0)), ["all"], [F.col("x")], {"upto": F.col("n")}))
    total = upto.agg(F.coalesce(F.max("upto"), F.lit(0)).alias("n")).scalar()

    def at(place: Column) -> Column:
        """Aggregate: the value that stands at a place (from 0) of the order."""
        return F.min(F.when(F.col("upto") > place, F.col("x")))

    out = []
    for p in points:
        place = (F.col("total") - 1) * F.lit(float(p))
        low = at(F.floor(place))
        out.append((low + (at(F.ceil(place)) - low) * F.max(place - F.floor(place))).alias(f"p{round(100 * p)}"))
    return upto.select("x", "upto", total.alias("total")).agg(*out)


def _counts(rows: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Positives and negatives by distinct score: what rank measures need, aggregated before any ordering."""
    return rows.groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))


def roc_auc(rows: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Chance that a positive outranks a negative, ties one half; null without both.  ``by``: groups, e.g. candidates."""
    by = by or []
    counts = running_sums(_counts(rows, score, label, by), by, [F.col("s")], {"upto": F.col("neg")})
    wins, pairs = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2.0)), F.sum("pos") * F.sum("neg")
    return counts.groupBy(*by).agg(F.when(pairs > 0, wins / pairs).alias("auc"))


def average_precision(rows: DataFrame, score: str, label: str, tie: str, by: list[str] | None = None) -> DataFrame:
    """Mean precision at each positive in descending order of score, ties by ``tie``."""
    by = by or []
    ranked = running_sums(rows.select(*by, score, label, tie), by, [F.desc(score), F.col(tie)], {"hits": F.col(label).cast("long"), "rank": F.lit(1).cast("long")})
    return ranked.groupBy(*by).agg((F.sum(F.when(F.col(label) == 1, F.col("hits") / F.col("rank"))) / F.count_if(F.col(label) == 1)).alias("ap"))


def confusion(rows: DataFrame, score: Column, label: str, by: list[str]) -> DataFrame:
    """tp, fp, tn, fn by group for ``score`` (a boolean alarm) with recall, fpr, precision and balanced accuracy."""
    y = F.col(label) == 1
    t = rows.groupBy(*by).agg(
        F.count_if(score & y).alias("tp"), F.count_if(score & ~y).alias("fp"), F.count_if(~score & ~y).alias("tn"), F.count_if(~score & y).alias("fn")
    )
    rate = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    t = t.withColumns({"recall": rate("tp", "fn"), "fpr": rate("fp", "tn"), "precision": rate("tp", "fp")})
    return t.withColumn("balanced", (F.coalesce("recall", F.lit(0.0)) + 1 - F.coalesce("fpr", F.lit(0.0))) / 2)


def threshold_sweep(rows: DataFrame, score: str, label: str, low: float, high: float, steps: int, by: list[str] | None = None, digits: int | None = 4) -> DataFrame:
    """The threshold of an even grid with the best balanced accuracy (to ``digits`` places, if given), then the lowest false positive rate, then the smallest.

    A score counts once, at the last threshold that it reaches, so what is
    summed over the grid is one count for each of its steps.
    """
    by = by or []
    values = [float(x) for x in rows.sparkSession.range(steps).select(F.round(low + F.col("id") * ((high - low) / (steps - 1)), 6)).toPandas().iloc[:, 0]]  # the grid, a parameter
    grid = F.array(*map(F.lit, values))
    # the rounded step of a score and its neighbours hold the last threshold that it reaches
    near = F.floor((F.col(score) - low) / ((high - low) / (steps - 1))).cast("int")
    reached = lambda k: F.coalesce(F.col(score) >= F.get(grid, k), F.lit(False))
    step = F.when(reached(near + 1), near + 1).when(reached(near), near).otherwise(near - 1)
    step = F.when(F.col(score) >= values[-1], steps - 1).when(F.col(score) < values[0], -1).otherwise(step)
    cells = rows.groupBy(*by, F.coalesce(step, F.lit(-1)).alias("step")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    whole = Window.partitionBy(*by)
    groups = cells.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    every = groups.select(*by, "p", "n", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    same = F.col("step") == F.col("_step")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    found = every.join(cells.select(F.col("step").alias("_step"), *[F.col(c).alias(f"_{c}") for c in by], "pos", "neg"), same, "left")
    above = whole.orderBy("step").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = found.select(
        *by, F.get(grid, F.col("step")).alias("threshold"), "p", "n",
        F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg").over(above), F.lit(0)).alias("fp"),
    )
    t = t.withColumns({"recall": F.col("tp") / F.col("p"), "fpr": F.col("fp") / F.col("n")})
    balanced = (F.col("recall") + 1 - F.col("fpr")) / 2
    t = t.withColumn("balanced", balanced if digits is None else F.round(balanced, digits))
    best = F.max_by(F.struct("threshold", "balanced", "recall", "fpr"), F.struct("balanced", -F.round("fpr", 9), -F.col("threshold")))
    return t.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def candidate_weights(weights: DataFrame, step: float = 1.0, low: float = 4.0, high: float = 18.0) -> DataFrame:
    """All transfers of ``step`` from one channel to another that stay inside the limits.

    (candidate, key, weight), the full set of weights of each candidate.  The
    weights are a table of a dozen channels.
    """
    donor = weights.select(F.col("key").alias("donor"), F.col("weight").alias("dw")).where(F.col("dw") - step >= low)
    taker = weights.select(F.col("key").alias("taker"), F.col("weight").alias("tw")).where(F.col("tw") + step <= high)
    moves = donor.join(taker, F.col("donor") != F.col("taker")).select("donor", "taker", F.concat_ws(">", "donor", "taker").alias("candidate"))
    change = F.when(F.col("key") == F.col("donor"), -step).when(F.col("key") == F.col("taker"), step).otherwise(0.0)
    return moves.join(weights).select("candidate", "key", (F.col("weight") + change).alias("weight"))


def event_peaks(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Peak score of each (candidate, window id) with rows; leave holdout windows out of ``windows``."""
    return in_windows(rows, windows).groupBy("candidate", "id").agg(F.max("score").alias("peak"))


#: Weights of ROC-AUC, average precision, event recall and specificity in the objective.
OBJECTIVE = (0.35, 0.25, 0.20, 0.20)


def evaluate_candidates(scored: DataFrame, label_windows: DataFrame, peak_windows: DataFrame, baseline: str) -> DataFrame:
    """Objective and guardrail verdict of each candidate of ``scored(candidate, d, score)``.

    Alarms are at the threshold of 20 to 80 (121 steps) with the best balanced
    accuracy.  Event recall is the share of windows whose peak reaches it.
    Differences are to the candidate named ``baseline``; d_peak is that of the
    window that loses most.  Tables used more than once are kept, so that the
    plan stays small.
    """
    scored = kept(scored)
    rows = kept(label_rows(scored, label_windows))
    by = ["candidate"]
    swept = kept(threshold_sweep(rows, "score", "label", 20.0, 80.0, 121, by, digits=None))
    peaks = kept(event_peaks(scored, peak_windows))
    recalls = peaks.join(swept.select("candidate", "threshold"), "candidate").groupBy("candidate").agg(F.avg((F.col("peak") >= F.col("threshold")).cast("double")).alias("event_recall"))
    base = peaks.where(F.col("candidate") == baseline).select("id", F.col("peak").alias("base_peak"))
    drops = peaks.join(base, "id").groupBy("candidate").agg(F.min(F.col("peak") - F.col("base_peak")).alias("d_peak"))
    out = swept
    for part in (roc_auc(rows, "score", "label", by), average_precision(rows, "score", "label", "d", by), recalls, drops):
        out = out.join(part, "candidate", "left")
    out = out.fillna(0.0, ["auc", "ap", "event_recall"])
    parts = (F.col("auc"), F.col("ap"), F.col("event_recall"), 1.0 - F.col("fpr"))
    out = kept(out.withColumn("objective", sum((w * c for w, c in zip(OBJECTIVE[1:], parts[1:], strict=True)), OBJECTIVE[0] * parts[0])))
    first = out.where(F.col("candidate") == baseline).select(F.col("objective").alias("base_objective"), F.col("fpr").alias("base_fpr"))
    out = out.join(first).withColumns({"d_objective": F.col("objective") - F.col("base_objective"), "d_fpr": F.col("fpr") - F.col("base_fpr")})
    return guardrails(out.drop("base_objective", "base_fpr"))


def guardrails(candidates: DataFrame, gain: float = 0.005, fpr_rise: float = 0.01, recall: float = 0.75, peak_drop: float = 8.0) -> DataFrame:
    """Reasons against each candidate(d_objective, d_fpr, event_recall, d_peak) and whether it passes."""
    reasons = F.array(
        F.when(F.col("d_objective") < gain, "objective"), F.when(F.col("d_fpr") > fpr_rise, "false positives"),
        F.when(F.col("event_recall") < recall, "event recall"), F.when(F.col("d_peak") < -peak_drop, "event peak"),
    )
    out = candidates.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull()))
    return out.withColumn("passes", F.size("reasons") == 0)


def accepted(judged: DataFrame) -> DataFrame:
    """The first candidate that passes, by objective (ties by name); no row if none does."""
    return judged.where("passes").orderBy(F.desc("objective"), "candidate").limit(1)


def config_changes(weights: DataFrame, candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """(key, before, after) of the weights that an accepted candidate changes."""
    new = candidates.join(chosen.select("candidate"), "candidate", "left_semi").select("key", F.col("weight").alias("after"))
    return weights.select("key", F.col("weight").alias("before")).join(new, "key").where("before <> after")


def hybrid_mix(rule: Column, network: Column, weights: tuple[float, float] = (0.65, 0.35)) -> Column:
    """Rule score and network probability (percent) mixed by normalised weights; one that is missing leaves the other."""
    wr, wn = (w / sum(weights) for w in weights)
    return F.when(network.isNull(), rule).when(rule.isNull(), network).otherwise(wr * rule + wn * network)


def split_guards(rows: DataFrame, part: str, label: str, least: dict[str, tuple[int, int]]) -> DataFrame:
    """Per part of a temporal split: rows, positives, and whether there are enough of both (part to least rows, least positives)."""
    per = rows.groupBy(part).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("positives"))
    enough = [F.when(F.col(part) == name, (F.col("n") >= n) & (F.col("positives") >= p)) for name, (n, p) in least.items()]
    return per.withColumn("enough", F.coalesce(*enough, F.lit(True)))
