"""Filters with optional bounds, point lookups, state views and reports."""

from __future__ import annotations

from datetime import date as _date

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from stresslens.functions.text import normalise


def limited(value: int, low: int, high: int) -> int:
    """An argument inside its limits."""
    return min(high, max(low, int(value)))


def _day(value: str | None) -> str | None:
    """A date argument; ValueError for what isn't one."""
    return None if value is None else _date.fromisoformat(value[:10]).isoformat()


def _bounds(column: Column, low, high) -> list[Column]:
    return [c for c in (None if low is None else column >= low, None if high is None else column <= high) if c is not None]


def _all(rows: DataFrame, conditions: list[Column]) -> DataFrame:
    for c in conditions:
        rows = rows.where(c)
    return rows


def history(
    rows: DataFrame, start: str | None = None, end: str | None = None, score: tuple[float | None, float | None] = (None, None),
    stage: tuple[int | None, int | None] = (None, None), newest_first: bool = True, limit: int = 365, date: str = "d",
) -> DataFrame:
    """Rows (date, score, stage) inside the bounds that are given; ``limit`` of 1 to 365 (of the answer).

    A missing score or stage fails a bound on it; rows whose date is missing are left out.
    """
    day = F.col(date)
    conditions = [day.isNotNull(), *_bounds(day, _day(start), _day(end)), *_bounds(F.col("score"), *score), *_bounds(F.col("stage"), *stage)]
    return _all(rows, conditions).orderBy(day.desc() if newest_first else day.asc()).limit(limited(limit, 1, 365))


def news_series(rows: DataFrame, as_of: str, key: str | None = None, kind: str | None = None, start: str | None = None, end: str | None = None, days: int | None = None) -> DataFrame:
    """Daily rows (day, kind, key, ...): key and kind equal but for case and spaces; the last ``days`` up to ``end`` if no start is given."""
    last = _day(end) or _day(as_of)
    conditions = [F.col("day") <= F.lit(last).cast("date")]
    if start is not None:
        conditions.append(F.col("day") >= F.lit(_day(start)).cast("date"))
    elif days is not None:
        conditions.append(F.col("day") >= F.date_sub(F.lit(last).cast("date"), days))
    conditions += [normalise(c) == normalise(F.lit(value)) for c, value in (("key", key), ("kind", kind)) if value is not None]
    return _all(rows, conditions)


#: The kinds of daily rows that name an actor.
ACTOR_KINDS = ("actor_mention", "reported_attribution")


def timeline(rows: DataFrame, as_of: str, actor: str | None = None, attribution_only: bool = False, least_score: float | None = None, days: int | None = None) -> DataFrame:
    """Daily rows (day, kind, key, max_score): of an actor only the kinds that name one, of attributions only theirs."""
    out = news_series(rows, as_of, days=days)
    if actor is not None:
        out = out.where(F.col("kind").isin(*ACTOR_KINDS) & (normalise("key") == normalise(F.lit(actor))))
    if attribution_only:
        out = out.where(F.col("kind") == ACTOR_KINDS[1])
    return out if least_score is None else out.where(F.col("max_score") >= least_score)


def covered(rows: DataFrame, least: float = 55.0) -> DataFrame:
    """Rows whose coverage reaches ``least``."""
    return rows.where(F.col("coverage") >= least)


def lookup(parents: DataFrame, children: DataFrame, key: str, value, order: list[Column], most: int = 50) -> DataFrame:
    """The row of ``parents`` with this key, and its first ``most`` children as an array (a limit of the answer)."""
    mine = children.where(F.col(key) == value).orderBy(*order).limit(most)
    gathered = mine.agg(F.collect_list(F.struct(*[c for c in children.columns if c != key])).alias("children"))
    return parents.where(F.col(key) == value).withColumn("children", gathered.scalar())


def scan_outcomes(rows: DataFrame, sources: DataFrame, source: str, value: Column) -> DataFrame:
    """Per row of ``sources(source)``: how many values it gave, and an error where it gave none.

    A source that fails or is empty is one row with an error; the others are
    untouched by it.
    """
    per = rows.groupBy(F.col(source).alias("_s")).agg(F.count(value).alias("n"), F.count("*").alias("n_rows"))
    out = sources.join(per, F.col(source) == F.col("_s"), "left").drop("_s").fillna(0, ["n", "n_rows"])
    return out.withColumn("error", F.when(F.col("n_rows") == 0, "no rows").when(F.col("n") == 0, "no readable value"))


def source_list(official: DataFrame, queries: DataFrame, template: Column) -> DataFrame:
    """(id, url, kind) of official feeds (id, url) and of query feeds (id, query), whose address comes from a template."""
    return official.select("id", "url", F.lit("official").alias("kind")).unionByName(queries.select("id", template.alias("url"), F.lit("query").alias("kind")))


def first_entries(entries: DataFrame, source: str, place: Column, most: int = 100) -> DataFrame:
    """The first ``most`` entries of each source (a limit of a feed)."""
    from pyspark.sql import Window

    return entries.withColumn("_n", F.row_number().over(Window.partitionBy(source).orderBy(place))).where(F.col("_n") <= most).drop("_n")


def indicator_view(scores: DataFrame, weights: DataFrame, names: DataFrame) -> DataFrame:
    """Per (d, key): name, score, weight, level, whether it is missing, and its share of the day's covered weight."""
    from stresslens.functions.scalars import level_word

    total = scores.join(weights, "key").where("score is not null").groupBy("d").agg(F.sum("weight").alias("covered"))
    rows = scores.join(weights, "key").join(names, "key", "left").join(total, "d", "left")
    return rows.select(
        "d", "key", F.coalesce("name", "key").alias("name"), "score", "weight", level_word("score").alias("level"), F.col("score").isNull().alias("missing"),
        F.when(F.col("score").isNotNull(), F.col("weight") / F.col("covered")).alias("share"),
    )


def state_view(parts: dict[str, DataFrame]) -> DataFrame:
    """One row with a struct for each of several one-row tables; a table without rows gives null."""
    columns = [one.select(F.struct(*one.columns)).scalar().alias(name) for name, one in parts.items()]
    return next(iter(parts.values())).sparkSession.range(1).select(*columns)


def status_report(rows: DataFrame, source: str, counters: dict[str, Column]) -> DataFrame:
    """(counter, source, n): each counter over all rows, and the rows of each source."""
    totals = rows.agg(*[F.count_if(c).alias(n) for n, c in counters.items()])
    long = totals.select(F.explode(F.array(*[F.struct(F.lit(n).alias("counter"), F.lit(None).cast("string").alias("source"), F.col(n).alias("n")) for n in counters])).alias("r")).select("r.*")
    per = rows.groupBy(F.col(source).cast("string").alias("source")).agg(F.count("*").alias("n"))
    return long.unionByName(per.select(F.lit("rows").alias("counter"), "source", "n"))


#: What views of the agent's and of the models' state show of their documents.
AGENT_STATE = "updated_at string, decision string, policy_summary string, baseline string, accepted_change string, candidate_count long, top_candidates array<string>, active_config string, holdout_report string"
NEURAL_STATE = "version string, model_type string, architecture string, ensemble_size long, target string, temporal_split string, selected_threshold double, current string, metrics string, event_evaluation string, limitations string"


def state_documents(documents: DataFrame, text: str, schema: str) -> DataFrame:
    """``documents`` with ``available`` and the fields of a JSON document of state; nested values stay JSON texts.

    A document that is null, empty, broken or an empty object isn't available:
    all its fields are null.  The models themselves (``models``) are left out
    unless the schema asks for them.
    """
    parsed = F.from_json(F.col(text), schema, {"mode": "PERMISSIVE"})
    usable = F.coalesce(F.size(F.json_object_keys(F.col(text))) > 0, F.lit(False))
    rows = documents.withColumn("state", F.when(usable, parsed))
    names = [f.name for f in rows.schema["state"].dataType.fields]
    return rows.select(*[F.col(f"`{c}`") for c in documents.columns if c != text], usable.alias("available"), *[F.col(f"state.`{n}`").alias(n) for n in names])


def as_document(columns: list[str]) -> Column:
    """A JSON document of a row's columns, nulls left out: what :func:`state_documents` reads back."""
    return F.to_json(F.struct(*columns))


def write_observed(rows: DataFrame, path: str, counters: dict[str, Column]) -> dict[str, int]:
    """Write ``rows`` as Parquet and return each counter and ``rows``, gathered while they were written: one pass over them."""
    seen = Observation()
    named = [F.count_if(c).alias(n) for n, c in counters.items()]
    rows.observe(seen, F.count(F.lit(1)).alias("rows"), *named).write.parquet(path)
    return dict(seen.get)


def as_views(resources: dict[str, DataFrame], prefix: str = "resource_") -> list[str]:
    """Register resources as temporary views of the session; their names."""
    names = []
    for name, rows in resources.items():
        rows.createOrReplaceTempView(f"{prefix}{name}")
        names.append(f"{prefix}{name}")
    return names
