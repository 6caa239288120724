"""Exact nearest neighbours by cells: vectors lie with the nearest of some centres, and cells too far away are never compared.

Centres are chosen from a bounded sample; every vector is in the cell of its
nearest centre, with its distance to it.  A query first searches the cells
nearest to it, which gives a distance within which its k neighbours lie.  By
the triangle inequality a vector v of the cell around c can be nearer than
that only if ``|d(q, c) - d(v, c)|`` is, so whole cells go by their least and
greatest distance, and in the cells that stay the vectors of a ring.  The
result is that of comparing all pairs, whatever the centres.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stresslens.functions.scalars import clamp
from stresslens.operators.retrieval import top
from stresslens.sources.shared import kept

#: Vectors of the sample that centres come from, and rounds that improve them.
SAMPLE, ROUNDS = 20_000, 4
#: The most centres: their table is held by every task.
MOST_CENTRES = 4096
#: Vectors of a cell that are compared in one task.
PIECE = 4096
#: Distances are rounded to this many places before they are ranked.
DIGITS = 6


def choose_centres(vectors: DataFrame, count: int | None = None, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Centres of cells, from at most ``sample`` vectors: random ones, improved by a few rounds of means.

    Their number is the square root of the table's, ``MOST_CENTRES`` at most;
    the sample is the ``sample`` smallest hashes of the ids.  They
    decide how much is compared and never what is found.
    """
    n = vectors.count()
    count = count or max(1, min(MOST_CENTRES, math.isqrt(n)))
    rows = vectors.select("v", F.xxhash64(F.lit(seed), "id").alias("h")).orderBy("h").limit(sample).toPandas()
    points = np.stack(rows["v"].to_numpy()).astype(float) if len(rows) else np.zeros((0, 1))
    centres = points[: min(count, len(points))].copy()
    for _ in range(ROUNDS):
        near = nearest_centre(points, centres)[0] if len(centres) else np.empty(0, int)
        for c in range(len(centres)):
            mine = points[near == c]
            if len(mine):
                centres[c] = mine.mean(axis=0)
    return centres


def distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distances of all ``points`` to all ``others``."""
    square = (points * points).sum(1)[:, None] - 2 * points @ others.T + (others * others).sum(1)[None, :]
    return np.sqrt(np.maximum(square, 0.0))


def nearest_centre(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and distance of the nearest centre of each point."""
    far = distances(points, centres)
    near = far.argmin(axis=1)
    # once more without the square's cancellation: bounds rely on it
    return near, np.sqrt(((points - centres[near]) ** 2).sum(axis=1))


def deal(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``vectors(id, v)`` with their ``cell``, the ``piece`` of it that they lie in, and ``far``, the distance to its centre; a stored table."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # MOST_CENTRES vectors at most

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                near, far = nearest_centre(np.stack(frame["v"].to_numpy()).astype(float), shared.value)
                yield frame.assign(cell=near, far=far)

    usable = vectors.select("id", F.col("v").cast("array<double>").alias("v")).where("id is not null and v is not null")
    kind = vectors.schema["id"].dataType.simpleString()
    dealt = kept(usable.mapInPandas(run, f"id {kind}, v array<double>, cell int, far double"))
    # a cell of any size is cut into pieces, so that no task holds more than a piece
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    return kept(dealt.join(sizes, "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"), "far"))


def _ring(q: np.ndarray, to_centre: float, far: np.ndarray, within: float) -> np.ndarray:
    """Positions of the vectors of a cell that can be within a distance of the query."""
    return np.flatnonzero(np.abs(to_centre - far) <= within + 1e-9 * (1 + to_centre + within))


def _compare(k: int):
    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            ids, far, v = held["id"].to_numpy(), held["far"].to_numpy(), np.stack(held["v"].to_numpy()).astype(float)
            for qid, q, to_centre, within in zip(asked["qid"], asked["q"], asked["to_centre"], asked["within"], strict=True):
                q = np.asarray(q, float)
                at = _ring(q, to_centre, far, within)
                dist = np.round(np.sqrt(((v[at] - q) ** 2).sum(axis=1)), DIGITS)
                first = np.lexsort((ids[at], dist))[:k]
                out.append(pd.DataFrame({"qid": qid, "id": ids[at][first], "dist": dist[first], "compared": np.where(np.arange(len(first)) == 0, len(at), 0)}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "id": [], "dist": [], "compared": []})

    return run


def _searched(asked: DataFrame, queries: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """(qid, id, dist, compared): k nearest of each piece of ``asked(qid, cell, to_centre, within)``; compared counts a piece's distances once."""
    pieces = held.select(F.col("cell").alias("in_cell"), F.col("piece").alias("in_piece")).distinct()
    wanted = asked.join(pieces, F.col("cell") == F.col("in_cell")).drop("cell").join(queries, "qid")
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, id {held.schema['id'].dataType.simpleString()}, dist double, compared long"
    return wanted.groupBy("in_cell", "in_piece").cogroup(held.groupBy("cell", "piece")).applyInPandas(_compare(k), kinds)


def knn_cells(queries: DataFrame, vectors: DataFrame, k: int, centres: np.ndarray | None = None, first: int = 2) -> tuple[DataFrame, DataFrame]:
    """(qid, id, dist, sim, rank), the k nearest of ``vectors(id, v)`` to each of ``queries(qid, q)``, and (qid, compared), the distances computed.

    As ``retrieval.knn``: exact, distances rounded to ``DIGITS`` places,
    ties by id; null ids and vectors are left out.  ``first`` cells are
    searched to get each query's bound, then all that it leaves.
    """
    usable = vectors.where("id is not null and v is not null")
    centres = choose_centres(usable, None) if centres is None else centres
    queries = kept(queries.select("qid", F.col("q").cast("array<double>").alias("q")).where("qid is not null and q is not null"))
    kind = queries.schema["qid"].dataType.simpleString()
    if not len(centres):
        spark = queries.sparkSession
        return spark.createDataFrame([], f"qid {kind}, id {vectors.schema['id'].dataType.simpleString()}, dist double, sim double, rank int"), spark.createDataFrame([], f"qid {kind}, compared long")
    held = deal(usable, centres)
    cells = kept(held.groupBy("cell").agg(F.min("far").alias("least"), F.max("far").alias("most"), F.count("*").alias("n")))
    shared = queries.sparkSession.sparkContext.broadcast(centres)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), 256):
                part = frame.iloc[start : start + 256]
                points = np.stack(part["q"].to_numpy()).astype(float)
                far = np.stack([np.sqrt(((shared.value - p) ** 2).sum(axis=1)) for p in points])
                yield pd.DataFrame({"qid": np.repeat(part["qid"].to_numpy(), len(shared.value)), "cell": np.tile(np.arange(len(shared.value)), len(part)), "to_centre": far.ravel()})

    # each query meets the centres, not the vectors
    reach = queries.mapInPandas(measure, f"qid {kind}, cell int, to_centre double").join(cells, "cell")
    apart = F.greatest(F.lit(0.0), F.col("to_centre") - F.col("most"), F.col("least") - F.col("to_centre"))
    reach = kept(reach.select("qid", "cell", "to_centre", apart.alias("apart")))
    begin = kept(top(reach, first, [F.col("to_centre"), F.col("cell")]).select("qid", "cell", "to_centre", F.lit(float("inf")).alias("within")))
    near = kept(_searched(begin, queries, held, k))
    bound = top(near, k, [F.col("dist"), F.col("id")]).where(F.col("rank") == k).select("qid", (F.col("dist") + 10.0**-DIGITS).alias("within"))
    # a query whose first cells hold fewer than k vectors has no bound yet
    rest = reach.join(bound, "qid", "left").withColumn("within", F.coalesce("within", F.lit(float("inf")))).where(F.col("apart") <= F.col("within") * (1 + 1e-9) + 1e-9)
    rest = kept(rest.select("qid", "cell", "to_centre", "within").join(begin, ["qid", "cell"], "left_anti"))
    both = kept(near.unionByName(_searched(rest, queries, held, k)))
    found = top(both, k, [F.col("dist"), F.col("id")]).select("qid", "id", "dist", clamp(1.0 - F.col("dist") * F.col("dist") / 2.0, -1.0, 1.0).alias("sim"), "rank")
    return found, both.groupBy("qid").agg(F.sum("compared").alias("compared"))
