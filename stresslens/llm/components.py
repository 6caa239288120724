"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stresslens.llm import scratch


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """Label the nodes of ``links(a, b)`` with the smallest node they reach.

    Returns ``(node, component)`` for every node but those that are their own
    component's smallest.  Each round points every node at its smallest
    neighbour (first over all neighbours, then over the smaller ones), which
    halves path lengths; rounds end when the table stops changing.  Minima
    are aggregated before they are shuffled and each round is written to the
    shared folder, so a hub with any number of links splits across tasks.
    """
    edges = scratch.save(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        tasks=scratch.tasks_for(links.count()),
    )
    state = _print_of(edges)
    while state[0]:
        tasks = scratch.tasks_for(state[0])
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")).coalesce(tasks)
        large = scratch.save(
            both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), tasks=tasks
        )
        low = large.groupBy("a").agg(F.min("b").alias("low")).coalesce(tasks)
        small = (
            large.join(low, "a")
            .where("b > low")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(low.select("a", F.col("low").alias("b")))
        )
        edges = scratch.save(small.distinct(), tasks=tasks)
        before, state = state, _print_of(edges)
        if before == state:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
