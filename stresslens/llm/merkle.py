"""A Merkle manifest of a dataset, kept as a postorder append log.

Leaves are ordered within their tree, every ``ARITY`` consecutive nodes have
one parent.  Builders take aligned runs of ``ARITY ** HEIGHT`` leaves and
write the nodes of their subtree in the order in which they are completed: a
node follows its last descendant, so nothing written is ever moved or
changed.  Where a node stands in such a log follows from the sizes of the
complete subtrees before it (:func:`log_position`), so siblings are fetched
by place and no search or link is stored.

The tops of the builders' subtrees are the leaves of the next tier, which is
built alike, until one node is left; tiers hold ``ARITY ** HEIGHT`` times
fewer nodes each.  Proofs go down the same tiers: each segment of the log
meets the path above it and hands its nodes' paths on.  Trees of any size and
any number of trees spread over tasks, and no task holds more than a segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stresslens.llm import scratch

ARITY, HEIGHT, WIDTH = 8, 4, 32


def level_sizes(n: int, most: int | None = None) -> list[int]:
    """Nodes of each level above ``n`` leaves, leaves first, until one is left or ``most`` levels are built."""
    sizes = [n]
    while sizes[-1] > 1 and (most is None or len(sizes) <= most):
        sizes.append(-(-sizes[-1] // ARITY))
    return sizes


def log_position(level: int, index: int, sizes: list[int]) -> int:
    """Place of node ``index`` of ``level`` in the postorder log of a tree with these level sizes.

    Before it stand its own subtree, all that is left of it on its level and
    below, and of the levels above the parents that were complete before.
    """
    below = sum(min((index + 1) * ARITY ** (level - k), sizes[k]) for k in range(level + 1))
    above = sum(index // ARITY ** (k - level) for k in range(level + 1, len(sizes)))
    return below - 1 + above


def digest(children: list[bytes]) -> bytes:
    """The node over digests: sha256 of their hexadecimal texts, one after another."""
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def completion_order(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(level, index) of all nodes of a tree with these level sizes, each after its last descendant."""
    for leaf in range(sizes[0]):
        yield 0, leaf
        index = leaf
        for level in range(1, len(sizes)):
            if (index + 1) % ARITY and index + 1 < sizes[level - 1]:
                break
            index //= ARITY
            yield level, index


def segment_sizes(leaves: int, levels: int) -> list[int]:
    """Nodes of each level of a segment that has ``levels`` levels above its leaves, whatever their number."""
    sizes = [leaves]
    for _ in range(levels):
        sizes.append(-(-sizes[-1] // ARITY))
    return sizes


def write_segment(leaves: list[bytes], levels: int) -> tuple[bytes, bytes]:
    """(log of the subtree's nodes in completion order, its top) with ``levels`` levels above the leaves."""
    nodes: list[list[bytes]] = [[] for _ in range(levels + 1)]
    log = []
    for level, index in completion_order(segment_sizes(len(leaves), levels)):
        node = digest(nodes[level - 1][index * ARITY : (index + 1) * ARITY]) if level else leaves[index]
        nodes[level].append(node)
        log.append(node)
    return b"".join(log), log[-1]


def pack_path(steps: list[tuple[int, list[bytes]]]) -> bytes:
    """A path as bytes: for each level the own place, the number of siblings, the siblings."""
    return b"".join(bytes([place, len(others)]) + b"".join(others) for place, others in steps)


def unpack_path(packed: bytes) -> list[tuple[int, list[bytes]]]:
    steps, at = [], 0
    while at < len(packed):
        place, count = packed[at], packed[at + 1]
        body = packed[at + 2 : at + 2 + count * WIDTH]
        steps.append((place, [body[k : k + WIDTH] for k in range(0, len(body), WIDTH)]))
        at += 2 + count * WIDTH
    return steps


def fold(leaf: bytes, steps: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a leaf and its siblings give."""
    node = leaf
    for place, others in steps:
        node = digest([*others[:place], node, *others[place:]])
    return node


def _equal(left: list[str], right: list[str]) -> Column:
    same = F.lit(True)
    for one, two in zip(left, right, strict=True):
        same = same & F.col(one).eqNullSafe(F.col(two))
    return same


def ranked(rows: DataFrame, tree: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``tree_id`` (place of their tree in the order of ``tree``), ``rank`` within the tree (both from 0) and ``n``, the tree's size.

    Rows are sorted in ranges and written once with their place there; each
    range and tree has one line that tells how many rows stand before, so a
    tree of any size spreads.  Rows that are equal in all of ``tree`` and
    ``order`` may stand in any order.
    """
    keys, of = [*tree, *order], [f"of_{c}" for c in tree]
    dealt = rows.repartitionByRange(*map(F.col, keys)).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    stored = scratch.save(dealt).withColumn("part", F.shiftright("place", 33))
    lines = stored.groupBy("part", *tree).agg(F.min("place").alias("first"), F.count("*").alias("here"))
    lines = scratch.save(lines.select(F.col("part").alias("of_part"), *[F.col(c).alias(o) for c, o in zip(tree, of, strict=True)], "first", "here"))
    whole = Window.partitionBy(*of)
    before = F.sum("here").over(whole.orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.select("of_part", *of, "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("here").over(whole).alias("n"))
    if tree:
        trees = ranked(lines.select(*of).distinct(), [], of).select(*[F.col(o).alias(f"{o}_") for o in of], F.col("rank").alias("tree_id"))
        lines = scratch.save(lines.join(trees, _equal(of, [f"{o}_" for o in of])).select("of_part", *of, "first", "before", "n", "tree_id"))
    else:
        lines = lines.withColumn("tree_id", F.lit(0).cast("long"))
    same = (F.col("part") == F.col("of_part")) & _equal(tree, of)
    return stored.join(lines, same).select(*rows.columns, "tree_id", (F.col("before") + F.col("place") - F.col("first")).alias("rank"), "n")


#: Columns of a segment of the log: its tree, the tree's leaves, the tier's nodes, its number, its nodes in completion order, its top.
SEGMENT = "tree_id long, leaves long, n long, block long, log binary, top binary"


def _block() -> Column:
    return F.floor(F.col("rank") / F.lit(ARITY**HEIGHT)).cast("long")


def _segments(nodes: DataFrame) -> DataFrame:
    """One row per aligned run of ``nodes(tree_id, leaves, n, rank, node)``."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        tree, block = (k.as_py() for k in key)
        run = rows.column("node").take(np.argsort(rows.column("rank").to_numpy(), kind="stable")).to_pylist()
        n = rows.column("n")[0].as_py()
        log, top = write_segment(run, len(level_sizes(n, HEIGHT)) - 1)
        return pa.table({"tree_id": [tree], "leaves": [rows.column("leaves")[0].as_py()], "n": [n], "block": [block], "log": [log], "top": [top]})

    keyed = nodes.select("tree_id", _block().alias("block"), "leaves", "n", "rank", "node")
    return keyed.groupBy("tree_id", "block").applyInArrow(build, SEGMENT)


def build_tiers(nodes: DataFrame) -> list[DataFrame]:
    """The segments of the log of each tree of ``nodes(tree_id, rank, n, node)``, tier by tier from the leaves up."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    tiers = [scratch.save(_segments(nodes.withColumn("leaves", F.col("n"))))]
    while (most := -(-most // ARITY**HEIGHT)) > 1:
        up = F.ceil(F.col("n") / F.lit(ARITY**HEIGHT)).cast("long")
        tiers.append(scratch.save(_segments(tiers[-1].select("tree_id", F.col("block").alias("rank"), "leaves", up.alias("n"), F.col("top").alias("node")))))
    return tiers


def tops(tiers: list[DataFrame]) -> DataFrame:
    """(tree_id, top): the root of each tree."""
    return tiers[-1].select("tree_id", "top")


class SegmentReader:
    """Reads paths out of a segment of the log, by places alone."""

    def __init__(self, n: int, block: int, log: bytes):
        self.first = block * ARITY**HEIGHT
        self.size = min(n - self.first, ARITY**HEIGHT)
        self.sizes = segment_sizes(self.size, len(level_sizes(n, HEIGHT)) - 1)
        self.log, self.kept = log, None

    def _run(self, level: int, index: int) -> tuple[int, list[bytes]]:
        """The place of a node in its run, and the digests of the run."""
        first = index - index % ARITY
        places = [log_position(level, k, self.sizes) for k in range(first, min(first + ARITY, self.sizes[level]))]
        return index - first, [self.log[p * WIDTH : (p + 1) * WIDTH] for p in places]

    def path(self, rank: int) -> list[tuple[int, list[bytes]]]:
        """Per level from the leaf to the segment's top: own place in the run, and the others of the run."""
        index, levels = rank - self.first, len(self.sizes) - 1
        if not levels:
            return []
        if self.kept is None or self.kept[0] != index // ARITY:  # all of a run share what is above it
            higher = [self._run(level, index // ARITY**level) for level in range(1, levels)]
            higher = [(place, run[:place] + run[place + 1 :]) for place, run in higher]
            self.kept = index // ARITY, self._run(0, index)[1], higher
        _, run, higher = self.kept
        place = index % ARITY
        return [(place, run[:place] + run[place + 1 :]), *higher]


def _paths(segments: DataFrame) -> DataFrame:
    """(tree_id, rank, path): for each leaf of the segments its path to the tree's root; ``segments`` have ``over``, the path above them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, n, block, log, over in zip(*batch.columns, strict=True):
                reader, over = SegmentReader(n.as_py(), block.as_py(), log.as_py()), over.as_py()
                ranks = range(reader.first, reader.first + reader.size)
                packed = [pack_path(reader.path(r)) + over for r in ranks]
                yield pa.RecordBatch.from_arrays([pa.array([tree.as_py()] * len(packed), pa.int64()), pa.array(ranks, pa.int64()), pa.array(packed, pa.binary())], ["tree_id", "rank", "path"])

    return segments.select("tree_id", "n", "block", "log", "over").mapInArrow(run, "tree_id long, rank long, path binary")


def with_paths(tiers: list[DataFrame]) -> DataFrame:
    """The segments of the lowest tier with ``over``, the path from each one's top to its tree's root."""
    below = tiers[-1].withColumn("over", F.lit(b""))
    for tier in tiers[-2::-1]:
        above = scratch.save(_paths(below)).select("tree_id", F.col("rank").alias("block"), F.col("path").alias("over"))
        below = tier.join(above, ["tree_id", "block"])
    return below


def log_entries(tiers: list[DataFrame]) -> DataFrame:
    """The whole log, one row per node: (tree_id, position, level, digest); positions of a tree run from 0, in completion order."""

    def entries(tier: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for tree, leaves, n, block, log in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    reader, whole = SegmentReader(n, block, log), level_sizes(leaves)
                    rows = []
                    for place, (level, index) in enumerate(completion_order(reader.sizes)):
                        if level or not tier:  # the leaves of a higher tier are the tops of the one below
                            up = level + tier * HEIGHT
                            rows.append((log_position(up, index + reader.first // ARITY**level, whole), up, log[place * WIDTH : (place + 1) * WIDTH]))
                    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays([pa.array([tree] * len(rows), pa.int64()), *columns], ["tree_id", "position", "level", "digest"])

        return run

    parts = [t.select("tree_id", "leaves", "n", "block", "log").mapInArrow(entries(k), "tree_id long, position long, level int, digest binary") for k, t in enumerate(tiers)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def leaf_of(fields: list[Column]) -> Column:
    """A row's digest as bytes: sha256 of its fields, each ``-`` if null, else its bytes' count, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256))


def _proven(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """``rows(tree_id, rank, doc_id, leaf, other)`` with what their proofs give; ``segments`` have over, top and root."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {c: [] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "position")}
        if right.num_rows:
            leaves, n, block, log, over, top, root = (right.column(c)[0].as_py() for c in ("leaves", "n", "block", "log", "over", "subroot", "root"))
            reader, over, whole = SegmentReader(n, block, log), unpack_path(over), level_sizes(leaves)
            siblings_over = b"".join(b"".join(others) for _, others in over)
            left = left.take(np.argsort(left.column("rank").to_numpy(), kind="stable"))
            for rank, doc_id, leaf, other in zip(*(left.column(c).to_pylist() for c in ("rank", "doc_id", "leaf", "other")), strict=True):
                inside = reader.path(rank)
                siblings = b"".join(b"".join(others) for _, others in inside) + siblings_over
                folded = fold(leaf if other is None else other, inside + over)
                values = (doc_id, leaf.hex(), top.hex(), root.hex(), hashlib.sha256(siblings.hex().encode()).hexdigest(), folded.hex(), folded == root, log_position(0, rank, whole))
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.int64()]
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    left = rows.select("tree_id", _block().alias("block"), "rank", "doc_id", "leaf", "other").groupBy("tree_id", "block")
    kinds = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, position long"
    return left.cogroup(segments.groupBy("tree_id", "block")).applyInArrow(run, kinds)


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its leaf, the roots over it, its proof and whether the proof holds.

    ``docs`` has doc_id, source, lang, n_chars and text; other columns are
    not read.  Trees are those of the languages, over them stands one tree of
    their roots.  A row's ``position`` is its leaf's place in its tree's log.
    Rows whose id's crc32 is divisible by 3 are proven with a text of which
    A-Z are lower-cased, and fail where that changes it.

    Nulls in any column are hashed as such; a null lang is a tree of its own,
    the first; null ids come first in their tree and aren't tampered with.
    Rows that repeat a doc_id stand in the order of their leaves, equal rows
    are equal leaves next to each other.  An empty table gives no rows.
    """
    texts = {c: F.col(c).cast("string") for c in ("source", "lang", "text")}
    doc_id, n_chars = F.col("doc_id").cast("bigint"), F.col("n_chars").cast("bigint")
    hashed = lambda text: leaf_of([doc_id, texts["source"], texts["lang"], n_chars, text])
    folded = F.translate(texts["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    other = F.when(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, hashed(folded))
    rows = ranked(docs.select(doc_id.alias("doc_id"), texts["lang"].alias("lang"), hashed(texts["text"]).alias("leaf"), other.alias("other")), ["lang"], ["doc_id", "leaf"])
    tiers = build_tiers(rows.select("tree_id", "rank", "n", F.col("leaf").alias("node")))
    count = tops(tiers).agg(F.count("*").alias("n")).scalar()
    subroots = tops(tiers).select(F.lit(0).cast("long").alias("tree_id"), F.col("tree_id").alias("rank"), count.alias("n"), F.col("top").alias("node"))
    over_all = build_tiers(scratch.save(subroots))
    to_root = _paths(with_paths(over_all)).select(F.col("rank").alias("tree_id"), F.col("path").alias("to_root"))
    root = tops(over_all).select("top").scalar()
    segments = with_paths(tiers).join(to_root, "tree_id").join(tops(tiers).withColumnRenamed("top", "subroot"), "tree_id")
    segments = segments.select("tree_id", "block", "leaves", "n", "log", F.concat("over", "to_root").alias("over"), "subroot", root.alias("root"))
    return _proven(rows, segments)
