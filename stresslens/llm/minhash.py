"""Near-duplicate documents by a join on MinHash signature coordinates.

Each distinct shingle set gets a signature of ``COORDS`` minima.  A set is
posted under each (coordinate, value) pair; two sets at the asked similarity
agree on at least ``min_matches`` coordinates but for a chance of about three
in a million.  Agreeing on ``t`` of ``K`` pairs means sharing one of the
``K - t + 1`` rarest pairs of either set (prefix), and pairs that only one
set has are skipped outright, so common passages, which make common pairs,
meet only where sets agree on most of their signature.  Collisions are
counted for sets of a common list, and pairs above the threshold are
confirmed on the full shingle sets.

Lists are never expanded into pairs.  In rounds, every set of a list is first
held against one pivot of the list, and the links so found are contracted;
rounds go on as long as each leaves at most half of the postings that it
began with, so all together cost less than two.  Then sets go that have too
many shingles of their own to link with any other set left.  What remains of
a list is dealt to blocks by set size and hash, and each task holds one block
against another: it skips pairs of one group, counts collisions, confirms,
and returns only links that join two groups, fewer than it has sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stresslens.llm import scratch
from stresslens.llm.components import connected_components
from stresslens.llm.words import hash_texts, mix, shingles

COORDS = 32
#: Sets and shingles of a block, about.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 19

_SEEDS = mix(np.arange(1, COORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = mix(_SEEDS) | np.uint64(1)
_TAGS = np.arange(COORDS, dtype=np.int64) << 32
_SLICE = 1 << 13
#: Candidates of a set that are confirmed at once.
_AT_ONCE = 64


def min_matches(similarity: float) -> int:
    """Collisions below which a pair of at least ``similarity`` falls with a chance of five deviations."""
    spread = math.sqrt(COORDS * similarity * (1 - similarity))
    return max(1, math.floor(COORDS * similarity - 5 * spread))


def _signature(values: np.ndarray) -> np.ndarray:
    low = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(values), _SLICE):
        part = (values[None, k : k + _SLICE] ^ _SEEDS[:, None]) * _FACTORS[:, None]
        low = np.minimum(low, part.min(axis=1))
    return _TAGS | (low >> np.uint64(32)).astype(np.int64)


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, shingle_words: int) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_shingles, digest of the shingle set, sig (empty without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sigs = [], [], []
            for _, hashes, _ in hash_texts(batch.column(2)):
                values = shingles(hashes, shingle_words)
                sizes.append(len(values))
                digests.append(_digest(values))
                sigs.append(_signature(values) if len(values) else _TAGS[:0])
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sigs])]).astype(np.int32)
            flat = np.concatenate(sigs) if sigs else _TAGS[:0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "digest", "sig"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, "doc_id bigint, text_hash bigint, n_shingles bigint, digest binary, sig array<bigint>"
    )


def _sets(docs: DataFrame, shingle_words: int) -> DataFrame:
    """The full shingle sets, packed, of few documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(h, shingle_words) for _, h, _ in hash_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["doc_id", "digest", "members"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, digest binary, members binary")


def _confirm(percent: int):
    """Keep the pairs whose sets satisfy 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
                    keep.append(False)
                    continue
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * common >= percent * (len(one) + len(two) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, held: DataFrame, percent: int, least: int) -> DataFrame:
    """The linked ones of ``pairs(a, b)``; ``held(node, n, sig, members)`` is a stored table."""
    one = held.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    two = held.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    near = pairs.join(one, "a").join(two, "b").where(F.size(F.array_intersect("sig_a", "sig_b")) >= least).select("a", "b")
    one = held.select(F.col("node").alias("a"), F.col("members").alias("set_a"))
    two = held.select(F.col("node").alias("b"), F.col("members").alias("set_b"))
    both = near.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b")
    return scratch.save(both.mapInArrow(_confirm(percent), "a bigint, b bigint"))


def _prefix_postings(reps: DataFrame, least: int, tasks: int) -> DataFrame:
    """(token, node) for each set's rarest shared pairs, enough that any two matching sets meet."""
    tokens = reps.select("node", F.explode("sig").alias("token"))
    counts = scratch.save(tokens.groupBy("token").agg(F.count("*").alias("held")).where("held > 1"), tasks=tasks)
    ranked = (
        tokens.join(counts, "token")
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("shared"))
        .where(F.size("shared") >= least)
    )
    return ranked.select(F.explode(F.expr(f"slice(shared, 1, size(shared) - {least} + 1)")).alias("s"), "node").select(F.col("s.token").alias("token"), "node")


def _sweep(rest: DataFrame, held: DataFrame, percent: int, least: int, tasks: int) -> tuple[DataFrame, DataFrame]:
    """Links of the sets of each list of ``rest(token, node, grp)`` with its pivot, and the postings without the pivots."""
    first = F.min_by("node", F.struct("grp", "node"))
    pivots = scratch.save(rest.groupBy("token").agg(first.alias("pivot"), F.min("grp").alias("pivot_grp"), F.count("*").alias("held")).where("held > 1"), tasks=tasks)
    swept = rest.join(pivots, "token").where("node <> pivot")
    pairs = swept.where("grp <> pivot_grp").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    return _links(scratch.save(pairs, tasks=tasks), held, percent, least), swept.select("token", "node")


def _labelled(postings: DataFrame, links: DataFrame, tasks: int) -> DataFrame:
    """The postings of lists that still hold more than one group, with each set's group."""
    groups = connected_components(links).withColumnRenamed("component", "joined")
    grouped = scratch.save(postings.join(groups, "node", "left").select("token", "node", F.coalesce("joined", "node").alias("grp")), tasks=tasks)
    mixed = grouped.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("token")
    return scratch.save(grouped.join(mixed.coalesce(tasks), "token", "left_semi"), tasks=tasks)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, members in zip(batch.column(0), batch.column(1), strict=True):
            values = np.frombuffer(members.as_buffer(), np.int64)
            for k in range(0, len(values), _SLICE):
                part = pa.array(values[k : k + _SLICE])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), node.as_py())), part], ["node", "shingle"])


def _linkable(left: DataFrame, held: DataFrame, percent: int, tasks: int) -> DataFrame:
    """The postings without the sets that can't link: too many of their shingles are in no other set left.

    A common passage makes sets agree on much of their signature; what stands
    around it tells them apart.  Shingles are counted before they are
    shuffled, and no pairs are made.
    """
    sets = held.join(left.select("node").distinct().coalesce(tasks), "node", "left_semi")
    shingled = sets.select("node", "members").mapInArrow(_unpacked, "node bigint, shingle bigint")
    single = shingled.groupBy("shingle").agg(F.count("*").alias("holders"), F.min("node").alias("node")).where("holders = 1")
    alone = single.groupBy("node").agg(F.count("*").alias("alone")).coalesce(tasks)
    apart = alone.join(held.select("node", "n"), "node").where(100 * (F.col("n") - F.col("alone")) < percent * F.col("n"))
    return scratch.save(left.join(scratch.save(apart.select("node"), tasks=tasks), "node", "left_anti"), tasks=tasks)


def _dealt(left: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The postings dealt to tasks (token, size class, i, j), each set with its role there.

    Sets that link are in one size class or in neighbouring ones.  A class of
    a list is cut into blocks by hash.  Task (c, i, j) holds block i of class
    c (left) against block j of class c, if i <= j, and block j of class
    c + 1 (right).  Role bits: 1 left, 2 right.
    """
    width = -math.log(percent / 100) + 1e-9
    sized = left.join(held.select("node", "n"), "node").withColumn("class", F.floor(F.log("n") / F.lit(width)).cast("int"))
    per = sized.groupBy("token", "class").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    order = Window.partitionBy("token").orderBy("class")  # the size classes of a list, some dozens
    beside = lambda move, step: F.when(move("class").over(order) == F.col("class") + step, move("m").over(order)).otherwise(0)
    per = per.select("token", "class", "sets", blocks.alias("m")).select("token", "class", "sets", "m", beside(F.lead, 1).alias("above"), beside(F.lag, -1).alias("below"))
    rows = sized.join(per.where("sets > 1 or above > 0 or below > 0"), ["token", "class"]).withColumn("s", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))

    def upto(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def task(c: Column, i: Column, j: Column, role: Column) -> Column:
        return F.struct(c.alias("class"), i.alias("i"), j.alias("j"), role.alias("role"))

    c, s, own = F.col("class"), F.col("s"), F.lit(1)
    as_left = F.transform(
        F.filter(upto(F.greatest("m", "above")), lambda j: (j >= s) | (j < F.col("above"))),
        lambda j: task(c, s, j, F.when(j == s, 3).otherwise(own)),
    )
    as_right = F.transform(upto(s), lambda i: task(c, i, s, F.lit(2)))
    as_upper = F.transform(upto(F.col("below")), lambda i: task(c - 1, i, s, F.lit(2)))
    return rows.select("token", "node", "grp", F.explode(F.concat(as_left, as_right, as_upper)).alias("t")).select("token", "t.*", "node", "grp")


class _Groups:
    """A local union-find over the groups of a task's sets."""

    def __init__(self, groups: np.ndarray):
        self.of = np.unique(groups, return_inverse=True)[1]

    def join(self, i: int, j: int) -> None:
        self.of[self.of == self.of[j]] = self.of[i]


def spanning_links(groups: np.ndarray, role: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], percent: int, least: int) -> list[tuple[int, int]]:
    """Positions of linked pairs, left against right, that join groups: fewer than there are sets.

    Of pairs of different groups collisions are counted; those at the match
    threshold are confirmed on the sets.
    """
    joined, links = _Groups(groups), []
    if joined.of.max() == 0:
        return links
    sizes = np.array([len(s) for s in sets])
    firsts = np.cumsum(sizes) - sizes
    ids = None
    right = np.flatnonzero(role & 2)
    for i in np.flatnonzero(role & 1):
        js = right[joined.of[right] != joined.of[i]]
        if role[i] == 3:
            js = js[(role[js] != 3) | (js > i)]
        js = js[100 * np.minimum(sizes[js], sizes[i]) >= percent * np.maximum(sizes[js], sizes[i])]
        if not len(js):
            continue
        met = (sigs[js] == sigs[i]).sum(axis=1)
        js = js[np.argsort(-met, kind="stable")][: int((met >= least).sum())]
        if not len(js):
            continue
        if ids is None:
            shared, ids = np.unique(np.concatenate(sets), return_inverse=True)
            mark = np.zeros(len(shared), np.int32)
        own = ids[firsts[i] : firsts[i] + sizes[i]]
        mark[own] = 1
        for k in range(0, len(js), _AT_ONCE):
            part = js[k : k + _AT_ONCE]
            part = part[joined.of[part] != joined.of[i]]
            if not len(part):
                continue
            hits = mark[np.concatenate([ids[firsts[j] : firsts[j] + sizes[j]] for j in part])]
            common = np.add.reduceat(hits, np.cumsum(sizes[part]) - sizes[part])
            for j in part[100 * common >= percent * (sizes[part] + sizes[i] - common)]:
                if joined.of[j] != joined.of[i]:
                    joined.join(i, j)
                    links.append((int(i), int(j)))
        mark[own] = 0
    return links


def _compared(percent: int, least: int):
    """Over rows sorted by task: the links of each task's sets that join groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("token", "class", "i", "j")
        current, kept, a, b = None, [], [], []

        def close() -> None:
            group = pa.Table.from_batches(kept)
            node = group.column("node").to_numpy()
            if len(node) > 1:
                sigs = group.column("sig").combine_chunks().flatten().to_numpy().reshape(len(node), COORDS)
                sets = [np.frombuffer(m.as_buffer(), np.uint64) for m in group.column("members")]
                for i, j in spanning_links(group.column("grp").to_numpy(), group.column("role").to_numpy(), sigs, sets, percent, least):
                    a.append(node[i])
                    b.append(node[j])

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in names])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), len(batch)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                if kept and tuple(keys[:, start]) != current:
                    close()
                    kept = []
                current = tuple(keys[:, start])
                kept.append(batch.slice(start, stop - start))
            if len(a) > 10_000:
                yield flush()
                a, b = [], []
        if kept:
            close()
        yield flush()

    return run


def _block_links(left: DataFrame, held: DataFrame, percent: int, least: int) -> DataFrame:
    """Links among the sets of each list that no pivot has found."""
    key = ["token", "class", "i", "j"]
    rows = _dealt(left, held, percent).join(held.select("node", "sig", "members"), "node").repartition(*key).sortWithinPartitions(*key)
    return scratch.save(rows.select(*key, "role", "node", "grp", "sig", "members").mapInArrow(_compared(percent, least), "a bigint, b bigint"))


def _judged(docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) of each row of ``docs(doc_id, text)``."""
    least = min_matches(percent / 100)
    signed = scratch.save(signatures(docs, shingle_words))
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    tasks = scratch.tasks_for(signed.count())
    # a node is a distinct set; its smallest document stands for it
    classes = scratch.save(usable.groupBy("digest").agg(F.min("doc_id").alias("rep")).withColumn("node", F.monotonically_increasing_id()), tasks=tasks)
    own = usable.join(classes.withColumnRenamed("digest", "d"), (usable.digest == F.col("d")) & (usable.doc_id == F.col("rep")))
    reps = scratch.save(own.select("node", F.col("n_shingles").alias("n"), "sig").dropDuplicates(["node"]))
    postings = scratch.save(_prefix_postings(reps, least, tasks), tasks=tasks)
    wanted = scratch.save(classes.join(postings.select("node").distinct(), "node", "left_semi"), tasks=tasks)
    sets = _sets(docs.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), shingle_words)
    sets = sets.join(wanted.withColumnRenamed("digest", "d"), (sets.digest == F.col("d")) & (sets.doc_id == F.col("rep"))).select("node", "members")
    held = scratch.save(sets.dropDuplicates(["node"]).join(reps, "node"))

    links, rest, before = None, postings.withColumn("grp", F.col("node")), postings.count()
    while True:
        found, swept = _sweep(rest, held, percent, least, tasks)
        links = found if links is None else links.unionByName(found)
        rest = _labelled(swept, links, tasks)
        before, after = rest.count(), before
        if 2 * before > after or not before:
            break
    if before:
        links = links.unionByName(_block_links(_linkable(rest, held, percent, tasks), held, percent, least))

    groups = scratch.save(connected_components(links), tasks=tasks)
    roots = groups.select(F.col("component").alias("node"), "component").distinct().unionByName(groups)
    smallest = roots.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    named = scratch.save(roots.join(smallest, "component").select("node", "component_id"), tasks=tasks)
    owners = scratch.save(classes.join(named, "node", "left").select("digest", F.coalesce("component_id", "rep").alias("owner")), tasks=tasks)
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("owner")).otherwise(F.col("doc_id")))
    return signed.select("doc_id", "text_hash", "n_shingles", "digest").join(owners, "digest", "left").select("doc_id", "text_hash", "n_shingles", component.alias("component_id"))


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Group documents whose word-shingle sets have at least ``percent`` / 100 similarity.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable over
    links, itself included) and kept (doc_id = component_id), one row per row
    of ``docs`` (doc_id and text are read; other columns may be there).

    Null or blank texts have an empty set, link with nothing and are kept.
    A null doc_id links with nothing: its component_id is null, kept is true.
    Rows are judged by their own text: rows that repeat a doc_id share a
    component only if their texts do.  An empty table gives no rows.
    """
    rows = _judged(_narrow(docs), shingle_words, percent).drop("text_hash")
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: those of the smallest doc_id of each group.

    Rows with a null doc_id or a blank text stay.  Rows that repeat both
    doc_id and text stay or go together.  Columns stay as they are, whatever
    their names; an empty table gives none.
    """
    judged = _judged(_narrow(docs), shingle_words, percent)
    gone = scratch.save(judged.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = (F.col("row.doc_id").cast("bigint") == F.col("gone_id")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("gone_hash"))
    return rows.join(gone, same, "left_anti").select("row.*")
