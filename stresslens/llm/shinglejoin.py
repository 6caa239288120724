"""Exact Jaccard join of word-shingle sets with adaptive multi-match prefixes.

All sets list their shingles in one order, rare ones first.  Two sets that
link share at least ``ceil(percent * n / 100)`` of either one's n shingles,
so their first ``n - ceil(percent * n / 100) + k`` shingles, the k-prefixes,
have at least k in common, for each k.  A longer prefix costs more postings
but asks for more matches.  Each document takes the k that is cheapest by an
estimate from the lengths of the very lists it would be posted to: the
postings read, and the candidates that could collect k matches from them,
each of which costs a verification.  Documents with different k meet at the
smaller one.  Candidates with enough matches are held against each other by
their parities, about a bit a shingle, in which sets differ no more than in
shingles; so that passes every link, and next to nothing else.  Whole sets
are fetched for what is left, and links are verified on them.

The order comes from a sketch of shingle counts of fixed size; it only has to
be the same everywhere, so its errors cost time and never a link.  Documents
of which fewer than k of the longest prefix's shingles occur in any other
such prefix can't link and leave before anything is joined.

Lists are never expanded into pairs.  Each set of a list is held against one
pivot of the list and links are contracted, in rounds, until that finds
little more.  What is left of a list is dealt to tasks in blocks, of lists
with the same members only one, first with parities.  A pair counts in one
list, that of the smallest token it meets at; whole sets follow to the tasks
where they have a candidate of another group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stresslens.llm import scratch
from stresslens.llm.components import connected_components
from stresslens.llm.minhash import _confirm, _dealt, _digest, _Groups, _labelled, _sets
from stresslens.llm.words import hash_texts, shingles

#: Counters of the sketch (2 ** bits of 4 bytes) and how many of them travel as one row.
SKETCH_BITS, SLICE_BITS = 22, 16
#: Bits of the filter that texts pass before they meet the ids of candidates.
FILTER_BITS = 24
#: Greatest number of matches that a prefix can ask for.
MOST_MATCHES = 12
#: Cost of verifying a candidate in postings: a part by set size, and a fixed part.
VERIFY_SHARE, VERIFY_FIXED = 0.05, 4.0


def least_overlap(n: Column | int, percent: int) -> Column | int:
    """Shingles that a set of ``n`` has in common with any set it links with, at least."""
    if isinstance(n, Column):
        return F.ceil(n * percent / 100).cast("int")
    return -(-n * percent // 100)


def _buckets(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def count_sketch(docs: DataFrame, shingle_words: int) -> np.ndarray:
    """Counters of all documents' shingles by the top bits of their hashes.

    Each task adds up its own documents and gives its counters packed, from a
    byte each (what is more frequent in a task counts as 255 there, which is
    late in the order anyway); slices of counters are then added up in
    parallel.  What comes to the driver is the sum, ``2 ** SKETCH_BITS``
    numbers whatever the input.
    """
    width = 1 << SLICE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for _, hashes, _ in hash_texts(batch.column(0)):
                np.add.at(total, _buckets(shingles(hashes, shingle_words)), np.uint32(1))
        for k in range(len(total) // width):
            part = total[k * width : (k + 1) * width]
            if part.any():
                packed = pa.compress(np.minimum(part, 255).astype(np.uint8), codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed], pa.binary())], ["slice", "counts"])

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for part in parts:
            for packed in part.column("counts"):
                total += np.frombuffer(pa.decompress(packed.as_buffer(), width, codec="zstd"), np.uint8)
        capped = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([capped.tobytes()], pa.binary())], ["slice", "counts"])

    slices = docs.select("text").mapInArrow(count, "slice int, counts binary")
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    for row in slices.groupBy("slice").applyInArrow(add, "slice int, counts binary").toLocalIterator():
        sketch[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["counts"], np.uint32)
    return sketch


def parity(values: np.ndarray) -> bytes:
    """For each of ``2 ** k`` places, at least as many as there are values: whether an odd number of them falls there, a bit each.

    One of two sets' values that the other lacks changes one bit, so sets
    differ in as many values as their parities do in bits, or more.
    """
    places = max(64, 1 << (len(values) - 1).bit_length())
    return np.packbits((np.bincount((values & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1).astype(np.uint8)).tobytes()


def _folded(parities: np.ndarray, length: int) -> np.ndarray:
    """A parity as it is over fewer places, ``8 * length``."""
    return np.bitwise_xor.reduce(parities.reshape(-1, length), axis=0)


def most_difference(both: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Values that only one of two sets that link can have, both sizes added, at most."""
    return both + 2 * (-percent * both // (100 + percent))


def longest_prefixes(docs: DataFrame, shingle_words: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, digest and parity of its set, and its longest prefix in the common order."""
    counters = docs.sparkSession.sparkContext.broadcast(sketch)  # 2 ** SKETCH_BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counters.value
        for batch in batches:
            sizes, digests, parities, prefixes = [], [], [], []
            for _, hashes, _ in hash_texts(batch.column(1)):
                values = shingles(hashes, shingle_words)
                least = least_overlap(len(values), percent)
                order = np.lexsort((values, counts[_buckets(values)]))
                sizes.append(len(values))
                digests.append(_digest(values))
                parities.append(parity(values))
                prefixes.append(values[order[: len(values) - least + min(MOST_MATCHES, least)]].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(parities, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["doc_id", "n_shingles", "digest", "parity", "prefix"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, parity binary, prefix array<bigint>")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by their first column: those whose value another row has, too; one row is held at a time."""
    held, met = None, False  # the last row, and whether the one before it has its value
    for batch in batches:
        if not len(batch):
            continue
        value = batch.column(0).to_numpy()
        again = held is not None and held.column(0)[0].as_py() == value[0]
        if held is not None and (met or again):
            yield held
        same, keep = value[1:] == value[:-1], np.zeros(len(value), bool)
        keep[1:] |= same
        keep[0] |= again
        held, met = batch.slice(len(value) - 1), bool(keep[-1])
        keep[:-1] |= same
        yield batch.slice(0, len(value) - 1).filter(pa.array(keep[:-1]))
    if held is not None and met:
        yield held


def _shared_only(reps: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Postings (token, node, n, at) of tokens that two prefixes hold, of sets that hold enough of them to link with any."""
    postings = reps.select(F.posexplode("prefix").alias("at", "token"), "node", "n").select("token", "node", "n", "at")
    met = postings.repartition("token").sortWithinPartitions("token").mapInArrow(_met, "token bigint, node bigint, n bigint, at int")
    common = scratch.save(met, tasks=4 * tasks)
    enough = F.least(F.lit(MOST_MATCHES), least_overlap(F.col("n"), percent))
    able = common.groupBy("node").agg(F.count("*").alias("met"), F.first("n").alias("n")).where(F.col("met") >= enough).select("node")
    return common.join(able, "node", "left_semi")


def cheapest(at: np.ndarray, held: np.ndarray, n: int, percent: int) -> tuple[int, int, int]:
    """(matches to ask for, shared tokens of that prefix, of the prefix for one match) for a set of ``n``, from its shared tokens' places (ascending) and list lengths."""
    least = least_overlap(n, percent)
    ask = np.arange(1, min(MOST_MATCHES, least) + 1)
    inside = np.searchsorted(at, n - least + ask)
    read = np.append(0, np.cumsum(held - 1))[inside].astype(float)
    best = int(np.argmin(read + (n * VERIFY_SHARE + VERIFY_FIXED) * read / ask))
    return int(ask[best]), int(inside[best]), int(inside[0])


def _choose(percent: int):
    """Over (node, n, lists of (at, held, token)): the matches that each set asks for, and its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends, parts = lists.offsets.to_numpy(), [lists.values.field(k).to_numpy() for k in range(3)]
            keep, matches, shorts, prefixes = [], [], [], []
            for row, n in enumerate(batch.column(1).to_pylist()):
                at, held, token = (p[ends[row] : ends[row + 1]] for p in parts)
                order = np.argsort(at)
                ask, inside, short = cheapest(at[order], held[order], n, percent)
                if inside >= ask and short:
                    keep.append(row)
                    matches.append(ask)
                    shorts.append(short)
                    prefixes.append(token[order[:inside]])
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
            kept = [batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(matches, pa.int32()), pa.array(shorts, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["node", "n", "matches", "short", "prefix"])

    return run


def adaptive_prefixes(reps: DataFrame, percent: int, tasks: int) -> DataFrame:
    """(node, n, matches, short, prefix) of the sets that can link: the matches each asks for, and the shared tokens of that prefix.

    The first ``short`` of them are those of the prefix for one match: any two
    sets that link meet there, so only these are posted.
    """
    postings = _shared_only(reps, percent, tasks)
    held = postings.groupBy("token").agg(F.count("*").alias("held")).where("held > 1")
    lists = postings.join(held, "token").groupBy("node").agg(F.first("n").alias("n"), F.collect_list(F.struct("at", "held", "token")).alias("lists"))
    return scratch.save(lists.mapInArrow(_choose(percent), "node bigint, n bigint, matches int, short int, prefix array<bigint>"), tasks=tasks)


def _alike(percent: int):
    """Keep the pairs whose sizes are like and whose parities differ in no more bits than linked sets can in shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                one, two = (np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y))
                length = min(len(one), len(two))
                apart.append(int(np.bitwise_count(_folded(one, length) ^ _folded(two, length)).sum()))
            n, m = (batch.column(k).to_numpy() for k in (2, 3))
            keep = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.array(apart, np.int64) <= most_difference(n + m, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def _links(pairs: DataFrame, ready: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int, tasks: int) -> DataFrame:
    """The linked ones of ``pairs(a, b)``: enough common tokens of their prefixes, like parities, then whole sets, of these candidates alone."""
    side = lambda x: ready.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "matches", "prefix", "parity")])
    met = F.size(F.array_intersect("prefix_a", "prefix_b")) >= F.least("matches_a", "matches_b")
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(met).select("a", "b", "n_a", "n_b", "parity_a", "parity_b")
    # written, so that the size of what meets the sets is known when that join is planned
    near = scratch.save(both.mapInArrow(_alike(percent), "a bigint, b bigint"), tasks=tasks)
    members = fetch(near.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    one = near.join(members.select(F.col("node").alias("a"), F.col("members").alias("set_a")), "a")
    two = near.join(members.select(F.col("node").alias("b"), F.col("members").alias("set_b")), "b")
    return scratch.save(one.join(two, ["a", "b"]).select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a bigint, b bigint"))


def _sweep(rest: DataFrame, ready: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int, tasks: int) -> tuple[DataFrame, DataFrame]:
    """Links of the sets of each list of ``rest(token, node, grp)`` with its pivot, and the postings without the pivots."""
    first = F.min_by("node", F.struct("grp", "node"))
    pivots = scratch.save(rest.groupBy("token").agg(first.alias("pivot"), F.min("grp").alias("pivot_grp"), F.count("*").alias("held")).where("held > 1"), tasks=tasks)
    swept = rest.join(pivots, "token").where("node <> pivot")
    pairs = swept.where("grp <> pivot_grp").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    return _links(scratch.save(pairs, tasks=tasks), ready, fetch, percent, tasks), swept.select("token", "node")


def _different_lists(postings: DataFrame) -> DataFrame:
    """The postings of one list of all that have the same members."""
    lists = postings.groupBy("token").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64(F.lit(1), "node") % 2**31).alias("s"), F.count("*").alias("held"))
    return postings.join(lists.groupBy("x", "s", "held").agg(F.min("token").alias("token")).select("token"), "token", "left_semi")


class _Common:
    """Counts of the values that a task's sets have in common."""

    def __init__(self, parts: list[np.ndarray]):
        values, self.ids = np.unique(np.concatenate(parts), return_inverse=True)
        self.at = np.append(0, np.cumsum([len(p) for p in parts]))
        self.mark = np.zeros(len(values), np.int32)

    def count(self, i: int, js: np.ndarray) -> np.ndarray:
        own = self.ids[self.at[i] : self.at[i + 1]]
        self.mark[own] = 1
        sums = np.append(0, np.cumsum(self.mark[np.concatenate([self.ids[self.at[j] : self.at[j + 1]] for j in js])]))
        self.mark[own] = 0
        lengths = self.at[js + 1] - self.at[js]
        ends = np.cumsum(lengths)
        return sums[ends] - sums[ends - lengths]


def block_candidates(
    token: int, groups: np.ndarray, role: np.ndarray, sizes: np.ndarray, matches: np.ndarray, shorts: np.ndarray, prefixes: list[np.ndarray], parities: list[np.ndarray], percent: int
) -> np.ndarray:
    """Positions of sets that may link with one of another group, left against right, and meet it at no smaller token."""
    heads = _Common(prefixes)
    before = _Common([p[:n][p[:n] < token] for p, n in zip(prefixes, shorts, strict=True)])
    lengths, folded = np.array([len(p) for p in parities]), {}
    for length in np.unique(lengths):
        folded[length] = np.zeros((len(parities), length), np.uint8)
        for j in np.flatnonzero(lengths >= length):
            folded[length][j] = _folded(parities[j], length)
    marked, right = np.zeros(len(groups), bool), np.flatnonzero(role & 2)
    for i in np.flatnonzero(role & 1):
        js = right[groups[right] != groups[i]]
        if role[i] == 3:
            js = js[(role[js] != 3) | (js > i)]
        js = js[~marked[js]] if marked[i] else js
        js = js[100 * np.minimum(sizes[js], sizes[i]) >= percent * np.maximum(sizes[js], sizes[i])]
        least = np.minimum(lengths[js], lengths[i])
        apart = np.zeros(len(js), np.int64)
        for length in np.unique(least):
            at = least == length
            apart[at] = np.bitwise_count(folded[length][js[at]] ^ folded[length][i]).sum(axis=1)
        js = js[apart <= most_difference(sizes[js] + sizes[i], percent)]
        if len(js):
            js = js[(before.count(i, js) == 0) & (heads.count(i, js) >= np.minimum(matches[js], matches[i]))]
        if len(js):
            marked[i] = marked[js] = True
    return np.flatnonzero(marked)


def block_links(groups: np.ndarray, role: np.ndarray, matches: np.ndarray, prefixes: list[np.ndarray], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Positions of linked pairs, left against right, that join groups: fewer than there are sets."""
    joined, links = _Groups(groups), []
    if joined.of.max() == 0:
        return links
    sizes = np.array([len(s) for s in sets])
    heads, whole = _Common(prefixes), None
    right = np.flatnonzero(role & 2)
    for i in np.flatnonzero(role & 1):
        js = right[joined.of[right] != joined.of[i]]
        if role[i] == 3:
            js = js[(role[js] != 3) | (js > i)]
        js = js[100 * np.minimum(sizes[js], sizes[i]) >= percent * np.maximum(sizes[js], sizes[i])]
        if len(js):
            js = js[heads.count(i, js) >= np.minimum(matches[js], matches[i])]
        for k in range(0, len(js), 64):
            part = js[k : k + 64]
            part = part[joined.of[part] != joined.of[i]]
            if not len(part):
                continue
            whole = whole or _Common(sets)
            shared = whole.count(i, part)
            for j in part[100 * shared >= percent * (sizes[part] + sizes[i] - shared)]:
                if joined.of[j] != joined.of[i]:
                    joined.join(i, j)
                    links.append((int(i), int(j)))
    return links


_TASK = ("token", "class", "i", "j")


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each task with more than one, of rows sorted by task."""
    current, kept = None, []
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in _TASK])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), len(batch)]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            if kept and tuple(keys[:, start]) != current:
                if sum(map(len, kept)) > 1:
                    yield pa.Table.from_batches(kept).combine_chunks()
                kept = []
            current = tuple(keys[:, start])
            kept.append(batch.slice(start, stop - start))
    if sum(map(len, kept)) > 1:
        yield pa.Table.from_batches(kept).combine_chunks()


def _values(group: pa.Table, *names: str) -> list[np.ndarray]:
    return [group.column(n).to_numpy() for n in names]


def _packed(group: pa.Table, name: str, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), kind) for v in group.column(name)]


def _prefixes(group: pa.Table) -> list[np.ndarray]:
    return [p.values.to_numpy() for p in group.column("prefix")]


def _candidates(percent: int):
    """Over rows sorted by task: those of sets that have a candidate in their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _tasks(batches):
            numbers = _values(group, "grp", "role", "n", "matches", "short")
            found = block_candidates(group.column("token")[0].as_py(), *numbers, _prefixes(group), _packed(group, "parity", np.uint8), percent)
            yield from group.select([*_TASK, "role", "node", "grp"]).take(pa.array(found, pa.int64())).combine_chunks().to_batches()

    return run


def _compared(percent: int):
    """Over rows sorted by task: the links of each task's sets that join groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _tasks(batches):
            found = block_links(*_values(group, "grp", "role", "matches"), _prefixes(group), _packed(group, "members", np.uint64), percent)
            node = group.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([node[x[k]] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _block_links(left: DataFrame, ready: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Links among the sets of each list that no pivot has found."""
    dealt = _dealt(left, ready, percent).join(ready.select("node", "n", "matches", "short", "prefix", "parity"), "node")
    rows = dealt.repartition(*_TASK).sortWithinPartitions(*_TASK).select(*_TASK, "role", "node", "grp", "n", "matches", "short", "prefix", "parity")
    near = scratch.save(rows.mapInArrow(_candidates(percent), "token bigint, class int, i int, j int, role int, node bigint, grp bigint"))
    members = fetch(near.select("node").distinct())
    whole = near.join(ready.select("node", "matches", "prefix"), "node").join(members, "node").repartition(*_TASK).sortWithinPartitions(*_TASK)
    return scratch.save(whole.select(*_TASK, "role", "node", "grp", "matches", "prefix", "members").mapInArrow(_compared(percent), "a bigint, b bigint"))


def _maybe_among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id hashes as one of ``ids(doc_id)`` does; ``2 ** FILTER_BITS`` bits are broadcast, whatever the input."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    bits = ids.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    at = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, at % 8) == 1
    return docs.join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col("bucket")).where(held).select("doc_id", "text")


def _node(digest: str, salt: int) -> Column:
    """Number of the distinct set with this digest."""
    return F.xxhash64(F.lit(salt), digest)


def shingle_join(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Group documents linked by sets of word shingles of at least ``percent`` / 100 similarity, exactly.

    Returns doc_id, n_shingles and component_id (smallest doc_id reachable
    over links, itself included), one row per row of ``docs`` (doc_id and
    text are read; other columns may be there, whatever their names).

    Words are the runs of ``[^\\x20\\x09-\\x0D]`` of the whole text with A-Z
    lower-cased; fewer words than a shingle has are one shingle.  Null and
    blank texts have an empty set and link with nothing.  A null doc_id links
    with nothing: its component_id is null.  Rows are judged by their own
    text, also where a doc_id is repeated; equal sets are compared once.  An
    empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.save(longest_prefixes(docs, shingle_words, percent, count_sketch(docs, shingle_words)))
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    tasks = scratch.tasks_for(signed.count())
    # a node is a distinct set; its smallest document stands for it
    classes = scratch.save(usable.groupBy("digest").agg(F.min("doc_id").alias("rep")), tasks=tasks)
    # numbers follow from digests, so that sets needn't be joined to get them; another salt where two are alike
    salt, held = 0, classes.count()
    while classes.select(_node("digest", salt)).distinct().count() < held:
        salt += 1
    usable, classes = (rows.withColumn("node", _node("digest", salt)) for rows in (usable, classes))
    own = usable.drop("node").join(classes.withColumnRenamed("digest", "d"), (usable.digest == F.col("d")) & (usable.doc_id == F.col("rep")))
    # rows that repeat a doc_id can stand for a set twice
    repeated = usable.select("doc_id").distinct().count() < usable.count()
    once = lambda rows: rows.dropDuplicates(["node"]) if repeated else rows
    ready = adaptive_prefixes(once(own.select("node", F.col("n_shingles").alias("n"), "prefix")), percent, tasks)
    ready = scratch.save(ready.join(usable.groupBy("node").agg(F.first("parity").alias("parity")), "node"), tasks=tasks)

    def fetch(nodes: DataFrame) -> DataFrame:
        """(node, members) of these nodes, and maybe of others where a doc_id is repeated."""
        wanted = scratch.save(classes.join(nodes, "node", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), tasks=tasks)
        # not a semi-join, which Spark would move in front of the filter
        sets = _sets(_maybe_among(docs, wanted).join(wanted, "doc_id").select("doc_id", "text"), shingle_words)
        return scratch.save(once(sets.select(_node("digest", salt).alias("node"), "members")))

    postings = scratch.save(ready.select(F.explode(F.slice("prefix", F.lit(1), F.col("short"))).alias("token"), "node"), tasks=4 * tasks)
    links, rest, before = None, postings.withColumn("grp", F.col("node")), postings.count()
    while True:
        found, swept = _sweep(rest, ready, fetch, percent, tasks)
        links = found if links is None else links.unionByName(found)
        rest = _labelled(swept, links, tasks)
        before, after = rest.count(), before
        if 2 * before > after or not before:
            break
    if before:
        links = links.unionByName(_block_links(_different_lists(rest), ready, fetch, percent))

    groups = scratch.save(connected_components(links), tasks=tasks)
    roots = groups.select(F.col("component").alias("node"), "component").distinct().unionByName(groups)
    smallest = roots.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    named = scratch.save(roots.join(smallest, "component").select("node", "component_id"), tasks=tasks)
    owners = scratch.save(classes.join(named, "node", "left").select("digest", F.coalesce("component_id", "rep").alias("owner")), tasks=tasks)
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("owner")).otherwise(F.col("doc_id")))
    return signed.select("doc_id", "n_shingles", "digest").join(owners, "digest", "left").select("doc_id", "n_shingles", component.alias("component_id"))
