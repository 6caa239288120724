"""A stored full-text index in segments, searched by blocks of which most are never opened.

Documents of a segment are cut into blocks of ``BLOCK`` documents as they come
from their source; a row of a segment is one block: its documents, its terms
and where each of them stands, so that a block is written and read whole and
texts are never shuffled.

A search first takes from each block what the asked terms have there.  Blocks
are then dealt in chunks to tasks, beside the queries.  The greatest weight of
each term in a block adds up to the bound of a query there; in a chunk the
blocks with the greatest bounds are scored, their k-th score is one that the
answer reaches, and only blocks whose bound reaches it too are scored after
them.  What is skipped can't be among the first k, so the answer equals that
of scoring everything.  A task holds a chunk, a block of queries and about
``HELD`` scores, and only k of each query (and rows that may tie with the
last of them) leave it.

The index is a log of versions (``sources.versioned``): documents are added
as a new segment, deleted ones are listed, segments of like size are merged
into one, and nothing is written when the source is the one that the index
was built from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stresslens.operators.retrieval import top
from stresslens.sources.shared import kept
from stresslens.sources.versioned import VersionLog

#: Documents of a block (65,536 at most); segments of a size tier that are merged; how many times larger a tier's segments are.
BLOCK, FAN_IN = 128, 4
#: Blocks of a chunk and queries that a task holds at once, about; scores that it holds before all but the first are dropped.
CHUNK, QUERIES, HELD = 64, 16_384, 1_000_000
#: The parameters of BM25.
K1, B = 1.2, 0.75
#: Scores are rounded to this many places before they are ranked.
DIGITS = 6
#: What may lie between two scores that are equal when rounded, with a place to spare.
_SLACK = 2 * 10.0**-DIGITS


def fingerprint(docs: DataFrame) -> str:
    """What tells whether ``docs(id, words)`` are the same rows as before: their number, and two sums of their hashes."""
    rows = docs.select(F.xxhash64("id", "words").alias("h"))
    n, x, s = rows.agg(F.count("*"), F.coalesce(F.bit_xor("h"), F.lit(0)), F.coalesce(F.sum(F.pmod("h", F.lit(1 << 31))), F.lit(0))).first()
    return f"{n}:{x}:{s}"


def _inverse(df: Column, n: int) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def _row(ids: pa.Array, sizes: np.ndarray, terms: pa.Array, code: np.ndarray, doc: np.ndarray, tf: np.ndarray | None = None) -> dict:
    """A block's row: documents, and for each of its terms (``code`` is a place in ``terms``) the documents (places in ``ids``) and counts.

    Entries that repeat a term and a document are counted if ``tf`` isn't given.
    """
    order = np.asarray(pc.sort_indices(terms))
    rank = np.empty(len(order), "int64")
    rank[order] = np.arange(len(order))
    key = rank[code] * len(ids) + doc
    if tf is None:
        key, tf = np.unique(key, return_counts=True)
    else:
        sort = np.argsort(key)
        key, tf = key[sort], tf[sort]
    counts = np.bincount(key // max(1, len(ids)), minlength=len(order))
    there = np.flatnonzero(counts)
    at = (key % max(1, len(ids))).astype("<u2").tobytes()
    return {"ids": ids, "sizes": pa.array(sizes, pa.int32()), "terms": terms.take(pa.array(order[there])), "counts": pa.array(counts[there], pa.int32()), "at": at, "tfs": tf.astype("<i4").tobytes()}


def _table(rows: list[dict], numbers: list[int], schema: pa.Schema, **others: list) -> pa.Table:
    """Rows of blocks as a table of the columns of ``schema``."""
    columns = []
    for field in schema:
        if field.name in ("at", "tfs"):
            columns.append(pa.array([r[field.name] for r in rows], field.type))
        elif field.name == "block" or field.name in others:
            columns.append(pa.array(numbers if field.name == "block" else others[field.name], field.type))
        else:
            ends = np.cumsum([0, *[len(r[field.name]) for r in rows]])
            values = pa.concat_arrays([r[field.name].cast(field.type.value_type) for r in rows]) if rows else pa.array([], field.type.value_type)
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))
    return pa.table(columns, schema=schema)


def _schema(ids: pa.DataType, *more: pa.Field) -> pa.Schema:
    lists = {"ids": ids, "sizes": pa.int32(), "terms": pa.string(), "counts": pa.int32()}
    return pa.schema([*more, ("block", pa.int64()), *[(n, pa.list_(t)) for n, t in lists.items()], ("at", pa.binary()), ("tfs", pa.binary())])


def _cut(most: int):
    """For ``mapInArrow``: documents (id, words) as rows of blocks, numbered by task."""

    def block(docs: pa.Table) -> dict:
        ids, words = (pa.concat_arrays(docs[c].chunks) for c in ("id", "words"))
        sizes = np.asarray(pc.fill_null(pc.list_value_length(words), 0))
        flat, doc = pc.list_flatten(words).cast(pa.string()), np.repeat(np.arange(len(sizes)), sizes)
        if flat.null_count:
            doc, flat = doc[np.asarray(flat.is_valid())], flat.drop_null()
        coded = flat.dictionary_encode()
        return _row(ids, sizes, coded.dictionary, np.asarray(coded.indices), doc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = None, TaskContext.get().partitionId() << 20
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            while held.num_rows >= most:
                yield from _table([block(held.slice(0, most))], [number], _schema(held.schema.field("id").type)).to_batches()
                held, number = held.slice(most), number + 1
        if held is not None and held.num_rows:
            yield from _table([block(held)], [number], _schema(held.schema.field("id").type)).to_batches()

    return run


class _Chunk:
    """Rows of blocks taken apart: an entry for each term of each document, and where blocks begin."""

    def __init__(self, blocks: pa.Table):
        held = pc.is_valid(blocks["sizes"])
        others, blocks = blocks.filter(pc.invert(held)), blocks.filter(held)
        one = lambda c: pa.concat_arrays(blocks[c].chunks) if blocks[c].num_chunks else pa.array([], blocks.schema.field(c).type)
        length = lambda c: np.asarray(pc.list_value_length(one(c)), "int64")
        raw = lambda c, kind: np.frombuffer(b"".join(blocks[c].to_pylist()), kind)
        self.block = np.asarray(one("block"))
        self.ids, self.sizes = pc.list_flatten(one("ids")), np.asarray(pc.list_flatten(one("sizes")))
        self.terms, self.counts = pc.list_flatten(one("terms")), np.asarray(pc.list_flatten(one("counts")), "int64")
        n = length("ids")
        #: the first document of each block (and the end); the block of each of ``terms``
        self.first, self.owner = np.cumsum([0, *n]), np.repeat(np.arange(len(n)), length("terms"))
        #: of each entry: its place in ``terms``, its document and count
        self.term = np.repeat(np.arange(len(self.terms)), self.counts)
        self.doc = self.first[self.owner[self.term]] + raw("at", "<u2")
        self.tf = raw("tfs", "<i4")
        self.alive, place = np.ones(len(self.ids), bool), {b: k for k, b in enumerate(self.block.tolist())}
        for b, dead in zip(others["block"].to_pylist(), others["dead"].to_pylist() if others.num_rows else [], strict=True):
            if b in place:
                at = slice(self.first[place[b]], self.first[place[b] + 1])
                self.alive[at] = ~np.asarray(pc.is_in(self.ids[at], pa.array(dead, self.ids.type)))

    def rows(self, coded: np.ndarray, names: pa.Array, entries: np.ndarray, edges: np.ndarray) -> list[dict]:
        """Rows of the living documents between ``edges``, of ``entries`` alone; ``coded`` are the places of their terms in ``names``."""
        entries = entries[self.alive[self.doc[entries]]]
        entries = entries[np.argsort(self.doc[entries], kind="stable")]
        out, ends = [], np.searchsorted(self.doc[entries], edges)
        for a, z, low, high in zip(edges[:-1], edges[1:], ends[:-1], ends[1:], strict=True):
            live, mine = np.flatnonzero(self.alive[a:z]), entries[low:high]
            place = np.cumsum(self.alive[a:z]) - 1
            codes, code = np.unique(coded[self.term[mine]], return_inverse=True)
            out.append(_row(self.ids.take(pa.array(a + live)), self.sizes[a + live], names.take(pa.array(codes)), code, place[self.doc[mine] - a], self.tf[mine]))
        return out


def _asked_of(blocks: pa.Table, asked: pa.Table) -> pa.Table:
    """The rows of a chunk with the entries of asked terms alone and without deleted documents, and a row (block -1) with the terms' documents."""
    schema = _schema(blocks.schema.field("ids").type.value_type, pa.field("chunk", pa.int32()))
    if not blocks.num_rows or not asked.num_rows:
        return _table([], [], schema, chunk=[])
    chunk, names = _Chunk(blocks), pa.concat_arrays(asked["term"].chunks)
    if not len(chunk.block):
        return _table([], [], schema, chunk=[])
    found = pc.index_in(chunk.terms, value_set=names)
    coded = np.asarray(found.fill_null(-1))
    rows = chunk.rows(coded, names, np.flatnonzero(coded[chunk.term] >= 0), chunk.first)
    # how many documents have a term is summed up in the chunk
    coded, owned = np.asarray(pc.index_in(pa.concat_arrays([r["terms"] for r in rows]), value_set=names)), np.concatenate([np.asarray(r["counts"]) for r in rows])
    df = np.bincount(coded, owned, len(names)).astype("int64")
    there = np.flatnonzero(df)
    rows.append({"ids": chunk.ids[:0], "sizes": pa.array([], pa.int32()), "terms": names.take(pa.array(there)), "counts": pa.array(df[there], pa.int32()), "at": b"", "tfs": b""})
    return _table(rows, [*chunk.block.tolist(), -1], schema, chunk=[blocks["chunk"][0].as_py()] * len(rows))


def _repacked(most: int):
    """For ``applyInArrow``: the living documents of a chunk in new blocks of ``most``."""

    def run(blocks: pa.Table) -> pa.Table:
        chunk = _Chunk(blocks)
        coded = chunk.terms.dictionary_encode()
        live = np.flatnonzero(chunk.alive)
        edges = np.array([*live[::most], len(chunk.ids)]) if len(live) else np.array([0])
        rows = chunk.rows(np.asarray(coded.indices), coded.dictionary, np.arange(len(chunk.doc)), edges)
        begin = blocks["chunk"][0].as_py() << 20
        return _table(rows, [begin + k for k in range(len(rows))], _schema(chunk.ids.type))

    return run


class _Best:
    """The first ``k`` scores of each of some queries, and whatever may tie with the last of them when rounded."""

    def __init__(self, queries: int, k: int, rank: np.ndarray):
        self.k, self.rank, self.cut, self.parts, self.held = k, rank, np.full(queries, -np.inf), [], 0

    def add(self, q: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((q, doc, score))
        self.held += len(q)
        if self.held > HELD:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Drop what can't be among the first; (query, document, score) of what is left."""
        if not self.parts:
            return np.array([], "int64"), np.array([], "int64"), np.array([])
        q, doc, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((self.rank[doc], -score, q))
        q, doc, score = q[order], doc[order], score[order]
        at = np.arange(len(q))
        place = at - np.searchsorted(q, q)
        last = place == self.k - 1
        self.cut[q[last]] = score[last]
        begins = np.r_[True, (q[1:] != q[:-1]) | (score[1:] != score[:-1])][: len(q)]
        equal = at - np.maximum.accumulate(np.where(begins, at, 0))  # of equal scores only the first k ids
        keep = (place < self.k) | ((score >= self.cut[q] - _SLACK) & (equal < self.k))
        self.parts, self.held = [(q[keep], doc[keep], score[keep])], 0
        return self.parts[0]


def _first_of(mean: float, k: int, first: int):
    """For ``applyInArrow``: the first ``k`` of a chunk for each query (qid, id, score), and (qid, blocks, opened) of the chunk."""

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        types = [("qid", asked.schema.field("qid").type), ("id", blocks.schema.field("ids").type.value_type), ("score", pa.float64()), ("blocks", pa.int32()), ("opened", pa.int32())]
        if not blocks.num_rows or not asked.num_rows:
            return pa.schema(types).empty_table()
        chunk = _Chunk(blocks)
        one = lambda c: pa.concat_arrays(asked[c].chunks)
        coded, terms, idf = one("qid").dictionary_encode(), one("term").dictionary_encode(), np.asarray(one("idf"))
        # rows of a query beside each other, its terms in one order in all chunks
        place = np.empty(len(terms.dictionary), "int64")
        place[np.asarray(pc.sort_indices(terms.dictionary))] = np.arange(len(place))
        query, code = np.asarray(coded.indices, "int64"), np.asarray(terms.indices, "int64")
        order = np.lexsort((place[code], query))
        query, code, idf = query[order], code[order], idf[order]
        n_queries, n_blocks = len(coded.dictionary), blocks.num_rows

        weight = chunk.tf * (K1 + 1.0) / (chunk.tf + K1 * (1.0 - B + B * chunk.sizes[chunk.doc] / mean))
        known = np.asarray(pc.index_in(chunk.terms, value_set=terms.dictionary).fill_null(-1), "int64")
        starts = np.cumsum(np.r_[0, chunk.counts])
        most = np.zeros((len(place), n_blocks))
        if len(weight):
            has = np.flatnonzero(known >= 0)
            most[known[has], chunk.owner[has]] = np.maximum.reduceat(weight, starts[:-1])[has]

        def summed(rows: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
            """For each query of ``rows`` (in order) the sum of idf times the row of ``values`` at its place; some queries at a time."""
            begins = np.flatnonzero(np.r_[True, query[rows][1:] != query[rows][:-1]])
            out = np.empty((len(begins), values.shape[1]))
            for low in range(0, len(begins), 1024):
                here = begins[low : low + 1024]
                end = begins[low + 1024] if low + 1024 < len(begins) else len(rows)
                out[low : low + 1024] = np.add.reduceat(idf[rows[here[0] : end], None] * values[at[here[0] : end]], here - here[0], axis=0)
            return out

        bound = summed(np.arange(len(query)), most, code)
        best = _Best(n_queries, k, _ranks(chunk.ids))
        opened, touched = np.zeros(n_queries, "int64"), np.searchsorted(chunk.owner, np.arange(n_blocks + 1))

        def score(wanted: np.ndarray) -> None:
            for b in range(n_blocks):
                chosen = wanted[:, b] & (bound[:, b] > 0) & (bound[:, b] >= best.cut - _SLACK)
                if not chosen.any():
                    continue
                opened[chosen] += 1
                # the block as a matrix: a row for each asked term that it has
                mine = np.arange(touched[b], touched[b + 1])
                mine = mine[known[mine] >= 0]
                line = np.full(len(chunk.terms[touched[b] : touched[b + 1]]), -1)
                line[mine - touched[b]] = np.arange(len(mine))
                of = np.full(len(place), -1)
                of[known[mine]] = np.arange(len(mine))
                entries = slice(starts[touched[b]], starts[touched[b + 1]])
                at, there = line[chunk.term[entries] - touched[b]], chunk.doc[entries] - chunk.first[b]
                matrix = np.zeros((len(mine), chunk.first[b + 1] - chunk.first[b]))
                matrix[at[at >= 0], there[at >= 0]] = weight[entries][at >= 0]
                rows = np.flatnonzero(chosen[query] & (of[code] >= 0))
                found, who = summed(rows, matrix, of[code[rows]]), np.flatnonzero(chosen)
                q, doc = np.nonzero((found > 0) & (found >= best.cut[who, None] - _SLACK))
                best.add(who[q], chunk.first[b] + doc, found[q, doc])

        begin = np.zeros(bound.shape, bool)
        some = min(n_blocks, first + k // max(1, len(chunk.ids) // n_blocks))
        np.put_along_axis(begin, np.argpartition(-bound, some - 1, axis=1)[:, :some], True, axis=1)
        score(begin)
        best.settle()
        score(~begin)
        q, doc, value = best.settle()
        held = (bound > 0).sum(1)
        those = np.flatnonzero(held)
        none = lambda n, kind: pa.nulls(n, kind)
        counts = [coded.dictionary.take(pa.array(those)), none(len(those), types[1][1]), none(len(those), pa.float64()), pa.array(held[those], pa.int32()), pa.array(opened[those], pa.int32())]
        hits = [coded.dictionary.take(pa.array(q)), chunk.ids.take(pa.array(doc)), pa.array(value, pa.float64()), none(len(q), pa.int32()), none(len(q), pa.int32())]
        return pa.concat_tables([pa.table(x, schema=pa.schema(types)) for x in (hits, counts)])

    return run


def _ranks(ids: pa.Array) -> np.ndarray:
    """The place of each id in their order."""
    ranks = np.empty(len(ids), "int64")
    ranks[np.asarray(pc.sort_indices(ids))] = np.arange(len(ids))
    return ranks


class BlockIndex:
    """An index of documents ``(id, words)`` at ``path``; ids are unique, words an array of strings.

    Null ids are left out, null words count as none.  A document that is
    added again replaces the one with its id.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, VersionLog(spark, path)

    # what a version holds

    def _state(self) -> tuple[int, dict]:
        number, state = self.log.latest()
        return number, state or {"segments": [], "deletions": [], "source": None, "next": 1, "id": None}

    def _read(self, folders: list[str], part: str, schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self.log.data(f"{f}/{part}") for f in folders])

    def _blocks(self, state: dict, folders: list[str] | None = None) -> DataFrame:
        """Rows of blocks; if there are deletions, also a row for each block that has some, of its number and the deleted ids as ``dead`` alone."""
        folders = [s["folder"] for s in state["segments"]] if folders is None else folders
        rows = self._read(folders, "blocks", _columns(state))
        if not state["deletions"]:
            return rows
        # they meet their blocks in a chunk: blocks aren't shuffled for them
        return rows.unionByName(self._gone(state).groupBy("block").agg(F.collect_list("id").alias("dead")), allowMissingColumns=True)

    def _docs(self, state: dict) -> DataFrame:
        return self._read([s["folder"] for s in state["segments"]], "docs", f"id {state['id'] or 'long'}, block long, size int")

    def _gone(self, state: dict) -> DataFrame:
        return self._read(state["deletions"], "docs", f"id {state['id'] or 'long'}, block long, size int")

    def counts(self) -> dict:
        """Documents, words, segments and deleted documents of the newest version."""
        _, state = self._state()
        held = [sum(s[c] for s in state["segments"]) - state.get(f"gone_{c}", 0) for c in ("docs", "words")]
        return {"docs": held[0], "words": held[1], "segments": len(state["segments"]), "gone": state.get("gone_docs", 0)}

    # writing

    def _write_segment(self, state: dict, blocks: DataFrame) -> dict:
        """A segment of rows of blocks, whose numbers become unique among all segments; its entry for the version."""
        number = state["next"]
        folder = f"s{number:06d}"
        numbered = blocks.withColumn("block", F.col("block") + F.lit(number << 40))
        numbered.write.mode("overwrite").option("compression", "zstd").parquet(self.log.data(f"{folder}/blocks"))
        lines = self._read([folder], "blocks", _columns(state)).select("block", F.explode(F.arrays_zip("ids", "sizes")).alias("d"))
        lines.select(F.col("d.ids").alias("id"), "block", F.col("d.sizes").alias("size")).write.mode("overwrite").parquet(self.log.data(f"{folder}/docs"))
        n, words = self._read([folder], "docs", "size int").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        return {"folder": folder, "docs": n, "words": int(words)}

    def _added(self, state: dict, docs: DataFrame) -> dict:
        rows = docs.where("id is not null").select("id", F.coalesce("words", F.array().cast("array<string>")).alias("words"))
        state = state | {"id": state["id"] or rows.schema["id"].dataType.simpleString()}
        if state["segments"]:
            state = self._without(state, rows.select("id"))
        # blocks are cut where the documents are read: only their rows are written
        entry = self._write_segment(state, rows.mapInArrow(_cut(BLOCK), _columns(state)))
        segments = [*state["segments"], entry] if entry["docs"] else state["segments"]
        return state | {"segments": segments, "next": state["next"] + 1}

    def _without(self, state: dict, ids: DataFrame) -> dict:
        """The state with documents deleted; ids that aren't there change nothing."""
        there = self._docs(state).join(self._gone(state).select("id", "block"), ["id", "block"], "left_anti")
        return self._listed(state, there.join(ids.select("id").distinct(), "id", "left_semi").select("id", "block", "size"))

    def _listed(self, state: dict, rows: DataFrame) -> dict:
        """The state with ``rows(id, block, size)`` of its segments as deletions."""
        gone = kept(rows)
        n, words = gone.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        if not n:
            return state
        folder = f"d{state['next']:06d}"
        gone.write.mode("overwrite").parquet(self.log.data(f"{folder}/docs"))
        return state | {"deletions": [*state["deletions"], folder], "next": state["next"] + 1, "gone_docs": state.get("gone_docs", 0) + n, "gone_words": state.get("gone_words", 0) + int(words)}

    def ensure(self, docs: DataFrame) -> bool:
        """Build the index from ``docs`` if there is none or it was built from other rows; True if it was built."""
        number, state = self._state()
        source = fingerprint(docs)
        if state["source"] == source:
            return False
        fresh = {"segments": [], "deletions": [], "source": None, "next": state["next"], "id": None}
        self.log.commit(number + 1, self._added(fresh, docs) | {"source": source})
        return True

    def add(self, docs: DataFrame) -> None:
        """Add documents as a new segment."""
        number, state = self._state()
        self.log.commit(number + 1, self._added(state, docs) | {"source": None})

    def delete(self, ids: DataFrame) -> None:
        """Delete the documents of ``ids(id)``."""
        number, state = self._state()
        after = self._without(state, ids)
        if after is not state:
            self.log.commit(number + 1, after | {"source": None})

    def merge_segments(self, fan_in: int = FAN_IN) -> list[str]:
        """Merge segments of like size until fewer than ``fan_in`` are in each tier; what was merged is gone for good, so are its deletions."""
        merged = []
        while True:
            number, state = self._state()
            tiers: dict[int, list[dict]] = {}
            for segment in state["segments"]:
                tiers.setdefault((max(1, segment["docs"]).bit_length() - 1) // (fan_in.bit_length() - 1), []).append(segment)
            full = [t for t in sorted(tiers) if len(tiers[t]) >= fan_in]
            if not full:
                return merged
            old = [s["folder"] for s in tiers[full[0]]]
            self.log.commit(number + 1, self._merged(state, old))
            merged += old

    def _merged(self, state: dict, old: list[str]) -> dict:
        """The state with the segments ``old`` as one, and deletions only of the others."""
        gone, n = kept(self._gone(state)), _chunks(sum(s["docs"] for s in state["segments"] if s["folder"] in old))
        dealt = self._blocks(state, old).withColumn("chunk", _dealt("block", n))
        entry = self._write_segment(state, dealt.groupBy("chunk").applyInArrow(_repacked(BLOCK), _columns(state)))
        rest = [s for s in state["segments"] if s["folder"] not in old]
        fresh = state | {"segments": [*rest, entry] if entry["docs"] else rest, "deletions": [], "gone_docs": 0, "gone_words": 0, "next": state["next"] + 1}
        # deletions of segments that stay are listed anew
        others = gone.where(~F.shiftright("block", 40).isin([int(f[1:]) for f in old]))
        return self._listed(fresh, others)

    def vacuum(self) -> list[str]:
        """Delete the folders that the newest version doesn't name."""
        _, state = self._state()
        return self.log.vacuum({*[s["folder"] for s in state["segments"]], *state["deletions"]})

    # searching

    def search(self, queries: DataFrame, k: int, first: int = 4) -> DataFrame:
        """(qid, id, score, rank): the first ``k`` documents for each of ``queries(qid, term)``, as BM25 over all documents ranks them; ties by id."""
        return self.search_counted(queries, k, first)[0]

    def search_counted(self, queries: DataFrame, k: int, first: int = 4) -> tuple[DataFrame, DataFrame]:
        """The same, and (qid, blocks, opened): how many blocks hold a term of the query, and how many were scored."""
        _, state = self._state()
        held, n = self.counts(), _chunks(sum(s["docs"] for s in state["segments"]))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        asked = kept(queries.select("qid", "term").where("qid is not null and term is not null").distinct())
        dealt = self._blocks(state).withColumn("chunk", _dealt("block", n))
        words = asked.select("term").distinct().select("term", every(n).alias("chunk"))
        needed = kept(dealt.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(_asked_of, f"chunk int, {_columns(state)}"))
        df = needed.where("block < 0").select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("df"))
        known = kept(asked.join(df, "term").select("qid", "term", _inverse(F.col("df"), held["docs"]).alias("idf")))

        parts = max(1, -(-known.select("qid").distinct().count() // QUERIES))
        left = needed.where("block >= 0").withColumn("part", every(parts)).groupBy("chunk", "part")
        right = known.withColumn("part", _dealt("qid", parts)).withColumn("chunk", every(n)).groupBy("chunk", "part")
        kinds = f"qid {known.schema['qid'].dataType.simpleString()}, id {state['id'] or 'long'}, score double, blocks int, opened int"
        mean = max(1e-9, held["words"] / max(1, held["docs"]))
        found = kept(left.cogroup(right).applyInArrow(_first_of(mean, k, first), kinds))
        scored = found.where("blocks is null").select("qid", "id", F.round("score", DIGITS).alias("score"))
        counted = found.where("blocks is not null").groupBy("qid").agg(F.sum("blocks").alias("blocks"), F.sum("opened").alias("opened"))
        return top(scored, k, [F.col("score").desc(), F.col("id")]), counted


def _columns(state: dict) -> str:
    """The columns of a block's row."""
    return f"block long, ids array<{state['id'] or 'long'}>, sizes array<int>, terms array<string>, counts array<int>, at binary, tfs binary"


def _chunks(docs: int) -> int:
    return max(1, -(-docs // (BLOCK * CHUNK)))


def _dealt(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
