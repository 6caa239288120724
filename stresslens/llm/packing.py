"""Best-two-fit packing of tokenized documents into sequences of bounded length.

Documents are tokenized whole; those longer than a sequence are cut into
full pieces and a remainder.  Pieces are dealt by hash to groups of bounded
expected size, and each group is packed on its own: a bin is filled greedily
with the longest piece that still fits; then its shortest piece is replaced
by the two unpacked pieces that fit the gap so widened more tightly.  A group
ends with at most one badly filled sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stresslens.llm import scratch

CAPACITY = 4096
#: The id that ends each document.
END = 1
#: Expected pieces of a group.
GROUP = 12_000
#: What every special token of the vocabulary starts with.
SPECIAL = b"<|"
#: Distinct words that a worker process remembers.
REMEMBER = 1_500_000


class WordTokenizer:
    """Ids of whole texts from ids of their words.

    The vocabulary's rules never reach over ASCII white space, so a text's
    ids are those of its runs between white space, one after the other.  Each
    distinct run is tokenized once and remembered; a trailing full stop or
    comma after ASCII letters is a token run of its own by the vocabulary's
    splitting rule, and case is folded by it, so runs that differ in these
    share their entry.  Special tokens are looked for before case is folded:
    the runs of a text that may hold one keep their case.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}

    def _encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: set[bytes]) -> None:
        cores = {}
        for word in words:
            core, tail = (word[:-1], word[-1:]) if word[-1:] in b".," else (word, b"")
            cores[word] = (core, tail) if tail and core.isalpha() else (word, b"")
        new = list({part for pair in cores.values() for part in pair if part and part not in self.known})
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            for word, ids in zip(part, self._encode([w.decode() for w in part]), strict=True):
                self.known[word] = np.array(ids, "<u4").tobytes()
        for word, (core, tail) in cores.items():
            if tail:
                self.known[word] = self.known[core] + self.known[tail]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, one after the other."""
        split = [(raw if SPECIAL in raw else raw.lower()).split() for raw in map(str.encode, texts)]
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        new = {w for words in split for w in words if w not in known}
        if new:
            self._learn(new)
        return [b"".join([known[w] for w in words]) for words in split]


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker process, so that tasks share what it remembers."""
    return WordTokenizer(path)


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces of each row of ``docs``: doc_id, piece, start, length, ids_crc32 (and ids).

    A null or empty text is one piece that holds the end id alone.  Rows that
    repeat a doc_id give their pieces again; a null doc_id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        end = np.array([END], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                rows, ids = [], []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, packed in zip(part.column(0).to_pylist(), tokenizer(texts), strict=True):
                    packed += end
                    for piece, at in enumerate(range(0, len(packed), step)):
                        body = packed[at : at + step]
                        rows.append((doc, piece, at // 4, len(body) // 4, zlib.crc32(body)))
                        if keep_ids:
                            ids.append(np.frombuffer(body, "<u4"))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece.  All lengths lie between 1 and ``capacity``."""
    order = np.argsort(lengths, kind="stable")
    left = np.bincount(lengths, minlength=capacity + 1)
    turn = np.cumsum(left) - left  # where in ``order`` the next piece of each length is
    below = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))  # longest length up to v that is left
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def take(v: int) -> None:
        left[v] -= 1
        if not left[v]:
            below[v : np.searchsorted(below, v, "right")] = below[v - 1]

    def give_back(v: int) -> None:
        if not left[v]:
            below[v : max(v, np.searchsorted(below, v, "left"))] = v
        left[v] += 1

    number = packed = 0
    while packed < len(lengths):
        chosen, gap = [], capacity
        while v := int(below[gap]):
            take(v)
            chosen.append(v)
            gap -= v
        if gap and below[capacity]:
            smallest = chosen[-1]
            room = smallest + gap
            one = np.flatnonzero(left[: room // 2 + 1])
            if len(one):
                two = below[room - one]
                possible = (two > one) | ((two == one) & (left[one] > 1))
                total = np.where(possible, one + two, 0)
                k = int(total.argmax())
                if total[k] > smallest:
                    give_back(chosen.pop())
                    for v in (int(two[k]), int(one[k])):
                        take(v)
                        chosen.append(v)
        at = 0
        for v in chosen:
            piece = order[turn[v]]
            turn[v] += 1
            bins[piece], offsets[piece] = number, at
            at += v
        packed += len(chosen)
        number += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` (with a column ``length``, 1 to ``capacity``) and each one's sequence_id and offset.

    ``pieces`` is read twice and should be a stored table.  Ids of sequences
    are any numbers; offsets in a sequence are gapless from 0.  Pieces that
    repeat are packed each; an empty table gives no rows.  Groups are dealt by
    each row's place in the stored table, so that no id, null or repeated,
    gathers in one.  Columns sequence_id and offset of ``pieces`` are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    grp = "grp" + "_" * max((len(c) for c in pieces.columns), default=0)
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn(grp, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = best_two_fit(frame["length"].to_numpy(), capacity)
        frame["sequence_id"], frame["offset"] = (frame[grp].to_numpy().astype(np.int64) << 32) + bins, offsets
        return frame.drop(columns=grp)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return dealt.groupBy(grp).applyInPandas(run, fields + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize and pack ``docs``: one row for each piece with its place in a sequence."""
    return pack(scratch.save(tokenize(docs, path, capacity)), capacity)


def sequences(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids (array of int), each at most ``capacity`` long."""
    placed = pack(scratch.save(tokenize(docs, path, capacity, keep_ids=True)), capacity)
    parts = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
