"""Document scores of a bigram model smoothed by deleted interpolation.

    p(w | v) = l2 c(v, w) / c(v) + l1 c(w) / N + l0 / (V + 1)

The weights depend on how often the context v was seen (buckets by powers of
two).  They are learned by expectation-maximisation on held-out counts:
documents are dealt to ``FOLDS`` folds by a hash of their id, and each fold
in turn is predicted from counts from which its own are deleted.  Held-out
tokens enter as whole numbers of tokens by bucket and class of probability,
so weights and scores don't depend on how the corpus is cut into files.

Counts cover the whole corpus and are exchanged in packed form.  A block is
a bounded number of tokens.  It sends each of its distinct words and word
pairs once a fold, with its own count, to the shard that owns the hash; the
shard adds up and returns the totals in the same order.  So frequent words
cost a few entries for each block, and no table of all words or pairs is in
one place.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stresslens.llm import scratch
from stresslens.llm.words import hash_texts, mix

#: Tokens of a block and terms of a shard, about.
BLOCK, SHARD = 1_000_000, 3_000_000
#: Blocks there are at least, so that small corpora are spread too.
LEAST_BLOCKS = 16
#: Folds of held-out counts, a power of two, and its bits.
FOLDS, FOLD_BITS = 16, np.uint64(4)
#: Context-frequency buckets: 0, 1, 2-3, 4-7, ...
BUCKETS = 24
#: Classes of probabilities: so many for each halving, over so many halvings; class 0 is for none.
FINE, HALVINGS = 4, 50
CLASSES = FINE * HALVINGS + 1
ROUNDS = 60
_END = mix(np.array([0x5EED], np.uint64))[0]
_LOW48 = np.uint64(16)


def _crc(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def held_out(doc_id: int | None) -> bool:
    """Documents that the model doesn't learn from."""
    return _crc(doc_id) % 7 == 2


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 up by planes: all lowest bytes, all next ones, as many as the largest needs; the first byte says how many.

    Planes of high bytes are nearly constant, so that the files' and the
    shuffle's compression takes them away.
    """
    planes = -(-int(numbers.max(initial=0)).bit_length() // 8)
    return bytes([planes]) + numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    wide = np.zeros((8, n), np.uint8)
    wide[: data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], n)
    return np.ascontiguousarray(wide.T).view("<u8").reshape(n)


def _deltas(keys: np.ndarray) -> bytes:
    """Sorted keys as the first and the packed steps from each to the next."""
    return keys[:1].tobytes() + _packed(np.diff(keys))


def _from_deltas(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(data[:8], np.uint64), _unpacked(data[8:], n - 1)]), dtype=np.uint64)


class _Block:
    """The tokens of a block, and its terms: words and pairs, each once a fold, as sorted codes (hash and fold)."""

    def __init__(self, row: dict):
        self.docs = np.frombuffer(row["docs"], np.int64)
        self.known_ids = np.frombuffer(row["known_ids"], bool)
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        words, tokens = _from_deltas(row["words"], row["n_words"]), _unpacked(row["tokens"], int(self.lengths.sum())).astype(np.int64)
        crcs = [_crc(int(d) if k else None) for d, k in zip(self.docs, self.known_ids, strict=True)]
        self.held = np.array([c % 7 == 2 for c in crcs], bool)
        self.learns = np.repeat(~self.held, self.lengths)
        self.fold = np.repeat(np.array([c // 7 % FOLDS for c in crcs], np.uint64), self.lengths)
        ends = np.cumsum(self.lengths)
        self.firsts = ends - self.lengths
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.firsts] = np.searchsorted(words, _END)  # a text starts after an end
        self.word_codes, self.word_of = np.unique(words[tokens] >> FOLD_BITS << FOLD_BITS | self.fold, return_inverse=True)
        self.before = np.empty_like(self.word_of)
        self.before[1:] = self.word_of[:-1]
        self.before[self.firsts] = self.word_of[ends - 1]
        keys = mix(mix(words)[before] + words[tokens]) >> _LOW48
        self.pair_codes, self.pair_of = np.unique(keys << FOLD_BITS | self.fold, return_inverse=True)
        self.word_counts = np.bincount(self.word_of[self.learns], minlength=len(self.word_codes)).astype(np.uint32)
        self.pair_counts = np.bincount(self.pair_of[self.learns], minlength=len(self.pair_codes)).astype(np.uint32)


def blocks(docs: DataFrame, size: int) -> DataFrame:
    """The corpus as rows of about ``size`` tokens; each text's words are followed by an end."""

    def pack(block: int, ids: list, texts: list) -> dict:
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        every = np.concatenate([np.append(t, _END) for t in texts])
        words, tokens = np.unique(every, return_inverse=True)
        return {
            "block": block,
            "docs": np.array([i or 0 for i in ids], np.int64).tobytes(), "known_ids": np.array([i is not None for i in ids]).tobytes(),
            "lengths": lengths.tobytes(), "n_words": len(words), "words": _deltas(words), "tokens": _packed(tokens),
        }

    sides = [(n, pa.binary()) for n in ("docs", "known_ids", "lengths", "words", "tokens")]
    schema = pa.schema([("block", pa.int64()), ("n_words", pa.int64()), *sides])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            names = batch.column(0).to_pylist()
            for row, hashes, _ in hash_texts(batch.column(1)):
                ids.append(names[row])
                texts.append(hashes.copy())
                held += len(hashes) + 1
                if held >= size:
                    yield pa.RecordBatch.from_pylist([pack(block, ids, texts)], schema)
                    ids, texts, held, block = [], [], 0, block + 1
        if ids:
            yield pa.RecordBatch.from_pylist([pack(block, ids, texts)], schema)

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "block bigint, n_words bigint, docs binary, known_ids binary, lengths binary, words binary, tokens binary")


def _shard_of(codes: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """The shard of each of sorted codes of so many bits, in order."""
    return np.minimum((codes >> np.uint64(bits - 48)).astype(float) * (shards / 2.0**48), shards - 1).astype(np.int64)


_SENT = "shard int, block bigint, n_words bigint, words binary, word_counts binary, n_pairs bigint, pairs binary, pair_counts binary"


def sent_terms(table: DataFrame, shards: int) -> DataFrame:
    """For each block and shard: the block's terms there, with its own training counts.  Shards without any get no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row)
                of_words, of_pairs = _shard_of(b.word_codes, 64, shards), _shard_of(b.pair_codes, 52, shards)
                used = np.union1d(of_words, of_pairs)
                spans = [np.searchsorted(of, used, side) for of in (of_words, of_pairs) for side in ("left", "right")]
                out = [
                    (s, row["block"], int(w1 - w0), _deltas(b.word_codes[w0:w1]), _packed(b.word_counts[w0:w1]),
                     int(p1 - p0), _deltas(b.pair_codes[p0:p1]), _packed(b.pair_counts[p0:p1]))
                    for s, w0, w1, p0, p1 in zip(used.tolist(), *spans, strict=True)
                ]
                kinds = (pa.int32(), pa.int64(), *(pa.int64(), pa.binary(), pa.binary()) * 2)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in _SENT.split(", ")])

    return table.mapInArrow(run, _SENT)


_RETURNED = "block bigint, shard int, n_words bigint, word_totals binary, word_own binary, n_pairs bigint, pair_totals binary, pair_own binary, tokens array<bigint>, types bigint"


def _sums(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, list[bytes], list[bytes], np.ndarray]:
    """Counts by term, and in the order in which they were sent each entry's total and its fold's; counts by fold."""
    every, n = np.concatenate(codes), np.concatenate(counts).astype(float)
    ends = np.cumsum([len(c) for c in codes])[:-1]
    _, inverse = np.unique(every >> FOLD_BITS, return_inverse=True)
    totals = np.bincount(inverse, weights=n).astype(np.int64)
    _, own = np.unique(every, return_inverse=True)
    parts = (totals[inverse], np.bincount(own, weights=n).astype(np.int64)[own])
    by_fold = np.bincount((every & np.uint64(FOLDS - 1)).astype(np.int64), weights=n, minlength=FOLDS).astype(np.int64)
    return totals, *([_packed(x) for x in np.split(part, ends)] for part in parts), by_fold


def _add_up(group: pa.Table) -> pa.Table:
    """A shard's totals for each block, in the order it sent; the shard's own sums stand in its first row."""
    columns = {n: group.column(n).to_pylist() for n in group.column_names}

    def summed(name: str) -> tuple:
        sent = list(zip(columns[f"{name}s"], columns[f"{name}_counts"], columns[f"n_{name}s"], strict=True))
        return _sums([_from_deltas(d, n) for d, _, n in sent], [_unpacked(c, n) for _, c, n in sent])

    terms, words, own_words, by_fold = summed("word")
    _, pairs, own_pairs, _ = summed("pair")
    rest = len(words) - 1
    return pa.table({
        "block": pa.array(columns["block"], pa.int64()), "shard": pa.array(columns["shard"], pa.int32()),
        "n_words": pa.array(columns["n_words"], pa.int64()), "word_totals": pa.array(words, pa.binary()), "word_own": pa.array(own_words, pa.binary()),
        "n_pairs": pa.array(columns["n_pairs"], pa.int64()), "pair_totals": pa.array(pairs, pa.binary()), "pair_own": pa.array(own_pairs, pa.binary()),
        "tokens": pa.array([by_fold.tolist()] + [[0] * FOLDS] * rest, pa.list_(pa.int64())), "types": pa.array([int((terms > 0).sum())] + [0] * rest, pa.int64()),
    })


_COUNTS = {"word_totals": "n_words", "word_own": "n_words", "pair_totals": "n_pairs", "pair_own": "n_pairs"}


def _joined(block: pa.Table, returned: pa.Table) -> tuple:
    """A block with its words' and pairs' totals and those of their folds."""
    rows = sorted(returned.to_pylist(), key=lambda r: r["shard"])
    return _Block(block.to_pylist()[0]), *(np.concatenate([_unpacked(r[c], r[n]) for r in rows]).astype(np.int64) for c, n in _COUNTS.items())


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)


def _class(p: np.ndarray) -> np.ndarray:
    """Classes of probabilities, 0 for none."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(CLASSES - 1 + np.round(FINE * np.log2(p)), 1, CLASSES - 1), 0).astype(np.int64)


def _probability(classes: np.ndarray) -> np.ndarray:
    """What stands for the probabilities of a class."""
    return np.where(classes > 0, 2.0 ** ((classes - (CLASSES - 1)) / FINE), 0.0)


def _held_out_table(tokens: list[int]):
    """Held-out tokens by context bucket and classes of the two estimates; ``tokens`` of each fold."""
    rest = np.maximum(1, sum(tokens) - np.array(tokens, np.int64))

    def run(block: pa.Table, returned: pa.Table) -> pa.Table:
        b, words, own_words, pairs, own_pairs = _joined(block, returned)
        words, pairs, at = words - own_words, pairs - own_pairs, b.learns
        context = words[b.before[at]]
        p2, p1 = pairs[b.pair_of[at]] / np.maximum(context, 1), words[b.word_of[at]] / rest[b.fold[at].astype(np.int64)]
        keys, n = np.unique((_bucket(context) * CLASSES + _class(p2)) * CLASSES + _class(p1), return_counts=True)
        return pa.table({"key": pa.array(keys, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def learn_weights(table: np.ndarray, types: int) -> np.ndarray:
    """Weights (bucket, component) by EM from rows (key, tokens); components pair, word, any."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    if len(table):
        table = table[np.argsort(table[:, 0])]
        key, n = table[:, 0], table[:, 1].astype(float)
        bucket = key // CLASSES**2
        parts = np.stack([_probability(key // CLASSES % CLASSES), _probability(key % CLASSES), np.full(len(n), 1 / (types + 1))], axis=1)
        for _ in range(ROUNDS):
            share = weights[bucket] * parts
            share *= (n / share.sum(axis=1))[:, None]
            expected = np.ones((BUCKETS, 3))
            np.add.at(expected, bucket, share)
            weights = expected / expected.sum(axis=1, keepdims=True)
    # an unseen context has no pair estimate
    weights[0] = [0, *(weights[0, 1:] / weights[0, 1:].sum())]
    return weights


def _scorer(tokens: int, types: int, weights: np.ndarray):
    def run(block: pa.Table, returned: pa.Table) -> pa.Table:
        b, words, _, pairs, _ = _joined(block, returned)
        count, context = words[b.word_of], words[b.before]
        w = weights[_bucket(context)]
        p = w[:, 0] * pairs[b.pair_of] / np.maximum(context, 1) + w[:, 1] * count / max(1, tokens) + w[:, 2] / (types + 1)
        per_doc = lambda x: np.add.reduceat(x, b.firsts)
        return pa.table({
            "doc_id": pa.array(b.docs, pa.int64(), mask=~b.known_ids), "held_out": pa.array(b.held), "n_tokens": pa.array(b.lengths),
            "n_known": pa.array(per_doc((count > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(b.docs), tokens, np.int64)),
            "base_score": pa.array(per_doc(np.log10((count + 1) / (tokens + types + 1)))), "score": pa.array(np.round(per_doc(np.log10(p)), 6)),
        })

    return run


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_documents(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Scores are log10 probabilities of the whole text with its end.  A null
    or empty text is an end alone; a null doc_id counts as the empty string
    when documents are held out or dealt to folds; repeated rows are learned
    and scored each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)) + 6 * F.count("*")).first()[0] / 6
    n_blocks = max(LEAST_BLOCKS, -(-int(size) // BLOCK))
    # a bucket holds several blocks where there are more than the session allows buckets; tasks take them one by one
    buckets = min(n_blocks, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    shards = max(2, -(-int(size) // SHARD))
    name = f"lm_{uuid.uuid4().hex}"
    try:
        # both tables are bucketed alike by block: the two passes below join them where they are
        blocks(docs, max(1, int(size) // n_blocks)).write.bucketBy(buckets, "block").option("compression", "zstd").saveAsTable(f"{name}_blocks")
        table = spark.table(f"{name}_blocks")
        returned = sent_terms(table, shards).groupBy("shard").applyInArrow(_add_up, _RETURNED)
        returned.write.bucketBy(buckets, "block").option("compression", "zstd").saveAsTable(f"{name}_totals")
        totals = spark.table(f"{name}_totals")
        by_fold = [F.coalesce(F.sum(F.get("tokens", F.lit(k))), F.lit(0)) for k in range(FOLDS)]
        *tokens, types = totals.agg(*by_fold, F.coalesce(F.sum("types"), F.lit(0))).first()

        pairs = table.groupBy("block").cogroup(totals.select("block", "shard", "n_words", "n_pairs", *_COUNTS).groupBy("block"))
        classes = pairs.applyInArrow(_held_out_table(tokens), "key bigint, n bigint")
        rows = classes.groupBy("key").agg(F.sum("n")).collect()  # at most BUCKETS * CLASSES * CLASSES numbers
        weights = learn_weights(np.array([tuple(r) for r in rows], np.int64).reshape(-1, 2), types)
        return scratch.save(pairs.applyInArrow(_scorer(sum(tokens), types, weights), SCORES))
    finally:
        for part in ("blocks", "totals"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{part}")
