"""Merkle manifest, filter audit and exact shingle join against plain versions, with odd rows."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stresslens.llm import audit, merkle, minhash, shinglejoin
from stresslens.llm.words import hash_texts, shingles
from tests.llm.test_llm import DOCS, SPACE, brute_components, frame, prose
from tests.llm.test_whole_queries import dense_group

UPPER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes):
    """(root, sibling hexes of each leaf level by level with the own place)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            first = at[k] - at[k] % 8
            run = nodes[first : first + 8]
            place = at[k] - first
            path.append((run[:place], run[place + 1 :]))
            at[k] //= 8
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain_manifest(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0], plain_leaf(*row), row))
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    built = {lang: plain_tree([leaf for _, leaf, _ in sorted(trees[lang], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]) for lang in order}
    root, above = plain_tree([built[lang][0] for lang in order])
    out = []
    for lang in order:
        for (doc_id, leaf, row), path in zip(sorted(trees[lang], key=lambda r: (r[0] is not None, r[0] or 0, r[1])), built[lang][1], strict=True):
            whole = path + above[order.index(lang)]
            node = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
                node = plain_leaf(doc_id, row[1] and row[1].translate(UPPER), *row[2:])
            for left, right in whole:
                node = sha("".join(left) + node + "".join(right))
            out.append((doc_id, leaf, built[lang][0], root, sha("".join("".join(a) + "".join(b) for a, b in whole)), node, node == root))
    return out


def got_manifest(docs):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return Counter(tuple(r[c] for c in names) for r in merkle.manifest(docs).collect())


@pytest.fixture(scope="module")
def leaves():
    rng = random.Random(3)
    sizes = {"en": 150, "de": 65, "fr": 8, "es": 1, None: 9, "": 2, "\U0001f600": 3, "zz": 1, "é": 1}
    rows = [(lang, k) for lang, n in sizes.items() for k in range(n)]
    rng.shuffle(rows)
    return [(i, None if i % 11 == 3 else f"Text {i} é{'X' * (i % 5)}", lang, None if i % 7 == 0 else f"s{i % 3}", None if i % 5 == 0 else i) for i, (lang, _) in enumerate(rows)]


def test_log_places_follow_completion():
    for n in (1, 2, 7, 8, 9, 64, 65, 150, 513):
        nodes = [sha(str(k)) for k in range(n)]
        sizes = merkle.level_sizes(n)
        log, top = merkle.write_segment([bytes.fromhex(x) for x in nodes], len(sizes) - 1)
        assert top.hex() == plain_tree(nodes)[0] and len(log) == merkle.WIDTH * sum(sizes)
        assert [merkle.log_position(level, k, sizes) for level, k in merkle.completion_order(sizes)] == list(range(sum(sizes)))


def test_manifest_against_a_plain_tree(spark, leaves):
    docs = spark.createDataFrame(leaves, DOCS).withColumn("rank", F.lit("clash")).withColumn("n", F.lit("clash"))
    assert got_manifest(docs) == Counter(plain_manifest(leaves))


def test_manifest_odd_rows(spark):
    rows = [(1, "A", "en", None, 1), (1, "A", "en", None, 1), (1, "b", "en", "x", None), (None, "Q", "en", "x", None), (None, None, None, None, None), (7, "long " * 200_000, "en", "y", 3)]
    assert got_manifest(spark.createDataFrame(rows, DOCS)) == Counter(plain_manifest(rows))
    assert got_manifest(spark.createDataFrame(rows[:1], DOCS)) == Counter(plain_manifest(rows[:1]))
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_a_tree_of_several_tiers(spark):
    n = 9000  # three segments of 4,096 leaves
    rows = [(k, f"t{k}", "en", "s", k) for k in range(n)] + [(n + k, f"t{k}", "de", "s", k) for k in range(5)]
    docs = spark.createDataFrame(rows, DOCS)
    assert got_manifest(docs) == Counter(plain_manifest(rows))
    ranked = merkle.ranked(docs.select("lang", "doc_id", F.unhex(F.sha2("text", 256)).alias("node")), ["lang"], ["doc_id"])
    log = merkle.log_entries(merkle.build_tiers(ranked.select("tree_id", "rank", "n", "node")))
    entries = sorted(tuple(r) for r in log.where("tree_id = 1").select("position", "level", "digest").collect())
    sizes = merkle.level_sizes(n)
    assert [e[0] for e in entries] == list(range(sum(sizes))) and [e[1] for e in entries] == [level for level, _ in merkle.completion_order(sizes)]
    top = plain_tree([sha(f"t{k}") for k in range(n)])[0]
    assert bytes(entries[-1][2]).hex() == top


def plain_mask(text):
    t = text or ""
    words = SPACE.findall(t)
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t)]


def plain_audit(rows, labels):
    fails = {}
    for k, (doc_id, text, _, _, _) in enumerate(rows):
        earlier = any(d is not None and doc_id is not None and d < doc_id and (t or "") == (text or "") for d, t, *_ in rows)
        fails[k] = dict(zip("ABCDE", [*plain_mask(text), earlier], strict=True))
    out = {}
    parts = sorted({r[3] or "" for r in rows})
    for part in parts:
        totals = Counter()
        for order in permutations("ABCDE"):
            left = [k for k, r in enumerate(rows) if (r[3] or "") == part]
            everything = list(left)
            for step, f in enumerate(order, 1):
                gone = [k for k in left if fails[k][f]]
                marks = lambda c, ks: sum(any(d == rows[k][0] and m[c] == 1 for d, *m in labels) for k in ks if rows[k][0] is not None)
                earlier = [k for k in everything if fails[k][f] and k not in left]
                left = [k for k in left if not fails[k][f]]
                alone = [k for k in everything if fails[k][f] and sum(fails[k].values()) == 1]
                totals[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(earlier), len(alone), marks(0, gone), marks(1, gone), f]
        for key, value in out.items():
            if key[0] == part:
                value[-1] = totals[value[-1]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_against_every_order(spark):
    rng = random.Random(4)
    texts = [None, "", "  ", "word " * 300, prose(rng, 250), "A LOUD TEXT " * 90, prose(rng, 230) + " 5%", prose(rng, 40), "é" * 3000, "Ab|" * 100]
    rows = [(k, rng.choice(texts), "en", rng.choice(["a", "b", None, ""]), 1) for k in range(36)]
    rows += [(5, texts[3], "en", "a", 1), (5, texts[3], "en", "b", 1), (None, texts[3], "en", "a", 1), (None, texts[4], "en", None, 1), (90, " ".join(prose(rng, 9) for _ in range(4000)), "en", "a", 1)]
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 30, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (8, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("mask", F.lit("clash")).withColumn("part", F.lit("clash")).withColumn("n", F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("n", F.lit("clash"))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in audit.filter_audit(docs, marks).collect()}
    assert got == plain_audit(rows, labels)
    assert audit.filter_audit(docs.limit(0), marks).count() == 0
    assert audit.filter_audit(docs, marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_least_squares_are_shapley_values():
    rng = random.Random(5)
    game = [0, *(rng.randrange(1000) for _ in range(31))]
    want = [Fraction(0)] * 5
    for order in permutations(range(5)):
        before = 0
        for k in order:
            want[k] += Fraction(game[before | 1 << k] - game[before], 120)
            before |= 1 << k
    assert audit.shapley_values(game) == want


def shingle_components(spark, texts, size, percent):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shinglejoin.shingle_join(frame(spark, texts), size, percent).collect()}


def near_texts(rng):
    """Texts around the threshold, short ones, shared passages, and copies."""
    base = [prose(rng, n) for n in (1, 2, 3, 4, 7, 12, 13, 14, 20, 40, 90, 200, 600)]
    out, passage = list(base), prose(rng, 120)
    for t in base:
        for _ in range(5):
            words = t.split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
            out.append(" ".join(words))
    out += [f"{prose(rng, 15)} {passage} {prose(rng, rng.randint(1, 15))}" for _ in range(25)]
    return [*out, *base[:3], None, "", "\n \t", base[5].upper()]


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_shingle_join_against_brute_force(spark, size, percent):
    texts = near_texts(random.Random(size))
    assert shingle_components(spark, texts, size, percent) == brute_components(texts, size, percent)


def test_shingle_join_of_dense_groups_and_chains(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SETS", 7)
    rng = random.Random(18)
    # near the threshold: some of a group's pairs link, others don't
    texts = dense_group(rng, 60, changed=7) + dense_group(rng, 60, changed=8) + dense_group(rng, 40, words=300, changed=10)
    chain = [f"c{k}" for k in range(120)]
    texts += [" ".join([*chain[:-k], *(f"d{i}" for i in range(k))] if k else chain) for k in range(0, 60, 3)]
    assert shingle_components(spark, texts, 3, 90) == brute_components(texts, 3, 90)


def test_shingle_join_odd_rows(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "z y x w"), (5, "A b  c d"), (3, "a b c d"), (9, "z y x w")], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in shinglejoin.shingle_join(rows.withColumn("node", F.lit("clash")), 3, 90).select("doc_id", "n_shingles", F.coalesce("component_id", F.lit(-9)).alias("component_id")).collect())
    assert got == [(-1, 2, -9), (3, 2, 3), (5, 2, 3), (5, 2, 3), (5, 2, 5), (9, 2, 5)]
    assert shinglejoin.shingle_join(rows.limit(0), 3, 90).count() == 0


def test_blocks_link_whatever_the_order_says():
    rng = np.random.default_rng(2)
    base = np.arange(200, dtype=np.uint64)
    sets = []
    for k in range(150):
        gone = rng.choice(200, rng.integers(3, 12), replace=False)
        sets.append(np.sort(np.concatenate([np.delete(base, gone), np.uint64(1000 * (k + 1)) + np.arange(len(gone), dtype=np.uint64)])))
    links = shinglejoin.block_links(np.arange(150), np.full(150, 3), np.ones(150, int), [s.view(np.int64) for s in sets], sets, 90)
    root = list(range(150))

    def find(x):
        return x if root[x] == x else find(root[x])

    like = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))
    assert len(links) < 150 and all(like(i, j) for i, j in links)
    for i, j in links:
        root[find(i)] = find(j)
    assert all(find(i) == find(j) for i in range(150) for j in range(i) if like(i, j))


def near_sets(rng, k, changed):
    """Sets of 200 values of which up to so many differ from one base."""
    base, out = np.arange(200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), []
    for i in range(k):
        gone = rng.choice(200, rng.integers(1, changed), replace=False)
        out.append(np.sort(np.concatenate([np.delete(base, gone), rng.integers(0, 2**63, len(gone) + i % 3 * 30, dtype=np.uint64)])))
    return out


def test_parities_pass_every_link_and_little_else():
    rng = np.random.default_rng(4)
    sets = [*near_sets(rng, 60, 20), *near_sets(rng, 60, 60), np.arange(1, dtype=np.uint64), np.arange(64, dtype=np.uint64), np.arange(70, dtype=np.uint64)]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
    common = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i, j in pairs}
    batch = pa.RecordBatch.from_arrays(
        [*(pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)), *(pa.array([len(sets[p[k]]) for p in pairs], pa.int64()) for k in (0, 1)), *(pa.array([shinglejoin.parity(sets[p[k]]) for p in pairs]) for k in (0, 1))],
        ["a", "b", "n_a", "n_b", "parity_a", "parity_b"],
    )
    (kept,) = shinglejoin._alike(90)([batch])
    kept = set(zip(kept.column(0).to_pylist(), kept.column(1).to_pylist(), strict=True))
    share = {p: 100 * common[p] / (len(sets[p[0]]) + len(sets[p[1]]) - common[p]) for p in pairs}
    linked = {p for p in pairs if share[p] >= 90}
    assert linked and linked <= kept and not {p for p in kept if share[p] < 80}


def test_block_candidates_are_those_that_meet_nowhere_before():
    rng = np.random.default_rng(7)
    sets = near_sets(rng, 80, 20)
    prefixes = [rng.permutation(s)[:60].view(np.int64) for s in sets]
    shorts, groups = rng.integers(20, 60, 80), rng.integers(0, 40, 80)
    posted = [set(p[:n].tolist()) for p, n in zip(prefixes, shorts, strict=True)]
    like = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))
    some = 0
    for token in sorted(set().union(*posted))[:40]:
        here = [i for i in range(80) if token in posted[i]]
        if len(here) < 2:
            continue
        pick = lambda x: [x[i] for i in here]
        found = shinglejoin.block_candidates(
            token, groups[here], np.full(len(here), 3), np.array([len(s) for s in pick(sets)]), np.ones(len(here), int), shorts[here], pick(prefixes), [np.frombuffer(shinglejoin.parity(s), np.uint8) for s in pick(sets)], 90
        )
        first = [(i, j) for i in here for j in here if groups[i] != groups[j] and min(posted[i] & posted[j]) == token]
        linked = {i for i, j in first if like(i, j)}
        assert linked <= {here[k] for k in found} <= {i for i, _ in first}
        some += len(linked)
    assert some


def test_sketch_counts_every_shingle(spark):
    texts = near_texts(random.Random(8))
    want = np.zeros(1 << shinglejoin.SKETCH_BITS, np.uint32)
    for _, hashes, _ in hash_texts(pa.array(texts)):
        np.add.at(want, shinglejoin._buckets(shingles(hashes, 3)), np.uint32(1))
    assert (shinglejoin.count_sketch(frame(spark, texts), 3) == want).all()


def test_whole_sets_are_fetched_for_candidates_alone(spark, monkeypatch):
    rng, fetched = random.Random(21), []
    passages = [prose(rng, 20) for _ in range(65)]
    # each text has four of its five passages in common with the next: all their shingles are shared, none link
    texts = [" ".join(passages[k : k + 5]) for k in range(60)]
    texts += [f"{prose(rng, 150)} {end}" for end in ("one", "two")]
    texts.append(texts[-1].replace("two", "three"))
    was = shinglejoin._sets
    monkeypatch.setattr(shinglejoin, "_sets", lambda docs, size: fetched.append(docs.count()) or was(docs, size))
    assert shingle_components(spark, texts, 3, 90) == brute_components(texts, 3, 90)
    assert 2 <= sum(fetched) <= 6


def test_sets_whose_numbers_are_alike_stay_apart(spark, monkeypatch):
    was = shinglejoin._node
    monkeypatch.setattr(shinglejoin, "_node", lambda digest, salt: was(digest, salt) if salt else F.lit(7).cast("bigint"))
    texts = near_texts(random.Random(3))[:60]
    assert shingle_components(spark, texts, 3, 90) == brute_components(texts, 3, 90)


def test_texts_are_filtered_before_they_meet_ids(spark):
    docs = spark.range(-500, 20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).union(spark.createDataFrame([(None, "t")], "doc_id bigint, text string"))
    ids = docs.where("doc_id % 40 = 0").select("doc_id")
    passed = [r["doc_id"] for r in shinglejoin._maybe_among(docs, ids).collect()]
    assert set(passed) >= {r["doc_id"] for r in ids.collect()} and len(passed) == len(set(passed)) < 600
    assert shinglejoin._maybe_among(docs, ids.limit(0)).count() == 0
