"""The registered queries and pipeline stages on small fixtures, against brute force and with odd rows."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from stresslens.llm import chat, imatch, lm, minhash, mixing, packing, quality, queries, secrets, unitdedup, warc
from tests.llm.test_llm import DOCS, SPACE, brute_components, frame, prose


@pytest.fixture(scope="module")
def odd_docs():
    """(doc_id, text, lang, source, n_chars): null ids, repeated ids, repeated rows, null and long texts."""
    rng = random.Random(21)
    texts = [prose(rng, rng.randint(80, 160)) + "\nAll rights reserved.\n" + prose(rng, 60) for _ in range(30)]
    rows = [(k, t, "en", f"src{k % 4}", len(t)) for k, t in enumerate(texts)]
    rows += [(3, "another text with the id of an older one " * 3, "en", None, 120), (3, texts[3], "en", "src3", len(texts[3])), (None, texts[5], None, None, None)]
    rows += [(40, None, "en", "src0", None), (41, "", "en", "src1", 0), (42, texts[1], "fr", "src1", len(texts[1])), (43, prose(rng, 6000), "en", "src2", 1)]
    return rows


@pytest.fixture(scope="module")
def sf_dir(spark, odd_docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(odd_docs, DOCS).write.parquet(f"{path}/documents.parquet")
    turns = [(c, t, "assistant" if t % 2 else "user", f"turn {t} of {c} </turn>") for c in range(5) for t in range(4)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def ids(rows):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows)


def test_quality_of_a_long_text_is_linear(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(1, " ".join(rng.choice("abcdefghij") * rng.randint(1, 6) for _ in range(20_000)))], "doc_id bigint, text string")
    quality.keep_good(rows.limit(0)).collect()
    began = time.time()
    assert quality.score_quality(rows).where("kept or not kept").count() == 1
    quality.keep_good(rows).collect()
    assert time.time() - began < 20


def test_stop_words_are_a_ratio(spark):
    plain = " ".join(f"word{i}" for i in range(96))
    rows = spark.createDataFrame([(0, plain + " the the the the"), (1, plain + " the the x y"), (2, plain + " the")], "doc_id bigint, text string")
    assert [r["kept"] for r in quality.score_quality(rows).orderBy("row.doc_id").collect()] == [True, False, False]


def dense_group(rng, n, words=400, changed=12):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for k in rng.sample(range(words), changed):
            copy[k] = f"c{rng.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("changed", [10, 13, 18])
def test_spanning_links_in_a_dense_group(changed):
    rng = random.Random(changed)
    n, percent = 2000, 85
    base = np.arange(398, dtype=np.uint64)
    sets, sigs = [], []
    for k in range(n):
        gone = {x for p in rng.sample(range(2, 398), changed) for x in (p - 2, p - 1, p)}
        values = np.unique(np.concatenate([np.delete(base, sorted(gone)), np.uint64(10**6) + np.arange(len(gone), dtype=np.uint64) + np.uint64(1000 * k)]))
        sets.append(values)
        sigs.append(minhash._signature(minhash.mix(values)))
    links = minhash.spanning_links(np.arange(n), np.full(n, 3), np.stack(sigs), sets, percent, 1)
    assert len(links) < n
    lists = [set(s.tolist()) for s in sets]
    like = lambda i, j: 100 * len(lists[i] & lists[j]) >= percent * len(lists[i] | lists[j])
    assert all(like(i, j) for i, j in links)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        root[find(i)] = find(j)
    for _ in range(3000):  # linked pairs are in one group
        i, j = rng.randrange(n), rng.randrange(n)
        assert not like(i, j) or find(i) == find(j)


def test_dense_groups_end_to_end(spark):
    rng = random.Random(8)
    texts = dense_group(rng, 120, changed=11) + dense_group(rng, 120, changed=9) + [prose(rng, 100) for _ in range(20)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, texts), 3, 85).collect()}
    assert got == brute_components(texts, 3, 85)


def test_blocks_of_a_list_meet_each_other(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SETS", 7)
    rng = random.Random(12)
    texts = dense_group(rng, 60, changed=11) + dense_group(rng, 50, words=440, changed=12)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, texts), 3, 85).collect()}
    assert got == brute_components(texts, 3, 85)


def test_rows_are_judged_by_their_own_text(spark):
    same, other = "a b c d e f g h", "i j k l m n o p"
    rows = spark.createDataFrame([(2, same, 1), (5, same, 2), (5, other, 3), (9, other, 4), (None, same, 5), (7, None, 6)], "doc_id bigint, text string, gone_id int")
    kept = minhash.keep_one_of_each(rows)
    assert sorted(r["gone_id"] for r in kept.collect()) == [1, 3, 5, 6] and kept.columns == rows.columns
    assert minhash.keep_one_of_each(rows.limit(0)).count() == 0


def test_op1_query(spark, sf_dir, odd_docs):
    got = queries.op1_minhash_near_dedup(spark, sf_dir).collect()
    assert ids(got) == ids([{"doc_id": r[0]} for r in odd_docs])
    assert {r["component_id"] for r in got if r["doc_id"] == 42} == {1}


def test_op2_query_against_brute_force(spark, sf_dir, odd_docs):
    got = queries.op2_imatch_fingerprints(spark, sf_dir).collect()
    assert ids(got) == ids([{"doc_id": r[0]} for r in odd_docs])
    digest = lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0]
    texts = {}
    for doc_id, text, *_ in odd_docs:
        texts.setdefault(doc_id, []).append(text or "")
    stands = {k: min(set(v), key=digest) if len(set(v)) > 1 else v[0] for k, v in texts.items()}
    order = sorted(stands, key=lambda k: (k is not None, k or 0), reverse=True)
    after = dict(zip(order, [*order[1:], order[0]], strict=True))

    def edited(doc_id, text):
        third = len(text) // 3
        return text[: len(text) - third] + stands[after[doc_id]][:third]

    want = Counter((k, len(t), hashlib.sha256(edited(k, t).encode()).hexdigest()) for k, v in texts.items() for t in v)
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    prints = {}
    for r in got:
        prints.setdefault((r["doc_id"], r["n_chars"]), r["fingerprint"])

    def likeness(one, two):
        pairs = [(a, b) for a, b in zip(one.split(","), two.split(","), strict=True) if a or b]
        return sum(a == b for a, b in pairs) / len(pairs) if pairs else 1.0

    for r in got:
        follow = after[r["doc_id"]]
        assert r["near_edited"] == pytest.approx(likeness(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(likeness(r["fingerprint"], prints[follow, len(stands[follow])]))


def test_lexicon_holds_the_band(spark, odd_docs):
    docs = spark.createDataFrame(odd_docs, DOCS)
    seen = Counter(w for r in odd_docs for w in set(SPACE.findall((r[1] or "").lower())))
    n = len(odd_docs)
    words = [w for w, c in seen.items() if c > 1 and 0.01 * n <= c <= 0.2 * n]
    hashes = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("h"))
    assert imatch.lexicon(docs).first()["terms"] == sorted(r["h"] for r in hashes.collect())


def test_whole_lines_against_brute_force(spark):
    rng = random.Random(31)
    line = lambda: " ".join(rng.choice(["Ab", "aB", "b", "c"]) for _ in range(rng.randint(0, 3)))
    texts = ["\n".join(line() for _ in range(rng.randint(1, 12))) for _ in range(40)] + [None, ""]
    seen, want = set(), set()
    for k, t in enumerate(texts):
        at = 0
        for part in (t or "").split("\n"):
            unit = tuple(x.lower() for x in SPACE.findall(part))
            if unit and unit in seen:
                want |= {(k, at + i) for i, c in enumerate(part) if not c.isspace()}
            seen.add(unit)
            at += len(part) + 1
    found = {(r["doc_id"], i) for r in unitdedup.repeated_spans(frame(spark, texts)).collect() for i in range(r["start"], r["stop"]) if not texts[r["doc_id"]][i].isspace()}
    assert found == want


def test_units_odd_rows(spark):
    text = "one line of its own\nand another"
    rows = spark.createDataFrame([(None, text, 0), (4, text, 1), (4, text, 2), (6, text, 3)], "doc_id bigint, text string, segments int")
    assert {r["doc_id"] for r in unitdedup.repeated_spans(rows).collect()} == {6}
    clean = unitdedup.dedup_units(rows)
    assert clean.columns == ["doc_id", "text", "segments"] and clean.count() == 4


def test_packing_odd_rows(spark, sf_dir, odd_docs):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    got = queries.op4_best_two_fit_packing(spark, sf_dir).collect()
    assert ids(r for r in got if r["piece"] == 0) == ids([{"doc_id": r[0]} for r in odd_docs])
    assert packing.pack_documents(spark.createDataFrame([], DOCS), path).count() == 0
    many = packing.pack_documents(spark.createDataFrame([(None, "same", "en", "s", 4)] * 50, DOCS), path).collect()
    assert len(many) == 50 and len({(r["sequence_id"], r["offset"]) for r in many}) == 50


ALPHABETS = {
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "HEX": "0123456789ABCDEF",
    "url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-", "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
}


def test_planted_secrets_without_a_base_pattern_are_found(spark):
    rng = random.Random(17)
    rows, planted = [], {}
    for k in range(200):
        before, after = prose(rng, 40), prose(rng, 40)
        secret = "".join(rng.choice(ALPHABETS[sorted(ALPHABETS)[k % 5]]) for _ in range(rng.randint(24, 48)))
        planted[k] = (len(before) + 1, len(before) + 1 + len(secret))
        rows.append((k, f"{before} {secret} {after}"))
    clean = [(1000 + k, " ".join(["_".join(prose(rng, 4).split()), prose(rng, 60), "/".join(prose(rng, 4).split())])) for k in range(100)]
    docs = spark.createDataFrame(rows + clean, "doc_id bigint, text string")
    found = {r["row"]["doc_id"]: [(s["start"], s["stop"]) for s in r["spans"]] for r in secrets.find_secrets(docs).collect()}
    recall = sum(any(a < stop and start < b for a, b in found[k]) for k, (start, stop) in planted.items()) / len(planted)
    wrong = sum(bool(found[k]) for k, _ in clean) / len(clean)
    assert recall >= 0.9 and wrong <= 0.05


def test_the_sample_is_bounded_whatever_is_copied(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "the same text over and over").otherwise(F.concat(F.lit("text number "), F.col("id").cast("string"))).alias("text"))
    samples = secrets.labelled_samples(docs).where("label = 0").collect()
    assert 0 < len(samples) <= secrets.SAMPLE_DOCS
    assert sum("same" in r["strings"] for r in samples) <= 1


def test_warc_repeated_and_null_ids(spark, tmp_path):
    a, b = "A" * 200, "B" * 300 + "\r\n\r\n"
    long = "x" * 3_000_000 + "\r\n\r\n\r\n\r\nWARC/1.1\r\n"
    rows = [(2, "u", a), (5, "u", a), (5, "u", b), (5, "u", b), (7, "u", long), (8, "u", long), (None, None, a), (1, "u", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/one")
    got = [tuple(r) for r in warc.describe_archives(warc.read_archives(spark, f"file://{tmp_path}/one")).collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(2, a, None), (5, a, 2), (5, b, None), (5, b, None), (7, long, None), (8, long, 7), (None, a, None), (1, "", None)]
    assert Counter(got) == Counter((p, len(t), sha(t), "revisit" if r else "response", r) for p, t, r in want)
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.describe_archives(warc.read_archives(spark, f"file://{tmp_path}/none")).count() == 0


def test_record_parser_refuses_wrong_lengths():
    parser = warc.RecordParser()
    parser.feed(b"WARC/1.1\r\nContent-Length: 3")
    with pytest.raises(ValueError, match="ended"):
        parser.feed(b"abcd")
    parser = warc.RecordParser()
    parser.feed(b"WARC/1.1\r\nContent-Length: 30")
    with pytest.raises(ValueError, match="cut off"):
        parser.close()
    with pytest.raises(ValueError, match="starts where"):
        warc.RecordParser().feed(b"HTTP/1.1 200 OK")


def brute_scores(docs):
    """Scores of the interpolated bigram model, counted plainly; docs are (doc_id, text)."""
    crc = lambda d: zlib.crc32(b"" if d is None else str(d).encode())
    tokens = [(d, [*SPACE.findall((t or "").lower()), ""]) for d, t in docs]
    words, pairs = Counter(), Counter()
    for d, ws in tokens:
        if crc(d) % 7 != 2:
            fold = crc(d) // 7 % lm.FOLDS
            for v, w in zip(["", *ws], ws, strict=False):
                words[fold, w] += 1
                pairs[fold, v, w] += 1
    total, both, by_fold = Counter(), Counter(), Counter()
    for (f, w), n in words.items():
        total[w] += n
        by_fold[f] += n
    for (_, v, w), n in pairs.items():
        both[v, w] += n
    bucket = lambda c: min(math.frexp(c)[1], lm.BUCKETS - 1)
    table = Counter()
    for (f, v, w), n in pairs.items():
        context = total[v] - words[f, v]
        p2, p1 = (both[v, w] - n) / max(1, context), (total[w] - words[f, w]) / max(1, sum(by_fold.values()) - by_fold[f])
        level = [0 if p == 0 else int(np.clip(lm.CLASSES - 1 + np.round(lm.FINE * np.log2(p)), 1, lm.CLASSES - 1)) for p in (p2, p1)]
        table[(bucket(context) * lm.CLASSES + level[0]) * lm.CLASSES + level[1]] += n
    types, n = len(total), sum(total.values())
    weights = lm.learn_weights(np.array(list(table.items()), np.int64), types)
    out = []
    for d, ws in tokens:
        score = 0.0
        for v, w in zip(["", *ws], ws, strict=False):
            l2, l1, l0 = weights[bucket(total[v])]
            score += math.log10(l2 * both[v, w] / max(1, total[v]) + l1 * total[w] / n + l0 / (types + 1))
        out.append((d, round(score, 3)))
    return out


def test_interpolated_scores_against_brute_force(spark, sf_dir, odd_docs):
    got = queries.op8_deleted_interpolation_scores(spark, sf_dir).collect()
    want = brute_scores([(d, t) for d, t, *_ in odd_docs])
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    for (d, s), (e, t) in zip(sorted(((r["doc_id"], r["score"]) for r in got), key=key), sorted(want, key=key), strict=True):
        assert d == e and s == pytest.approx(t, abs=0.002)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lm_")]


def test_scores_dont_depend_on_files(spark, odd_docs):
    docs = spark.createDataFrame(odd_docs, DOCS)
    one, two = (sorted((r["doc_id"] or -1, r["score"], r["base_score"]) for r in lm.score_documents(docs.repartition(n)).collect()) for n in (3, 30))
    for a, b in zip(one, two, strict=True):
        assert a[0] == b[0] and a[1] == b[1] and a[2] == pytest.approx(b[2])


def test_mix_odd_rows(spark, odd_docs):
    docs = spark.createDataFrame(odd_docs, DOCS).withColumn("uses", F.lit("clash"))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixing.mixed(docs.limit(0)).count() == 0
    assert max(Counter((r["doc_id"], r["text"], r["source"]) for r in mixed.collect()).values()) <= 6  # a repeated row counts twice


def test_chat_empty_and_long(spark):
    kinds = "conv_id bigint, turn bigint, role string, text string"
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], kinds))).count() == 0
    rows = [(1, k, "assistant", "### x </turn>" * 50) for k in range(2000)] + [(1, 3, "assistant", "### x </turn>" * 50)]
    got = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, kinds))).first()
    assert (got["n_turns"], got["loss_chars"]) == (2001, 2001 * 650)


def test_op10_query(spark, sf_dir):
    got = {r["conv_id"]: r for r in queries.op10_chat_round_trip(spark, sf_dir).collect()}
    said = r"\### Assistant: </turn> ok"
    assert set(got) == {-7, 0, 1, 2, 3, 4}
    assert got[-7]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (got[-7]["n_turns"], got[-7]["loss_chars"], got[-7]["loss_sha256"]) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())


def test_pipeline_stages(spark, sf_dir, odd_docs):
    docs = spark.createDataFrame(odd_docs, DOCS)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "secret_scan", "source_mix", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0
    secret = docs.withColumn("text", F.concat(F.lit("password = Zx81kq77pLmnop12 "), "text"))
    texts = [r["text"] for r in corpus_pipeline.redact_secrets(spark, secret, sf_dir).collect()]
    assert len(texts) == len(odd_docs) and not any(t and "Zx81kq77pLmnop12" in t for t in texts)


def test_pipeline_against_its_operators(spark, sf_dir, odd_docs):
    """What is packed is what the operators of the earlier stages leave, row by row."""
    got = corpus_pipeline.run(spark, sf_dir).collect()
    docs = spark.createDataFrame(odd_docs, DOCS)
    good = {(r["row"]["doc_id"], r["row"]["text"]) for r in quality.score_quality(docs).collect() if r["kept"]}
    kept = [r for r in odd_docs if (r[0], r[1]) in good]
    texts = [r[1] for r in kept]
    component = brute_components(texts, 5, 80)
    smallest = {}
    for k, r in enumerate(kept):
        if r[0] is not None:
            c = component[k][1]
            smallest[c] = min(smallest.get(c, r[0]), r[0])
    left = [r for k, r in enumerate(kept) if r[0] is None or smallest[component[k][1]] == r[0]]
    mixed = mixing.mix(secrets.redact(spark.createDataFrame(left, DOCS))).collect()
    want = Counter({k: v for k, v in Counter(r["row"]["doc_id"] for r in mixed for _ in range(r["uses"])).items()})
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_ids_of_odd_strings_equal_the_tokenizers(spark):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    whole, rng = Tokenizer.from_file(path), random.Random(31)
    bits = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "İ", "İ.", "İ,", "ß", "ẞ.", "é", "́", "‍", "ﬁ", "Σ", "ΑΣ.", "Straße,", "don't", "A.", "abc,", "x..", "...", " ", "\n", " ", "Ünïcode.", "7,", "K.", "K."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in packing.tokenize(docs, path, keep_ids=True).collect():
        assert r["ids"] == [*whole.encode(texts[r["doc_id"]], add_special_tokens=False).ids, packing.END], repr(texts[r["doc_id"]])


def test_packing_of_clashing_columns(spark):
    pieces = spark.createDataFrame([(k, "g", "s", "o", 1 + k % 90) for k in range(400)], "doc_id bigint, grp string, sequence_id string, offset string, length bigint")
    got = packing.pack(pieces, capacity=100).collect()
    assert len(got) == 400 and all(r["grp"] == "g" for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(at == sum(n for _, n in sorted(b)[:k]) for b in bins.values() for k, (at, _) in enumerate(sorted(b)))
    assert all(sum(n for _, n in b) <= 100 for b in bins.values())


def test_texts_of_one_id_are_cleaned_each_by_itself(spark):
    rng = random.Random(41)
    notice, passage = "Alle Rechte vorbehalten, so gehört es sich für Übersetzungen", prose(rng, 60)
    own = lambda k: " ".join(f"é{k}x{i}" for i in range(35))
    rows = [(1, f"{own(0)}\n{notice}\n{passage}"), (7, f"{own(1)}\n{notice}\n{own(2)}"), (7, f"{own(3)} {own(4)}\n{own(5)}\n{notice}\n{passage}"), (7, own(6)), (7, f"{own(1)}\n{notice}\n{own(2)}"), (None, notice)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["text"]) for r in unitdedup.dedup_units(docs).collect())
    want = [rows[0], (7, f"{own(1)}\n{own(2)}"), (7, f"{own(3)} {own(4)}\n{own(5)}\n"), rows[3], (7, f"{own(1)}\n{own(2)}"), rows[5]]
    assert got == Counter(want)
    spans = unitdedup.repeated_spans(docs).collect()
    assert len({(r["doc_id"], r["text_hash"]) for r in spans}) == 2 and len(spans) == 2


def test_rows_without_ids_meet_the_target(spark):
    rng = random.Random(51)
    rows = [(None, prose(rng, 35 + k % 11), "a") for k in range(50)] + [(k % 3, prose(rng, 30 + k), "b") for k in range(40)] + [(k, prose(rng, 40), None) for k in range(60)]
    rows += [(None, "same text here", "d")] * 9
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for source in ("a", "b", None):
        mine = mixing.mix(docs).where(F.col("row.source").eqNullSafe(F.lit(source))).select("size", "target", "uses").collect()
        taken, longest = sum(r["size"] * r["uses"] for r in mine), max(r["size"] for r in mine)
        assert abs(taken - mine[0]["target"]) <= longest / 2 + 1e-6 and max(r["uses"] for r in mine) <= mixing.EPOCHS
