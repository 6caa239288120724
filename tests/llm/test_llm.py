"""Training-data operators against brute force, round trips and odd input."""

import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from stresslens.llm import chat, imatch, lm, minhash, mixing, packing, quality, secrets, unitdedup, warc

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n):
    return " ".join("".join(rng.choice(["the", "ou", "in", "re", "er", "an", "st"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [prose(rng, rng.randint(60, 140)) for _ in range(12)]
    out = list(base)
    for t in base[:6]:
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        out += [" ".join(words), t]
    return [*out, None, "", "  \n\t", "one", "one two", "One TWO", "é" * 40]


def frame(spark, texts, start=0):
    rows = [(k + start, t, "en", f"src{k % 3}" if k % 5 else None, None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("row", F.lit("clash"))


def brute_components(texts, size, percent):
    sets = []
    for t in texts:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in SPACE.findall(t or "")]
        sets.append({tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {k: (len(sets[k]), find(k)) for k in range(len(texts))}


def test_near_duplicates_against_brute_force(spark, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, texts), 3, 85).collect()}
    assert got == brute_components(texts, 3, 85)


def test_near_duplicates_odd_rows(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (3, "a b c d")], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in minhash.near_duplicates(rows, 3, 85).collect())
    assert got == [(-1, None, True), (3, 3, True), (5, 3, False), (5, 3, False)]
    assert minhash.near_duplicates(rows.limit(0), 3, 85).count() == 0


def test_fingerprints(spark, texts):
    rows = {r["row"]["doc_id"]: tuple(r["hashes"]) for r in imatch.fingerprints(frame(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for a, b in itertools.combinations(range(len(texts)), 2):
        if (texts[a] or "") == (texts[b] or ""):
            assert rows[a] == rows[b]
    assert rows[0] != rows[1]
    follow = {r["doc_id"]: r["next_id"] for r in imatch.next_ids(frame(spark, texts)).collect()}
    assert all(follow[k] == (k - 1) % len(texts) for k in follow)


def test_substring_dedup(spark):
    rng = random.Random(9)
    passage = prose(rng, 70)
    word = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    texts = [f"{word(1)} {passage} {word(2)}", f"{word(3)} {passage} {word(4)}", word(5), None, "", passage + "\n" + word(6)]
    docs = frame(spark, texts)
    spans = {r["doc_id"]: r for r in unitdedup.repeated_spans(docs).collect()}
    assert set(spans) == {1, 5} and all(r["first_doc_id"] == 0 for r in spans.values())
    assert all(texts[k].encode()[r["start"] : r["stop"]].decode().strip() in passage for k, r in spans.items())
    clean = {r["doc_id"]: r for r in unitdedup.dedup_units(docs).collect()}
    assert clean[2]["text"] == texts[2] and clean[3]["text"] is None and word(3) in clean[1]["text"]
    assert clean[1]["text"].encode() == b"".join(texts[1].encode()[s["start"] : s["stop"]] for s in clean[1]["segments"])


def test_short_and_cut_lines_are_deduped(spark):
    rng = random.Random(5)
    notice, long = "All rights reserved.", prose(rng, 45)
    own = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    texts = [f"{own(1)}\n{notice}\n{long}\n{own(2)}", f"{own(3)}\n{notice}\n\n{own(4)}\n{notice}", f"{own(5)} {notice}\n{own(6)}", f"{own(7)}\n{long}\n{notice}\n{own(8)}"]
    spans = sorted(tuple(r) for r in unitdedup.repeated_spans(frame(spark, texts)).select("doc_id", "start", "stop", "n_words", "first_doc_id").collect())
    cut = lambda d, s, e: texts[d].encode()[s:e].decode().split("\n")
    assert [(d, [x for x in cut(d, s, e) if x], n, f) for d, s, e, n, f in spans] == [(1, [notice], 3, 0), (1, [notice], 3, 0), (3, [long, notice], 48, 0)]
    clean = {r["doc_id"]: r["text"] for r in unitdedup.dedup_units(frame(spark, texts)).collect()}
    assert clean == {0: texts[0], 1: f"{own(3)}\n{own(4)}\n", 2: texts[2], 3: f"{own(7)}\n{own(8)}"}


def test_packing(spark, texts):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    long = [*texts, "It's THE end... of the <|endoftext|> x\x1cy İstanbul café, 12,5!", prose(random.Random(1), 9000)]
    rows = packing.pack_documents(frame(spark, long), path).collect()
    seen = {}
    for r in rows:
        seen.setdefault(r["doc_id"], []).append(r)
    for k, t in enumerate(long):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, r in enumerate(sorted(seen[k], key=lambda r: r["piece"])):
            part = ids[piece * 4096 : (piece + 1) * 4096]
            crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            assert (r["piece"], r["start"], r["length"], r["ids_crc32"]) == (piece, piece * 4096, len(part), crc)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= math.ceil(sum(r["length"] for r in rows) / 4096) + 1


def test_best_two_fit_counts():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(20):
        lengths = rng.integers(1, 101, rng.integers(1, 300))
        bins, offsets = packing.best_two_fit(lengths, 100)
        totals = np.bincount(bins, weights=lengths)
        assert totals.max() <= 100 and (offsets >= 0).all()
        assert len(totals) <= math.ceil(lengths.sum() / 100) * 1.25 + 1


def test_secrets_against_regex(spark):
    rng = random.Random(2)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [
        f'é password = "{hexes}" and AKIA{key}!', "token: api_key: abcdefghijklmnop", f"x{hexes[:15]} y {hexes[:16]}", None, "", "TOKEN:short",
        "ordinary words only, nothing to see", " ".join([hexes] * 600), "AKIAAKIA" + "B" * 14 + " secret==a" + hexes,
    ]
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)

    def base(t):
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        return sorted(spans)

    found = {r["row"]["doc_id"]: r for r in secrets.find_secrets(frame(spark, texts)).collect()}
    for k, t in enumerate(texts):
        assert [(s["start"], s["kind"], s["stop"]) for s in found[k]["base"]] == base(t or "")
    assert not found[6]["spans"]
    clean = {r["doc_id"]: r for r in secrets.redact(frame(spark, texts)).collect()}
    assert hexes not in clean[0]["text"] and clean[6]["text"] == texts[6] and clean[3]["text"] is None
    assert clean[0]["n_chars"] == len(clean[0]["text"])


def test_markov_models_tell_random_from_ordinary(spark):
    rng = random.Random(11)
    docs = frame(spark, [prose(rng, 200) for _ in range(20)])
    ratios = secrets.train(secrets.labelled_samples(docs.select("text")))
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    random_ones = ["".join(rng.choice(chars) for _ in range(32)) for _ in range(100)]
    plain = ["_".join(prose(rng, 5).split()) for _ in range(100)]
    rows = spark.createDataFrame([(1, s) for s in random_ones] + [(0, s) for s in plain], "y int, s string")
    got = rows.select("y", secrets.log_ratio(F.col("s"), ratios).alias("r")).collect()
    assert sum((r["r"] >= secrets.MARGIN) == (r["y"] == 1) for r in got) >= 190


def test_warc_round_trip(spark, tmp_path):
    body = "<p>" + "same " * 40 + "\r\n\r\nWARC/1.1\r\n</p>é"
    rows = [(5, "http://a/\r\nX: y", body), (2, None, body), (9, "u", body), (1, "u", None), (3, "u", "short"), (4, "u", "short"), (None, "u", body)]
    path = f"file://{tmp_path}/warc"
    warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string"), path)
    records = warc.read_archives(spark, path)
    assert {r["payload"].decode() for r in records.where("record_type = 'response'").collect()} == {body, "", "short"}
    for r in warc.describe_archives(records).collect():
        html = next(h or "" for p, _, h in rows if p == r["page_id"])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
        assert r["refers_to"] == (2 if html == body and r["page_id"] in (5, 9) else None)  # a null page_id is a response


def naive_quality(t):
    t = t or ""
    words = SPACE.findall(t)
    lines = [s for s in t.split("\n") if SPACE.search(s)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + o for i, w in enumerate(windows) if windows.count(w) > 1 for o in range(3)}
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, texts):
    rng = random.Random(1)
    more = [*texts, "a b c a b c a b c", "x\nx\n\nx | y <#>", " ".join(rng.choice("ab") for _ in range(120)), "\x1cword\x85  x"]
    for r in quality.score_quality(frame(spark, more)).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        want = naive_quality(more[r["row"]["doc_id"]])
        assert got == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert quality.keep_good(frame(spark, more)).columns == frame(spark, more).columns


def test_lm_scores(spark, texts):
    docs = frame(spark, texts)
    got = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    tokens = {k: [*SPACE.findall((t or "").lower()), None] for k, t in enumerate(texts)}
    held = {k for k in tokens if zlib.crc32(str(k).encode()) % 7 == 2}
    counts = {}
    for k in tokens.keys() - held:
        for w in tokens[k]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for k, words in tokens.items():
        base = sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in words)
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (k in held, len(words), sum(w in counts for w in words), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] <= 0
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


def test_mix(spark, texts):
    rows = mixing.mix(frame(spark, texts * 8)).collect()
    taken, target, biggest = {}, {}, {}
    for r in rows:
        s = r["row"]["source"]
        taken[s] = taken.get(s, 0) + r["size"] * r["uses"]
        target[s] = r["target"]
        biggest[s] = max(biggest.get(s, 0), r["size"])
        assert 0 <= r["uses"] <= 3 and r["size"] == len(SPACE.findall(texts[r["row"]["doc_id"] % len(texts)] or ""))
    assert all(abs(taken[s] - target[s]) <= biggest[s] for s in taken)
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in rows))
    again = mixing.mix(frame(spark, texts * 8)).collect()
    assert sorted((r["row"]["doc_id"], r["uses"]) for r in rows) == sorted((r["row"]["doc_id"], r["uses"]) for r in again)


def test_chat_grammar():
    rng = random.Random(3)
    parts = ["\\", "### ", "Assistant", ":", "\n", "</turn>", "</turn>\n", "#", "<", " ", "a", "n", "\\n", "\\#"]
    for _ in range(5000):
        role, text = ("".join(rng.choice(p) for _ in range(rng.randint(0, 6))) for p in (["user", "\\", ":", "\n", "n", "#"], parts))
        assert [(r, t) for r, t, _, _ in chat.parse(chat.format_turn(role, text))] == [(role, text)]


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "### user:\n"), (1, 2, "assistant", None), (2, 1, "assistant", "b"), (2, 0, None, "a\\</turn>"), (None, 0, "user", "x")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()}
    for conv, r in got.items():
        turns = sorted((t, role or "", text or "") for c, t, role, text in rows if c == conv)
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_is_formatted_turn_by_turn(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"text {k} </turn>") for k in range(60)] + [(2, 0, "user", "x")]
    parts = chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    one = sorted((r for r in parts.collect() if r["conv_id"] == 1), key=lambda r: r["place"])
    assert [r["place"] for r in one] == list(range(60))
    whole = "".join(r["formatted"] for r in one)
    assert [(r, t) for r, t, _, _ in chat.parse(whole)] == [(r, t) for c, _, r, t in rows if c == 1]
    assert [chat.unescape(whole[r["loss_start"] : r["loss_end"]]) for r in one if r["loss_start"] is not None] == [t for c, k, _, t in rows if c == 1 and k % 2]


def test_operators_take_empty_tables(spark):
    docs = frame(spark, ["x"]).limit(0)
    for result in (quality.score_quality(docs), mixing.mix(docs), secrets.find_secrets(docs), unitdedup.repeated_spans(docs), imatch.fingerprints(docs), lm.score_documents(docs)):
        assert result.count() == 0
