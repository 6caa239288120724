"""Secret scans: base patterns and character Markov models, from built-in functions only.

Two first-order Markov models over ASCII characters, one of random strings
and one of ordinary identifiers, are trained from labelled samples.  A long
run of key-like characters is a secret if the first model makes it likelier
by ``MARGIN`` nats.  Positions are code points of the whole text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stresslens.llm.quality import let, words_of

#: Kind, pattern, shortest secret (of the last group).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 characters and more; a shorter run can't hold a longer match
HEX = r"[0-9a-f]{16,}"  # a whole run of 16 and more, as shorter runs fail
KINDS = ("assign", "access", "hex", "markov")
SHORTEST_VALUE = 12

#: Candidates of the models, and the log-likelihood ratio (nats) that makes one a secret.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
MARGIN = 12.0
#: Labelled samples: distinct texts for ordinary words (at most), random strings of each alphabet.
SAMPLE_DOCS, SAMPLE_RANDOM = 400, 400
#: Characters of candidates in the models' order; 0 stands before the first.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1
_BLOCK = 256


def _starts(gaps: Column, hits: Column) -> Column:
    """Start of each hit: running sums of gap and hit lengths, by blocks so that long lists stay cheap."""
    steps = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.coalesce(F.length(h), F.lit(0)).alias("hit")))
    none = F.array().cast("array<int>")

    def block(all_steps: Column, b: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), none.alias("starts"))
        return F.aggregate(
            F.slice(all_steps, b * _BLOCK + 1, F.lit(_BLOCK)),
            zero,
            lambda acc, s: F.struct((acc["at"] + s["gap"] + s["hit"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + s["gap"])).alias("starts")),
        )

    def joined(blocks: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("parts"))
        return F.aggregate(
            blocks,
            zero,
            lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["parts"], F.array(F.transform(b["starts"], lambda s: s + acc["at"]))).alias("parts")),
            lambda acc: F.flatten(acc["parts"]),
        )

    return let(steps, lambda s: joined(F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _BLOCK).cast("int")), lambda b: block(s, b))))


def hits_of(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans (start, kind, stop, hit) of a pattern's leftmost non-overlapping matches.

    The text between matches comes from splitting at the pattern, so both
    together give the positions; only texts with a match are split.
    """
    empty = F.array().cast("array<struct<start:int,kind:int,stop:int,hit:string>>")

    def spans(hits: Column) -> Column:
        starts = _starts(F.split(text, pattern, -1), hits)
        found = F.zip_with(hits, F.slice(starts, F.lit(1), F.size(hits)), lambda h, s: F.struct(
            s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(h)).alias("stop"), h.alias("hit")))
        return F.filter(found, keep) if keep else found

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: F.when(F.size(h) > 0, spans(h)).otherwise(empty))


def base_spans(text: Column) -> Column:
    value = lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= SHORTEST_VALUE
    return F.array_sort(F.concat(hits_of(text, ASSIGN, 0, value), hits_of(text, ACCESS, 1), hits_of(text, HEX, 2)))


def _code(string: Column, i: Column) -> Column:
    """The state of the i-th character, 0 before the first and for others."""
    return F.when(i < 1, F.lit(0)).otherwise(F.position(F.substring(string, i, F.lit(1)), F.lit(ALPHABET)))


def labelled_samples(docs: DataFrame) -> DataFrame:
    """(label, strings): bounded samples of random strings (1) and ordinary identifiers (0).

    Random: values that the base patterns find in the sample of documents and
    digests written in the usual alphabets.  Ordinary: the sample's words of
    letters, alone and joined in pairs the way identifiers join words.  The
    sample is the ``SAMPLE_DOCS`` distinct texts with the smallest hashes; a
    first cut by hash keeps what is sorted small, and copies of a text count
    once however many there are.
    """
    spark: SparkSession = docs.sparkSession
    share = docs.agg(F.greatest(F.lit(1), F.floor(F.count("*") / (8 * SAMPLE_DOCS))).alias("n")).scalar()
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).where(F.pmod("h", share) == 0)
    sample = texts.groupBy("h").agg(F.min("text").alias("text")).orderBy("h").limit(SAMPLE_DOCS).select("text")
    words = F.filter(F.array_distinct(words_of(F.col("text"))), lambda w: w.rlike("^[A-Za-z]{3,}$"))
    mark = F.array(F.lit("_"), F.lit("-"), F.lit(""), F.lit("/"))
    found = sample.select(F.transform(base_spans(F.col("text")), lambda s: F.when(s["kind"] == 0, F.regexp_extract(s["hit"], ASSIGN, 2)).otherwise(s["hit"])).alias("strings"))
    key = F.sha2(F.col("id").cast("string"), 256)
    drawn = spark.range(SAMPLE_RANDOM, numPartitions=4).select(
        F.array(F.md5(key), F.upper(F.md5(F.reverse(key))), F.base64(F.unhex(key)), F.translate(F.base64(F.unhex(F.sha2(key, 256))), "+/=", "-_")).alias("strings")
    )
    return (
        found.unionByName(drawn).select(F.lit(1).alias("label"), "strings")
        .unionByName(sample.select(F.lit(0).alias("label"), let(words, lambda ws: F.concat(ws, F.transform(ws, lambda w, i: F.concat(w, F.get(mark, i % 4), F.initcap(F.coalesce(F.get(ws, i + 1), F.lit(""))))))).alias("strings")))
    )


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio of each transition, prev * STATES + next, with half a count added to each.

    Only sums by pair of characters come to the driver.
    """
    strings = samples.select("label", F.explode("strings").alias("s")).select("label", F.concat(F.lit("^"), "s").alias("s"))
    pairs = strings.select("label", "s", F.explode(F.sequence(F.lit(1), F.length("s") - 1)).alias("i")).select("label", F.substring("s", F.col("i"), F.lit(2)).alias("pair"))
    counts = pairs.where(F.col("pair").rlike("^[\\x21-\\x7e]{2}$")).groupBy("label", "pair").agg(F.count("*").alias("n"))
    state = {c: k + 1 for k, c in enumerate(ALPHABET)} | {"^": 0}
    seen = {(r["label"], state.get(r["pair"][0], 0) * STATES + state.get(r["pair"][1], 0)): r["n"] for r in counts.collect()}
    ratios = []
    for prev in range(STATES):
        rows = [(seen.get((1, prev * STATES + k), 0), seen.get((0, prev * STATES + k), 0)) for k in range(STATES)]
        totals = [sum(r[m] for r in rows) + STATES / 2 for m in (0, 1)]
        ratios += [math.log((r[0] + 0.5) / totals[0]) - math.log((r[1] + 0.5) / totals[1]) for r in rows]
    return ratios


def log_ratio(string: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio (nats) of a string of the models' characters: random against ordinary."""
    table = F.split(F.lit(",".join(f"{r:.3f}" for r in ratios)), ",").cast("array<double>")  # a constant
    step = lambda acc, i: acc + F.get(table, _code(string, i - 1) * STATES + _code(string, i))
    return F.aggregate(F.sequence(F.lit(1), F.length(string)), F.lit(0.0), step)


def find_secrets(docs: DataFrame, ratios: list[float] | None = None) -> DataFrame:
    """Per row of ``docs``: its columns in ``row``, ``body`` (text, null as empty), base and spans.

    Both are arrays of (start, kind, stop, hit), sorted by start and kind:
    base has what the patterns find, spans also the runs that only the models
    find and that don't touch a base span.  The models are trained from
    ``docs`` unless given (what :func:`train` returns).  Empty texts have no
    spans; repeated rows have the same; an empty table gives no rows.
    """
    ratios = train(labelled_samples(docs.select("text"))) if ratios is None else ratios
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), body.alias("body"))
    found = found.select("row", "body", base_spans(F.col("body")).alias("base"), hits_of(F.col("body"), CANDIDATE, 3).alias("runs"))
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    added = F.filter("runs", lambda s: (log_ratio(s["hit"], ratios) >= MARGIN) & free(s))
    return found.select("row", "body", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def as_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(body: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every secret replaced by a mark; overlapping secrets give one mark."""

    def cut(acc: Column, s: Column) -> Column:
        gap = F.substring(body, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        piece = F.concat(acc["out"], gap, F.when(s["start"] >= acc["at"], F.lit(mark)).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), piece.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(spans, zero, cut, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))
    return F.when(F.size(spans) > 0, whole).otherwise(body)


def redact(docs: DataFrame, ratios: list[float] | None = None) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced, and ``n_chars`` (if there is one) counted anew; a null text stays null."""
    found = find_secrets(docs, ratios)
    text = F.when(F.col("row.text").isNotNull(), redacted(F.col("body"), F.col("spans")))
    found = found.select("row", "spans", text.alias("clean"))
    count = F.when(F.size("spans") > 0, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    new = {"text": F.col("clean"), "n_chars": count}
    return found.select(*[(new[c] if new.get(c) is not None else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
