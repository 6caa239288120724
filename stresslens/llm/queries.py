"""The registered queries of this subpackage and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stresslens.llm import audit, chat, imatch, lm, merkle, minhash, mixing, packing, quality, scratch, secrets, shinglejoin, unitdedup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Place of the public vocabulary file that op4 and the pipeline use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op2_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last third replaced by the next text's beginning.

    Every row gives one row.  The next document is that of the next smaller
    doc_id; a null doc_id is below all others and counts as one document.
    Where a doc_id is repeated, the text with the smallest hash stands for it
    as a next document.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lexicon = scratch.save(imatch.lexicon(docs))
    follow = scratch.save(imatch.next_ids(docs))
    known = lambda c, name: (F.coalesce(c, F.lit(0)).alias(name), c.isNull().alias(f"{name}_null"))
    # ids and lengths meet first, so that a text is shuffled once for its beginning
    lengths = docs.select(*known(F.col("doc_id"), "id"), F.floor(F.length("text") / 3).cast("int").alias("third")).groupBy("id", "id_null").agg(F.max("third").alias("third"))
    wanted = follow.select(*known(F.col("doc_id"), "id"), "next_id").join(lengths, ["id", "id_null"])
    wanted = wanted.select(F.col("id").alias("for"), F.col("id_null").alias("for_null"), "third", *known(F.col("next_id"), "id"))
    rows = docs.select(*known(F.col("doc_id"), "id"), "text")
    heads = rows.join(wanted, ["id", "id_null"]).select("for", "for_null", F.expr("substring(text, 1, third)").alias("head"), F.xxhash64("text").alias("h"))
    heads = heads.groupBy("for", "for_null").agg(F.min_by("head", "h").alias("head")).withColumnsRenamed({"for": "id", "for_null": "id_null"})
    both = rows.join(heads, ["id", "id_null"]).select(
        "id", "id_null", "text", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.expr("substring(head, 1, cast(floor(length(text) / 3) as int))")).alias("edited")
    )
    prints = both.select(
        "id", "id_null", F.xxhash64("text").alias("h"), F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        imatch.terms_of(F.col("text")).alias("terms"), imatch.terms_of(F.col("edited")).alias("edited_terms"),
    )
    inside = [F.array_intersect(lexicon.scalar(), F.col(c)).alias(f"{c}_inside") for c in ("terms", "edited_terms")]
    hashed = [imatch.fingerprint(F.col(c), F.col(f"{c}_inside")) for c in ("terms", "edited_terms")]
    prints = scratch.save(prints.select("*", *inside).select("id", "id_null", "h", "n_chars", "edited_sha256", hashed[0].alias("own"), hashed[1].alias("edited")))
    others = prints.groupBy("id", "id_null").agg(F.min_by("own", "h").alias("other"))
    others = others.join(wanted.select("id", "id_null", "for", "for_null"), ["id", "id_null"]).select(F.col("for").alias("id"), F.col("for_null").alias("id_null"), "other")
    return prints.join(others, ["id", "id_null"]).select(
        F.when(~F.col("id_null"), F.col("id")).alias("doc_id"), "n_chars", "edited_sha256",
        imatch.as_text(F.col("own")).alias("fingerprint"), imatch.as_text(F.col("edited")).alias("edited_fingerprint"),
        imatch.likeness(F.col("own"), F.col("edited")).alias("near_edited"), imatch.likeness(F.col("own"), F.col("other")).alias("near_next"),
    )


def op3_unit_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unitdedup.repeated_spans(_table(spark, sf_dir, "documents"))


def op4_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_markov_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.as_text(F.col("spans")).alias("spans"),
    )


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.folder(spark)
    warc.write_archives(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.describe_archives(warc.read_archives(spark, path))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_deleted_interpolation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return used.select("row.doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("uses")).alias("taken"))


def op10_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return chat.read_back(chat.format_conversations(turns.unionByName(extra)))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_shingle_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shinglejoin.shingle_join(_table(spark, sf_dir, "documents"), shingle_words=3, percent=90)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = (
        op1_minhash_near_dedup, op2_imatch_fingerprints, op3_unit_substring_dedup, op4_best_two_fit_packing, op5_markov_secret_scan,
        op6_warc_revisits, op7_quality_rules, op8_deleted_interpolation_scores, op9_source_mix, op10_chat_round_trip, op11_merkle_manifest, op12_filter_audit, op13_shingle_jaccard_join, pipeline,
    )
    return {f.__name__: f for f in ops}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP1 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) < 3 THEN [array_to_string(a, ' ')] ELSE
    list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2]) END) AS g
  FROM w WHERE len(a) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id
"""

_OP6 = """
WITH h AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def _op7() -> str:
    rules = " AND ".join(f"NOT ({left} > {limit} * {right})" for _, left, limit, right in quality.RULES)
    stop = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    return rf"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS a FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM b),
g AS (SELECT doc_id, unnest(range(1, len(a) - 1)) AS i, unnest(list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2])) AS g FROM b WHERE len(a) >= 3),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
m AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM k, (SELECT unnest([0, 1, 2]) AS o) WHERE c > 1 GROUP BY 1),
q AS (
  SELECT b.doc_id, len(a)::BIGINT AS n_words, coalesce(list_sum(list_transform(a, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(m.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(a, lambda x: x IN ({stop})))::BIGINT AS n_stop
  FROM b JOIN l ON l.doc_id = b.doc_id LEFT JOIN m ON m.doc_id = b.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {rules} AS kept
FROM q
"""


_OP9 = rf"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS size FROM d GROUP BY 1),
r AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM s),
o AS (
  SELECT *, sum(size) OVER () AS total, sum(w) OVER () AS ws,
    coalesce(sum(3 * size) OVER z, 0) AS cb, coalesce(sum(w) OVER z, 0) AS wb
  FROM r WINDOW z AS (ORDER BY size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 3 * size * (ws - wb) <= w * (total - cb) AS stops FROM o),
t AS (
  SELECT source, size, CASE WHEN stops THEN 3 * size ELSE w * (total - coalesce(sum(CASE WHEN stops THEN 3 * size END) OVER (), 0))
    / (ws - coalesce(sum(CASE WHEN stops THEN w END) OVER (), 0)) END AS target FROM c),
x AS (SELECT *, CASE WHEN size > 0 THEN floor(target / size + 1e-9) ELSE 0 END AS whole FROM t),
u AS (SELECT source, h, sum(size)::DOUBLE AS b FROM d GROUP BY 1, 2),
v AS (SELECT source, h, b, sum(b) OVER (PARTITION BY source ORDER BY h) - b AS below FROM u),
y AS (
  SELECT v.source, v.h, target, x.size AS source_size, whole,
    target - whole * x.size > 0 AND (below + b <= target - whole * x.size
      OR (below <= target - whole * x.size AND below + b - (target - whole * x.size) < target - whole * x.size - below)) AS extra
  FROM v JOIN x ON v.source IS NOT DISTINCT FROM x.source)
SELECT d.doc_id, d.size, y.source_size::BIGINT AS source_size, round(target, 6) AS target, (d.size * (whole + extra::INT))::BIGINT AS taken
FROM d JOIN y ON d.source IS NOT DISTINCT FROM y.source AND d.h = y.h
"""


#: Levels of trees that the SQL of op11 goes up: 8 ** 8 documents of a language, 8 ** 5 languages.
_LEVELS, _TOP_LEVELS = 8, 5


def _op11() -> str:
    """Level by level: nodes, what stands left and right of each in its run, and what a document's proof has gathered so far."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    folded = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def up(name: str, levels: int, key: str) -> list[str]:
        out = []
        for k in range(levels):
            run = f"PARTITION BY {key}, i // 8 ORDER BY i ROWS BETWEEN"
            out.append(f"""{name}s{k} AS MATERIALIZED (SELECT {key}, i, n = 1 AS top,
  coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
  coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM {name}{k})""")
            out.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT {key}, i // 8 AS i, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h,
  CASE WHEN n = 1 THEN 1 ELSE (n + 7) // 8 END AS n FROM {name}{k} GROUP BY {key}, i // 8, n)""")
        return out

    def gather(start: str, name: str, levels: int, key: str, index: str) -> list[str]:
        out = [f"{name}p0 AS (SELECT *, {index} AS i FROM {start})"]
        for k in range(levels):
            out.append(f"""{name}p{k + 1} AS MATERIALIZED (SELECT p.* REPLACE (p.i // 8 AS i, CASE WHEN s.top THEN p.f ELSE sha256(s.lft || p.f || s.rgt) END AS f, p.p || s.lft || s.rgt AS p)
  FROM {name}p{k} p JOIN {name}s{k} s ON p.{key} IS NOT DISTINCT FROM s.{key} AND p.i = s.i)""")
        return out

    crc = """WITH RECURSIVE bits(b, v, k) AS (SELECT b, b, 0 FROM range(256) t(b) UNION ALL
  SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8)"""
    crc32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda x, y: xor(x // 256, t[1 + (xor(x, y) & 255)])))"""
    parts = [
        f"d AS MATERIALIZED (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc32} % 3 = 0 THEN {leaf(folded)} END AS other FROM documents, crc_table)",
        "l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM d)",
        "n0 AS (SELECT lang, r AS i, leaf AS h, n FROM l)",
        *up("n", _LEVELS, "lang"),
        f"t0 AS MATERIALIZED (SELECT 0 AS a, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n FROM n{_LEVELS})",
        *up("t", _TOP_LEVELS, "a"),
        "e0 AS (SELECT doc_id, lang, leaf, r, coalesce(other, leaf) AS f, '' AS p FROM l)",
        *gather("e0", "n", _LEVELS, "lang", "r"),
        f"e1 AS (SELECT x.* EXCLUDE (i), t0.i AS tree, 0 AS a, t0.h AS subroot FROM n{'p'}{_LEVELS} x JOIN t0 ON x.lang IS NOT DISTINCT FROM t0.lang)",
        *gather("e1", "t", _TOP_LEVELS, "a", "tree"),
    ]
    # the place of a leaf in its tree's log: leaves up to it, and the parents completed before it
    place = " + ".join(f"r // {8**k}" for k in range(_LEVELS + 1))
    return f"""{crc},
{", ".join(parts)}
SELECT x.doc_id, leaf, subroot, y.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = y.h AS verified, ({place})::BIGINT AS position
FROM tp{_TOP_LEVELS} x, t{_TOP_LEVELS} y
"""


_OP12 = rf"""
WITH b AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS} AS a FROM documents),
f AS (
  SELECT doc_id, part, CASE WHEN len(a) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(a)) < 50 * len(a) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM b),
g AS (SELECT doc_id, max((quality = 1)::INT) AS q, max((toxic = 1)::INT) AS x FROM labels GROUP BY 1),
c AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(q), 0) AS good, coalesce(sum(x), 0) AS toxic FROM f LEFT JOIN g ON g.doc_id = f.doc_id GROUP BY 1, 2),
s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS s),
o AS (
  SELECT v.s || w.s || x.s || y.s || z.s AS filter_order FROM s v, s w, s x, s y, s z
  WHERE w.s <> v.s AND x.s NOT IN (v.s, w.s) AND y.s NOT IN (v.s, w.s, x.s) AND z.s NOT IN (v.s, w.s, x.s, y.s)),
k AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, filter_order, step, letter, contains(fails, letter) AS hit, translate(fails, before, '') <> fails AS gone, fails = letter AS sole, n, good, toxic FROM c, k),
t AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (sole), 0) AS unique_fails,
    coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost
  FROM r GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM t
"""

#: The components of op1's SQL at the greater similarity.
_OP13 = f"SELECT doc_id, n_shingles, component_id FROM ({_OP1.replace('>= 85 *', '>= 90 *')})"


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {"op1_minhash_near_dedup": _OP1, "op6_warc_revisits": _OP6, "op7_quality_rules": _op7(), "op9_source_mix": _OP9, "op11_merkle_manifest": _op11(), "op12_filter_audit": _OP12, "op13_shingle_jaccard_join": _OP13}
