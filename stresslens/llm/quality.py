"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
_SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for on with as be by this are at from "
    "der die das und zu den von mit ist im auf für sich "
    "le la les de des et en un une que qui dans pour est "
    "el los las y del por con se no su al lo"
).split()

#: (rule, left, limit, right): a text fails when left > limit * right; all terms are counts of the text.
RULES = (
    ("symbols", "10 * n_symbols", 2, "n_words"),
    ("duplicate_lines", "10 * n_dup_lines", 3, "n_lines"),
    ("short_words", "2 * n_words", 1, "word_chars"),
    ("long_words", "word_chars", 20, "n_words"),
    ("stop_words", "n_words", 25, "n_stop"),
    ("few_lines_of_words", "n_lines", 1, "n_words"),
)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """The runs of ``[^\\x20\\x09-\\x0D]`` of a text; null gives an empty array."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE_CHARS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE))


def _repeated_starts(windows: Column) -> Column:
    """Sorted positions of the array's values that occur at least twice."""

    def mark(pairs: Column) -> Column:
        same = lambda i, h: F.coalesce(F.get(pairs, i)["h"] == h, F.lit(False))
        return F.transform(pairs, lambda p, i: F.when(same(i - 1, p["h"]) | same(i + 1, p["h"]), p["i"]))

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.sort_array(F.filter(let(pairs, mark), lambda i: i.isNotNull()))


def repeated_words(words: Column) -> Column:
    """How many words stand in three-word windows that occur at least twice in the text."""
    starts = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    covered = lambda at: F.aggregate(
        F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    return let(
        windows,
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(_repeated_starts(w), covered)),
    ).cast("long")


#: The counts of a text that rules read, in order.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop")


def _verdict(m: Column, rules) -> tuple[Column, Column]:
    """(base_failed, kept) of a struct of counts, from a threshold table; rules are compiled against the struct's fields."""
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])

    def side(term: str) -> Column:
        parts = [m[t] if t in MEASURES else F.lit(int(t)) for t in (x.strip() for x in term.split("*"))]
        return reduce(mul, parts)

    broken = [side(left) > limit * side(right) for _, left, limit, right in rules]
    return failed, reduce(lambda kept, rule: kept & ~rule, broken, ~failed)


def assessed(text: Column, rules=RULES) -> Column:
    """All counts of a text with base_failed and kept, as one struct.

    The text and its words stand behind lambda variables.  So the optimizer,
    which copies a column's definition into whatever reads the column (a
    filter on ``kept`` that it moves below the projection, say), can only
    copy the whole, never the splitting of a text into the loop over its words.
    """

    def counted(body: Column, words: Column, lines: Column) -> Column:
        values = (
            F.size(words), F.length(F.regexp_replace(body, SPACE, "")), F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")),
            F.size(lines), F.size(lines) - F.size(F.array_distinct(lines)), repeated_words(words), F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))),
        )
        return F.struct(*[v.cast("long").alias(n) for n, v in zip(MEASURES, values, strict=True)])

    def judged(m: Column) -> Column:
        failed, kept = _verdict(m, rules)
        return F.struct(*[m[n].alias(n) for n in MEASURES], failed.alias("base_failed"), kept.alias("kept"))

    def whole(body: Column) -> Column:
        lines = F.filter(F.split(body, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
        return let(words_of(body), lambda words: let(lines, lambda found: let(counted(body, words, found), judged)))

    return let(F.coalesce(text.cast("string"), F.lit("")), whole)


def _rows(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def score_quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """Per row of ``docs``: its columns in ``row``, the measures, base_failed and kept.

    A null or empty text has no words and fails; every row gets one verdict,
    repeated rows alike; other columns are carried untouched, whatever their
    names (they stay in ``row``, so none can clash).  An empty table gives no
    rows.  Time is linear in the length of a text, but for sorting its words.
    """
    judged = docs.select(_rows(docs), assessed(F.col("text"), rules).alias("m"))
    return judged.select("row", *[F.col(f"m.{n}").alias(n) for n in (*MEASURES, "base_failed", "kept")])


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass the rules, with their columns."""
    return docs.select(_rows(docs), assessed(F.col("text"), rules)["kept"].alias("kept")).where("kept").select("row.*")
