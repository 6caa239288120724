"""Text functions for news-like articles, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token pattern of queries, Latin words with marks or a run of Japanese.
TOKEN = r"[a-z0-9_./%-]+|[ぁ-んァ-ヶ一-龠々ー]+"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalise(text: Column | str) -> Column:
    """Trimmed, lower case, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(_col(text), r"[ \t\n\r\x0b\f]+", " ")))


def tokens(text: Column | str, most: int | None = None, shortest: int = 1) -> Column:
    """Query tokens in order, at most ``most`` of at least ``shortest`` characters."""
    found = F.regexp_extract_all(normalise(text), F.lit(TOKEN), F.lit(0))
    if shortest > 1:
        found = F.filter(found, lambda t: F.length(t) >= shortest)
    return F.slice(found, 1, most) if most else found


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a non-empty term."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int")


def lexical_score(text: Column | str, phrase: str, terms: list[str]) -> Column:
    """8 for the whole phrase; for each term that occurs 2 and a quarter for each occurrence, 3 at most."""
    body = normalise(text)
    score = F.when(F.contains(body, F.lit(phrase)), 8.0).otherwise(0.0)
    for term in terms:
        n = occurrences(body, F.lit(term))
        score = score + F.when(n > 0, 2.0 + F.least(F.lit(3.0), 0.25 * n)).otherwise(0.0)
    return score


#: Fixed value: a publisher at the end of a title.
TITLE_SUFFIX = r"\s+-\s+([^-]{1,80})$"


def canonical_title(title: Column | str) -> Column:
    """The title without a trailing `` - Publisher`` of up to 80 characters."""
    return F.trim(F.regexp_replace(_col(title), TITLE_SUFFIX, ""))


def publisher(title: Column | str, source: Column | str) -> Column:
    """The publisher at the end of a title, else the feed's name."""
    found = F.regexp_extract(_col(title), TITLE_SUFFIX, 1)
    return F.coalesce(F.nullif(F.trim(found), F.lit("")), _col(source))


def article_id(title: Column | str, publisher_name: Column | str, published: Column | str) -> Column:
    """Content key: 24 hex digits of a digest of title, publisher and day."""
    key = F.concat_ws("|", F.lower(_col(title)), F.lower(_col(publisher_name)), F.substring(_col(published).cast("string"), 1, 10))
    return F.substring(F.sha2(key, 256), 1, 24)


def event_id(topic: Column | str, doc_id: Column | str) -> Column:
    """Key of an event from its topic and first article."""
    return F.concat(F.lit("evt_"), F.substring(F.sha1(F.concat_ws("|", _col(topic), _col(doc_id).cast("string"))), 1, 16))


#: Entities that are replaced after tags are dropped.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def numeric_entities(text: Column) -> Column:
    """The text with decimal and hexadecimal character references resolved."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|.[^&]*"), F.lit(0))

    def resolve(p: Column) -> Column:
        hexadecimal = F.conv(F.regexp_extract(p, "^&#[xX]([0-9a-fA-F]+);$", 1), 16, 10)
        code = F.when(p.rlike("^&#[xX][0-9a-fA-F]{1,6};$"), hexadecimal).when(p.rlike("^&#[0-9]{1,7};$"), F.regexp_extract(p, "^&#([0-9]+);$", 1)).cast("int")
        return F.when(code.isNull() | (code > 0x10FFFF), p).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    return F.when(F.contains(text, F.lit("&#")), F.array_join(F.transform(parts, resolve), "")).otherwise(text)


def html_text(html: Column | str) -> Column:
    """Text of a page: tags replaced by blanks, common and numeric entities resolved, white space collapsed."""
    out = F.regexp_replace(_col(html), r"<[^>]+>", " ")
    out = numeric_entities(out)
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\n\r]+", " "))


def needs_limits(alias: str) -> bool:
    """Whether an alias counts only between word limits: short ASCII ones do."""
    return alias.isascii() and sum(c.isalnum() for c in alias) <= 3


def alias_pattern(alias: str) -> str:
    """A pattern for an alias: short ASCII ones need word limits, others match anywhere."""
    body = re.escape(alias.lower())
    if needs_limits(alias):
        return rf"(?<![a-z0-9]){body}(?![a-z0-9])"
    return body


def lexicon_matches(text: Column | str, lexicon: dict[str, list[str]], bounded: bool = True) -> Column:
    """Sorted keys of a lexicon (key to aliases) of which an alias occurs in the text.

    With ``bounded`` short aliases need word limits; without, any substring counts.
    One alternation for each key: the text is scanned once a key.
    """
    body = F.lower(F.coalesce(_col(text), F.lit("")))
    hits = [
        F.when(body.rlike("|".join(alias_pattern(a) if bounded else re.escape(a.lower()) for a in aliases)), F.lit(key))
        for key, aliases in sorted(lexicon.items())
    ]
    return F.filter(F.array(*hits), lambda k: k.isNotNull())


def embedding_text(*parts: Column | str) -> Column:
    """The text that is embedded: parts that are there, one a line."""
    return F.concat_ws("\n", *[_col(p) for p in parts])


def truncated(text: Column | str, most: int) -> Column:
    """The first ``most`` characters: 1200 for summaries, 140 for labels."""
    return F.substring(_col(text), 1, most)


def parsed_time(text: Column | str) -> Column:
    """An ISO time as UTC; missing or unreadable ones are the epoch."""
    return F.coalesce(F.try_to_timestamp(_col(text)), F.timestamp_seconds(F.lit(0)))


def language(locale: Column | str, default: str = "en") -> Column:
    """The language of a locale such as ``ja-JP``."""
    return F.coalesce(F.nullif(F.lower(F.split_part(F.replace(_col(locale), F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1))), F.lit("")), F.lit(default))


def trust(value: Column | str, default: float = 0.72) -> Column:
    """The trust of a source; sources without one get the default."""
    return F.coalesce(_col(value).cast("double"), F.lit(default))


def query_url(template: str, query: Column | str) -> Column:
    """A feed's address: ``{query}`` of the template replaced by the encoded query."""
    before, _, after = template.partition("{query}")
    return F.concat(F.lit(before), F.url_encode(_col(query)), F.lit(after))


def float_bytes(vector: Column | str) -> Column:
    """A vector in 4-byte precision."""
    return _col(vector).cast("array<float>")


def expand_aliases(found: Column, aliases: dict[str, list[str]]) -> Column:
    """Query tokens, followed by those that the aliases of a token or phrase add, once each."""
    added = [F.when(F.array_contains(found, key), F.array(*map(F.lit, values))).otherwise(F.array().cast("array<string>")) for key, values in sorted(aliases.items())]
    return F.array_distinct(F.concat(found, *added))


def flags(**conditions: Column) -> Column:
    """The names of the conditions that hold, in the order given."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]), lambda n: n.isNotNull())
