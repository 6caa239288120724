"""Positions of many aliases by one automaton: a text is read once, whatever the size of the lexicon."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stresslens.functions.text import needs_limits

#: Characters that a short alias must not stand beside.
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
#: Rows of a result batch, about.
ROWS = 1 << 15


class Matcher:
    """Finds the aliases of a lexicon (key to aliases) in lower-case texts.

    As ``enrich.mentions``: occurrences of one alias don't overlap, the
    earlier counts; short aliases need word limits if ``bounded``.
    Occurrences of different aliases are independent of each other.
    """

    def __init__(self, lexicon: dict[str, list[str]], bounded: bool = True):
        import ahocorasick

        self.keys: dict[str, list[str]] = {}
        for key, aliases in lexicon.items():
            for alias in aliases:
                if alias:
                    self.keys.setdefault(alias.lower(), []).append(key)
        self.limits = {a for a in self.keys if bounded and needs_limits(a)}
        self.automaton = ahocorasick.Automaton()
        for alias in self.keys:
            self.automaton.add_word(alias, alias)
        if self.keys:
            self.automaton.make_automaton()

    def find(self, text: str) -> set[tuple[str, int]]:
        """(key, position) of each occurrence, from 0, in code points."""
        found, free = set(), {}
        if not self.keys:
            return found
        for end, alias in self.automaton.iter(text):
            start = end + 1 - len(alias)
            if start < free.get(alias, 0) or (alias in self.limits and not self._limited(text, start, end + 1)):
                continue
            free[alias] = end + 1
            found.update((key, start) for key in self.keys[alias])
        return found

    @staticmethod
    def _limited(text: str, start: int, stop: int) -> bool:
        inner = lambda at: 0 <= at < len(text) and text[at] in _WORD
        return not inner(start - 1) and not inner(stop)


def mentions(rows: DataFrame, id: str, text: str, lexicon: dict[str, list[str]], bounded: bool = True) -> DataFrame:
    """(id, key, pos): every position of every alias of a lexicon in the texts, once for each key; a null text has none.

    One pass over the texts; the automaton is built once in a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon, bounded)
        out: list[list] = [[], [], []]

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32())], ["id", "key", "pos"])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for row in range(len(batch)):
                found = matcher.find(batch.column(1)[row].as_py())
                if found:
                    own = batch.column(0)[row].as_py()
                    for key, pos in found:
                        for column, value in zip(out, (own, key, pos), strict=True):
                            column.append(value)
                if len(out[0]) > ROWS:
                    yield flush()
                    out = [[], [], []]
        if out[0]:
            yield flush()

    body = F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    kind = rows.schema[id].dataType.simpleString()
    return rows.select(F.col(id).alias("id"), body.alias("body")).mapInArrow(run, f"id {kind}, key string, pos int")


def entities(rows: DataFrame, id: str, text: str, lexicon: dict[str, list[str]]) -> DataFrame:
    """(id, entities): the sorted keys of which an alias occurs anywhere in the text; ids are unique, texts without any have no row."""
    return mentions(rows, id, text, lexicon, bounded=False).groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("entities"))
