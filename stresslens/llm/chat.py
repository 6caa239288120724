"""Chat formatting whose text a deterministic parser turns back into the same turns.

A turn is ``### <Role>:`` + newline + text + ``</turn>`` + newline.  Inside a
role or text a backslash before ``\\``, ``#``, ``<``, ``:`` or ``n`` escapes
it (``\\n`` in a role is a line break); every other backslash stands for
itself.  The formatter first renders texts as they are, reparses, and
compares; texts that come back changed are escaped further until the parse
equals the source: first only the control strings, then every character
that could be read as part of one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, END = "### ", "</turn>\n"
_STOP = re.compile(r"\\[\\#<:n]|</turn>|### [^\n:]*:\n")
_ESCAPED = re.compile(r"\\([\\#<:n])")


def escape(text: str, level: int) -> str:
    """Level 0: as it is; 1: control strings only; 2: all characters of control strings and backslashes."""
    if level == 1:
        return re.sub(r"</turn>|### ", lambda m: "\\" + m[0], text)
    if level == 2:
        return re.sub(r"[\\#<]", lambda m: "\\" + m[0], text)
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def _role(role: str) -> str:
    return re.sub(r"[\\:]", lambda m: "\\" + m[0], role).replace("\n", "\\n")


def render_turn(role: str, text: str, level: int) -> str:
    return f"{OPEN}{_role(role)}:\n{escape(text, level)}{END}"


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """The turns (role, text, start, end of the escaped text) of a formatted chat; raises ValueError."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError("no turn starts here")
        head = re.compile(r"((?:\\.|[^\\:\n])*):\n").match(formatted, at + len(OPEN))
        if not head:
            raise ValueError("no role")
        place = head.end()
        while True:
            stop = _STOP.search(formatted, place)
            if not stop or stop[0].startswith("#"):
                raise ValueError("a turn starts inside another" if stop else "a turn has no end")
            if stop[0] == "</turn>":
                break
            place = stop.end()
        if not formatted.startswith(END, stop.start()):
            raise ValueError("no line break after a turn")
        turns.append((unescape(head[1]), unescape(formatted[head.end() : stop.start()]), head.end(), stop.start()))
        at = stop.start() + len(END)
    return turns


def format_turn(role: str, text: str) -> str:
    """A turn rendered with the least escaping that parses back to exactly (role, text)."""
    for level in (0, 1, 2):
        out = render_turn(role, text, level)
        try:
            back = parse(out)
        except ValueError:
            continue
        if [(r, t) for r, t, _, _ in back] == [(role, text)]:
            return out
    raise AssertionError("the last level escapes everything")


#: What :func:`format_conversations` returns.
SCHEMA = "conv_id bigint, place bigint, formatted string, loss_start bigint, loss_end bigint"
#: Characters of texts returned at once.
HELD = 1 << 22


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row for each turn of ``turns(conv_id, turn, role, text)``: its part of the formatted chat.

    Columns conv_id, place (0, 1, ...), formatted, and for assistant turns
    loss_start and loss_end (code points of the text, as escaped, in the whole
    chat, which is the parts joined by place).  Turns are ordered by turn
    (null first), then role, then text, so ties and repeated rows have one
    order and all stay.  Null role or text is empty.  Rows with a null conv_id
    form one conversation.  Rows are sorted by Spark; a task holds a few turns
    at a time, and the rows come out in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], ["conv_id", "place", "formatted", "loss_start", "loss_end"])

        done, size, started, current, length, count = [], 0, False, None, 0, 0
        for batch in batches:
            for cells in zip(*(batch.column(i) for i in range(3)), strict=True):
                conv, role, text = (c.as_py() for c in cells)
                if not started or conv != current:
                    started, current, length, count = True, conv, 0, 0
                out, span = format_turn(role, text), (None, None)
                if role == "assistant":
                    span = (length + len(OPEN) + len(_role(role)) + 2, length + len(out) - len(END))
                done.append((conv, count, out, *span))
                length, count, size = length + len(out), count + 1, size + len(out)
                if size > HELD:
                    yield flush()
                    done, size = [], 0
        if done:
            yield flush()

    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted chats say when parsed: digests of turns and of the text under the loss mask.

    Takes the rows as :func:`format_conversations` gives them, each chat's
    turns together and in order; other orders raise ValueError.  Digests and
    counts are carried from turn to turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        def close() -> None:
            out.append((current, count, turns.hexdigest(), chars, loss.hexdigest(), length))

        out, started, current = [], False, None
        turns, loss, count, chars, length = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for batch in batches:
            for cells in zip(*(batch.column(i) for i in range(5)), strict=True):
                conv, place, text, start, end = (c.as_py() for c in cells)
                if not started or conv != current:
                    if started:
                        close()
                    started, current = True, conv
                    turns, loss, count, chars, length = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                found = parse(text)
                if place != count or len(found) != 1:
                    raise ValueError(f"conversation {conv} isn't in order, or a row isn't one turn")
                role, body, first, last = found[0]
                if (start, end) != ((length + first, length + last) if role == "assistant" else (None, None)):
                    raise ValueError(f"conversation {conv} doesn't parse back")
                turns.update(f"{role}\n{body}\n".encode())
                if start is not None:
                    masked = unescape(text[start - length : end - length])
                    loss.update(masked.encode())
                    chars += len(masked)
                count, length = count + 1, length + len(text)
            if len(out) > 10_000:
                yield flush()
                out = []
        if started:
            close()
            yield flush()

    return formatted.select("conv_id", "place", "formatted", "loss_start", "loss_end").mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
