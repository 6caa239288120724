"""Word hashing over Arrow text columns without a Python object per word.

Words are the runs of ``[^\\x20\\x09-\\x0D]``, the same classes that
``bytes.split()`` uses.  A word's 64-bit hash is a polynomial over random
per-byte values, so equal words have equal hashes in every task and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the temporary arrays.
SLICE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_values(fold: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if fold:
        codes[65:91] += _U(32)
    values = mix((codes + _U(1)) * _U(0x9E3779B97F4A7C15))
    values[_SPACE] = 0
    return values


_VALUES = {True: _byte_values(True), False: _byte_values(False)}
_POWERS = [np.cumprod(np.full(1 << 12, 0xD6E8FEB86659FD93, np.uint64))]


def _powers(n: int) -> np.ndarray:
    if n > len(_POWERS[0]):
        _POWERS[0] = np.cumprod(np.full(2 * n, 0xD6E8FEB86659FD93, np.uint64))
    return _POWERS[0]


def find_words(data: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word; ``breaks`` are extra word boundaries."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    if breaks is not None and len(breaks):
        breaks = breaks[(breaks > 0) & (breaks < len(data))]
        first[breaks] = inside[breaks]
        last[breaks - 1] = inside[breaks - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of the words at ``starts``..``ends`` (ASCII case folded if ``fold``)."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    longest = int((ends - starts).max())
    values = _VALUES[fold][data[starts[0]:]] * _powers(longest)[np.minimum(place, longest - 1)]
    return mix(np.add.reduceat(values, starts - starts[0]) + (ends - starts).astype(np.uint64))


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return data, offsets


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and each row's offsets in them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    return _buffers(column)


def hash_texts(column: pa.Array, fold: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (row, word hashes, word start bytes within the row) for each row of a text column."""
    data, offsets = text_bytes(column)
    row = 0
    while row < len(column):
        until = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        until = min(until, len(column))
        part = data[offsets[row] : offsets[until]]
        if until == row + 1 and len(part) > SLICE:
            yield row, *_long_text(part, fold)
        else:
            cuts = offsets[row : until + 1] - offsets[row]
            starts, ends = find_words(part, cuts)
            hashes = hash_spans(part, starts, ends, fold)
            at = np.searchsorted(starts, cuts)
            for k in range(until - row):
                yield row + k, hashes[at[k] : at[k + 1]], starts[at[k] : at[k + 1]] - cuts[k]
        row = until


def _long_text(data: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """A text longer than a slice, hashed piece by piece; pieces end at white space."""
    hashes, places, begin = [], [], 0
    while begin < len(data):
        end = begin + SLICE
        while end < len(data) and not (space := np.flatnonzero(_SPACE[data[end : end + SLICE]])[:1]).size:
            end += SLICE
        end = min(len(data), end + int(space[0])) if end < len(data) else len(data)
        starts, ends = find_words(data[begin:end])
        hashes.append(hash_spans(data[begin:end], starts, ends, fold))
        places.append(starts + begin)
        begin = end
    return np.concatenate(hashes), np.concatenate(places)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct shingles of ``size`` words; a shorter text is one shingle."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64)
    width = min(size, n)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total = mix(total + hashes[k : n - width + 1 + k])
    return np.unique(total)
