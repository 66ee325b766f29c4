"""Vectorised words of Arrow string columns: byte spans and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}

#: Texts are handled in groups of about so many bytes; a longer text is a group of its own.
GROUP_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits depend on all input bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, GROUP_BYTES + 1)
        raw = np.full(size, base, dtype=np.uint64)
        raw[0] = 1
        have = np.multiply.accumulate(raw)
        if size <= GROUP_BYTES + 1:  # those of a longer text are not kept
            _powers[kind] = have
    return have[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def groups(offsets: np.ndarray):
    """Ranges of texts of about GROUP_BYTES."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + GROUP_BYTES, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes that are not in gap, and for each text the index of its first word (n + 1 entries). data starts at offsets[0]."""
    offsets = offsets - offsets[0]
    word = ~gap[data]
    opens, closes = np.ones(len(data), dtype=bool), np.ones(len(data), dtype=bool)
    opens[1:] = ~word[:-1]
    closes[:-1] = ~word[1:]
    opens[offsets[offsets < len(data)]] = True
    closes[offsets[offsets > 0] - 1] = True
    starts, ends = np.flatnonzero(word & opens), np.flatnonzero(word & closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, after lower-casing A-Z."""
    return run_hashes(data, starts, [ends], lower)[0]


def run_hashes(data: np.ndarray, starts: np.ndarray, many_ends: list[np.ndarray], lower: bool = True) -> list[np.ndarray]:
    """Hashes of the bytes from each start to each of its ends."""
    if not len(starts):
        return [np.zeros(0, dtype=np.uint64) for _ in many_ends]
    with np.errstate(over="ignore"):
        values = (_LOWER[data] if lower else data).astype(np.uint64)
        values += np.uint64(1)
        values *= _power("up", _BASE, len(data))
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values, out=total[1:])
        before, unshift = total[starts], _power("down", _INVERSE, len(data))[starts]
        return [mix((total[ends] - before) * unshift) for ends in many_ends]


def grouped_words(column: pa.Array, lower: bool = True):
    """For each group of texts: index of its first text, word hashes, first word of each text (n + 1 entries)."""
    data, offsets = text_buffers(column)
    for lo, hi in groups(offsets):
        part = data[offsets[lo] : offsets[hi]]
        starts, ends, first = spans(part, offsets[lo : hi + 1])
        yield lo, word_hashes(part, starts, ends, lower), first
