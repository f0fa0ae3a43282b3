"""Vectorised words and hashes over Arrow string columns.

Everything here works on bytes: UTF-8 bytes of 0x80 and above are never ASCII
separators, so byte classes and character classes agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_B = 0x9E3779B97F4A7C15 | 1
_BASE = 0xD1342543DE82EF95
_INV = pow(_BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 4 * SLICE_BYTES:
            _powers[name] = have
    return have


def _table(separators: set[int], lower: bool = True) -> np.ndarray:
    """Codes of the 256 bytes: 0 for separators, else a code of its own; A-Z share those of a-z."""
    codes, nxt = np.zeros(256, dtype=np.uint8), 1
    for b in range(256):
        if b not in separators and not (lower and 0x41 <= b <= 0x5A):
            codes[b] = nxt
            nxt += 1
    if lower:
        for b in range(0x41, 0x5B):
            codes[b] = codes[b + 32]
    return codes


SPACED = _table({0x20, *range(0x09, 0x0E)})
ALNUM = _table({*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)} - set(range(0x41, 0x5B)))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and offsets[n + 1] into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None and len(column) else np.zeros(len(column) + 1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to `limit` bytes together; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED, hashed: bool = True, kinds: np.ndarray | None = None):
    """(starts, ends, row, hash) of every word; words never cross a row, nor, with kinds, bytes of different kinds."""
    codes = table[data]
    inside = codes != 0
    if not len(codes) or not inside.any():
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, np.zeros(0, dtype=np.uint64)
    change = inside[1:] != inside[:-1] if kinds is None else (kind := kinds[data])[1:] != kind[:-1]
    first = inside.copy()
    first[1:] &= change
    last = inside.copy()
    last[:-1] &= change
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(codes))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, starts, side="right") - 1
    if not hashed:
        return starts, ends, row, None
    power = _power("power", _BASE, len(codes) + 1)
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * power[: len(codes)], out=total[1:])
    value = (total[ends] - total[starts]) * _power("inverse", _INV, len(codes) + 1)[starts]
    return starts, ends, row, mix(value + (ends - starts).astype(np.uint64) * np.uint64(_B))


def word_rows(column: pa.Array, table: np.ndarray = SPACED) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows i..j of a column: (i, j, bounds[j - i + 1] into hashes, hashes of the words)."""
    data, offsets = text_bytes(column)
    for i, j in slices(offsets):
        own = offsets[i : j + 1] - offsets[i]
        _, _, row, value = words(data[offsets[i] : offsets[j]], own, table)
        yield i, j, np.searchsorted(row, np.arange(j - i + 1)), value


_GRAM = np.array([0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingles(value: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes, ascending, of one text's shingles of `size` words; fewer words make one, none none."""
    n = len(value)
    if not n:
        return value
    own = min(size, n)
    total = np.full(n - own + 1, own, dtype=np.uint64)
    for k in range(own):
        total += value[k : n - own + 1 + k] * _GRAM[k]
    return np.unique(mix(total))


def hash_word(word: bytes, table: np.ndarray = SPACED) -> int:
    """The hash of one word, as words() gives it."""
    data = np.frombuffer(word, dtype=np.uint8)
    return int(words(data, np.array([0, len(data)]), table)[3][0])
