"""Numpy helpers for Arrow batches of texts: word boundaries, word hashes and shingles of many texts at once."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are looked at together; arrays of eight bytes a text byte stay near a core's cache.
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FAR = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE_WORD = np.ones(256, dtype=bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def lower_points() -> np.ndarray:
    """The lower-case code point of each code point, where that is a single one."""
    lowered = (chr(c).lower() for c in range(0x110000))
    return np.fromiter((ord(x) if len(x) == 1 else c for c, x in enumerate(lowered)), np.uint32, 0x110000)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text starts (one more entry for the end). Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SLICE_BYTES of text, one row at least."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        at, rows = 0, batch.num_rows
        while at < rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
            yield batch.slice(at, min(to, rows) - at)
            at = min(to, rows)


class Words:
    """Words of several texts: hashes in order, and the first word of each text in `first` (one more entry for the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        data = LOWER[data]
        word = inside[data]
        before = np.empty_like(word)
        before[1:] = word[:-1]
        begins = offsets[:-1]
        if len(before):
            before[0] = False
        before[begins[begins < len(data)]] = False
        self.starts = np.flatnonzero(word & ~before)
        self.first = np.searchsorted(self.starts, offsets)
        if not len(self.starts):
            self.hashes = np.zeros(0, np.uint64)
            return
        lengths = np.diff(np.append(self.starts, len(data)))
        from0 = self.starts[0]
        place = np.arange(from0, len(data)) - np.repeat(self.starts, lengths)
        value = _BYTE[data[from0:]] * _PLACE[place & 63]
        if lengths.max() > 64:
            value *= _FAR[(place >> 6) & 63]
        value *= word[from0:]
        count = np.add.reduceat(word[from0:].astype(np.int64), self.starts - from0)
        self.hashes = mix(np.add.reduceat(value, self.starts - from0) + count.astype(np.uint64))

    def shingles(self, k: int) -> list[np.ndarray]:
        """For each text the distinct hashes of its k-word shingles, sorted; all words as one if there are fewer than k."""
        n = len(self.hashes)
        full = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            full += self.hashes[j : n - k + 1 + j] * _ORDER[j] if n >= k else 0
        full = mix(full)
        out = []
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(full[a : b - k + 1]))
            elif b > a:
                out.append(mix(np.array([(self.hashes[a:b] * _ORDER[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
            else:
                out.append(full[:0])
        return out
