"""Words of Arrow text batches as NumPy arrays: positions and 64-bit hashes, whole texts, no Python per word."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20  # text bytes handled at once; bounds the temporary arrays of a task
_LONG = 512  # words above this many bytes are hashed one by one

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PUNCTUATION = SPACE.copy()  # white space and ASCII marks
PUNCTUATION[[c for c in range(128) if not chr(c).isalnum()]] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble unsigned 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and, in UTF-8, of the capitals of Latin-1."""
    out = LOWER[data]
    if len(out) > 1:
        out[1:] += ((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) * np.uint8(32)
    return out


def text_chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first, last, bytes, offsets`` for stretches of rows of about ``limit`` bytes; null is empty."""
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    payload = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        low = offsets[first]
        yield first, last, payload[low:offsets[last]], offsets[first:last + 1] - low
        first = last


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of consecutive texts, or runs of other bytes than those of ``gap``.

    ``starts``/``ends`` are byte positions, ``bounds[i]:bounds[i+1]`` the words of text i.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        n = len(data)
        solid = ~gap[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        opens, closes = solid.copy(), solid.copy()
        opens[1:] &= ~solid[:-1] | edge[1:n]
        closes[:-1] &= ~solid[1:] | edge[1:n]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """One unsigned 64-bit hash per word, from all its bytes."""
        padded = np.concatenate([self.data, np.zeros(8, dtype=np.uint8)])
        eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        length = self.ends - self.starts
        h = mix(length.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
        long_words = np.flatnonzero(length > _LONG)
        at, rest, left = self.starts.copy(), np.minimum(length, _LONG), np.arange(len(length))
        while len(left):
            taken = np.minimum(rest, 8).astype(np.uint64)
            piece = eight[at] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * taken))
            h[left] = mix(h[left] ^ piece) + np.uint64(0x9E3779B97F4A7C15)
            more = rest > 8
            left, at, rest = left[more], at[more] + 8, rest[more] - 8
        for i in long_words:
            whole = self.data[self.starts[i]:self.ends[i]].tobytes()
            tail = np.array([zlib.crc32(whole), zlib.adler32(whole)], dtype=np.uint64)
            h[i:i + 1] = mix(h[i:i + 1] ^ (tail[:1] << np.uint64(32)) ^ tail[1:])
        return h


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words (order matters)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total = mix(total + h[k:k + n] + np.uint64(0x9E3779B97F4A7C15))
    return total


def sequence_hash(h: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a word sequence as two signed longs."""
    n = np.uint64(len(h))
    place = np.arange(1, len(h) + 1, dtype=np.uint64)
    low = mix(h + place * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    high = mix(mix(h ^ _M2) + place * _M1).sum(dtype=np.uint64)
    pair = mix(np.array([low ^ n, high + n], dtype=np.uint64)).view(np.int64)
    return int(pair[0]), int(pair[1])


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    sizes = np.fromiter((len(v) for v in values), dtype=np.int32, count=len(values))
    flat = np.concatenate(values) if values else np.zeros(0)
    ends = np.concatenate([np.zeros(1, dtype=np.int32), np.cumsum(sizes, dtype=np.int32)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=kind))
