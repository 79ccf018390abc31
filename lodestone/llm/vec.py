"""Vectorised text primitives on Arrow batches: UTF-8 bytes as numpy arrays, spans and their hashes.

Texts stay in Arrow's contiguous UTF-8 buffer; a batch is worked on in slices of whole rows of about
SLICE_BYTES, so memory follows the slice (or the longest single text), not the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
#: An odd multiplier.
BASE = 0x9E3779B97F4A7C15


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of consecutive rows with about `limit` bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.names.index(column)
        data, offs = utf8(batch.column(at))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offs, offs[begin] + limit, "right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin), data[offs[begin] : offs[end]], offs[begin : end + 1] - offs[begin]
            begin = end
    release()


def release() -> None:
    """Give freed memory back to the system: workers live on after a task, and other operators' tasks need the room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: a bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: The bytes of a chunk that belong to a span with so many bytes left.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer spans are hashed one by one.
LONG_SPAN = 512


def chunks(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a number; zeros follow the end."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, np.uint64, wide, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = BASE) -> np.ndarray:
    """64-bit hash of the bytes data[starts[i]:ends[i]]; equal spans hash alike wherever they stand.

    The length and each 8 bytes go through the finaliser one after another, so spans of like structure collide no more often than others.
    """
    size = ends - starts
    h = mix(size.astype(np.uint64) + np.uint64(seed))
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest()
        h[i] = int.from_bytes(digest, "little")
    live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    at, left, own, eight = starts[live], size[live], h[live], chunks(data)
    while len(live):
        own = mix(own ^ (eight[at] & _MASKS[np.minimum(left, 8)]))
        h[live] = own
        more = np.flatnonzero(left > 8)
        live, at, left, own = live[more], at[more] + 8, left[more] - 8, own[more]
    return h


def equal_spans(data: np.ndarray, starts: np.ndarray, other: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether data[starts[i]:][:sizes[i]] is other[places[i]:][:sizes[i]], by their bytes."""
    out = np.ones(len(sizes), bool)
    live, left, a, b = np.flatnonzero(sizes > 0), sizes[sizes > 0], chunks(data), chunks(other)
    step = 0
    while len(live):
        same = ((a[starts[live] + step] ^ b[places[live] + step]) & _MASKS[np.minimum(left, 8)]) == 0
        out[live[~same]] = False
        more = np.flatnonzero(same & (left > 8))
        live, left, step = live[more], left[more] - 8, step + 8
    return out


def class_table(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z: digits, a-z and all that isn't ASCII.
WORD_BYTES = class_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: [^\x20\x09-\x0D]
VISIBLE_BYTES = ~class_table((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row) of the maximal runs of `inside` bytes; no run crosses a row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    is_in = inside[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = is_in[0], is_in[-1]
    np.not_equal(is_in[1:], is_in[:-1], out=edge[1:-1])
    cut = offs[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[is_in[cut] & is_in[cut - 1]]  # a run that would go on into the next row
    at = np.flatnonzero(edge)
    if len(cut):
        at = np.sort(np.concatenate([at, cut, cut]))
    starts, ends = at[::2], at[1::2]
    return starts, ends, np.searchsorted(starts, offs)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the ranges [start, start + length), one range after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] for each row i, along the first axis; empty rows give 0. Equal rows have equal sums."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), np.float64)
    full = first[1:] > first[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, first[:-1][full], axis=0, dtype=np.float64)
    return out


def row_minima(values: np.ndarray, first: np.ndarray, empty) -> np.ndarray:
    """Minimum of each row's values; `empty` for a row without any."""
    out = np.full(len(first) - 1, empty, values.dtype)
    full = first[1:] > first[:-1]
    if full.any():
        out[full] = np.minimum.reduceat(values, first[:-1][full])
    return out


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of n consecutive words, first of each row); a row of 1 to n - 1 words has one shingle of them all."""
    count = np.diff(first)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(made)])
    start = ragged(first[:-1], made)
    size = np.minimum(np.repeat(count, made), n)
    h = np.zeros(len(start), np.uint64)
    for k in range(n):
        if k == 0:
            h += hashes[start] * np.uint64(BASE)
        else:
            with_k = size > k
            at = np.where(with_k, start + k, start)
            h = np.where(with_k, (h ^ (h >> np.uint64(29))) * np.uint64(BASE) + hashes[at], h)
    return mix(h), to


class Memo:
    """Map of 64-bit keys to entry numbers with vectorised look-up; forgets everything when full."""

    PROBES = 4

    def __init__(self, bits: int = 21):
        self.mask = np.uint64((1 << bits) - 1)
        self.limit = 1 << (bits - 1)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(int(self.mask) + 1 + self.PROBES, np.uint64)
        self.entry = np.full(int(self.mask) + 1 + self.PROBES, -1, np.int32)
        self.size = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry number of each key, or -1."""
        slot = (keys & self.mask).astype(np.int64)
        out = np.where(self.keys[slot] == keys, self.entry[slot], -1)
        for probe in range(1, self.PROBES):
            open_ = np.flatnonzero(out < 0)
            if not len(open_):
                break
            at = slot[open_] + probe
            out[open_] = np.where(self.keys[at] == keys[open_], self.entry[at], -1)
        return out

    def add(self, keys: np.ndarray, entries: np.ndarray) -> None:
        """Insert keys that are distinct and absent; a key without a free slot displaces another."""
        slot = (keys & self.mask).astype(np.int64)
        left = np.arange(len(keys))
        for probe in range(self.PROBES):
            at = slot[left] + probe
            free = self.entry[at] < 0
            tried = left[free]
            self.keys[slot[tried] + probe] = keys[tried]
            self.entry[slot[tried] + probe] = entries[tried]
            left = left[(self.keys[slot[left] + probe] != keys[left]) | (self.entry[slot[left] + probe] != entries[left])]
            if not len(left):
                break
        self.keys[slot[left]] = keys[left]
        self.entry[slot[left]] = entries[left]
        self.size += len(keys)
