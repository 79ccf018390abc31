"""Benchmark decontamination with suffix arrays over the training documents.

Each task turns its documents, a shard of about SHARD_BYTES of whole texts at a time, into one sequence of words and
builds the shard's suffix array: suffixes are sorted by their first three words (fewer where a text has very many different words) and the ties are refined by prefix
doubling. Every suffix of every benchmark item is then looked up by binary search of its window (`window`
words; a shorter item's only window is all of it); the range found holds all places where the window occurs verbatim.
Matches that continue along the same item are joined, which gives the longest verbatim matches of a window or more and their places.

A document is whole within one shard, so results need no shuffle and no document text leaves its task. Benchmark items
are read from a shared table in blocks of BLOCK_ITEMS, whatever their number; nothing is broadcast or collected.
Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import shared, vec

WINDOW = 13
SHARD_BYTES = 2 << 20
BLOCK_ITEMS = 5_000
#: What a worker keeps of the benchmark between shards.
CACHE_BYTES = 64 << 20
MOST_MATCHES = 1 << 20


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, never 0; first word of each row), A-Z lower-cased."""
    data = vec.LOWER[data]
    starts, ends, first = vec.words(data, offs, vec.WORD_BYTES)
    return np.maximum(vec.span_hashes(data, starts, ends), 1), first


def key_layout(vocabulary: int) -> tuple[int, int]:
    """(words in a suffix key, bits of each) for so many different words: three words, or fewer where they need more bits."""
    words = next((k for k in (3, 2) if vocabulary < (1 << 63 // k) - 1), 1)
    return words, 63 // words


def suffix_array(seq: np.ndarray, left: np.ndarray, words: int = 3, bits: int = 21) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, their keys: the first `words` values of `bits` bits) of a sequence of small numbers whose texts end with 0.

    left: values from each place to the end of its text. Suffixes that are equal up to there stay in any order.
    """
    n = len(seq)
    ahead = np.concatenate([seq, np.zeros(words - 1, np.int64)])
    key = ahead[:n].copy()
    for k in range(1, words):
        key = key << bits | ahead[k : n + k]
    sa = np.argsort(key)
    keys = key[sa]
    head = np.concatenate([[True], keys[1:] != keys[:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    start_of = np.flatnonzero(head)
    rank[sa] = np.repeat(start_of, np.diff(np.append(start_of, n)))
    depth, at = words, np.flatnonzero(~(head & np.append(head[1:], True))) if n else np.zeros(0, np.int64)
    while True:
        at = at[left[sa[at]] >= depth]  # else the texts have ended alike
        if not len(at):
            return sa, keys
        own, then = rank[sa[at]], rank[np.minimum(sa[at] + depth, n - 1)]
        order = np.lexsort((then, own))
        sa[at] = sa[at][order]
        own, then = own[order], then[order]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (then[1:] != then[:-1])])
        heads = np.flatnonzero(new)
        rank[sa[at]] = np.repeat(at[heads], np.diff(np.append(heads, len(at))))
        at = at[~(new & np.append(new[1:], True))]
        depth *= 2


class Shard:
    """The documents of one slice, with their suffix array over word numbers."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray):
        count = np.diff(first)
        self.vocabulary, number = np.unique(hashes, return_inverse=True)
        self.layout = key_layout(len(self.vocabulary))
        self.begin = first[:-1] + np.arange(len(count))  # each text is followed by a 0
        self.seq = np.zeros(len(hashes) + len(count), np.int64)
        self.seq[vec.ragged(self.begin, count)] = number + 1
        ends = np.repeat(self.begin + count, count + 1)
        self.sa, self.keys = suffix_array(self.seq, ends - np.arange(len(self.seq)) + 1 if len(ends) else ends, *self.layout)
        self.count = count

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers here, or 0 for words that don't occur."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def find(self, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges in the suffix array of the suffixes that start with each row of pattern (all of one length, no 0)."""
        width, (words, bits) = pattern.shape[1], self.layout
        low, high = np.zeros(len(pattern), np.int64), np.zeros(len(pattern), np.int64)
        for k in range(words):
            low = low << bits | (pattern[:, k] if k < width else 0)
            high = high << bits | (pattern[:, k] if k < width else (1 << bits) - 1)
        lo, hi = np.searchsorted(self.keys, low, "left"), np.searchsorted(self.keys, high, "right")
        if width <= words:
            return lo, hi
        some = np.flatnonzero(lo < hi)
        for bound, equal_is_less in ((lo, False), (hi, True)):
            a, b = lo[some].copy(), hi[some].copy()
            while (open_ := np.flatnonzero(a < b)).size:
                mid = (a[open_] + b[open_]) // 2
                at = np.minimum(self.sa[mid][:, None] + np.arange(width), len(self.seq) - 1)
                differs = self.seq[at] - pattern[some[open_]]
                first = (differs != 0).argmax(1)
                sign = differs[np.arange(len(open_)), first]
                less = (sign < 0) | ((sign == 0) & equal_is_less)
                a[open_[less]] = mid[less] + 1
                b[open_[~less]] = mid[~less]
            if equal_is_less:
                hi[some] = a
            else:
                new_low = a
        lo[some] = new_low
        return lo, np.maximum(hi, lo)


def encoded_benchmark(benchmark: DataFrame) -> str:
    """The path of a new shared table of item_id and the hashes of the item's words; items without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in vec.slices(batches):
            hashes, first = word_hashes(data, offs)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))], ["item_id", "words"])

    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    path = shared.new_path(benchmark.sparkSession, "benchmark")
    items.mapInArrow(run, "item_id string, words array<bigint>").where("size(words) > 0").write.parquet(path)
    return path


class Block:
    """Items with the different windows of each: of the block, of each width (a shorter item's only window is all of it)."""

    def __init__(self, ids: list[str | None], words: np.ndarray, first: np.ndarray, window: int):
        self.ids, self.words, self.first = ids, words, first
        size = np.diff(first)
        self.widths = []
        for w in np.unique(np.minimum(size, window)):
            of = np.flatnonzero(np.minimum(size, window) == w)
            made = np.where(size[of] >= window, size[of] - window + 1, 1)
            begin, owner = vec.ragged(first[of], made), np.repeat(of, made)
            h = np.zeros(len(begin), np.uint64)
            for k in range(int(w)):
                h = vec.mix(h * np.uint64(vec.BASE) + words[begin + k])
            _, at, number = np.unique(h, return_index=True, return_inverse=True)
            order = np.lexsort((begin, number))  # places of each window
            self.widths.append((int(w), begin[at], begin[order], owner[order], np.searchsorted(number[order], np.arange(len(at) + 1))))

    def bytes(self) -> int:
        return self.words.nbytes + sum(x.nbytes for _, *arrays in self.widths for x in arrays)


_cached: dict[tuple[str, int], list[Block]] = {}


def blocks(path: str, window: int) -> Iterator[Block]:
    """Blocks of items of a shared table; a worker keeps what takes CACHE_BYTES at most and reads larger benchmarks again for each shard."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector

    if (path, window) in _cached:
        yield from _cached[path, window]
        return
    _cached.clear()
    kept, size = [], 0
    fs, inner = shared.filesystem(path)
    for info in sorted(fs.get_file_info(FileSelector(inner)), key=lambda x: x.path):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                for batch in pq.ParquetFile(f).iter_batches(BLOCK_ITEMS, columns=["item_id", "words"]):
                    lists = batch.column(1)
                    first = lists.offsets.to_numpy().astype(np.int64)
                    block = Block(batch.column(0).to_pylist(), lists.values.to_numpy().view(np.uint64), first, window)
                    size += block.bytes()
                    if size <= CACHE_BYTES:
                        kept.append(block)
                    yield block
    if size <= CACHE_BYTES:
        _cached[path, window] = kept


def found_windows(shard: Shard, block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each width: (width, number of a window, its place in shard.seq) of all its occurrences, and (places in the items, items, first of each window).

    Each place of the shard begins one window of a width, so there are as many occurrences as places at most, however often items repeat a window.
    """
    numbers = shard.numbers(block.words)
    for w, begin, places, owners, first in block.widths:
        pattern = numbers[begin[:, None] + np.arange(w)]
        known = np.flatnonzero((pattern > 0).all(1))
        lo, hi = shard.find(pattern[known])
        n = hi - lo
        yield w, np.repeat(known, n), shard.sa[vec.ragged(lo, n)], places, owners, first


def longest_runs(shard: Shard, block: Block, window: np.ndarray, at: np.ndarray, width: int, places: np.ndarray, owners: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By row: the words of its longest verbatim match (0: none), its place in seq, the item and the place in that; ties: lowest item, then place.

    Windows that follow one another in an item and in a text are one match. Matches are taken up a group of items at a time, of about MOST_MATCHES (window, place) pairs or one item.
    """
    rows = len(shard.count)
    best = [np.zeros(rows, np.int64), *(np.full(rows, -1, np.int64) for _ in range(3))]
    order = np.argsort(window, kind="stable")
    window, at = window[order], at[order]
    begin, end = np.searchsorted(window, np.arange(len(first) - 1)), np.searchsorted(window, np.arange(len(first) - 1), "right")
    number = np.repeat(np.arange(len(first) - 1), np.diff(first))
    by_item = np.argsort(owners, kind="stable")
    by_item = by_item[end[number[by_item]] > begin[number[by_item]]]  # entries (window, place in an item) with occurrences, item by item
    n = (end - begin)[number[by_item]]
    last = np.append(owners[by_item][1:] != owners[by_item][:-1], True)
    total, start = np.cumsum(n), 0
    while start < len(by_item):
        stop = int(np.searchsorted(total, (total[start - 1] if start else 0) + MOST_MATCHES, "right"))
        stop = min(max(stop, start + 1), len(by_item))
        stop += int(np.argmax(last[stop - 1 :]))  # to the end of the item
        entry, count = by_item[start:stop], n[start:stop]
        start = stop
        i = np.repeat(owners[entry], count)
        p = np.repeat(places[entry] - block.first[owners[entry]], count)
        a = at[vec.ragged(begin[number[entry]], count)]
        order = np.lexsort((a, a - p, i))
        i, d, a, p = i[order], (a - p)[order], a[order], p[order]
        head = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (d[1:] != d[:-1]) | (a[1:] != a[:-1] + 1)]))
        size = np.diff(np.append(head, len(i))) - 1 + width
        row = np.searchsorted(shard.begin, a[head], "right") - 1
        pick = np.lexsort((a[head], i[head], -size, row))
        pick = pick[np.concatenate([[True], row[pick][1:] != row[pick][:-1]])]
        pick = pick[size[pick] > best[0][row[pick]]]
        for out, x in zip(best, (size[pick], a[head][pick], i[head][pick], p[head][pick]), strict=True):
            out[row[pick]] = x
    return tuple(best)


EXTRA = {"n_words": "long", "n_hit": "long", "n_items": "long", "items": "array<string>", "longest": "long", "longest_item": "string", "longest_at": "long"}


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, prefix: str = "") -> DataFrame:
    """docs with the columns of EXTRA: words, words inside any occurrence of a window, items with such windows (sorted
    ids), and the longest verbatim match (words, item, first word in the document; 0 and nulls without one).

    A null text has no words. Items that share an id count as one; items without an id hit words like any other, but are not named. Texts of any length and of any number of
    different words take part whole; a text lies in one shard. Equal rows get equal results. Ties of the longest match go to the first block and item. Empty tables: no rows, or no hits. Columns of
    docs with these names (after prefix) are replaced; other columns stay, whatever they are called.
    """
    names = [prefix + k for k in EXTRA]
    kept = docs.drop(*names)
    table = encoded_benchmark(benchmark)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), *(f"`{k}` {v}" for k, v in zip(names, EXTRA.values(), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in vec.slices(batches, "text", SHARD_BYTES):
            shard = Shard(*word_hashes(data, offs))
            n = len(offs) - 1
            cover = np.zeros(len(shard.seq) + 1, np.int64)
            items: list[set[str]] = [set() for _ in range(n)]
            longest = [(0, None, None)] * n
            for block in blocks(table, window):
                for width, number, at, places, owners, first in found_windows(shard, block):
                    cover += np.bincount(at, minlength=len(cover)) - np.bincount(at + width, minlength=len(cover))
                    pairs = np.unique((np.searchsorted(shard.begin, at, "right") - 1) * len(first) + number)
                    row, number_ = pairs // len(first), pairs % len(first)
                    item = owners[vec.ragged(first[number_], first[number_ + 1] - first[number_])]
                    for k in np.unique(np.repeat(row, first[number_ + 1] - first[number_]) * len(block.ids) + item).tolist():
                        if (name := block.ids[k % len(block.ids)]) is not None:
                            items[k // len(block.ids)].add(name)
                    size, where, which, _ = longest_runs(shard, block, number, at, width, places, owners, first)
                    for k in np.flatnonzero(size).tolist():
                        if size[k] > longest[k][0]:
                            longest[k] = (int(size[k]), block.ids[which[k]], int(where[k] - shard.begin[k]))
            hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
            extra = [
                pa.array(shard.count),
                pa.array(hit[shard.begin + shard.count] - hit[shard.begin]),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                *(pa.array([x[j] for x in longest], t) for j, t in enumerate((pa.int64(), pa.string(), pa.int64()))),
            ]
            yield pa.RecordBatch.from_arrays([*rows.columns, *extra], [*rows.schema.names, *names])

    return kept.mapInArrow(run, schema)


def is_contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """At least one word in twenty stands inside an occurrence."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the contaminated ones; same columns."""
    prefix = shared.fresh(docs, "_decontam_")
    found = scan(docs, benchmark, window, prefix)
    return found.where(~is_contaminated(f"{prefix}n_hit", f"{prefix}n_words")).select(*(f"`{c}`" for c in docs.columns))


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted ids joined by commas), contaminated."""
    found = scan(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"), "longest", "longest_item", "longest_at")
