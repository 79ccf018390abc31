"""Exact removal of repeated passages with difference-cover anchors.

A window is `window` consecutive words. With a difference cover of a period v, any two places i and j have a shift t < v for which i + t and
j + t both lie at cover positions modulo v. So where a window stands in two documents, both have the same anchor of window - v + 1 words at a cover
position inside of it, and only anchors at cover positions (3 of 7 places for 13 words) are hashed and compared over the whole table:

1. Documents are dealt out into slices of about SLICE_BYTES. A slice's different anchors, sorted, go to buckets by ranges of the hash; a bucket
   answers each slice by one bit for each anchor: whether another slice has it too.
2. Such anchors are extended to all windows around them. The slice's different windows, with the smallest doc_id that has each, go to buckets
   again, which answer with the smallest doc_id of the whole table where that is another slice's.
3. Each slice compares its own windows and the answers, and cuts the words of windows that start in a smaller doc_id.

Whatever the number of copies, a slice sends an anchor or a window once, so no key is hot, and no pair of documents is ever formed. Anchors are told apart by 64
bits, where an error costs only a useless extension, windows by 96 bits of hashes of their words' bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import shared, vec

WINDOW = 13
#: Difference covers by period; each is a perfect difference set.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
SLICE_BYTES = 8 << 20
#: Text whose anchors (about 0.6 bytes for each of it) make a bucket.
BUCKET_BYTES = 32 << 20
EXTRA = {"n_words": "bigint", "n_removed": "bigint", "kept": "string"}
_LANES = (0x243F6A8885A308D3, 0x13198A2E03707344)


def cover_of(window: int) -> tuple[int, tuple[int, ...]]:
    """(period, cover) with the largest period of up to half a window."""
    period = max(p for p in COVERS if p <= (window + 1) // 2)
    return period, COVERS[period]


def chain(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of n consecutive items from each place on, the last n - 1 places excepted."""
    size = 1
    while size < n and len(h):
        step = min(size, n - size)
        h = vec.mix(h[:-step] * np.uint64(vec.BASE) + h[step:]) if len(h) > step else h[:0]
        size += step
    return h


class Slice:
    """Words, anchors and windows of the documents of one slice; the same rows give the same slice, in whatever order they come."""

    def __init__(self, table: pa.Table, window: int):
        texts = table["text"].cast(pa.large_string()).combine_chunks()
        self.ids = table["doc_id"].combine_chunks()
        self.data, offs = vec.utf8(texts)
        self.starts, self.ends, self.first = vec.words(self.data, offs, vec.VISIBLE_BYTES)
        self.window, (self.period, self.cover) = window, cover_of(window)
        self.count = np.diff(self.first)
        known = np.asarray(self.ids.is_valid())
        self.own = np.where(known, self.ids.fill_null(0).to_numpy(zero_copy_only=False), 0)
        made = np.where(known, np.maximum(self.count - window + 1, 0), 0)  # a row without an id has no place in the order
        self.begin = vec.ragged(self.first[:-1], made)  # first word of each window
        self.row = np.repeat(np.arange(len(made)), made)
        self.lane = vec.span_hashes(self.data, self.starts, self.ends, _LANES[0])

    def anchors(self) -> None:
        """anchor: the different anchor hashes, ascending; place: word and anchor number of each anchor, by word."""
        size = self.window - self.period + 1
        long = np.flatnonzero(self.count >= self.window)
        made = self.count[long] - size + 1
        at = vec.ragged(self.first[:-1][long], made)
        offset = at - np.repeat(self.first[:-1][long], made)
        at = at[np.isin(offset % self.period, self.cover)]
        self.anchor, self.number = np.unique(chain(self.lane, size)[at], return_inverse=True)
        self.at = at

    def windows(self) -> None:
        """a, b: the two hashes of the different windows in order; which: the number of each window of `begin`; least: smallest doc_id of each."""
        a = chain(self.lane, self.window)[self.begin]
        b = (chain(vec.span_hashes(self.data, self.starts, self.ends, _LANES[1]), self.window)[self.begin] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.a, self.b = a[new], b[new]
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.least = np.minimum.reduceat(self.own[self.row[order]], np.flatnonzero(new)) if len(a) else np.zeros(0, np.int64)

    def extended(self, common: np.ndarray) -> np.ndarray:
        """Numbers of the different windows that hold an anchor which another slice has too, ascending."""
        near = np.zeros(len(self.starts) + 1, np.int64)
        at = self.at[common[self.number]]
        np.add.at(near, np.maximum(at - self.period + 1, 0), 1)  # windows that begin up to period - 1 words before the anchor hold it
        np.add.at(near, at + 1, -1)
        return np.unique(self.which[np.cumsum(near)[self.begin] > 0])


def buckets_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of each bucket's part of ascending hashes."""
    edge = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edge), [len(hashes)]])


def by_slice(blobs: dict[int, bytes], bounds: np.ndarray) -> np.ndarray:
    """The buckets' bits for a slice's items, in the items' order; a bucket without an answer says no."""
    out = np.zeros(int(bounds[-1]), bool)
    for k, blob in blobs.items():
        n = int(bounds[k + 1] - bounds[k])
        out[bounds[k] : bounds[k + 1]] = np.unpackbits(np.frombuffer(blob, np.uint8)[: (n + 7) // 8], count=n).astype(bool)
    return out


def meet(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, group number in that order) of all items of some ascending arrays, equal items one group."""
    every = np.concatenate(hashes)
    order = np.argsort(every, kind="stable")
    every = every[order]
    return order, np.cumsum(np.concatenate([[False], every[1:] != every[:-1]]))


def common_anchors(table: pa.Table) -> pa.Table:
    """For each slice of a bucket, the bits of its anchors that some other slice has."""
    parts = [np.frombuffer(x, np.uint64) for x in table["blob"].to_pylist()]
    order, group = meet(parts)
    common = np.empty(len(order), bool)
    common[order] = (np.bincount(group) > 1)[group]
    bits = [np.packbits(x).tobytes() for x in np.split(common, np.cumsum([len(p) for p in parts])[:-1])]
    return pa.table({"slice": table["slice"], "kind": pa.array(np.zeros(len(bits), np.int32)), "bucket": table["bucket"], "blob": pa.array(bits, pa.binary())})


WINDOW_ITEM = np.dtype([("a", "<u8"), ("b", "<u4"), ("least", "<i8")])


def first_ids(table: pa.Table) -> pa.Table:
    """For each slice of a bucket, the bits of its windows that start in a smaller doc_id of another slice, and then the smallest of these ids."""
    parts = [np.frombuffer(x, WINDOW_ITEM) for x in table["blob"].to_pylist()]
    every = np.concatenate(parts)
    order = np.lexsort((every["least"], every["b"], every["a"]))
    a, b, ids = every["a"][order], every["b"][order], every["least"][order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = np.empty(len(order), np.int64)
    least[order] = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
    smaller, cut = least < every["least"], np.cumsum([len(p) for p in parts])[:-1]
    blobs = [np.packbits(s).tobytes() + x[s].tobytes() for s, x in zip(np.split(smaller, cut), np.split(least, cut), strict=True)]
    return pa.table({"slice": table["slice"], "kind": pa.array(np.ones(len(blobs), np.int32)), "bucket": table["bucket"], "blob": pa.array(blobs, pa.binary())})


ITEMS, ANSWERS = "bucket int, slice bigint, blob binary", "slice bigint, kind int, bucket int, blob binary"


def answers(table: pa.Table, kind: int) -> dict[int, bytes]:
    kinds = table["kind"].to_numpy()
    bucket, blob = table["bucket"].to_pylist(), table["blob"]
    return {bucket[i]: blob[i].as_py() for i in np.flatnonzero(kinds == kind).tolist()}


def items(number: int, bounds: np.ndarray, values: np.ndarray) -> pa.Table:
    """Rows of ITEMS with the values of each bucket that has some."""
    full = np.flatnonzero(np.diff(bounds)).tolist()
    blobs = [values[bounds[k] : bounds[k + 1]].tobytes() for k in full]
    return pa.table({"bucket": pa.array(full, pa.int32()), "slice": pa.array([number] * len(full), pa.int64()), "blob": pa.array(blobs, pa.binary())})


def removed_words(part: Slice, found: dict[int, bytes], emitted: np.ndarray, buckets: int) -> np.ndarray:
    """Whether each word of the slice goes: it is covered by a window that a smaller doc_id has, here or in another slice."""
    least = part.least.copy()
    bounds = buckets_of(part.a[emitted], buckets)
    smaller = by_slice(found, bounds)
    for k, blob in found.items():
        n = int(bounds[k + 1] - bounds[k])
        at = emitted[bounds[k] : bounds[k + 1]][smaller[bounds[k] : bounds[k + 1]]]
        least[at] = np.frombuffer(blob, np.int64, len(at), (n + 7) // 8)
    gone = part.begin[least[part.which] < part.own[part.row]]
    depth = np.zeros(len(part.starts) + 1, np.int64)
    np.add.at(depth, gone, 1)
    np.add.at(depth, gone + part.window, -1)
    return np.cumsum(depth[:-1]) > 0


def joined(part: Slice, keep: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one space."""
    at = np.flatnonzero(keep)
    size = part.ends[at] - part.starts[at] + 1
    out = part.data[np.minimum(vec.ragged(part.starts[at], size), max(len(part.data) - 1, 0))]
    end = np.cumsum(size)
    out[end - 1] = 0x20
    last = np.searchsorted(at, part.first)  # first kept word of each row
    bounds = np.concatenate([[0], end])[last]
    full = bounds[1:] > bounds[:-1]
    drop = bounds[1:][full] - 1  # the space after a row's last word
    out = np.delete(out, drop)
    offsets = bounds - np.concatenate([[0], np.cumsum(full)])
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())])


def scan(docs: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with n_words, n_removed and kept: the words left, joined by one space, when each word goes that is covered by a window of `window` words
    which also starts in a document with a smaller doc_id. Words are runs of other characters than \\x20 and \\x09-\\x0D.

    All windows are judged on the input. Repetitions within a document stay, and rows that share a doc_id (a tie) take nothing from each other. A row without a doc_id is
    neither smaller nor greater than any: it keeps its words and takes none. A null text has no words and `kept` is empty, as it is for a text without any; a text
    shorter than a window keeps all. Texts of any length take part whole, each in one slice. An empty table gives no rows. Columns of docs called like the new ones are replaced; other
    columns stay, whatever they are called.
    """
    spark = docs.sparkSession
    given = docs.drop(*EXTRA).withColumn("text", F.col("text").cast("string")).withColumn("doc_id", F.col("doc_id").cast("long"))
    columns = given.columns
    number = shared.fresh(given, "_slice")
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices, buckets = max(least, -(-size // slice_bytes)), max(least, -(-size // bucket_bytes))
    rows = shared.table(given.withColumn(number, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slices))), "slices", "zstd")

    def slice_of(table: pa.Table) -> tuple[int, Slice]:
        return table[number][0].as_py(), Slice(table, window)

    def send_anchors(table: pa.Table) -> pa.Table:
        at, part = slice_of(table)
        part.anchors()
        out = items(at, buckets_of(part.anchor, buckets), part.anchor)
        vec.release()
        return out

    asked = rows.select("doc_id", "text", number).groupBy(number).applyInArrow(send_anchors, ITEMS)
    common = shared.table(asked.groupBy("bucket").applyInArrow(common_anchors, ANSWERS), "anchors")
    del asked
    shared.forget()  # the shuffled texts

    def emitted(part: Slice, found: pa.Table) -> np.ndarray:
        part.anchors()
        part.windows()
        return part.extended(by_slice(answers(found, 0), buckets_of(part.anchor, buckets)))

    def send_windows(table: pa.Table, found: pa.Table) -> pa.Table:
        at, part = slice_of(table)
        which = emitted(part, found)
        made = np.empty(len(which), WINDOW_ITEM)
        made["a"], made["b"], made["least"] = part.a[which], part.b[which], part.least[which]
        out = items(at, buckets_of(made["a"], buckets), made)
        vec.release()
        return out

    asked = rows.select("doc_id", "text", number).groupBy(number).cogroup(common.groupBy("slice")).applyInArrow(send_windows, ITEMS)
    firsts = shared.table(asked.groupBy("bucket").applyInArrow(first_ids, ANSWERS), "windows")
    del asked
    shared.forget()

    def finish(table: pa.Table, found: pa.Table) -> pa.Table:
        _, part = slice_of(table)
        gone = removed_words(part, answers(found, 1), emitted(part, found), buckets)
        total = np.concatenate([[0], np.cumsum(gone)])[part.first]
        extra = [pa.array(part.count), pa.array(np.diff(total)), joined(part, ~gone).cast(pa.string())]
        out = pa.table([*(table[c] for c in columns), *extra], names=[*columns, *EXTRA])
        vec.release()
        return out

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields), *(f"{k} {v}" for k, v in EXTRA.items())])
    return rows.groupBy(number).cogroup(common.unionByName(firsts).groupBy("slice")).applyInArrow(finish, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return scan(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
