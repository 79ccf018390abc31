"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into LZ78 phrases over its UTF-8 bytes: each phrase is the shortest stretch, from where the last one
ended, that is not yet in the text's dictionary, which it then joins; the rest at the end is a phrase too. The set of
phrases is hashed and its minima under HASHES functions, shortened to 16 bits each, are the fingerprint in hex. The
share of equal minima estimates the Jaccard likeness of the phrase sets, which is high for texts that would compress each other
well. Equal texts have equal fingerprints; a text without phrases has a fingerprint of zeros.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import vec

HASHES = 128
_FACTOR = np.random.default_rng(7).integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = np.random.default_rng(8).integers(0, 1 << 32, HASHES, dtype=np.uint32)
#: Phrase starts and ends are hashed together until they fill about this many bytes of text.
FLUSH_BYTES = 1 << 20
Parsed = tuple[int, dict, int, list[int]]


def parse(text: bytes, state: Parsed | None = None) -> Parsed:
    """Go on with a parse of LZ78 phrases over text.

    The state is (current node, dictionary from node * 256 + byte to node, place where the current phrase began, phrase ends).
    """
    node, tree, begin, ends = state or (0, {}, 0, [])
    fresh = len(tree) + 1
    get = tree.get
    for at, byte in enumerate(text, begin):
        key = node << 8 | byte
        node = get(key)
        if node is None:
            tree[key] = fresh
            fresh += 1
            ends.append(at + 1)
            node = 0
    return node, tree, begin + len(text), ends


def phrase_ends(text: bytes) -> list[int]:
    """Ends of all phrases of a text, with that of the rest."""
    _, _, size, ends = parse(text)
    return ends if not size or (ends and ends[-1] == size) else [*ends, size]


def shared_start_ends(text: bytes, edited: bytes, common: int) -> tuple[list[int], list[int]]:
    """phrase_ends() of two texts that agree in their first `common` bytes, which are parsed once."""
    node, tree, at, ends = parse(text[:common])
    out = []
    for tail, size, last in ((text[common:], len(text), False), (edited[common:], len(edited), True)):
        own = (node, tree if last else dict(tree), at, ends if last else list(ends))
        _, _, _, found = parse(tail, own)
        out.append(found if not size or (found and found[-1] == size) else [*found, size])
    return out[0], out[1]


def signatures(texts: list[bytes], ends: list[list[int]]) -> np.ndarray:
    """A row of HASHES 16-bit minima for each text."""
    out = np.zeros((len(texts), HASHES), np.uint16)
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.array([len(e) for e in ends], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    base = np.repeat(np.cumsum(sizes) - sizes, counts)
    stop = np.fromiter((x for e in ends for x in e), np.int64, int(counts.sum())) + base
    first = np.concatenate([[0], np.cumsum(counts)])
    start = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    start[first[:-1][full]] = base[first[:-1][full]]
    h = (vec.span_hashes(data, start, stop) >> np.uint64(32)).astype(np.uint32)
    heads = first[:-1][full]
    for k in range(HASHES):
        least = np.minimum.reduceat((h ^ _SHIFT[k]) * _FACTOR[k], heads)
        out[full, k] = ((least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(-1)


def to_hex(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, column: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each whole text; null texts are empty. A column of that name is replaced."""
    kept = docs.drop(column)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), f"`{column}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in vec.slices(batches, "text", FLUSH_BYTES):
            texts = [data[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)]
            found = signatures(texts, [phrase_ends(t) for t in texts])
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([to_hex(s) for s in found])], [*rows.schema.names, column])

    return kept.mapInArrow(run, schema)


def chained(docs: DataFrame, parts: int | None = None) -> DataFrame | None:
    """doc_id, text and bucket, with a copy of the row that follows each bucket (`halo`), sorted in buckets by doc_id.

    Buckets are ranges of doc_id whose bounds are ids that occur, from Spark's mergeable quantile sketch. The first row of a
    bucket is sent to the bucket before it too, and the first row of all to the last one: one more row for each bucket. None if docs is empty.
    """
    spark = docs.sparkSession
    parts = parts or max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    stats = rows.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 20 * parts).alias("at"), F.min(key).alias("least")).first()
    if stats["least"] is None:
        return None
    bounds = sorted({b for b in (stats["at"] or []) if b > stats["least"]})
    buckets = len(bounds) + 1

    @F.pandas_udf("int")
    def bucket_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds, np.int64), k.to_numpy(np.int64), "right").astype(np.int32))

    placed = rows.withColumn("k", key).withColumn("bucket", bucket_of("k"))
    first_of_bucket = F.col("k").isin(bounds) if bounds else F.lit(False)
    halo = F.when(F.col("k") == F.lit(stats["least"]), F.array(F.lit(buckets - 1))).when(first_of_bucket, F.array(F.col("bucket") - 1)).otherwise(F.array())
    copies = F.concat(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("halo"))), F.transform(halo, lambda b: F.struct(b.cast("int").alias("bucket"), F.lit(True).alias("halo"))))
    exploded = placed.select("doc_id", "k", "text", F.explode(copies).alias("c")).select("doc_id", "k", "text", "c.bucket", "c.halo")
    return exploded.repartition(buckets, "bucket").sortWithinPartitions("bucket", "halo", "k", "text")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text: the last floor(n_chars / 4) code points are replaced by the first as many (or all) of the next row's
    text in ascending doc_id order; after the last row comes the first. Null doc_ids come first, rows with the same doc_id
    are ordered by text; a single row follows itself. Null texts are empty. Texts of any length are parsed whole. Other columns are ignored, whatever they are called;
    an empty table gives no rows. Rows that share a doc_id lie in one bucket, and so in one task.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = chained(docs)
    if rows is None:
        return docs.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None  # (doc_id, bucket, text) whose next row has not come yet
        done_halo = -1
        pairs: list[tuple] = []
        size = 0
        for batch in batches:
            for doc, text, bucket, halo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if halo and done_halo == bucket:
                    continue  # further rows of the id that begins the next bucket
                if waiting is not None:
                    pairs.append((waiting[0], waiting[2], text))
                    size += len(waiting[2])
                    if size >= FLUSH_BYTES:
                        yield finish(pairs)
                        pairs, size = [], 0
                waiting = None if halo else (doc, bucket, text)
                done_halo = bucket if halo else done_halo
        if pairs:
            yield finish(pairs)

    def finish(pairs: list[tuple]) -> pa.RecordBatch:
        """The rows of one bucket that follow each other are in pairs; so each next text is parsed once more only at a break."""
        texts, ends, edited = [], [], []
        for _, text, then in pairs:
            cut = len(text) - len(text) // 4
            other = text[:cut] + then[: len(text) // 4]
            a, b, common = text.encode(), other.encode(), len(text[:cut].encode())
            one, two = shared_start_ends(a, b, common)
            texts += [a, b]
            ends += [one, two]
            edited.append(hashlib.sha256(b).hexdigest())
        extra = [i for i, (_, _, then) in enumerate(pairs) if i + 1 == len(pairs) or pairs[i + 1][1] is not then]
        for i in extra:
            raw = pairs[i][2].encode()
            texts.append(raw)
            ends.append(phrase_ends(raw))
        found = signatures(texts, ends)
        own, changed = found[0 : 2 * len(pairs) : 2], found[1 : 2 * len(pairs) : 2]
        following = np.concatenate([own[1:], own[:1]])
        following[extra] = found[2 * len(pairs) :]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([p[0] for p in pairs], pa.int64()),
                pa.array([len(p[1]) for p in pairs], pa.int64()),
                pa.array(edited),
                pa.array([to_hex(s) for s in own]),
                pa.array([to_hex(s) for s in changed]),
                pa.array(likeness(own, changed)),
                pa.array(likeness(own, following)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return rows.select("doc_id", "text", "bucket", "halo").mapInArrow(run, schema)
