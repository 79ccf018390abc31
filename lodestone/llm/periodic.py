"""Periodic run detection by comparing each document's words with themselves at every lag.

Words become numbers (exactly, by a dictionary of the slice of documents at hand), and the numbers of all documents of a slice lie in one
array, longest document first, each closed by a number of its own. For every lag p up to n / min_exp the array is compared with
itself shifted by p: words that are equal p apart, in a stretch long enough, are a run with period p. A stretch that is long enough covers a
multiple of its least length, so only those places are compared at first, and places around the hits next; documents where these are equal too are
compared as a whole, and their true stretches are run-length coded. So ordinary text costs about n log n comparisons instead of n * n / min_exp.

Spark distributes (document, lag range) units: a document of up to LONG_BYTES is one unit, with its neighbours in the file; a longer
one is dealt out by ranges of LAGS lags, whose runs meet again by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import shared, vec

MIN_EXP, MIN_LENGTH = 4, 6
SLICE_BYTES = 2 << 20
LONG_BYTES = 1 << 20
LAGS = 1 << 17
#: Words that are compared on either side of a hit, as far as half of the least stretch goes.
NEAR = (1, 2, 3, 4, 5, 6, 7, 8, *(1 << k for k in range(4, 31)))
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
EXTRA = {"n_words": "bigint", "runs": RUNS, "best": "struct<start: bigint, length: bigint, period: bigint>", "collapsed": "string"}


def words_of(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """(words of each text, their numbers one text after another, first word of each text); white space is \\x20 and \\x09-\\x0D, a null text has no words."""
    words = [t.split() if t else [] for t in texts]
    first = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
    flat = pa.array([x for w in words for x in w], pa.large_binary()).dictionary_encode()
    return words, flat.indices.to_numpy(zero_copy_only=False).astype(np.int32), first


def smallest_period(stretch: np.ndarray, period: int) -> int:
    """The smallest period of a stretch of four times a known period or more: by the theorem of Fine and Wilf it divides that one."""
    for d in range(1, int(period**0.5) + 1):
        if period % d == 0 and np.array_equal(stretch[d:], stretch[:-d]):
            return d
    return min((period // d for d in range(1, int(period**0.5) + 1) if period % d == 0 and np.array_equal(stretch[period // d :], stretch[: -(period // d)])), default=period)


def find_runs(ids: np.ndarray, first: np.ndarray, low: int = 1, high: int | None = None, min_exp: int = MIN_EXP, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (text, start, length, smallest period) of the runs that show at lags of low to high (None: all), by text, start and period.

    A run: consecutive words with smallest period q and a length of min_length and of min_exp * q at least, which no neighbour extends.
    """
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    size = count[order]
    begin = np.cumsum(size + 1) - size - 1
    seq = np.empty(int(size.sum()) + len(size), np.int32)
    seq[begin + size] = -1 - np.arange(len(size), dtype=np.int32)
    seq[vec.ragged(begin, size)] = ids[vec.ragged(first[:-1][order], size)]
    run_end, run_period = np.zeros(len(seq), np.int64), np.ones(len(seq), np.int64)  # of a known run at each place
    found: set[tuple[int, int, int, int]] = set()
    longest = int(size[0]) if len(size) else 0
    for lag in range(low, min(longest // min_exp, longest if high is None else high) + 1):
        least = max(min_length, min_exp * lag)
        docs = int(np.searchsorted(-size, -least, "right"))
        if not docs:
            break
        need = least - lag
        stop = int(begin[docs - 1] + size[docs - 1]) - lag  # pairs end here; none of two documents makes a stretch of `need`
        hit = np.flatnonzero(seq[:stop:need] == seq[lag : stop + lag : need]) * need
        if not len(hit):
            continue
        hit = hit[(run_end[hit] <= hit + lag) | (lag % run_period[hit] != 0)]
        right, left = hit, hit
        for d in NEAR:
            if d > need // 2 or not (len(right) or len(left)):
                break
            right = right[right + d < stop]
            right = right[seq[right + d] == seq[right + d + lag]]
            left = left[left >= d]
            left = left[seq[left - d] == seq[left - d + lag]]
        if not (len(right) or len(left)):
            continue
        for k in np.unique(np.searchsorted(begin, np.concatenate([right, left]), "right") - 1).tolist():
            a, n = int(begin[k]), int(size[k])
            equal = np.zeros(n - lag + 2, np.int8)
            np.equal(seq[a : a + n - lag], seq[a + lag : a + n], out=equal[1:-1].view(bool))
            edge = np.flatnonzero(np.diff(equal))
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if e - s >= need:
                    e += lag
                    q = smallest_period(seq[a + s : a + e], lag)
                    found.add((int(order[k]), s, e - s, q))
                    wider = run_end[a + s : a + e] < a + e
                    run_end[a + s : a + e][wider] = a + e
                    run_period[a + s : a + e][wider] = q
    return np.array(sorted(found, key=lambda x: (x[0], x[1], x[3])), np.int64).reshape(-1, 4)


def best_run(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int | None:
    """The run with the greatest exact length / period; ties: smallest start, then period."""
    if not len(start):
        return None
    ratio = length / period
    near = np.flatnonzero(ratio >= ratio.max() * (1 - 1e-9)).tolist()  # more than floating point can tell apart
    return min(near, key=lambda i: (-Fraction(int(length[i]), int(period[i])), int(start[i]), int(period[i])))


def results(words: list[list[bytes]], runs: np.ndarray) -> list[pa.Array]:
    """Columns of EXTRA for the words of some texts and their runs (text, start, length, period), sorted."""
    bounds = np.searchsorted(runs[:, 0], np.arange(len(words) + 1))
    kept, best = [], []
    for k, w in enumerate(words):
        _, start, length, period = runs[bounds[k] : bounds[k + 1]].T
        if len(start):
            depth = np.zeros(len(w) + 1, np.int64)
            np.add.at(depth, start + period, 1)
            np.add.at(depth, start + length, -1)
            w = [w[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
        i = best_run(start, length, period)
        best.append(None if i is None else {"start": int(start[i]), "length": int(length[i]), "period": int(period[i])})
        kept.append(b" ".join(w))
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    flat = pa.StructArray.from_arrays([pa.array(runs[:, j]) for j in (1, 2, 3)], fields=list(kind))
    return [
        pa.array([len(w) for w in words], pa.int64()),
        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat),
        pa.array(best, kind),
        pa.array(kept, pa.binary()).view(pa.string()),
    ]


def _texts(rows: pa.RecordBatch) -> list[bytes | None]:
    column = rows.column(rows.schema.names.index("text"))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def scan(docs: DataFrame, min_exp: int = MIN_EXP, min_length: int = MIN_LENGTH, long_bytes: int = LONG_BYTES, lags: int = LAGS) -> DataFrame:
    """docs with the columns of EXTRA: number of words, all runs by start and period, the run with the greatest length / period (null without
    one), and the words left, joined by one space, when every run keeps only its first period.

    A null or empty text has no words, no runs and an empty `collapsed`. Texts of any length take part whole; those of more than long_bytes
    are searched by ranges of `lags` lags. Ties of the best run go to the smallest start, then period. Repeated rows get equal results, also where they share a
    doc_id or have none: rows are never matched by it. An empty table gives no rows. Columns of docs called like the new ones are replaced; other columns stay, whatever they are called.
    """
    kept = docs.drop(*EXTRA)
    text = F.col("text").cast("string")
    kept = kept.withColumn("text", text)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    schema = ", ".join([*fields, *(f"{k} {v}" for k, v in EXTRA.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in vec.slices(batches, "text", SLICE_BYTES):
            words, ids, first = words_of(_texts(rows))
            extra = results(words, find_runs(ids, first, 1, None, min_exp, min_length))
            yield pa.RecordBatch.from_arrays([*rows.columns, *extra], [*rows.schema.names, *EXTRA])

    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) > long_bytes
    short = kept.where(~is_long).mapInArrow(run, schema)
    return short.unionByName(_long(kept.where(is_long), fields, schema, min_exp, min_length, lags))


def _long(docs: DataFrame, fields: list[str], schema: str, min_exp: int, min_length: int, lags: int) -> DataFrame:
    """scan() for long texts: runs are found by (document, lag range), and meet again by the number that each row gets."""
    rid, part, runs = (shared.fresh(docs, x) for x in ("_rid", "_part", "_runs"))
    rows = shared.table(docs.withColumn(rid, F.monotonically_increasing_id()), "long-texts")
    most = F.floor(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")) / min_exp)
    units = rows.select(rid, "text", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((most - 1) / lags), F.lit(0)).cast("int"))).alias(part)).repartition(rid, part)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in vec.slices(batches, "text", 1):  # one unit at a time
            _, ids, first = words_of(_texts(rows))
            at = rows.column(2)[0].as_py() * lags
            found = find_runs(ids, first, at + 1, at + lags, min_exp, min_length)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows.column(0).to_numpy(), len(found))), *(pa.array(found[:, j]) for j in (1, 2, 3))], ["rid", "start", "length", "period"])

    found = units.mapInArrow(search, "rid bigint, start bigint, length bigint, period bigint").distinct()
    by_row = found.groupBy(F.col("rid").alias(rid)).agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias(runs))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in vec.slices(batches, "text", 1):
            words = [t.split() for t in _texts(rows)]
            given = rows.column(rows.schema.names.index(runs))[0].as_py() or []
            extra = results(words, np.array([(0, x["start"], x["length"], x["period"]) for x in given], np.int64).reshape(-1, 4))
            own = [i for i, name in enumerate(rows.schema.names) if name not in (rid, runs)]
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in own), *extra], [*(rows.schema.names[i] for i in own), *EXTRA])

    return rows.join(by_row, rid, "left").select(*(f"`{c}`" for c in docs.columns), runs).mapInArrow(finish, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of scan(docs)."""
    found = scan(docs.select("doc_id", "text"))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    best = [F.col(f"best.{k}").alias(k) for k in ("start", "length", "period")]
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) where every text whose crc32(doc_id) ends in 0 has its tail replaced by repetitions: the contract's input of op13.

    With h that checksum, n words, g = h // 10, a = g % n and p = 1 + (n - a) // (3 + g % 8), each word i >= a becomes word a + (i - a) % p. Other texts stay as they are.
    """
    key = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = _texts(batch), batch.column(2).to_pylist()
            for k, h in enumerate(keys):
                if h % 10 == 0 and texts[k] and (words := texts[k].split()):
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    texts[k] = b" ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).view(pa.string())], ["doc_id", "text"])

    given = docs.select("doc_id", F.col("text").cast("string").alias("text"), key.alias("key"))
    return given.mapInArrow(run, given.select("doc_id", "text").schema)
