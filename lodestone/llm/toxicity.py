"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A text's features are the different n-grams (N_GRAMS bytes of lower-cased UTF-8, a space before and after the text),
hashed to 2**SLOT_BITS slots. Each feature's value is its log-count ratio r: the log of its smoothed share of toxic
training texts over its share of the others. Logistic regression with L2 penalty on these values gives the weights.
Slots with a low document frequency or a ratio near 0 take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import vec

N_GRAMS = (4, 5, 6)
SLOT_BITS = 22
LEAST_TEXTS = 4
LEAST_RATIO = 1.5
PENALTY = 1e-3
#: The classifier's documented bounds: training rows by label, and bytes of their texts. Each row takes part whole.
MOST_TOXIC, MOST_CLEAN = 1_200, 1_800
MOST_BYTES = 256 << 20
_SPACE = np.uint8(0x20)


def grams(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: (slots of all n-grams in order, first of each row); rows get a space at both ends."""
    lens = np.diff(offs) + 2
    to = np.concatenate([[0], np.cumsum(lens)])
    stream = np.full(int(to[-1]), _SPACE, np.uint8)
    stream[vec.ragged(to[:-1] + 1, lens - 2)] = vec.LOWER[data]
    left = np.repeat(to[1:], lens) - np.arange(len(stream))  # bytes from here to the row's end
    wide = np.concatenate([stream, np.zeros(max(N_GRAMS), np.uint8)]).astype(np.uint64)
    key, n = wide[: len(stream)].copy(), 1
    for size in N_GRAMS:
        while n < size:
            key |= wide[n : n + len(stream)] << np.uint64(8 * n)
            n += 1
        slot = (((key ^ (key >> np.uint64(23))) * np.uint64(vec.BASE)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        whole = left >= size
        yield slot[whole], np.concatenate([[0], np.cumsum(np.maximum(lens - size + 1, 0))])


class Model:
    """bias and weight by slot (the logistic regression's weight times the ratio)."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray, bias: float):
        self.slots, self.weights, self.bias = slots, weights.astype(np.float32), bias
        self._table: np.ndarray | None = None

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros(1 << SLOT_BITS, np.float32)
            self._table[self.slots] = self.weights
        margin = np.full(len(offs) - 1, self.bias)
        for slot, first in grams(data, offs):
            at = np.flatnonzero(self._table[slot])
            row = np.searchsorted(first, at, "right") - 1
            pairs = np.unique(row << SLOT_BITS | slot[at])  # a feature counts once for each text
            margin += np.bincount(pairs >> SLOT_BITS, self._table[pairs & ((1 << SLOT_BITS) - 1)].astype(np.float64), len(margin))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))

    def __getstate__(self):
        return self.__dict__ | {"_table": None}


def features(texts: list[bytes | pa.Buffer]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, slots) of the different n-grams of the texts, a few texts at a time."""
    at = 0
    while at < len(texts):
        part, size = [], 0
        while at < len(texts) and (not part or size < vec.SLICE_BYTES):
            part.append(texts[at])
            size += len(texts[at])
            at += 1
        data = np.frombuffer(b"".join(part), np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(t) for t in part])])
        for slot, first in grams(data, offs):
            pairs = np.unique(np.repeat(np.arange(len(part)), np.diff(first)) << SLOT_BITS | slot)
            yield (pairs >> SLOT_BITS) + at - len(part), pairs & ((1 << SLOT_BITS) - 1)


def fit(texts: list[bytes | pa.Buffer], toxic: np.ndarray) -> Model:
    """A model of these labelled texts; without texts of both labels it is a constant: the share of toxic ones (0.0 of none)."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return Model(np.zeros(0, np.int64), np.zeros(0), 30.0 if len(toxic) and toxic.all() else -30.0)
    with_toxic, with_clean = np.zeros(1 << SLOT_BITS, np.int32), np.zeros(1 << SLOT_BITS, np.int32)
    for row, slot in features(texts):
        np.add.at(with_toxic, slot[toxic[row]], 1)
        np.add.at(with_clean, slot[~toxic[row]], 1)
    seen = np.flatnonzero(with_toxic + with_clean >= LEAST_TEXTS)  # ratios of these alone, as the tables have all slots
    with_toxic, with_clean = with_toxic[seen], with_clean[seen]
    ratio = np.log((with_toxic + 1) / (toxic.sum() + 2)) - np.log((with_clean + 1) / ((~toxic).sum() + 2))
    strong = np.abs(ratio) >= LEAST_RATIO
    used, ratio = seen[strong], ratio[strong]
    del with_toxic, with_clean, seen, strong
    number = np.full(1 << SLOT_BITS, -1, np.int32)
    number[used] = np.arange(len(used))
    kept = [(row[keep].astype(np.int32), number[slot[keep]]) for row, slot in features(texts) if (keep := number[slot] >= 0).any()]
    row, column = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (np.zeros(0, np.int64),) * 2
    del kept, number
    value = ratio[column]
    weight, bias = np.full(len(used), 0.0), 0.0
    steps = [np.zeros(len(used) + 1), np.zeros(len(used) + 1)]  # Adam's moments
    share = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())  # both labels weigh alike
    for t in range(1, 81):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, value * weight[column], len(toxic)), -500, 500)))
        error = (p - toxic) * share
        grad = np.append(np.bincount(column, value * error[row], len(used)) + PENALTY * weight, error.sum())
        for m, g, b in zip(steps, (grad, grad * grad), (0.9, 0.999), strict=True):
            m *= b
            m += (1 - b) * g
        step = 0.02 * (steps[0] / (1 - 0.9**t)) / (np.sqrt(steps[1] / (1 - 0.999**t)) + 1e-8)
        weight -= step[:-1]
        bias -= step[-1]
    return Model(used, weight * ratio, bias)


def within(sizes: list[tuple[int, int, int]], most: int = MOST_BYTES) -> list[int] | None:
    """The ids of (id, bytes, label) that keep their order within `most` bytes, half for each label and one id of each at least; None: all."""
    if sum(n for _, n, _ in sizes) <= most:
        return None
    kept, used = [], {}
    for i, n, label in sizes:
        if label not in used or used[label] + n <= most // 2:
            used[label] = used.get(label, 0) + n
            kept.append(i)
    return kept


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on docs' texts joined to labels' (doc_id, toxic).

    At most MOST_TOXIC and MOST_CLEAN labelled ids, those with the smallest hashes of the id, then the smallest ids; rows with a null id or
    label are left out, an id with both labels counts as toxic. Where their texts have more than MOST_BYTES bytes, each label has half of that for its first ids (one at least). Of the rows of one id the smallest text takes part, so there are as many texts as ids. Null texts are empty. Texts of any
    length take part whole. Without rows of both labels the model is a constant.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for value, most in ((1, MOST_TOXIC), (0, MOST_CLEAN)):
        part = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most MOST_TOXIC + MOST_CLEAN pairs of numbers
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sizes = rows.groupBy("doc_id").agg(F.octet_length(F.min("text")).alias("bytes"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()  # as many numbers
    bounded = within([tuple(r.values()) for r in sizes.to_pylist()])
    rows = rows if bounded is None else rows.where(F.col("doc_id").isin(bounded))
    found = rows.groupBy("doc_id").agg(F.min("text").cast("binary").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").toArrow()  # MOST_BYTES at most, or one text of each label
    # the texts stay where Arrow has them
    model = fit([t.as_buffer() for t in found["text"]], np.array(found["toxic"].to_pylist(), bool))
    del found
    vec.release()
    return model


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with the probability that each whole text is toxic; null and empty texts score as a text of two spaces.

    A column of docs called like the new one is replaced; repeated rows get equal scores. Texts of any length are scored whole; an empty table gives no rows.
    """
    kept = docs.drop(column)
    at = kept.columns.index("text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), f"`{column}` double"])
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # as large as the number of used slots, 2**SLOT_BITS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for rows, data, offs in vec.slices(batches):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(m.score(data, offs))], [*rows.schema.names, column])

    assert at >= 0
    return kept.mapInArrow(run, schema)
