"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of 0 to `order` bytes with the counts of the bytes that follow them. A byte
seen in a context costs -log2(n / (total + distinct)) bits; an unseen one first costs the escape
-log2(distinct / (total + distinct)) and is then coded in the next shorter context, down to a uniform byte. The
statistics are frozen after training and symbols of longer contexts are not excluded, so the cost of a byte
depends on the order + 1 bytes that end at it alone: the exact code lengths of all languages are tabulated by these
grams, and a text's are sums of table rows. The predicted language has the shortest code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import vec

UNDETERMINED = "und"
#: The documented bound of the whole training sample.
MOST_BYTES = 64 << 20
#: The most languages of a model, and the most numbers in its tables (4 bytes each): what is broadcast has this bound.
LANGUAGES, MOST_CELLS = 256, 64 << 20
_LETTER = re.compile(r"[^\W\d_]")


class Model:
    """Code-length tables of all languages over a shared numbering of the grams seen in training.

    next[k] maps (number of a gram of k bytes) * symbols + byte's symbol to the number of the gram of k + 1 bytes, 0
    if unseen. cost[k] has the code length of the last byte of a gram of k + 1 bytes, escape[k] the
    escape cost of a context of k bytes; both by language.
    """

    def __init__(self, samples: dict[str, list[bytes]], order: int = 3):
        self.order, self.langs = order, sorted(samples)
        streams = [[np.frombuffer(t, np.uint8) for t in samples[x]] for x in self.langs]
        seen = np.unique(np.concatenate([*(a for s in streams for a in s), np.zeros(1, np.uint8)]))
        self.symbol = np.full(256, len(seen) + 1, np.int64)  # 0: before the start of a text; the last: bytes never seen
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 2
        padded = [np.concatenate([np.concatenate([np.zeros(order, np.int64), self.symbol[a]]) for a in s] or [np.zeros(order, np.int64)]) for s in streams]
        ends = [np.concatenate([np.concatenate([np.zeros(order, bool), np.ones(len(a), bool)]) for a in s] or [np.zeros(order, bool)]) for s in streams]
        self.next, self.cost, self.escape = [], [], []
        grams = [np.zeros(len(p), np.int64) for p in padded]  # number of the gram of k bytes that ends at each place
        sizes, shorter = 1, np.full((1, len(self.langs)), 8.0)
        for k in range(order + 1):
            keys = []
            for g, p in zip(grams, padded, strict=True):
                before = np.concatenate([np.zeros(1, np.int64), g[:-1]])
                keys.append(before * self.width + p)
            known = np.unique(np.concatenate(keys))
            known = known[known >= self.width] if k else known  # without those that begin before the first text
            table = np.zeros(sizes * self.width, np.int32)
            table[known] = np.arange(1, len(known) + 1)
            counts = np.stack([np.bincount(table[x[e]], minlength=len(known) + 1) for x, e in zip(keys, ends, strict=True)], 1).astype(np.float64)
            context = np.concatenate([[0], known // self.width])
            total = np.zeros((sizes, len(self.langs)))
            distinct = np.zeros((sizes, len(self.langs)))
            np.add.at(total, context[1:], counts[1:])
            np.add.at(distinct, context[1:], (counts[1:] > 0).astype(float))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                own = -np.log2(counts / (total + distinct)[context])
            suffix = np.zeros(len(known) + 1, np.int64)  # the same byte after the context without its first byte
            for g, x in zip(grams, keys, strict=True):
                suffix[table[x]] = g
            cost = np.where(counts > 0, own, escape[context] + shorter[suffix])
            cost[0] = 0
            self.next.append(table)
            self.cost.append(cost.astype(np.float32))
            self.escape.append(escape.astype(np.float32))
            grams = [table[x].astype(np.int64) for x in keys]
            sizes, shorter = len(known) + 1, cost

    def bits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length of each text in each language."""
        pad, lens = self.order, np.diff(offs)
        to = offs[:-1] + pad * np.arange(1, len(offs))
        stream = np.zeros(len(data) + pad * len(lens), np.int64)
        inside = vec.ragged(to, lens)
        stream[inside] = self.symbol[data]
        grams = [np.zeros(len(stream), np.int64)]
        for table in self.next:
            key = np.empty(len(stream), np.int64)
            key[:1] = stream[:1]
            np.multiply(grams[-1][:-1], self.width, out=key[1:])
            key[1:] += stream[1:]
            grams.append(table[key].astype(np.int64))
        cost = np.zeros((len(data), len(self.langs)), np.float32)
        left, at = np.arange(len(data)), inside
        for k in range(self.order, -1, -1):
            g = grams[k + 1][at]
            found = g > 0
            cost[left[found]] += self.cost[k][g[found]]
            left, at = left[~found], at[~found]
            if not len(left):
                break
            cost[left] += self.escape[k][grams[k][at - 1] if k else np.zeros(len(at), np.int64)]
        cost[left] += 8.0
        return vec.row_sums(cost, offs)


def cells(samples: dict[str, list[bytes]], order: int) -> int:
    """Numbers in the tables of a model of these samples, about: its grams by languages, and its shorter grams by symbols."""
    data = [np.frombuffer(b"\0".join(t), np.uint8).astype(np.uint64) for t in samples.values()]
    grams, shorter, key = 0, 1, [np.zeros(len(d), np.uint64) for d in data]
    symbols = len(np.unique(np.concatenate([*data, np.zeros(1, np.uint64)]))) + 2
    for _ in range(order + 1):
        key = [(np.concatenate([np.zeros(1, np.uint64), k[:-1]]) << np.uint64(8) | d) if len(d) else k for k, d in zip(key, data, strict=True)]
        found = len(np.unique(np.concatenate(key)))
        grams, table, shorter = grams + found, shorter * symbols, found
        grams += table // max(1, len(samples))
    return grams * len(samples)


def bounded(samples: dict[str, list[bytes]], order: int) -> dict[str, list[bytes]]:
    """The samples, halved until a model of them has MOST_CELLS numbers at most; a last text is cut."""
    while samples and cells(samples, order) > MOST_CELLS and max(map(len, (b"".join(t) for t in samples.values()))) > 1:
        for k, texts in samples.items():
            left, half = sum(map(len, texts)) // 2, []
            for t in texts:
                if left > 0:
                    half.append(t[:left])
                    left -= len(t)
            samples[k] = half or texts[:1]
    return samples


def training_sample(docs: DataFrame, max_bytes: int) -> dict[str, list[bytes]]:
    """Different whole texts of each language in the order of their hashes, as many as max_bytes hold (MOST_BYTES / languages, if that is less), one at least.

    Each text is taken once, however often it stands there. At most LANGUAGES languages are learned, those with most bytes; a first text longer than the bound is cut there.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.col("text").cast("string").alias("text"))
    once = usable.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.max(F.octet_length("text")).alias("n"))  # copies count once
    sizes = once.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return {}
    most = min(max_bytes, MOST_BYTES // len(sizes))
    # the texts with the smallest hashes: about twice the bound, so that ordering them is work of a bounded size
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], float(min(1.0, 2.0 * most / max(1, r["n"]))))))
    hashed = usable.withColumn("h", F.xxhash64("text")).withColumn("near", F.pmod("h", F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    different = hashed.where("near").groupBy("lang", "h").agg(F.min("text").alias("text"))
    running = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    taken = different.withColumn("before", F.coalesce(running, F.lit(0))).where(F.col("before") + F.octet_length("text") <= most)
    out: dict[str, list[bytes]] = {r["lang"]: [] for r in sizes}
    for r in taken.select("lang", "text").collect():  # MOST_BYTES at most
        out[r["lang"]].append(r["text"].encode())
    if missing := [k for k, v in out.items() if not v]:  # their few texts are long, or none was near
        first = hashed.where(F.col("lang").isin(missing)).groupBy("lang").agg(F.min_by(F.left("text", F.lit(most)), F.struct(F.octet_length("text"), "h")).alias("text"))
        for r in first.collect():
            out[r["lang"]].append(r["text"].encode()[:most])
    return out


def predict(docs: DataFrame, training: DataFrame, order: int = 3, max_bytes: int = 1_500_000) -> DataFrame:
    """docs' other columns with lang_pred and score in place of text, learned from training's lang and text.

    The model is fitted on at most max_bytes of text of each language, MOST_BYTES of all and as much as MOST_CELLS numbers hold, the documented bounds of this classifier;
    every text of docs is scored whole. Texts that are null or have no letter get `und` and score 0, and so do all
    if training has no labelled text. score is the share of the best language's probability. Languages with equal
    code lengths: the first in alphabetical order. Texts of any length are scored whole, repeated rows alike; an empty table gives no rows. Columns of docs called lang_pred or score are replaced.
    """
    spark = docs.sparkSession
    samples = bounded({k: sorted(v) for k, v in training_sample(training, max_bytes).items()}, order)
    model = spark.sparkContext.broadcast(Model(samples, order) if samples else None)
    kept = [f for f in docs.drop("lang_pred", "score").schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        langs = np.array([*(m.langs if m else []), UNDETERMINED], object)
        for rows, data, offs in vec.slices(batches):
            best = np.full(len(offs) - 1, len(langs) - 1)
            score = np.zeros(len(offs) - 1)
            if m:
                lettered = has_letter(data, offs)
                bits = m.bits(data, offs)
                least = bits.argmin(1)
                share = 1 / np.exp2(-np.clip(bits - bits.min(1, keepdims=True), 0, 1000)).sum(1)
                best, score = np.where(lettered, least, best), np.where(lettered, share, 0.0)
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(langs[best].tolist(), pa.string()), pa.array(score)], [*rows.schema.names[:-1], "lang_pred", "score"])

    return docs.select(*(f"`{f.name}`" for f in kept), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


_ASCII_LETTERS = vec.class_table((0x41, 0x5A), (0x61, 0x7A))


def has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    out = np.diff(np.searchsorted(np.flatnonzero(_ASCII_LETTERS[data]), offs)) > 0
    for i in np.flatnonzero(~out):
        out[i] = bool(_LETTER.search(data[offs[i] : offs[i + 1]].tobytes().decode("utf-8")))
    return out
