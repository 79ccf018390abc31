"""Language-model scoring by logistic mixing of hashed-context bit predictors.

A text is coded byte by byte, and a final 0 byte ends it. Each of a byte's 8 bits is predicted in the contexts of the last 0
to ORDER bytes, and of those of them that belong to the current word, together with the bits of this byte so far: a counter holds how often the
bit was 0 and 1 there in training. The predictors' logits are combined by weights chosen by a gate (the bit's place, the longest context seen in training and how
often the word so far was seen), which are learned online, a small batch of examples after another, by the gradient of the code length. An adaptive map by the bits so
far refines the mixed probability. A text's score is the log10 probability of all its bits.

What training gathers grows with its texts: the counts of all different grams (ORDER bytes and the byte after them). Grams are dealt into parts by the TAIL bytes before
their last one. All contexts of TAIL bytes or more of a part's grams lie in that part, so one task makes their counters, exactly and without a table of
fixed size. Counters of shorter contexts, of which there is a bounded number, are SHORT_BITS tables that every task gets. When weights and map
are learned, an example is first taken out of its own counters; parts learn from the same start, and their weights are averaged by the number of examples of each gate.
Counters, weights and map are frozen for scoring, nothing adapts within a text: so a gram's last byte costs the same everywhere, is worked out once, and a text's bits are a sum of
such costs.

The base score is that of a unigram word model with additive smoothing. Costs of grams and counts of words are joined to batches of documents, not to single ones: each
batch gets those of its own grams and words only, so neither the counters nor the vocabulary nor any document's words are ever broadcast or collected.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import shared, vec

ORDER = 6
#: Contexts of so many bytes or more are counted within a part.
TAIL = 3
PART_GRAMS = 500_000
SHORT_BITS = 18
#: Predictors: orders 0 to ORDER and the current word.
MODELS = ORDER + 2
WORD = ORDER + 1
SHORT = (*range(TAIL), WORD)
#: Buckets of the number of times the word so far was seen: 0, 1, 2 to 3, ... 32 and more.
SEEN = 7
GATES = 8 * (ORDER + 1) * SEEN
INPUTS = MODELS + 1
BUCKETS = 33
PRIOR = 0.1
RATE = 0.05
EXAMPLES = 1024
BATCH_BYTES = 80 << 20
SLICES = 3
#: Bytes whose grams are counted before they are merged with those of the batch so far.
PENDING = 4_000_000
END_WORD = np.uint64(1)


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(for each byte of each row, and its end, the ORDER bytes before it and itself as one number; first of each row)."""
    lens = np.diff(offs)
    first = np.concatenate([[0], np.cumsum(lens + 1)])
    # ORDER + 1 zeros, then the rows' bytes, each with its end
    stream = np.zeros(int(first[-1]) + ORDER + 1, np.uint8)
    byte = np.ones(int(first[-1]), bool)
    byte[first[1:] - 1] = False
    stream[ORDER + 1 :][byte] = data
    whole = np.ndarray(int(first[-1]), ">u8", stream, strides=(1,)).astype(np.uint64) & np.uint64((1 << 8 * (ORDER + 1)) - 1)
    for k in range(ORDER):  # nothing comes before a row's first byte
        at = first[:-1][lens >= k] + k
        whole[at] &= np.uint64((1 << 8 * (k + 1)) - 1)
    return whole, first


def sum_equal(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(different keys in order, sum of their counts, or how often they stand there)."""
    order = np.argsort(keys) if counts is not None else None
    keys = keys[order] if counts is not None else np.sort(keys)
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if counts is None:
        return keys[head], np.diff(np.append(head, len(keys)))
    return keys[head], np.add.reduceat(counts[order], head) if len(head) else counts[:0]


def merged(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two ascending lists of different keys as one, with the sums of their counts."""
    at = np.searchsorted(keys, more)
    there = keys[np.minimum(at, len(keys) - 1)] == more
    counts[at[there]] += n[there]
    return np.insert(keys, at[~there], more[~there]), np.insert(counts, at[~there], n[~there])


def word_length(gram: np.ndarray) -> np.ndarray:
    """How many of the ORDER bytes before a gram's last one come after the last white space or start of the text."""
    out = np.full(len(gram), ORDER)
    for k in range(ORDER, 0, -1):
        byte = (gram >> np.uint64(8 * k)) & np.uint64(255)
        out[(byte == 32) | (byte == 0) | ((byte >= 9) & (byte <= 13))] = k - 1
    return out


def context_of(gram: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(a number of 51 bits for the context of `order` bytes, or of the current word's for WORD; whether it has TAIL bytes or more)."""
    before = gram >> np.uint64(8)
    if order <= ORDER:
        return before & np.uint64((1 << 8 * order) - 1), np.full(len(gram), order >= TAIL)
    size = word_length(gram).astype(np.uint64)
    return before & ((np.uint64(1) << (np.uint64(8) * size)) - np.uint64(1)) | size << np.uint64(8 * ORDER), size >= TAIL


def short_slots(context: np.ndarray, node: np.ndarray, order: int) -> np.ndarray:
    """Slots of short contexts with the bits so far (node: 1 and those bits)."""
    h = vec.mix((context << np.uint64(12)) ^ (node.astype(np.uint64) << np.uint64(3)) ^ np.uint64(order))
    return (h >> np.uint64(64 - SHORT_BITS)).astype(np.int64)


def logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def expit(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


Bit = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def predictions(gram: np.ndarray, n: np.ndarray, short: dict[int, np.ndarray], own: bool) -> Iterator[Bit]:
    """For each of the 8 bits of the last byte of a part's grams (n: their training counts): (mixer inputs, gates, nodes, bits).

    own: take each gram once out of its counters.
    """
    symbol, node = (gram & np.uint64(255)).astype(np.int64), np.ones(len(gram), np.int64)
    contexts = {k: context_of(gram, k) for k in range(MODELS)}
    ordered = {}  # grams with a context and first bits stand together in the order of context and last byte
    for k in range(TAIL, MODELS):
        key = contexts[k][0] << np.uint64(8) | gram & np.uint64(255)
        at = np.argsort(key)
        ordered[k] = at, key[at], n[at]
    taken = np.minimum(n, 1) if own else 0
    for place in range(8):
        bit = symbol >> (7 - place) & 1
        x = np.empty((len(gram), INPUTS), np.float32)
        x[:, -1] = 0.3
        longest = np.zeros(len(gram), np.int64)
        for k in range(MODELS):
            context, long = contexts[k]
            zeros, ones = np.empty(len(gram)), np.empty(len(gram))
            if k >= TAIL and len(gram):
                at, key, weight = ordered[k]
                prefix = key >> np.uint64(8 - place)
                head = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
                sizes = np.diff(np.append(head, len(key)))
                with_one = np.add.reduceat(weight * (key >> np.uint64(7 - place) & np.uint64(1)), head)
                ones[at] = np.repeat(with_one, sizes)
                zeros[at] = np.repeat(np.add.reduceat(weight, head) - with_one, sizes)
            if k in SHORT:
                few = np.flatnonzero(~long)
                found = short[k][short_slots(context[few], node[few], k)]
                zeros[few], ones[few] = found[:, 0], found[:, 1]
            if own:
                ones = np.maximum(ones - taken * bit, 0)
                zeros = np.maximum(zeros - taken * (1 - bit), 0)
            x[:, k] = np.log((ones + PRIOR) / (zeros + PRIOR))
            total = zeros + ones
            if k <= ORDER:
                longest[total > 0] = k
        seen = np.minimum(np.ceil(np.log2(total + 1)), SEEN - 1).astype(np.int64)  # of the word, the last predictor
        yield x, (place * (ORDER + 1) + longest) * SEEN + seen, node, bit
        node = node << 1 | bit


class Mixer:
    """Weights by gate, and the adaptive map: counts of bits by node and bucket of the mixed logit."""

    def __init__(self, weights: np.ndarray | None = None, seen: np.ndarray | None = None):
        self.weights = np.array([0.3] * MODELS + [0.0], np.float32)[None].repeat(GATES, 0) if weights is None else weights
        self.squares = np.full((GATES, INPUTS), 1e-3, np.float32)
        self.examples = np.zeros(GATES)
        self.seen = np.zeros((256, BUCKETS, 2)) if seen is None else seen

    @staticmethod
    def bucket(z: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(z * 2).astype(np.int64) + BUCKETS // 2, 0, BUCKETS - 1)

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("ij,ij->i", x, self.weights[gate]), -14, 14)

    def refined(self, z: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Probability of a 1: the mean of the mixed and the mapped logit."""
        n = self.seen[node, self.bucket(z)]
        p = expit(z)
        mapped = (n[:, 1] + 4 * p) / (n.sum(1) + 4)
        return expit((z + logit(np.clip(mapped, 1e-6, 1 - 1e-6))) / 2)

    def learn(self, x: np.ndarray, gate: np.ndarray, node: np.ndarray, bit: np.ndarray, count: np.ndarray) -> None:
        """One step for a batch of examples that stand for `count` equal ones each: the mean gradient of each gate, scaled by what it was before."""
        z = self.mixed(x, gate)
        np.add.at(self.seen, (node, self.bucket(z), bit), count)
        error = (bit - expit(z)) * count
        order = np.argsort(gate, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], np.diff(gate[order]) != 0]))
        gates = gate[order][head]
        total = np.add.reduceat(count[order], head)
        step = np.add.reduceat((error[:, None] * x)[order], head) / total[:, None]
        self.examples[gates] += total
        self.squares[gates] += step**2
        self.weights[gates] += (RATE * step / np.sqrt(self.squares[gates])).astype(np.float32)

    def train(self, gram: np.ndarray, n: np.ndarray, short: dict[int, np.ndarray]) -> None:
        """Learn from the training grams of a part, in an order that their hashes give."""
        used = np.flatnonzero(n > 0)
        order = used[np.argsort(vec.mix(gram[used]))]
        gram, n = gram[order], n[order]  # the others have no counts
        for x, gate, node, bit in predictions(gram, n, short, own=True):
            for i in range(0, len(order), EXAMPLES):
                at = slice(i, i + EXAMPLES)
                self.learn(x[at], gate[at], node[at], bit[at], n[at])

    def bits(self, gram: np.ndarray, n: np.ndarray, short: dict[int, np.ndarray]) -> np.ndarray:
        """Code length of the last byte of each gram of a part."""
        out = np.zeros(len(gram))
        for x, gate, node, bit in predictions(gram, n, short, own=False):
            p = self.refined(self.mixed(x, gate), node)
            out -= np.log2(np.where(bit == 1, p, 1 - p))
        return out


def empty_short() -> dict[int, np.ndarray]:
    return {k: np.zeros((1 << SHORT_BITS, 2)) for k in SHORT}


def count_short(gram: np.ndarray, n: np.ndarray, into: dict[int, np.ndarray]) -> None:
    """Add the grams' bits to the counters of short contexts."""
    symbol, node = (gram & np.uint64(255)).astype(np.int64), np.ones(len(gram), np.int64)
    for place in range(8):
        bit = symbol >> (7 - place) & 1
        for k in SHORT:
            context, long = context_of(gram, k)
            few = np.flatnonzero(~long)
            slot = short_slots(context[few], node[few], k)
            into[k] += np.bincount(slot << 1 | bit[few], n[few], 2 << SHORT_BITS).reshape(-1, 2)
        node = node << 1 | bit


def batched(docs: DataFrame, train: Column) -> DataFrame:
    """A shared table of doc_id, train, text and batch: texts in their order, BATCH_BYTES or one text in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batch, used = TaskContext.get().partitionId() << 24, 0
        for rows, data, _ in vec.slices(batches):
            if used and used + len(data) > BATCH_BYTES:
                batch, used = batch + 1, 0
            used += len(data)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(rows.num_rows, batch))], [*rows.schema.names, "batch"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), train.alias("train"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    few = max(2 * docs.sparkSession.sparkContext.defaultParallelism, given.rdd.getNumPartitions() // 4)  # fewer batches share more grams
    return shared.table(given.coalesce(few).mapInArrow(run, "doc_id long, train boolean, text string, batch long"), "batched", "zstd")


def batch_grams(rows: DataFrame) -> DataFrame:
    """A shared table of batch, gram and n: the different grams of each batch, and how often they stand in its training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, new, size = None, None, [], 0  # known: what has been summed up; new: the grams that have come since, each with a last bit for training

        def summed() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate(new)
            every.sort()
            gram = every >> np.uint64(1)
            head = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            k, n = gram[head], np.add.reduceat((every & np.uint64(1)).astype(np.int64), head)
            return (k, n) if known is None else merged(*known, k, n)

        def to_batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(known[0]), now)), pa.array(known[0].view(np.int64)), pa.array(known[1])], ["batch", "gram", "n"])

        for part, data, offs in vec.slices(batches):
            g, first = grams(data, offs)
            g = g << np.uint64(1) | np.repeat(part.column(0).to_numpy(zero_copy_only=False).astype(np.uint64), np.diff(first))
            ids = part.column(2).to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            for row, end in zip(begin.tolist(), [*begin[1:].tolist(), len(ids)], strict=True):
                if ids[row] != now:
                    if new or known:
                        known = summed() if new else known
                        yield to_batch()
                    now, known, new, size = int(ids[row]), None, [], 0
                new.append(g[first[row] : first[end]])
                size += len(new[-1])
                if size > PENDING:
                    known, new, size = summed(), [], 0
                    if len(known[0]) > 4_000_000:
                        yield to_batch()
                        known = None
        if new or known:
            known = summed() if new else known
            yield to_batch()

    return shared.table(rows.select("train", "text", "batch").mapInArrow(run, "batch long, gram long, n long"), "batch-grams", "zstd")


def short_counters(found: DataFrame) -> dict[int, np.ndarray]:
    """The counters of short contexts: tables of a fixed size, added up over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = empty_short()
        for batch in batches:
            count_short(batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().astype(np.float64), own)
        for k, n in own.items():
            used = np.flatnonzero(n.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(used | k << SHORT_BITS), pa.array(n[used, 0]), pa.array(n[used, 1])], ["slot", "zeros", "ones"])

    out = empty_short()
    sums = found.where("n > 0").select("gram", "n").mapInArrow(run, "slot long, zeros double, ones double").groupBy("slot").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    for batch in sums.toArrow().to_batches():  # len(SHORT) << SHORT_BITS rows at most
        slot = batch.column(0).to_numpy()
        for k in out:
            mine = slot >> SHORT_BITS == k
            out[k][slot[mine] & ((1 << SHORT_BITS) - 1)] = np.stack([batch.column(1).to_numpy()[mine], batch.column(2).to_numpy()[mine]], 1)
    return {k: n.astype(np.float32) for k, n in out.items()}


def in_parts(found: DataFrame) -> DataFrame:
    """found (gram, n) with part: as many parts as give each about PART_GRAMS grams."""
    parts = max(8, -(-found.count() // PART_GRAMS))
    tail = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * TAIL) - 1))
    return found.select("gram", "n", F.pmod(F.xxhash64(tail), F.lit(parts)).alias("part"))


def columns_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(grams, counts) of a part, in ascending order, so that the order of arrival has no effect."""
    gram, n = table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy().astype(np.float64)
    order = np.argsort(gram)
    return gram[order], n[order]


def train_mixer(parted: DataFrame, short) -> Mixer:
    """The mean of the parts' weights, by the number of examples, and the sum of their maps. short: the broadcast counters."""

    def run(table: pa.Table) -> pa.Table:
        mixer = Mixer()
        mixer.train(*columns_of(table), short.value)
        used = np.flatnonzero(mixer.seen)
        per_gate = np.repeat(mixer.examples, INPUTS)
        vec.release()
        return pa.table({"key": np.concatenate([np.arange(GATES * INPUTS), -1 - used]), "value": np.concatenate([mixer.weights.ravel() * per_gate, mixer.seen.ravel()[used]]), "weight": np.concatenate([per_gate, np.ones(len(used))])})

    sums = parted.groupBy("part").applyInArrow(run, "key long, value double, weight double").groupBy("key").agg(F.sum("value").alias("value"), F.sum("weight").alias("weight"))
    mixer = Mixer()
    weights, seen = mixer.weights.ravel(), mixer.seen.ravel()
    for r in sums.where("weight > 0").collect():  # as large as the model: GATES * INPUTS + 256 * BUCKETS * 2 rows at most
        if r["key"] >= 0:
            weights[r["key"]] = r["value"] / r["weight"]
        else:
            seen[-1 - r["key"]] = r["value"]
    return Mixer(weights.reshape(GATES, INPUTS), seen.reshape(256, BUCKETS, 2))


def gram_costs(parted: DataFrame, mixer: Mixer, short) -> DataFrame:
    """A shared table of gram and cost, the bits of its last byte."""
    shipped = parted.sparkSession.sparkContext.broadcast(mixer)  # of fixed size

    def run(table: pa.Table) -> pa.Table:
        gram, n = columns_of(table)
        cost = shipped.value.bits(gram, n, short.value)
        vec.release()
        return pa.table({"gram": gram.view(np.int64), "cost": cost.astype(np.float32)})

    return shared.table(parted.groupBy("part").applyInArrow(run, "gram long, cost float"), "costs", "zstd")


def word_rows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first of each row): runs without white space, A-Z lower-cased. No hash is END_WORD or 0."""
    data = vec.LOWER[data]
    starts, ends, first = vec.words(data, offs, vec.VISIBLE_BYTES)
    return np.maximum(vec.span_hashes(data, starts, ends), 2), first


def batch_words(rows: DataFrame) -> DataFrame:
    """A shared table of batch, word (its hash) and n: the different words of each batch, the end among them, and how often they stand in its training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts = None, [], []
        for part, data, offs in vec.slices(batches):
            ids = part.column(2).to_numpy()
            for batch in np.unique(ids).tolist():
                if batch != now:
                    if now is not None:
                        yield to_batch(now, keys, counts)
                    now, keys, counts = batch, [], []
                mine = ids == batch
                h, first = word_rows(data, offs)
                train = part.column(0).to_numpy(zero_copy_only=False) & mine
                per_word = np.repeat(mine, np.diff(first))
                k, n = sum_equal(np.concatenate([h[per_word], np.repeat(END_WORD, int(mine.sum()))]), np.concatenate([np.repeat(train, np.diff(first))[per_word], train[mine]]).astype(np.int64))
                keys.append(k)
                counts.append(n)
        if now is not None:
            yield to_batch(now, keys, counts)

    def to_batch(batch: int, keys: list, counts: list) -> pa.RecordBatch:
        k, n = sum_equal(np.concatenate(keys), np.concatenate(counts))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), batch)), pa.array(k.view(np.int64)), pa.array(n)], ["batch", "word", "n"])

    found = rows.select("train", "text", "batch").mapInArrow(run, "batch long, word long, n long")
    return shared.table(found, "batch-words", "zstd")


def store(found: DataFrame, values: DataFrame, key: str, value: str, kind: type) -> str:
    """A folder with a file for each batch: the different keys of found (batch, key) in ascending order, and their values in values (key, value).

    Batches are worked off in slices, which bounds the disk that the join takes.
    """
    folder = shared.new_path(found.sparkSession, f"{key}-files")

    def run(table: pa.Table) -> pa.Table:
        keys, at = np.unique(table["key"].to_numpy().view(np.uint64), return_index=True)
        fs, inner = shared.filesystem(folder)
        fs.create_dir(inner, recursive=True)
        name = f"{inner}/{uuid.uuid4().hex}"
        with fs.open_output_stream(name, compression=None) as f:
            f.write(np.array([len(keys)], np.int64).tobytes() + keys.tobytes() + table["value"].to_numpy()[at].astype(kind).tobytes())
        fs.move(name, f"{inner}/{table['batch'][0].as_py()}")  # a task that runs again writes the same file
        vec.release()
        return pa.table({"batch": table["batch"][:1]})

    for k in range(SLICES):
        part = found.where(F.pmod(F.xxhash64("batch"), F.lit(SLICES)) == k).select("batch", key).join(values, key)
        part.select("batch", F.col(key).alias("key"), F.col(value).alias("value")).groupBy("batch").applyInArrow(run, "batch long").count()
        shared.forget()
    return folder


class Lookup:
    """A batch's file as a map from keys to values; every key asked for is there."""

    def __init__(self, folder: str, batch: int, kind: type):
        fs, inner = shared.filesystem(folder)
        with fs.open_input_file(f"{inner}/{batch}") as f:
            raw = f.read()
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        keys, values = np.frombuffer(raw, np.uint64, n, 8), np.frombuffer(raw, kind, n, 8 + 8 * n)
        self.size = np.uint64(2 * n + 1)
        place = self.place(keys)
        order = np.argsort(place)
        # each key's slot is the first free one from its place on, in the order of places
        slot = np.arange(n) + np.maximum.accumulate(place[order] - np.arange(n))
        slots = max([int(self.size), *(slot[-1:] + 1).tolist()])
        self.keys, self.values = np.zeros(slots, np.uint64), np.zeros(slots, kind)
        self.keys[slot], self.values[slot] = keys[order], values[order]

    def place(self, keys: np.ndarray) -> np.ndarray:
        h = (keys ^ (keys >> np.uint64(29))) * np.uint64(vec.BASE)
        return ((h >> np.uint64(32)) * self.size >> np.uint64(32)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.place(keys)
        left = np.flatnonzero(self.keys[at] != keys)
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] != keys[left]]
        return self.values[at]


def count_words(rows: DataFrame) -> tuple[str, int, int]:
    """(folder with a file for each batch: its words' hashes and training counts; tokens and different tokens in training)."""
    found = batch_words(rows)
    totals = shared.table(found.groupBy("word").agg(F.sum("n").alias("total")), "totals", "zstd")
    seen = totals.where("total > 0").agg(F.sum("total").alias("tokens"), F.count("*").alias("different")).first()
    folder = store(found, totals, "word", "total", np.int64)
    shared.forget(found, totals)
    return folder, int(seen["tokens"] or 0), int(seen["different"])


def count_grams(rows: DataFrame) -> str:
    """A folder with a file for each batch: its grams and their costs."""
    found = batch_grams(rows)
    total = shared.table(found.groupBy("gram").agg(F.sum("n").alias("n")), "grams", "zstd")
    shared.forget()
    short = rows.sparkSession.sparkContext.broadcast(short_counters(total))  # of fixed size
    parted = in_parts(total)
    costs = gram_costs(parted, train_mixer(parted, short), short)
    shared.forget(total)
    folder = store(found, costs, "gram", "cost", np.float32)
    shared.forget(found, costs)
    return folder


def score(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every text of docs.

    train: the rows to learn from. Null texts are empty; an empty text has its end only. Repeated rows are scored alike, and each counts in training.
    Texts of any length are scored whole; a text is a row, so a task holds its longest one. Other columns are ignored, whatever they are called.
    Without training rows all words are unknown and all bits as likely as not. An empty table gives no rows. Words and grams are told apart by hashes and numbers of 64 bits.
    """
    rows = batched(docs, train)
    costs = count_grams(rows)
    folder, tokens, different = count_words(rows)
    denominator = tokens + 0.1 * (different + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cost_of, count_of = None, None, None
        for part, data, offs in vec.slices(batches):
            g, at = grams(data, offs)
            h, first = word_rows(data, offs)
            cost, n = np.zeros(len(g)), np.zeros(len(h), np.int64)
            ends = np.zeros(part.num_rows, np.int64)
            ids = part.column(3).to_numpy()
            for batch in np.unique(ids).tolist():
                if batch != now:
                    cost_of = count_of = None
                    now, cost_of, count_of = batch, Lookup(costs, batch, np.float32), Lookup(folder, batch, np.int64)
                mine = np.repeat(ids == batch, np.diff(at))
                cost[mine] = cost_of(g[mine])
                mine = np.repeat(ids == batch, np.diff(first))
                n[mine] = count_of(h[mine])
                ends[ids == batch] = count_of(np.array([END_WORD]))[0]
            bits = vec.row_sums(cost, at)
            base = vec.row_sums(np.log10((n + 0.1) / denominator), first) + np.log10((ends + 0.1) / denominator)
            known = vec.row_sums((n > 0).astype(np.float64), first).astype(np.int64) + (ends > 0)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.diff(first) + 1), pa.array(known), pa.array(np.full(part.num_rows, tokens)), pa.array(base), pa.array(-bits * np.log10(2)), pa.array(bits / np.maximum(np.diff(offs), 1))],
                ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
            )

    return rows.mapInArrow(run, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
