"""Language identification, toxicity and language-model scores."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import langid, mixing, toxicity, vec

SYLLABLES = {"x": ["ka", "ro", "mi"], "y": ["sch", "ung", "er"]}


def text_of(lang, rng, n=30):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def slow_bits(samples, text, order):
    """PPM by the book: longest context first, escapes with the number of different successors."""
    counts = collections.defaultdict(collections.Counter)
    for t in samples:
        symbols = [None] * order + list(t)
        for i in range(order, len(symbols)):
            for k in range(order + 1):
                counts[tuple(symbols[i - k : i])][symbols[i]] += 1
    symbols, total = [None] * order + list(text), 0.0
    for i in range(order, len(symbols)):
        for k in range(order, -1, -1):
            c = counts.get(tuple(symbols[i - k : i]))
            if c is None:
                continue
            n, d = sum(c.values()), len(c)
            if c[symbols[i]]:
                total -= math.log2(c[symbols[i]] / (n + d))
                break
            total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


def test_code_lengths_are_exact():
    rng = random.Random(1)
    samples = {k: [text_of(k, rng).encode() for _ in range(3)] for k in SYLLABLES}
    texts = [text_of("x", rng).encode(), text_of("y", rng).encode(), b"", b"kaq\xc3\xa9", b"z"]
    model = langid.Model(samples, 3)
    got = model.bits(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    expected = [[slow_bits(samples[k], t, 3) for k in model.langs] for t in texts]
    assert np.allclose(got, expected, rtol=1e-5)


def test_language_query(spark):
    rng = random.Random(2)
    rows = [(i, text_of("xy"[i % 2], rng), "xy"[i % 2], 1) for i in range(60)] + [(60, None, "x", 1), (61, "12 !!", "y", 1), (62, "", None, 1), (None, text_of("x", rng), None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    found = {r.doc_id: r for r in langid.predict(docs, docs.where("doc_id < 40")).collect()}
    assert all(found[i].lang_pred == "xy"[i % 2] and 0 <= found[i].score <= 1 for i in range(60))
    assert [found[i].lang_pred for i in (60, 61, 62)] == ["und"] * 3 and found[None].lang_pred == "x"
    assert langid.predict(docs.where("1 = 0"), docs).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, docs.where("1 = 0")).collect()} == {"und"}


def test_training_samples(spark):
    """Different texts in the order of their hashes up to the bound, one at least of each language; copies count once."""
    rows = [("x", "the same text " * 20)] * 500 + [("x", f"text {i} " * 30) for i in range(200)] + [("y", "a very long text " * 400)] * 3 + [("z", "short"), (None, "no language"), ("w", None)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    found = langid.training_sample(docs, 4000)
    assert sorted(found) == ["x", "y", "z"] and len(set(found["x"])) == len(found["x"]) > 5
    assert 0 < sum(map(len, found["x"])) <= 4000 and len(found["y"]) == 1 and len(found["y"][0]) == 4000 and found["z"] == [b"short"]
    tie = spark.createDataFrame([("b", "same"), ("a", "same")], "lang string, text string")
    asked = spark.createDataFrame([("same", 1), ("same", 1), ("same " * 300_000, 2)], "text string, lang_pred int")
    assert {r.lang_pred for r in langid.predict(asked, tie).collect()} == {"a"}


def test_models_have_a_bound(monkeypatch):
    rng = np.random.default_rng(1)
    samples = {f"l{i}": [rng.integers(1, 256, 3000, dtype=np.uint8).tobytes() for _ in range(4)] for i in range(6)}
    monkeypatch.setattr(langid, "MOST_CELLS", 600_000)
    small = langid.bounded(dict(samples), 3)
    model = langid.Model(small, 3)
    assert sorted(small) == sorted(samples) and all(sum(map(len, v)) for v in small.values())
    assert sum(x.size for x in (*model.next, *model.cost, *model.escape)) < 1_200_000
    monkeypatch.undo()
    assert langid.bounded(dict(samples), 1) == samples


def test_toxicity(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        words = text_of("x", rng, 60).split()
        if i % 3 == 0:
            words[rng.randrange(60)] = rng.choice(["vilify", "scorned"])
        rows.append((i, " ".join(words), i % 3 == 0))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows if i < 200] + [(1, None), (None, 1), (0, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((found[i] >= 0.5) == y for i, _, y in rows) and found[900] == found[901] < 0.5
    for other in (labels.where("1 = 0"), labels.where("toxic = 0")):
        assert all(r.score < 0.5 for r in toxicity.score(docs, toxicity.train(docs, other)).collect())
    assert toxicity.score(docs.where("1 = 0"), model).count() == 0


def slow_toxicity(texts, toxic):
    """Scores by the book: sets of n-grams, smoothed log-count ratios, and the same steps of gradient descent in plain Python."""

    def features(text):
        padded = b" " + text.encode().lower() + b" "
        return {padded[i : i + n] for n in toxicity.N_GRAMS for i in range(len(padded) - n + 1)}

    sets = [features(t) for t in texts]
    n_toxic, n_clean = sum(toxic), len(toxic) - sum(toxic)
    ratio = {}
    for f in sorted(set().union(*sets)):
        a, b = sum(f in s for s, y in zip(sets, toxic, strict=True) if y), sum(f in s for s, y in zip(sets, toxic, strict=True) if not y)
        r = math.log((a + 1) / (n_toxic + 2)) - math.log((b + 1) / (n_clean + 2))
        if a + b >= toxicity.LEAST_TEXTS and abs(r) >= toxicity.LEAST_RATIO:
            ratio[f] = r
    names = list(ratio)
    weight, moments = [0.0] * (len(names) + 1), [[0.0] * (len(names) + 1), [0.0] * (len(names) + 1)]
    rows = [[k for k, f in enumerate(names) if f in s] for s in sets]
    for t in range(1, 81):
        grad = [toxicity.PENALTY * w for w in weight[:-1]] + [0.0]
        for row, y in zip(rows, toxic, strict=True):
            margin = weight[-1] + sum(ratio[names[k]] * weight[k] for k in row)
            error = (1 / (1 + math.exp(-margin)) - y) * (0.5 / n_toxic if y else 0.5 / n_clean)
            for k in row:
                grad[k] += ratio[names[k]] * error
            grad[-1] += error
        for k, g in enumerate(grad):
            moments[0][k] = 0.9 * moments[0][k] + 0.1 * g
            moments[1][k] = 0.999 * moments[1][k] + 0.001 * g * g
            weight[k] -= 0.02 * (moments[0][k] / (1 - 0.9**t)) / (math.sqrt(moments[1][k] / (1 - 0.999**t)) + 1e-8)
    return [1 / (1 + math.exp(-weight[-1] - sum(ratio[f] * weight[k] for k, f in enumerate(names) if f in s))) for s in sets]


def test_toxicity_by_the_book():
    rng = random.Random(8)
    texts = [text_of("x", rng, 12) + rng.choice(["", " vilify", " Scorned"]) + (" É" if i % 5 == 0 else "") for i in range(40)]
    toxic = [("vilify" in t or "Scorned" in t) != (i % 10 == 9) for i, t in enumerate(texts)]
    model = toxicity.fit([t.encode() for t in texts], np.array(toxic))
    data = [t.encode() for t in texts]
    got = model.score(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in data])]))
    assert np.allclose(got, slow_toxicity(texts, toxic), atol=1e-5)


def test_toxicity_of_odd_rows(spark):
    rows = [(1, "vile words here"), (1, "vile words here"), (1, "another"), (2, "kind words"), (None, None), (3, "long " * 60_000)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 0)], "doc_id long, toxic int")
    found = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(found) == 6 and found[0].score == found[1].score and len(found[0]) == 3


def test_a_feature_counts_once():
    model = toxicity.Model(np.arange(1 << toxicity.SLOT_BITS), np.ones(1 << toxicity.SLOT_BITS), 0.0)
    data = b"abcdabcdabcd"
    margin = math.log(1 / (1 - model.score(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]) - 1)
    padded = " abcdabcdabcd "
    grams = {padded[i : i + n] for n in toxicity.N_GRAMS for i in range(len(padded) - n + 1)}
    assert round(margin) == len(grams)


def test_scores(spark):
    rng = random.Random(4)
    texts = [text_of("x", rng, 40) + rng.choice(["", "\n", " Ä É"]) for _ in range(60)] + [None, "", "  ", "KA ka", "KA ka"]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, batch int, train int").repartition(3)
    train = F.col("doc_id") % 5 != 0
    got = {r.doc_id: r for r in mixing.score(docs, train).collect()}
    split = re.compile("[^\x20\x09-\x0d]+")
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    tokens = [[*split.findall((t or "").translate(lower)), None] for t in texts]
    counts = collections.Counter(w for i, t in enumerate(tokens) if i % 5 for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(tokens):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert r.score < 0
    assert got[63].score == got[64].score and got[60].score == got[61].score
    held = [i for i in range(60) if i % 5 == 0]
    assert sum(got[i].score for i in held) > -0.6 * 8 * math.log10(2) * sum(len(texts[i].encode()) for i in held)
    assert mixing.score(docs.where("1 = 0"), train).count() == 0
    alone = mixing.score(docs.where("doc_id = 60"), F.lit(False)).first()
    assert alone.train_tokens == 0 and alone.base_score == pytest.approx(0) and alone.score == pytest.approx(-8 * math.log10(2), rel=0.01)


def counted(texts):
    """(grams of texts, how often each stands there, counters of short contexts)."""
    data = [t.encode() for t in texts]
    gram, n = mixing.sum_equal(mixing.grams(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in data])]))[0])
    short = mixing.empty_short()
    mixing.count_short(gram, n.astype(np.float64), short)
    return gram, n.astype(np.float64), short


def trained_mixer(texts):
    gram, n, short = counted(texts)
    mixer = mixing.Mixer()
    mixer.train(gram, n, short)
    return mixer


def test_merged_counts():
    rng = np.random.default_rng(2)
    for size in (1, 5, 300):
        a, b = rng.integers(0, 400, 300).astype(np.uint64), rng.integers(0, 400, size).astype(np.uint64)
        keys, counts = mixing.merged(*mixing.sum_equal(a), *mixing.sum_equal(b))
        assert [x.tolist() for x in (keys, counts)] == [x.tolist() for x in mixing.sum_equal(np.concatenate([a, b]))]


def test_probabilities_sum_to_one():
    rng = random.Random(5)
    texts = [text_of("x", rng, 50) for _ in range(5)]
    gram, n, short = counted(texts)
    mixer = trained_mixer(texts)
    for g in (gram[100], gram[-1], np.uint64(0x717171717171)):
        every = (g & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
        both = np.unique(np.concatenate([gram, every]))
        weight = np.zeros(len(both))
        weight[np.searchsorted(both, gram)] = n
        bits = mixer.bits(both, weight, short)[np.searchsorted(both, every)]
        assert np.exp2(-bits).sum() == pytest.approx(1, abs=1e-6)


def slow_text_bits(texts, mixer, text):
    """Code length of a text, byte by byte and bit by bit, with counters in a dictionary."""
    counts = collections.defaultdict(lambda: [0, 0])

    def steps(data):
        data = bytes(mixing.ORDER) + data + b"\0"
        for at in range(mixing.ORDER, len(data)):
            before = data[at - mixing.ORDER : at]
            word = re.split(rb"[\x00\x09-\x0d\x20]", before)[-1]
            contexts = [(k, before[mixing.ORDER - k :]) for k in range(mixing.ORDER + 1)] + [("word", word)]
            for place in range(8):
                yield place, contexts, 1 << place | data[at] >> (8 - place), data[at] >> (7 - place) & 1, word

    for t in texts:
        for _, contexts, node, bit, _ in steps(t.encode()):
            for c in contexts:
                counts[c, node][bit] += 1
    total = 0.0
    for place, contexts, node, bit, _ in steps(text.encode()):
        found = [counts.get((c, node), (0, 0)) for c in contexts]
        x = [math.log((b + mixing.PRIOR) / (a + mixing.PRIOR)) for a, b in found] + [0.3]
        longest = max([k for k in range(mixing.ORDER + 1) if sum(found[k])], default=0)
        seen = min(math.ceil(math.log2(sum(found[-1]) + 1)), mixing.SEEN - 1)
        z = sum(w * v for w, v in zip(mixer.weights[(place * (mixing.ORDER + 1) + longest) * mixing.SEEN + seen].tolist(), x, strict=True))
        z = max(-14.0, min(14.0, z))
        zeros, ones = mixer.seen[node, max(0, min(mixing.BUCKETS - 1, round(z * 2) + mixing.BUCKETS // 2))]
        p = 1 / (1 + math.exp(-z))
        mapped = min(max((ones + 4 * p) / (zeros + ones + 4), 1e-6), 1 - 1e-6)
        p = 1 / (1 + math.exp(-(z + math.log(mapped / (1 - mapped))) / 2))
        total -= math.log2(p if bit else 1 - p)
    return total


def test_scores_bit_by_bit(spark, monkeypatch):
    rng = random.Random(6)
    texts = [text_of("x", rng, 25) for _ in range(12)] + ["", "ka ka\nro", "Äé", text_of("x", rng, 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    train = F.col("doc_id") < 12
    mixer = trained_mixer(texts[:12])
    monkeypatch.setattr(mixing, "train_mixer", lambda parted, short: mixer)
    monkeypatch.setattr(mixing, "PART_GRAMS", 50)
    monkeypatch.setattr(mixing, "PENDING", 20)
    for r in mixing.score(docs, train).collect():
        assert r.score == pytest.approx(-slow_text_bits(texts[:12], mixer, texts[r.doc_id]) * math.log10(2), rel=1e-4)


def test_weights_are_learned_without_the_example_itself():
    """A text of letters by chance cannot be foretold, however well it was counted."""
    rng = random.Random(7)
    texts = ["".join(rng.choices("abcdefgh", k=400)) for _ in range(20)]
    gram, n, short = counted(texts)
    mixer = trained_mixer(texts)
    fresh, m, _ = counted(["".join(rng.choices("abcdefgh", k=3000))])
    both = np.unique(np.concatenate([gram, fresh]))
    weight = np.zeros(len(both))
    weight[np.searchsorted(both, gram)] = n
    bits = mixer.bits(both, weight, short)[np.searchsorted(both, fresh)]
    assert 2.9 < (bits * m).sum() / m.sum() < 3.5


def test_contexts_reach_six_bytes_back():
    text = np.frombuffer(b"abcdefg", np.uint8)
    gram, first = mixing.grams(text, np.array([0, len(text)]))
    assert list(first) == [0, 8] and int(gram[6]) == int.from_bytes(b"abcdefg", "big")
    assert mixing.MODELS == 8 and mixing.word_length(gram[6:7])[0] == 6
    other = gram[6:7] ^ np.uint64(1 << 48)
    assert mixing.context_of(gram[6:7], 5)[0] == mixing.context_of(other, 5)[0] and mixing.context_of(gram[6:7], 6)[0] != mixing.context_of(other, 6)[0]


def test_held_out_texts_beat_the_words(spark):
    found = mixing.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0)
    held = found.where("not train").toPandas()
    assert (held.score > held.base_score).mean() > 0.6 and held.score.sum() > held.base_score.sum()


def test_words_of_a_batch_in_two_tasks(spark):
    rows = spark.createDataFrame([(True, "a b", 0), (True, "a c", 0)], "train boolean, text string, batch long").repartitionByRange(2, "text")
    assert rows.rdd.getNumPartitions() == 2
    assert mixing.count_words(rows)[1:] == (6, 4)


def test_memo():
    memo = vec.Memo(4)
    keys = np.arange(1, 100, dtype=np.uint64) * np.uint64(vec.BASE)
    memo.add(keys, np.arange(99))
    found = memo.find(keys)
    assert ((found == -1) | (found == np.arange(99))).all() and (found >= 0).sum() >= 8


def test_toxicity_sample_is_bounded_in_bytes():
    sizes = [(i, 10 * i, i % 2) for i in range(10)]
    assert toxicity.within(sizes, 450) is None
    assert toxicity.within(sizes, 200) == [0, 1, 2, 3, 4, 5] and toxicity.within(sizes, 1) == [0, 1]
    assert toxicity.within([(7, 10**9, 1), (8, 10**9, 1), (9, 10**9, 0)], 100) == [7, 9]
