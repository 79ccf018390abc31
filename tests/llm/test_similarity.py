"""Line dedup, the n-gram join, components and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import components, linededup, lzprint, ngram_join

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re", "so", "ta", "vi") for b in ("ba", "de", "fo", "gu", "ni", "pra", "st", "x")]


def sentence(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def corpus(seed):
    """Texts with exact and near copies, shared lines, odd lines and nothing at all."""
    rng = random.Random(seed)
    lines = [sentence(rng, n) for n in (1, 2, 3, 4, 5, 6, 8, 12, 20, 30, 45)]
    texts = ["", "\n\n", "!!! ...", "a", "a b c d", "A, b; c d"]
    for _ in range(40):
        own = [sentence(rng, rng.randint(1, 40)) for _ in range(rng.randint(0, 4))]
        own += [edited(rng, rng.choice(lines), rng.randint(0, 3)).capitalize() + rng.choice(["", ".", " !"]) for _ in range(3)]
        rng.shuffle(own)
        texts.append("\n".join(own))
    texts += [edited(rng, texts[i].replace("\n", " "), k % 4) for k, i in enumerate(range(10, 30)) if texts[i]]
    texts += texts[8:12] + [sentence(rng, 3000)]
    return texts


def brute_lines(rows, threshold=0.8):
    """Removed line numbers by row, rows in order."""
    seen, out = [], []
    for text in rows:
        removed = []
        for n, line in enumerate((text or "").split("\n")):
            words = frozenset(w for w in re.split(r"[\s!-/:-@\[-`{-~]+", line.lower()) if w)
            if words:
                if any(len(words & s) / len(words | s) >= threshold - 1e-9 for s in seen):
                    removed.append(n)
                seen.append(words)
        out.append(removed)
    return out


def test_lines(spark):
    texts = corpus(1)
    rows = list(enumerate(texts)) + [(7000, None)]
    docs = spark.createDataFrame([(i, t, 5, "r", len(t or "")) for i, t in rows], "doc_id long, text string, rid int, removed string, n_chars long").repartition(5)
    expected = brute_lines([t for _, t in rows])
    got = {r.doc_id: r for r in linededup.dedup(docs).collect()}
    assert len(got) == len(rows) and sum(map(len, expected)) > 40
    for (i, t), gone in zip(rows, expected, strict=True):
        left = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
        assert (got[i].text, got[i].rid, got[i].removed, got[i].n_chars) == (left, 5, "r", len(left or ""))


def test_lines_of_repeated_and_null_ids(spark):
    rows = [(2, "one two three\nfour"), (None, "four"), (2, "one two three\nfour"), (2, "another"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    expected = [None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone) for (_, t), gone in zip(ordered, brute_lines([t for _, t in ordered]), strict=True)]
    assert sorted(map(str, (r.text for r in linededup.dedup(docs).collect()))) == sorted(map(str, expected))
    assert linededup.dedup(docs.where("1 = 0")).count() == 0


def test_keys_of_similar_sets(spark):
    """Sets of all sizes at the threshold, also across bands and in prefixes that are dealt out in parts, share a key."""
    rng = random.Random(4)
    lines = []
    for n in (4, 5, 9, 10, 11, 12, 13, 15, 60, 102, 127, 128, 150, 160, 255, 256, 300, 1300, 2560):
        a = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        d = n // 9  # two sets of n words that share n - d have a Jaccard of (n - d) / (n + d)
        lines += [" ".join(a), " ".join(a[d:] + [f"v{rng.randrange(10**9)}" for _ in range(d)]), " ".join(a + [f"u{rng.randrange(10**9)}" for _ in range(n // 4)])]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.removed or [] for r in linededup.dedup(docs, removed="removed").collect()}
    assert [got[i] for i in range(len(lines))] == brute_lines(lines)
    with pytest.raises(ValueError):
        linededup.dedup(docs, 0.5)


def test_lines_of_a_template(spark):
    """Short lines with the same fixed words and two words of their own share few keys: none that all lines of a template have."""
    rng = random.Random(11)
    templates = (("posted", "by", "on"), ("filed", "under", "at"), ("seen", "with", "near"), ("sent", "to", "from"))
    lines = [" ".join((*rng.choice(templates), f"user{rng.randrange(1000)}", f"day{rng.randrange(365)}")) for _ in range(4000)]
    rows = spark.createDataFrame(list(enumerate(lines)), "rid long, text string").repartition(3)
    firsts = linededup.first_lines(rows, linededup.rarity(rows), linededup.THRESHOLD)
    sizes = [r["count"] for r in linededup.join_keys(firsts.select("n", "tokens"), linededup.THRESHOLD).groupBy("key").count().collect()]
    assert max(sizes) < 30 and sum(n * (n - 1) // 2 for n in sizes) < 40_000
    docs = rows.where("rid < 600").withColumnRenamed("rid", "doc_id")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    got = {r.doc_id: r.removed or [] for r in linededup.dedup(docs, removed="removed").collect()}
    assert [got[i] for i in sorted(got)] == brute_lines(texts)


def test_keys_of_unlike_lines(spark):
    """A key of two unlike lines is told by their bitmaps while keys are counted, so its rows are not joined; keys of any number of lines lose no similar pair."""
    rng = random.Random(12)
    lines = []
    for size in (2, 2, 2, 3, linededup.CROWD, linededup.CROWD + 1, 40):
        common = [f"c{rng.randrange(10**9)}" for _ in range(6)]
        lines += [" ".join(common + [f"w{k}" for k in rng.sample(range(60), 24)]) for _ in range(size)]
        lines.append(edited(rng, lines[-1], 1))
    for _ in range(150):  # the six rarest words of 20 in common: unlike, and pairs of them are keys of these two only
        common = [f"d{rng.randrange(10**9)}" for _ in range(6)]
        lines += [" ".join(common + [f"w{k}" for k in rng.sample(range(60), 14)]) for _ in range(2)]
    rng.shuffle(lines)
    rows = spark.createDataFrame(list(enumerate(lines)), "rid long, text string").repartition(3)
    firsts = linededup.first_lines(rows, linededup.rarity(rows), linededup.THRESHOLD)
    pairs = linededup.join_keys(firsts.select("n", "tokens"), linededup.THRESHOLD).groupBy("key").count().where("count > 1").count()
    kept = linededup.shared_keys(firsts, linededup.THRESHOLD)
    assert pairs > 250 and kept.count() < pairs / 2 and not kept.where("crowd").isEmpty()
    got = {r.doc_id: r.removed or [] for r in linededup.dedup(rows.withColumnRenamed("rid", "doc_id"), removed="removed").collect()}
    assert [got[i] for i in range(len(lines))] == brute_lines(lines)


def test_a_group_of_near_copies(spark):
    rng = random.Random(9)
    base = sentence(rng, 40)
    texts = [edited(rng, base, rng.randint(0, 8)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.removed or [] for r in linededup.dedup(docs, removed="removed").collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts)


def test_texts_are_cut_once(spark, tmp_path, monkeypatch):
    """Of the tables made on the way only two read texts: the hashes of all lines, and the few sets to verify; rare words, sets and numbers of lines are read from the first."""
    texts, tables, write = corpus(3), [], linededup.shared.table
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/docs")

    def table(df, name, *args, **options):
        if re.search(r"ReadSchema: struct<[^>]*\btext:", df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")):
            tables.append(name)
        return write(df, name, *args, **options)

    monkeypatch.setattr(linededup.shared, "table", table)
    got = {r.doc_id: r.removed or [] for r in linededup.dedup(spark.read.parquet(f"{tmp_path}/docs"), removed="removed").collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts)
    assert tables == ["cut", "sets"]


def test_words_of_odd_lines(spark):
    """Final sigmas, dotted capitals, marks and white space of all kinds at the ends of lines and words."""
    lines = ["ΟΔΟΣ ΣΑΣ' x", "ΟΔΟΣ' ΣΑΣ\tX", "οδος σας x!", "İstanbul I", "i̇stanbul i", "--", " \t\x0b\f\r ", "a\u00a0b", "a b", "(A)...[b]", "\x00", "_\\^`{|}~", "€ 5", "5 €\r"]
    docs = spark.createDataFrame([(0, "\n".join(lines)), (1, "\n" + "\n".join(reversed(lines)) + "\n")], "doc_id long, text string")
    got = {r.doc_id: r.removed or [] for r in linededup.dedup(docs, removed="removed").collect()}
    odd = [n for n, line in enumerate(lines) if not re.sub(r"[\s!-/:-@\[-`{-~]+", "", line)]
    assert got[1] == [len(lines) - n for n in reversed(range(len(lines))) if n not in odd]
    assert got[0] == [1, 2, 4, 9, 13]


def test_lines_need_no_python(spark):
    docs = spark.createDataFrame(list(enumerate(corpus(2))), "doc_id long, text string")
    plan = linededup.dedup(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def shingles(text, n=5):
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute_join(docs):
    sets = {i: shingles(t) for i, t in docs.items()}
    ids, up, links = sorted(docs), {i: i for i in docs}, dict.fromkeys(docs, 0)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (root(i), links[i]) for i in ids}


@pytest.mark.parametrize("block", [3, 512])
def test_join(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", block)
    rng = random.Random(6)
    base = sentence(rng, 120)
    texts = corpus(3) + [edited(rng, base, k % 5) for k in range(25)] + [base, base, base.upper()]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "x", 1), (500, None, 1)], "doc_id long, text string, class_id int")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(docs).collect()}
    expected = brute_join(dict(enumerate(texts)) | {500: ""})
    assert got.pop(None) == (None, 0)
    assert got == expected and max(n for _, n in expected.values()) > 15
    if block == 512:
        kept = ngram_join.deduplicate(docs)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {c for c, _ in expected.values()} | {None}


def test_join_of_repeated_ids_and_nothing(spark):
    docs = spark.createDataFrame([(1, "b b b b b b"), (1, "a a a a a a"), (2, "a a a a a a")], "doc_id long, text string")
    assert {(r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(docs).collect()} == {(1, 1, 1), (2, 1, 1)}
    assert ngram_join.near_duplicates(docs.where("1 = 0")).count() == 0


def test_join_compares_every_row(spark):
    a, z, y = "a b c d e f g", "t u v w x y z", "k l m n o p q"
    docs = spark.createDataFrame([(1, a), (1, a), (2, a), (2, z), (None, a), (None, y), (None, y), (3, None)], "doc_id long, text string")
    found = sorted(((r.doc_id, r.class_id, r.copy_id, r.n_copies, r.n_links) for r in ngram_join.near_duplicates(docs).collect()), key=str)
    nameless = [(None, 1, 1, 4, 3), (None, None, None, 2, 1), (None, None, None, 2, 1)]
    assert found == sorted([(1, 1, 1, 4, 3), (1, 1, 1, 4, 3), (2, 1, 1, 4, 3), (2, 2, 2, 1, 3), (3, 3, 3, 1, 0), *nameless], key=str)
    kept = [tuple(r) for r in ngram_join.deduplicate(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (2, z), (None, y), (3, None)], key=str)


def test_threshold_of_large_sets():
    """Pairs at a Jaccard of exactly 0.8 are links, one n-gram less is none, whatever the size."""
    for shared_words, own in ((8, 1), (80, 10), (16_000, 2_000), (40_000, 5_000)):
        words = [f"w{i}" for i in range(shared_words + 2 * own + 1)]
        a, b = words[: shared_words + own], words[:shared_words] + words[shared_words + own : shared_words + 2 * own]
        assert len(set(a) & set(b)) * 9 == 4 * (len(a) + len(b))
        assert len(ngram_join.verify([" ".join(a), " ".join(b)], 1, 0.8)[0]) == 1
        assert len(ngram_join.verify([" ".join(a), " ".join([*b, words[-1]])], 1, 0.8)[0]) == 0


def test_components_of_a_long_path(spark):
    path = spark.range(600).selectExpr("id as a", "id + 1 as b")
    assert {r.component for r in components.connected_components(path).collect()} == {0}


def test_bands():
    b, r = ngram_join.choose_bands(0.8, 0.9999, 128)
    assert b * r <= 128 and 1 - (1 - 0.8**r) ** b >= 0.9999


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7), (3, None)]
    up = list(range(200))
    for a, b in ((a, b) for a, b in edges if b is not None):
        old, new = max(up[a], up[b]), min(up[a], up[b])
        up = [new if x == old else x for x in up]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    assert got == {x: up[x] for x in nodes}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_phrases(data):
    known, out, at = set(), [], 0
    for end in range(1, len(data) + 1):
        if data[at:end] not in known:
            known.add(data[at:end])
            out.append(end)
            at = end
    return out if at == len(data) else [*out, len(data)]


def test_phrases():
    rng = random.Random(3)
    for _ in range(50):
        a, b = sentence(rng, rng.randint(0, 60)).encode(), sentence(rng, rng.randint(0, 60)).encode()
        cut = rng.randint(0, len(a))
        assert lzprint.phrase_ends(a) == slow_phrases(a)
        assert lzprint.shared_start_ends(a, a[:cut] + b, cut) == (slow_phrases(a), slow_phrases(a[:cut] + b))


def test_fingerprints(spark):
    texts = [*corpus(4), "é中😀" * 9, None]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in lzprint.digests(docs).collect()}
    texts = [t or "" for t in texts]
    single = [lzprint.signatures([t.encode()], [slow_phrases(t.encode())])[0] for t in texts]
    for k, t in enumerate(texts):
        r, n = got[3 * k], (k + 1) % len(texts)
        other = t[: len(t) - len(t) // 4] + texts[n][: len(t) // 4]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(t), hashlib.sha256(other.encode()).hexdigest(), lzprint.to_hex(single[k]))
        changed = lzprint.signatures([other.encode()], [slow_phrases(other.encode())])[0]
        assert (r.edited_fingerprint, r.near_edited, r.near_next) == (lzprint.to_hex(changed), (single[k] == changed).mean(), (single[k] == single[n]).mean())
    plain = {r.doc_id: r.fingerprint for r in lzprint.fingerprints(docs.withColumn("fingerprint", F.lit(1))).collect()}
    assert plain == {i: r.fingerprint for i, r in got.items()}


def test_fingerprints_estimate_the_jaccard_of_phrases():
    rng = random.Random(9)
    a = sentence(rng, 800)
    b = edited(rng, a, 100)
    sets = [{t.encode()[s:e] for s, e in zip([0, *ends], ends)} for t in (a, b) for ends in [slow_phrases(t.encode())]]
    one, two = lzprint.signatures([a.encode(), b.encode()], [slow_phrases(a.encode()), slow_phrases(b.encode())])
    assert abs(np.mean(one == two) - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.15


def test_fingerprints_of_few_rows(spark):
    one = spark.createDataFrame([(5, "abcabcabc")], "doc_id long, text string")
    r = lzprint.digests(one).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abcabcaab").hexdigest()
    assert lzprint.digests(one.where("1 = 0")).count() == 0
    same = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c"), (2, "dd")], "doc_id long, text string")
    assert lzprint.digests(same).count() == 4


def test_blocks_of_sets_against_each_pair():
    """Counts by products, counts pair by pair and components of one block and of two, against plain sets."""
    rng = np.random.default_rng(5)
    for dense in (1, 3, 64):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(ngram_join, "DENSE", dense)
            patch.setattr(ngram_join, "STRIPE", 7)
            sets = [np.unique(rng.integers(0, 40, rng.integers(0, 30))).astype(np.uint64) for _ in range(41)]
            sets += [sets[3], sets[3][:-1], sets[5]]
            h, first = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            every = np.arange(len(sets))
            for a, b in ((every, every), (every[:20], every[20:]), (every[::2], every[1::2])):
                both = ngram_join.overlaps(h, first, a, b)
                expected = np.array([[len(np.intersect1d(sets[i], sets[j])) for j in b] for i in a])
                assert (both == expected)[a[:, None] != b[None, :]].all()
                link = ngram_join.linked_sets(h, first, a, b, 0.5)
                jaccard = [[i != j and len(np.intersect1d(sets[i], sets[j])) > 0 and 2 * len(np.intersect1d(sets[i], sets[j])) >= len(np.union1d(sets[i], sets[j])) for j in b] for i in a]
                assert link.tolist() == jaccard
                label = ngram_join.group_labels(link, a is b)
                nodes = a if a is b else np.concatenate([a, b])
                up = {int(x): int(x) for x in nodes}
                for _ in nodes:
                    for x, y in zip(*np.nonzero(link), strict=True):
                        up[int(a[x])] = up[int(b[y])] = min(up[int(a[x])], up[int(b[y])])
                assert len(set(label.tolist())) == len(set(up.values())) and all((label[x] == label[y]) == (up[int(nodes[x])] == up[int(nodes[y])]) for x in range(len(nodes)) for y in range(len(nodes)))
                assert ngram_join.link_sums(link, np.arange(len(b)) + 1.0).tolist() == [sum(k + 1 for k, y in enumerate(r) if y) for r in jaccard]
