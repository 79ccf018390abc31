"""Decontamination, WARC archives and the pipeline against brute force."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import decontam, queries, toxicity, warc

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items, width=13):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words_of(t)
        if w:
            for k in range(max(1, len(w) - width + 1)):
                windows[tuple(w[k : k + width])] |= {str(i)} if i is not None else set()  # without an id it hits, but is not named
    out = []
    for i, t in docs:
        w, hit, found = words_of(t), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if (names := windows.get(tuple(w[k : k + size]))) is not None:
                    found |= names
                    hit |= set(range(k, k + size))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def case(seed, vocabulary=12):
    rng = random.Random(seed)
    names = [f"w{i}é" for i in range(vocabulary)]
    items = [(i, " ".join(rng.choices(names, k=rng.choice([1, 2, 3, 5, 12, 13, 14, 20, 40])))) for i in range(30)] + [(30, None), (31, "?!"), (None, "w1é"), (5, "Second TEXT of five")]
    docs = [(i, " ".join(rng.choices(names, k=rng.randint(0, 60)))) for i in range(60)] + [(60, None), (61, ""), (None, "second text of five"), (62, "x " * 3000)]
    for _, t in items[:30:3]:
        docs.append((100 + len(docs), "before, " + t.upper() + "; after " * rng.randint(0, 30)))
    return docs + docs[:3], items


@pytest.mark.parametrize(("shard", "block", "vocabulary"), [(1 << 20, 5000, 12), (300, 4, 12), (1 << 20, 5000, 2000)])
def test_windows(spark, monkeypatch, shard, block, vocabulary):
    monkeypatch.setattr(decontam, "SHARD_BYTES", shard)
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", block)
    docs, items = case(1, vocabulary)
    d = spark.createDataFrame([(i, t, 3) for i, t in docs], "doc_id long, text string, items int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r)[:6] for r in decontam.digests(d, b).collect()]
    assert sorted(got, key=str) == sorted(brute(docs, items), key=str)
    kept = decontam.decontaminate(d, b)
    assert kept.columns == d.columns and sorted(map(str, ((r.doc_id, r["items"]) for r in kept.collect()))) == sorted(str((e[0], 3)) for e in brute(docs, items) if not e[5])


def test_longest_match(spark):
    b = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(40)))], "item_id long, text string")
    d = spark.createDataFrame([(1, "x y " + " ".join(f"a{i}" for i in range(5, 35)) + " z " + " ".join(f"a{i}" for i in range(14))), (2, "a1 a2")], "doc_id long, text string")
    got = {r.doc_id: (r.longest, r.longest_item, r.longest_at) for r in decontam.digests(d, b).collect()}
    assert got == {1: (30, "1", 2), 2: (0, None, None)}


def test_repetitive_texts_and_items(spark):
    """Every place of a text begins one window of a width, however often an item repeats it."""
    b = spark.createDataFrame([(1, "a b " * 800), (2, "a b " * 20 + "c"), (None, "q " * 13)], "item_id long, text string")
    d = spark.createDataFrame([(1, "a b " * 10_000), (2, "b a " * 7 + "x"), (3, "q " * 20)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated, r.longest, r.longest_item) for r in decontam.digests(d, b).collect()}
    assert got == {1: (20_000, 20_000, 2, True, 1600, "1"), 2: (15, 14, 2, True, 14, "1"), 3: (20, 20, 0, True, 13, None)}


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(30):
        texts = [rng.integers(1, 4, rng.integers(0, 30)) for _ in range(5)]
        seq = np.concatenate([np.append(t, 0) for t in texts])
        left = np.concatenate([np.arange(len(t) + 1, 0, -1) for t in texts])
        sa, _ = decontam.suffix_array(seq, left)
        suffixes = [seq[i : i + left[i]].tolist() for i in sa]
        assert suffixes == sorted(suffixes) and sorted(sa.tolist()) == list(range(len(seq)))


def test_no_documents_or_items(spark):
    docs, items = case(2)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontam.digests(d.where("1 = 0"), b).count() == 0
    assert {r.n_hit for r in decontam.digests(d, b.where("1 = 0")).collect()} == {0}


def test_loser_tree():
    rng = random.Random(2)
    for k in range(9):
        runs = [sorted(rng.randrange(30) for _ in range(rng.randint(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("HTTPS://www.Example.com:443/A?b=1#c") == "com,example)/a?b=1"
    assert warc.url_key("http://m.x.org:8080") == "org,x,m:8080)/" and warc.url_key(None) == ")/"


def test_archives(spark):
    rng = random.Random(3)
    pages = [(i, f"http://h{rng.randrange(5)}.example/p{rng.randrange(4)}", rng.choice(["<p>same</p>", "", "é" * 50, f"own {i}"])) for i in range(80)] + [(80, None, None), (81, "http://h1.example/p1\r\nX: y", "crlf"), (40, "u", "own twice"), (40, "u", "own twice")]
    frame = spark.createDataFrame([(*p, 1, "n") for p in pages], "page_id long, url string, html string, best int, sha string").repartition(7)
    got = sorted(tuple(r)[:5] for r in warc.capture_histories(spark, frame).collect())
    best: dict = {}
    for i, _, h in pages:
        best[h or ""] = max(best.get(h or "", -1), i)
    expected = sorted((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if best[h or ""] == i else "revisit", None if best[h or ""] == i else best[h or ""]) for i, _, h in pages)
    assert sorted(map(str, got)) == sorted(map(str, expected))
    many = spark.range(0, 3000, 1, 3).selectExpr("id as page_id", "concat('http://h', id % 7, '.example/p', id % 11) as url", "cast(id as string) as html")
    archives = warc.write(many)
    merged = warc.merged(spark, archives, 4).orderBy("part", "at").collect()
    keys = [(r.url_key, r.seconds, r.page_id) for r in merged]
    assert keys == sorted(keys) and sorted(k[2] for k in keys) == list(range(3000)) and len({r.part for r in merged}) > 1
    assert warc.capture_histories(spark, frame.where("1 = 0")).count() == 0
    assert warc.capture_histories(spark, spark.createDataFrame([(None, None, "a"), (None, "x", "a")], "page_id long, url string, html string")).count() == 2


def test_many_runs_are_merged_in_passes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FAN_IN", 2)
    monkeypatch.setattr(warc, "RUN_BLOCK", 7)
    pages = spark.createDataFrame([(i, f"http://h{i * 7919 % 50}.example/{i % 11}", f"p{i % 90}") for i in range(700)], "page_id long, url string, html string")
    made = warc.write(pages.where("1 = 0"))
    made["runs"] = [r for k in range(7) for r in warc.write(pages.where(f"page_id % 7 = {k}"), made["folder"])["runs"]]
    assert len(made["runs"]) == 7 and len(warc.fewer_runs(spark, made)["runs"]) <= 2
    merged = warc.merged(spark, made, 3).orderBy("part", "at").collect()
    keys = [(r.url_key, r.seconds, r.page_id) for r in merged]
    assert keys == sorted(keys) and sorted(k[2] for k in keys) == list(range(700))


def test_small_payloads_may_stay_responses(spark):
    frame = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", "long text"), (4, "u", "long text")], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.capture_histories(spark, frame, least_bytes=5).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


@pytest.fixture(scope="module")
def stages(spark):
    """The input and output rows of each stage of the pipeline."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    out = []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, SF).cache()
        out.append((name, docs, kept))
        docs = kept
    return out


def test_stages(spark, stages):
    from tests.llm.test_similarity import brute_join, brute_lines

    columns = stages[0][1].columns
    for name, before, after in stages:
        given = {r.doc_id: r for r in before.collect()}
        kept = {r.doc_id: r for r in after.collect()}
        assert set(kept) <= set(given)
        if name != "bpe":
            assert after.columns == columns
        if name == "toxicity":
            model = toxicity.train(before.where(queries.fold(5) != 0), spark.read.parquet(f"{SF}/labels.parquet").where(queries.fold(5) != 0))
            scores = {r.doc_id: r.s for r in toxicity.score(before, model, "s").collect()}
            assert set(kept) == {i for i, s in scores.items() if s < 0.5} and len(kept) < len(given)
        if name == "line_dedup":
            ids = sorted(given)
            for i, gone in zip(ids, brute_lines([given[i].text for i in ids]), strict=True):
                assert kept[i].text == "\n".join(x for n, x in enumerate(given[i].text.split("\n")) if n not in gone) and kept[i].n_chars == len(kept[i].text)
        if name == "ngram_jaccard":
            assert set(kept) == {c for c, _ in brute_join({i: r.text for i, r in given.items()}).values()}
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(kept) == {e[0] for e in brute([(i, r.text) for i, r in given.items()], items) if not e[5]}
        if name == "bpe":
            assert set(kept) == set(given) and all(r.round_trip and r.n_tokens == len(r.ids) for r in kept.values())


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[-1][2].count()


@pytest.mark.parametrize("empty", [(), ("labels", "benchmark"), ("documents",), ("documents", "labels", "benchmark")])
def test_pipeline_of_odd_tables(spark, tmp_path, empty):
    """Nulls in every column, empty and long texts, repeated ids and rows, columns with names that operators use, and empty tables."""
    passage = " ".join(f"item{i}" for i in range(20))
    line = "a line of some words that stands here again and again"
    rows = [(1, line, "en", "s", 53, 1, "r"), (1, line, "en", "s", 53, 1, "r"), (1, "another text under the same id, which is to stay as it is", None, None, None, None, None), (None, None, None, None, None, None, None)]
    rows += [(None, f"{line}\nnot in any other document at all, this one", "en", "s", 99, 2, "x"), (2, "", "en", "s", 0, 1, "r"), (3, f"before {passage} after", "en", "s", 9, 1, "r"), (4, "long " * 50_000 + "end", "en", "s", 9, 1, "r")]
    tables = {
        "documents": spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rid int, removed string"),
        "labels": spark.createDataFrame([(1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int"),
        "benchmark": spark.createDataFrame([(7, passage), (None, None), (8, "")], "item_id long, text string"),
    }
    for name, table in tables.items():
        table.where("1 = 0" if name in empty else "1 = 1").write.parquet(f"{tmp_path}/{name}.parquet")
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs, texts = given, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == given.columns
        texts.append([(r.doc_id, r.text) for r in docs.collect()])
    found = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    if "documents" in empty:
        assert not any(texts) and not found
        return
    assert len(texts[0]) == len(rows) and len(texts[1]) == len(rows)
    assert sum(line in (t or "").split("\n") for _, t in texts[1]) == 1 and (None, None) in texts[1] and (2, "") in texts[1]
    assert (1, rows[2][1]) in texts[3] and (4, rows[7][1]) in texts[3] and ((3, rows[6][1]) in texts[3]) == bool(empty)
    assert len(found) == len(texts[3]) and all(r.round_trip for r in found)


def test_contract_columns(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    found = queries.QUERIES["op9_benchmark_decontamination"](spark, SF)
    assert found.count() == len(docs) and found.where(F.col("contaminated")).count() > 0


@pytest.mark.parametrize("words", [1, 2, 3])
def test_suffix_keys_of_fewer_words(monkeypatch, words):
    monkeypatch.setattr(decontam, "key_layout", lambda _: (words, 63 // words))
    rng = np.random.default_rng(8)
    hashes, first = rng.integers(1, 5, 400).astype(np.uint64), np.array([0, 0, 150, 151, 400])
    shard = decontam.Shard(hashes, first)
    for width in (1, 2, 3, 4, 13):
        pattern = np.stack([hashes[k : k + width] for k in range(151, 151 + 60)])
        lo, hi = shard.find(shard.numbers(pattern.ravel()).reshape(pattern.shape))
        for p, a, b in zip(pattern, lo, hi, strict=True):
            places = [k + r for r in range(4) for k in range(first[r], first[r + 1] - width + 1) if (hashes[k : k + width] == p).all()]
            assert sorted(shard.sa[a:b].tolist()) == places


def test_a_text_of_very_many_different_words():
    n = (1 << 21) + 10
    shard = decontam.Shard(np.arange(1, n + 1, dtype=np.uint64), np.array([0, n]))
    block = decontam.Block(["x"], np.arange(n - 19, n + 1, dtype=np.uint64), np.array([0, 20]), 13)
    ((width, number, at, places, _, first),) = decontam.found_windows(shard, block)
    assert width == 13 and sorted(at.tolist()) == list(range(n - 20, n - 12)) and len(set(number.tolist())) == 8 == len(first) - 1
    assert sorted((places[first[k]], a) for k, a in zip(number.tolist(), at.tolist(), strict=True)) == list(zip(range(8), range(n - 20, n - 12), strict=True))
