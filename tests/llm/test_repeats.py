"""Repeated passages against brute force, and hashes of spans that are alike in structure."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import anchors, bpe, decontam, ngram_join, pretokens, queries, vec


def slow_rows(docs: list[tuple[int | None, str | None]], window: int) -> list[tuple]:
    """Every window in a dictionary with its smallest doc_id."""
    words = [(t or "").encode().split() for _, t in docs]
    first: dict[tuple, int] = {}
    for (i, _), w in zip(docs, words, strict=True):
        for k in range(len(w) - window + 1 if i is not None else 0):
            s = tuple(w[k : k + window])
            first[s] = min(i, first.get(s, i))
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = set()
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


def passages(rng: random.Random) -> list[tuple[int | None, str | None]]:
    """Documents of shared passages of all lengths around a window, some twice in one document, with rows without id or text and repeated ids."""
    stock = [" ".join(rng.choice("abcdeé") for _ in range(rng.randrange(5, 40))) for _ in range(12)]
    docs: list[tuple[int | None, str | None]] = [(None, stock[0]), (3, None), (4, ""), (5, " \n"), (6, "a\x1cb " * 20), (7, "a\x1cb " * 20), (7, "a\x1cb " * 20)]
    for i in range(80):
        parts = [rng.choice(stock) if rng.random() < 0.6 else " ".join(str(rng.randrange(50)) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(6))]
        docs.append((rng.choice([i, i, 1000 - i, 9]), rng.choice([" ", "\n", "\t "]).join(parts)))
    return docs + [(i, " ".join(stock)) for i in range(2000, 2040)]


@pytest.mark.parametrize(("window", "slice_bytes", "bucket_bytes"), [(13, 8 << 20, 32 << 20), (13, 400, 700), (5, 2000, 500), (1, 1000, 1000), (26, 500, 5000)])
def test_repeats_equal_brute_force(spark, window, slice_bytes, bucket_bytes):
    docs = passages(random.Random(window))
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, Kept2 string").repartition(5)
    found = anchors.scan(frame, window, slice_bytes, bucket_bytes)
    assert found.columns == ["doc_id", "text", "Kept2", "n_words", "n_removed", "kept"]
    assert sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_removed", "kept").collect()), key=repr) == slow_rows(docs, window)


def test_repeats_of_odd_tables(spark):
    docs = spark.createDataFrame([(2, "w " * 13, 7, "s"), (1, "w " * 13, 8, "s")], "doc_id long, text string, kept int, _slice string")
    rows = {r["doc_id"]: r for r in anchors.scan(docs).collect()}
    assert (rows[1]["kept"], rows[2]["kept"], rows[2]["n_removed"], rows[2]["_slice"]) == ("w " * 12 + "w", "", 13, "s")
    assert anchors.scan(docs.limit(0)).count() == 0
    long = " ".join(str(i) for i in range(60_000))
    rows = {r["doc_id"]: r for r in anchors.scan(spark.createDataFrame([(1, long), (2, "x " + long + " y")], "doc_id long, text string")).collect()}
    assert (rows[1]["n_removed"], rows[2]["n_removed"], rows[2]["kept"]) == (0, 60_000, "x y")


def test_covers_meet_at_every_shift():
    for period, cover in anchors.COVERS.items():
        assert all(any((i + t) % period in cover and (j + t) % period in cover for t in range(period)) for i in range(period) for j in range(period))
    assert anchors.cover_of(13) == (7, (0, 1, 3))


def thue_morse(n: int) -> tuple[str, str]:
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_hashes_of_spans():
    for n in (1, 8, 64, 512, 2048):
        data = np.frombuffer("".join(thue_morse(n)).encode(), np.uint8)
        h = vec.span_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
        assert h[0] != h[1]
    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, 5000).astype(np.uint8)
    a = rng.integers(0, 4000, 20_000)
    size = rng.integers(0, 12, 20_000)
    by_bytes: dict[bytes, int] = {}
    for i, (s, h) in enumerate(zip(a.tolist(), vec.span_hashes(data, a, a + size).tolist(), strict=True)):
        assert by_bytes.setdefault(data[s : s + size[i]].tobytes(), h) == h
    assert len(set(by_bytes.values())) == len(by_bytes)
    other = data[::-1].copy()
    b = rng.integers(0, 4000, 20_000)
    same = vec.equal_spans(data, a, other, b, size)
    assert same.tolist() == [data[s : s + n].tobytes() == other[t : t + n].tobytes() for s, t, n in zip(a, b, size, strict=True)]


def test_pieces_with_one_hash_are_told_apart():
    """A hash of the length alone makes all pieces of a length collide; ids are still each piece's own."""
    words = pretokens.WordIds(lambda pieces: [list(p) for p in pieces], bits=6, keys=lambda data, a, b: (b - a).astype(np.uint64))
    rng = np.random.default_rng(2)
    for _ in range(20):
        data = rng.integers(0, 4, 300).astype(np.uint8)
        starts = np.unique(np.concatenate([[0, 300], rng.integers(0, 300, 90)]))
        ids, sizes = words(data, starts)
        assert ids.tolist() == data.tolist() and sizes.tolist() == np.diff(starts).tolist()


def test_texts_of_like_structure_in_the_operators(spark):
    import tokenizers

    one, two = thue_morse(2048)
    docs = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string").coalesce(1)
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    rows = {r["doc_id"]: r for r in bpe.encode(docs, queries.tokenizer_path()).collect()}
    assert all(rows[i]["ids"] == library.encode(t, add_special_tokens=False).ids and rows[i]["decoded"] == t for i, t in ((1, one), (2, two), (3, one)))
    benchmark = spark.createDataFrame([("x", one)], "item_id string, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontam.digests(docs, benchmark).collect()} == {1: 1, 2: 0, 3: 1}
    assert {r["doc_id"]: r["class_id"] for r in ngram_join.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
    assert anchors.scan(docs, 1).where("n_removed > 0").select("doc_id").collect() == [(3,)]


def test_slices_do_not_depend_on_the_order_of_rows():
    table = pa.table({"doc_id": pa.array([5, None, 2]), "text": pa.array(["a b c " * 9, "x " * 30, "b c a " * 9])})
    made = []
    for order in ([0, 1, 2], [2, 1, 0]):
        part = anchors.Slice(table.take(order), 13)
        part.anchors()
        part.windows()
        made.append((part.anchor.tolist(), part.a.tolist(), part.least.tolist(), part.extended(np.ones(len(part.anchor), bool)).tolist()))
    assert made[0] == made[1]


def test_sql_of_repeats_counts_like_the_query(spark):
    found = queries.QUERIES["op11_substring_dedup"](spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert found.where(F.col("n_removed") > 0).count() > 5
