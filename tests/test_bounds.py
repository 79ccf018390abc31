"""What a task holds follows its slices, not the partition, the length of a text or the number of queries."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunking as C
from lodestone.operators import retrieval as R
from lodestone.sources import cache as K


def test_hard_limit_of_a_long_text(spark):
    """A text of many pieces: columns are repeated for each of them, the text is not."""
    text = "word " * 500_000
    found = C.hard_limit(spark.createDataFrame([(1, text, 3), (2, "short", 3)], "doc_id long, text string, header_len int"), 800, 200)
    rows = found.where("doc_id = 1").orderBy("hard_split_index").collect()
    assert [r.text for r in rows] == C.hard_pieces(text, 800, 200) and [r.header_len for r in rows[:3]] == [3, 0, 0]
    assert [tuple(r) for r in found.where("doc_id = 2").collect()] == [(2, "short", 3, None)]


def test_slices():
    texts = ["x" * (C.SLICE_BYTES + 1), None, *["ab"] * (C.ROWS + 1), "y" * C.SLICE_BYTES, "z"]
    parts = [p.column("text").to_pylist() for p in C.slices(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), "text")]
    assert [t for p in parts for t in p] == texts
    assert all(len(p) <= C.ROWS and (len(p) == 1 or sum(len(t or "") for t in p) <= C.SLICE_BYTES) for p in parts) and len(parts) == 5
    assert not [*C.slices(pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["text"]), "text")]


class Captured:
    """Stands for a DataFrame and keeps the function of its task."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def batches_of(vectors: np.ndarray, rows: int) -> list[pa.RecordBatch]:
    return [pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(v))), pa.array(v.tolist())], ["id_num", "embedding"]) for at in range(0, len(vectors), rows) for v in [vectors[at : at + rows]]]


@pytest.mark.parametrize("most", [11, None])
def test_memory_of_distances(spark, most):
    """Many queries: a task holds the distances of a tile and not those to all of them."""
    rng = np.random.default_rng(1)
    queries = [(i, v) for i, v in enumerate(rng.random((R.QUERY_BLOCK, 8)).tolist())]
    run = R.distances(Captured(), queries, most).run
    given = batches_of(rng.random((4_096, 8)), 2_048)
    tracemalloc.start()
    n = sum(b.num_rows for b in run(iter(given)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == R.QUERY_BLOCK * (most or 4_096) and peak < 64e6


@pytest.mark.parametrize("rows", [3, 700, 5_000])
def test_nearest_with_ties(spark, rows):
    """More queries than a tile has, vectors of few different values: the nearest by distance and id, whatever the batches."""
    rng = np.random.default_rng(2)
    queries, vectors = rng.integers(1, 4, (R.COLUMNS + 9, 2)).astype(float), rng.integers(1, 4, (3_000, 2)).astype(float)[::-1]
    found = R.distances(Captured(), list(enumerate(queries.tolist())), 5).run(iter(batches_of(vectors, rows)))
    got = sorted((q, i) for b in found for q, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    unit = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (queries, vectors)]
    d = np.round(1 - unit[0] @ unit[1].T, 6)
    assert got == sorted((q, int(i)) for q in range(len(queries)) for i in np.lexsort((np.arange(3_000), d[q]))[:5])


def test_a_look_up_leaves_stored_questions_alone(spark, tmp_path, monkeypatch):
    """Of a cache's rows only what an answer needs is read and merged; a key is worked out once for all that ask."""
    cache, read, keys = K.AnswerCache(spark, tmp_path, "f"), [], []
    monkeypatch.setattr(K, "latest", lambda rows, f=K.latest: (read.append(rows.columns), f(rows))[1])
    monkeypatch.setattr(K, "written", lambda df, name, f=K.written: (keys.append(df.columns), f(df, name))[1], raising=False)
    for answer in ("old", "new"):
        cache.store(spark.createDataFrame([("What  is it?", answer, None)], f"query string, answer string, context {K.CONTEXT}"))
    found = cache.lookup(spark.createDataFrame([(1, "WHAT is\tit"), (2, "Who?"), (3, None)], "query_id long, query string"))
    assert {r.query_id: (r.query, r.cached_answer) for r in found.collect()} == {1: ("WHAT is\tit", "new"), 2: ("Who?", None), 3: (None, None)}
    assert "query" not in read[0] and keys == [["query_hash"]]


def test_squeezed_questions(spark):
    """Every character alone, inside and at both ends: as by the pattern."""
    marks = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([(t,) for m in marks for t in (m, f"a{m}{m}b", f"{m}|a{m}")] + [(None,), ("",), ("|",), ("||",)], "q string")
    assert rows.where(~T.squeeze_nfkc(F.col("q")).eqNullSafe(T.squeeze(T.nfkc(F.col("q"))))).count() == 0


def test_memory_of_the_toxicity_fit(spark):
    """The driver holds ratios of slots that occur, not of all; texts may be Arrow's own buffers."""
    toxicity = pytest.importorskip("lodestone.llm.toxicity")
    texts = [f"{'bad awful' if i % 2 else 'kind and good'} words number {i % 9} ".encode() for i in range(200)]
    labels = np.arange(200) % 2
    model = toxicity.fit(texts, labels)
    tracemalloc.start()
    again = toxicity.fit([pa.scalar(t, pa.binary()).as_buffer() for t in texts], labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 72e6 and np.array_equal(model.slots, again.slots) and np.array_equal(model.weights, again.weights)
    rows = spark.createDataFrame([(i, t.decode(), int(i % 2)) for i, t in enumerate(texts)], "doc_id long, text string, toxic int")
    trained = toxicity.train(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    assert np.array_equal(trained.slots, model.slots) and np.allclose(trained.weights, model.weights)
