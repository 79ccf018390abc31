"""The vector index against full scans, the buckets of the cache, and index builds that keep vectors."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval as R
from lodestone.sources import cache as K
from lodestone.sources import corpus
from lodestone.sources.config import Settings
from lodestone.sources.index import Index, IndexBuildError, ensure_index
from lodestone.sources.vectors import VectorIndex


def clustered(rng, n: int, groups: int, spread: float) -> list[list[float]]:
    centres = rng.normal(size=(groups, 12))
    return (centres[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, 12))).tolist()


@pytest.mark.parametrize(("spread", "clusters"), [(0.05, 24), (1.0, 8), (0.0, 5), (0.05, 1)])
def test_vector_index_equals_a_full_scan(spark, tmp_path, spread, clusters):
    rng = np.random.default_rng(int(100 * spread) + clusters)
    vectors = clustered(rng, 600, 20, spread)
    rows = [(i, v) for i, v in enumerate(vectors)] + [(700 + i, vectors[i]) for i in range(30)] + [(900, None), (901, [0.0] * 12), (902, [1.0] * 5), (903, [float("nan")] * 12)]
    frame = spark.createDataFrame(rows, "id_num long, embedding array<double>").repartition(4)
    queries = spark.createDataFrame([(i, vectors[i]) for i in range(0, 600, 40)] + [(2000, rng.normal(size=12).tolist()), (2001, None)], "query_id long, embedding array<double>")
    index = VectorIndex(spark, tmp_path / "v")
    assert index.build(frame, clusters) <= clusters
    for k, alone in ((5, True), (1, False), (40, True)):
        found = index.search(queries, k, alone)
        assert sorted(map(tuple, found.found.collect())) == sorted(map(tuple, R.top_k(queries, frame, k, alone).collect()))
        assert found.read <= set(range(found.clusters))
    if spread == 0.05 and clusters > 1:
        near = queries.where("query_id = 40")
        found = index.search(near, 3)
        assert 0 < len(found.read) < found.clusters / 2
        plan = found.found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "cluster" in plan.split("PartitionFilters: [")[1][:200]
    before = index._stored()["build"]
    index.build(frame.limit(50), 3)
    assert index._stored()["build"] != before and not (index.place / before).exists() and index.search(queries, 100).found.where("query_id = 40").count() <= 50


def test_empty_vector_index(spark, tmp_path):
    index = VectorIndex(spark, tmp_path / "v")
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<double>")
    assert index.search(queries, 3).found.count() == 0
    assert index.build(spark.createDataFrame([], "id_num long, embedding array<double>")) == 0
    assert index.search(queries, 3).found.count() == 0
    index.build(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id_num long, embedding array<double>"))
    assert [tuple(r) for r in index.search(queries, 3).found.orderBy("rank").collect()] == [(1, 1, 2, 0.105573), (1, 2, 1, 0.552786)]


def cached(spark, folder) -> K.AnswerCache:
    return K.AnswerCache(spark, folder, "f")


def test_cache_reads_the_buckets_asked_for(spark, tmp_path):
    cache = cached(spark, tmp_path / "c")
    schema = f"query string, answer string, context {K.CONTEXT}"
    many = spark.createDataFrame([(f"question {i}", f"a{i}", []) for i in range(400)], schema)
    cache.store(many)
    cache.store(spark.createDataFrame([("question 7", "newer", [])], schema))
    asked = spark.createDataFrame([(1, "Question 7?"), (2, "question 8"), (3, "nothing")], "query_id long, query string")
    hits = {r.query_id: r.cached_answer for r in cache.lookup(asked).collect()}
    assert hits == {1: "newer", 2: "a8", 3: None}
    files = cache.asked_rows(asked.withColumn("query_hash", cache.key(F.col("query"))))
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters: [")[1][:120]
    read = files.select(F.input_file_name().alias("f")).distinct().count()
    assert read <= 4 and cache.rows().select("bucket").distinct().count() > 100
    assert cache.rows().count() == 401 and cache.compact() == 400 and cache.rows().count() == 400
    assert {r.query_id: r.cached_answer for r in cache.lookup(asked).collect()} == hits
    cache.store(spark.createDataFrame([("nothing", "now", [])], schema))
    assert {r.query_id: r.cached_answer for r in cached(spark, tmp_path / "c").lookup(asked).collect()} == hits | {3: "now"}
    assert len(cache.place.children()) == 2  # the generation and its pointer
    cache.clear()
    assert cache.rows().count() == 0 and cache.compact() == 0


class Counting(R.ShaEmbedder):
    """Counts the texts it embeds, in a file of each call."""

    def __init__(self, folder, broken: str | None = None):
        self.folder, self.broken = str(folder), broken

    def embed(self, texts):
        import pathlib
        import uuid

        if self.broken and any(self.broken in t for t in texts):
            raise ValueError("no")
        pathlib.Path(self.folder, uuid.uuid4().hex).write_text(str(len(texts)))
        return super().embed(texts)

    def count(self) -> int:
        import pathlib

        files = list(pathlib.Path(self.folder).iterdir())
        total = sum(int(f.read_text()) for f in files)
        for f in files:
            f.unlink()
        return total


def test_builds_keep_vectors_of_unchanged_texts(spark, tmp_path):
    (tmp_path / "n").mkdir()
    provider = Counting(tmp_path / "n")
    settings = Settings(chunk_size=200, chunk_overlap=40, min_chunk_len=20)

    def sources(*texts):
        for i, t in enumerate(texts):
            (tmp_path / f"{i}.txt").write_text(t)
        (tmp_path / "m.json").write_text(json.dumps({"entries": [{"path": f"{i}.txt", "source": f"s{i}", "source_display": f"S{i}"} for i in range(len(texts))]}))
        return corpus.read_sources(spark, tmp_path / "m.json")

    first = "".join(f"Clause {i} says something of weight. " for i in range(40))
    second = "".join(f"Rule {i} holds for all of them. " for i in range(30))
    index = Index(spark, tmp_path / "index")
    ensure_index(index, sources(first), settings, provider=provider)
    n = index.count()
    assert provider.count() == n == index.stored()["embedded"] > 5
    ensure_index(index, sources(first, second), settings, provider=provider)
    added = index.count() - n
    assert provider.count() == added == index.stored()["embedded"] > 3
    assert len(index.place.children()) == 2
    # equal to a build from nothing
    fresh = Index(spark, tmp_path / "fresh")
    ensure_index(fresh, sources(first, second), settings, provider=provider)
    columns = sorted(fresh.chunks().columns)
    assert sorted(map(str, index.chunks().select(columns).collect())) == sorted(map(str, fresh.chunks().select(columns).collect()))
    provider.count()
    # a broken build leaves its predecessor's vectors to the next one
    third = "A new clause that breaks the model. " * 3
    with pytest.raises(IndexBuildError):
        ensure_index(index, sources(first, second, third), settings, provider=Counting(tmp_path / "n", "breaks"))
    provider.count()
    ensure_index(index, sources(first, second, third), settings, provider=provider)
    assert provider.count() == index.stored()["embedded"] == index.count() - n - added > 0
    # another model's vectors are never kept
    ensure_index(index, sources(first, second, third), Settings(chunk_size=200, chunk_overlap=40, min_chunk_len=20, embedding_model="other"), provider=provider)
    assert provider.count() == index.count() == index.stored()["embedded"]
