"""A stored exact vector index: vectors clustered around pivots, clusters skipped by the triangle inequality.

Cosine distance d and the chord c between unit vectors go together as c * c = 2 * d, and chords are a metric. A build keeps for each cluster its pivot, its number of
vectors and the greatest and smallest chord from the pivot to one of them. For a query at chord x from a pivot no vector of the cluster is nearer than x - greatest
or smallest - x. A search looks at each query's nearest clusters first, which bounds its k-th distance, and then at the clusters that this bound does not exclude.
Results are those of a full scan, ties included; how many clusters are read depends on how the vectors lie.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.retrieval import query_blocks
from lodestone.sources.storage import Place

#: Vectors of a cluster that a build aims at, and the most clusters: pivots are held by every task.
CLUSTER_ROWS, MOST_CLUSTERS = 4_096, 4_096
#: Chords are compared with some slack for floating point.
SLACK = 1e-6
FOUND = "query_id long, id_num long, distance double"


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chords between the rows of two matrices of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def usable(ids: list, vectors: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of those with a direction: `size` finite numbers that are not all 0."""
    rows = [(i, v) for i, v in zip(ids, vectors, strict=True) if v is not None and len(v) == size and None not in v]
    made = np.array([v for _, v in rows], np.float64).reshape(len(rows), size)
    norm = np.linalg.norm(made, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return np.array([i for i, _ in rows], np.int64)[good], made[good]


@dataclass
class Clusters:
    """What a search knows without reading vectors; rows go by cluster number."""

    pivots: np.ndarray
    counts: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least chord from each query to a vector of each cluster, greatest chord)."""
        x = chord(unit(queries), self.pivots)
        return np.maximum(np.maximum(x - self.farthest, self.nearest - x), 0), x + self.farthest


@dataclass
class Search:
    """query_id, rank, id_num, distance of the nearest vectors, and which clusters were read for them."""

    found: DataFrame
    read: set[int] = field(default_factory=set)
    clusters: int = 0


class VectorIndex:
    """Builds under a folder of any file system that Spark knows; a pointer file names the current one."""

    def __init__(self, spark: SparkSession, folder: str | Path):
        self.spark, self.place = spark, Place(spark, folder)

    @property
    def pointer(self) -> Place:
        return self.place / "vectors.json"

    def build(self, vectors: DataFrame, clusters: int | None = None) -> int:
        """Store vectors(id_num, embedding) anew; returns the number of clusters.

        Pivots are different vectors of those with the smallest hashes of their ids, a sample of twice the number of clusters at most. Vectors of other lengths than the first pivot's, null ones and those without a
        direction are left out, as a search leaves them out. Nothing that is stored is touched before the new build is whole.
        """
        rows = vectors.select(F.col("id_num").cast("long").alias("id_num"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null and size(embedding) > 0 and id_num is not null")
        wanted = clusters or min(MOST_CLUSTERS, max(1, math.ceil(rows.count() / CLUSTER_ROWS)))
        sample = rows.orderBy(F.xxhash64("id_num"), "id_num").limit(2 * wanted).toPandas()  # bounded by MOST_CLUSTERS
        size = len(sample.embedding.iloc[0]) if len(sample) else 0
        _, chosen = usable(sample.id_num.tolist(), [list(v) for v in sample.embedding], size) if size else (None, np.zeros((0, 0)))
        pivots = pd.DataFrame(unit(chosen)).drop_duplicates().to_numpy()[:wanted] if len(chosen) else np.zeros((0, size))
        build = f"vectors-{uuid.uuid4().hex}"
        target = self.place / build

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, found = usable(batch.column(0).to_pylist(), batch.column(1).to_pylist(), size)
                for at in range(0, len(ids), 4096):
                    part = found[at : at + 4096]
                    x = chord(unit(part), pivots)
                    near = x.argmin(1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[at : at + 4096]), pa.array(list(part), pa.list_(pa.float64())), pa.array(x[np.arange(len(near)), near]), pa.array(near.astype(np.int32))],
                        ["id_num", "embedding", "chord", "cluster"],
                    )

        schema = "id_num long, embedding array<double>, chord double, cluster int"
        placed = rows.mapInArrow(assign, schema) if len(pivots) else self.spark.createDataFrame([], schema)
        # a cluster of very many vectors goes to several files, each written by one task
        dealt = placed.repartition(F.col("cluster"), F.pmod(F.xxhash64("id_num"), F.lit(8)))
        dealt.write.partitionBy("cluster").parquet(str(target))
        stored = self._read(build)
        sizes = {r["cluster"]: (r["n"], r["a"], r["b"]) for r in stored.groupBy("cluster").agg(F.count("*").alias("n"), F.min("chord").alias("a"), F.max("chord").alias("b")).collect()} if len(pivots) else {}
        old = self._stored().get("build")
        listed = [{"pivot": p.tolist(), "count": sizes.get(k, (0, 0, 0))[0], "nearest": sizes.get(k, (0, 0, 0))[1], "farthest": sizes.get(k, (0, 0, 0))[2]} for k, p in enumerate(pivots)]
        self.pointer.write_text(json.dumps({"build": build, "size": size, "clusters": listed}))
        if old:
            (self.place / old).remove()
        return len(listed)

    def _stored(self) -> dict:
        return json.loads(self.pointer.read_text()) if self.pointer.exists() else {}

    def _read(self, build: str) -> DataFrame:
        return self.spark.read.schema("id_num long, embedding array<double>, chord double, cluster int").parquet(str(self.place / build))

    def clusters(self) -> Clusters:
        listed = self._stored().get("clusters", [])
        return Clusters(np.array([c["pivot"] for c in listed], np.float64), *(np.array([c[k] for c in listed]) for k in ("count", "nearest", "farthest")))

    def _near(self, wanted: Mapping[int, np.ndarray], ids: np.ndarray, queries: np.ndarray, most: int, digits: int) -> DataFrame:
        """FOUND rows of the clusters `wanted` (numbers of the queries of each): a task's nearest `most` of a query. Other clusters are not read."""
        build, size = self._stored()["build"], queries.shape[1]
        directions = unit(queries)

        def best(found: pd.DataFrame) -> pd.DataFrame:
            return found.sort_values(["query_id", "distance", "id_num"]).groupby("query_id", sort=False).head(most)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = None
            for batch in batches:
                cluster = batch.column(2).to_numpy()
                for c in np.unique(cluster).tolist():
                    part = batch.filter(pa.array(cluster == c))
                    numbers, vectors = usable(part.column(0).to_pylist(), part.column(1).to_pylist(), size)
                    asking = wanted[c]
                    for at in range(0, len(numbers), 1024):
                        d = np.round(1 - unit(vectors[at : at + 1024]) @ directions[asking].T, digits)
                        number = numbers[at : at + 1024]
                        if len(number) > most:
                            limit = np.partition(d, most - 1, axis=0)[most - 1]
                            r, q = np.nonzero(d <= limit)  # ties of the last place stay
                        else:
                            r, q = np.indices(d.shape).reshape(2, -1)
                        found = pd.DataFrame({"query_id": ids[asking][q], "id_num": number[r], "distance": d[r, q]})
                        kept = best(found if kept is None else pd.concat([kept, found]))
            if kept is not None:
                yield pa.RecordBatch.from_pandas(kept, preserve_index=False)

        rows = self._read(build).where(F.col("cluster").isin(sorted(wanted))).select("id_num", "embedding", "cluster")
        return rows.mapInArrow(run, FOUND)

    def search(self, queries: DataFrame, k: int = 10, exclude_self: bool = False, digits: int = 6) -> Search:
        """The k nearest vectors of each query (query_id, embedding), as operators.retrieval.top_k finds them; ties by id_num."""
        known, size = self.clusters(), self._stored().get("size", 0)
        most, out, read = k + exclude_self, None, set()
        for rows in query_blocks(queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))):
            ids, vectors = usable([q for q, _ in rows], [list(v) for _, v in rows], size) if size else (np.zeros(0, np.int64), None)
            if not len(ids):
                continue
            low, high = known.bounds(vectors)
            full = np.flatnonzero(known.counts > 0)
            first: dict[int, list[int]] = {}
            for q in range(len(ids)):  # clusters in the order of their greatest chord, until they hold enough
                order = full[np.argsort(high[q, full], kind="stable")]
                enough = int(np.searchsorted(np.cumsum(known.counts[order]), most)) + 1
                for c in order[:enough].tolist():
                    first.setdefault(c, []).append(q)
            begun = self._near({c: np.array(q) for c, q in first.items()}, ids, vectors, most, digits)
            nth = begun.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id_num"))).where(F.col("n") == most)
            reached = dict(nth.select("query_id", "distance").collect())  # a number for each query of the block
            limit = np.array([math.sqrt(2 * (reached[i] + 10.0**-digits)) + SLACK if i in reached else math.inf for i in ids.tolist()])
            wanted = {int(c): np.flatnonzero(low[:, c] <= limit) for c in full}
            wanted = {c: q for c, q in wanted.items() if len(q)}
            read |= set(first) | set(wanted)
            near = self._near(wanted, ids, vectors, most, digits)
            out = near if out is None else out.unionByName(near)
        if out is None:
            return Search(self.spark.createDataFrame([], "query_id long, rank int, id_num long, distance double"), read, len(known.counts))
        if exclude_self:
            out = out.where("query_id <> id_num")
        order = Window.partitionBy("query_id").orderBy("distance", "id_num")
        ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id_num", "distance")
        return Search(ranked, read, len(known.counts))
