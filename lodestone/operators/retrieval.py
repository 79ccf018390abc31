"""Embedding, exact cosine top-k and context selection."""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

#: Queries that one pass over the chunks takes along; more are worked off in as many passes.
QUERY_BLOCK = 4_096
#: Vectors and queries whose distances a task works out at a time.
ROWS, COLUMNS = 1_024, 512


class ProviderError(RuntimeError):
    """An embedding or chat call failed for good; the text has no credentials in it."""


class Retryable(Exception):
    """A connection or time-out error that a provider wants to see tried again."""


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[tuple[int, list[float]]]:
        """(index in texts, vector) in any order."""


class ShaEmbedder:
    """The offline default; equal to functions.text.sha_embedding."""

    def embed(self, texts: list[str]) -> list[tuple[int, list[float]]]:
        return [(i, [(b + 1) / 256 for b in hashlib.sha256(t.encode()).digest()[:8]]) for i, t in enumerate(texts)]


def embed_batch(provider: Embedder, texts: list[str], attempts: int = 5, sleep=time.sleep) -> list[list[float]]:
    for k in range(attempts):
        try:
            found = dict(provider.embed(texts))
            return [found[i] for i in range(len(texts))]
        except Retryable as e:
            if k + 1 == attempts:
                raise ProviderError(f"no embeddings after {attempts} attempts: {type(e).__name__}") from e
            sleep(min(30, 2**k))
    raise ProviderError("no attempts allowed")


def embed(rows: DataFrame, provider: Embedder, text: str = "text", batch: int = 16, attempts: int = 5) -> DataFrame:
    """rows with an embedding column; batches of texts go to the provider in each task."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("embedding").schema.fields), "embedding array<double>"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part[text].fillna("").tolist()
            yield part.assign(embedding=[v for i in range(0, len(texts), batch) for v in embed_batch(provider, texts[i : i + batch], attempts)])

    return rows.drop("embedding").mapInPandas(run, schema)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if either vector is null or zero, or the lengths differ."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), 1 - dot(a, b) / size)


def distances(chunks: DataFrame, queries: list[tuple[int, list[float]]], most: int | None, digits: int = 6) -> DataFrame:
    """query_id, id_num, distance of chunks(id_num, embedding) to each query; with `most`, each task's nearest so many of a query.

    A task multiplies ROWS vectors with COLUMNS queries at a time and keeps the best of each query, so what it holds and passes on does not
    grow with its rows, and with the queries by a few numbers each. Rows without a usable vector are left out.
    """
    ids = np.array([q for q, _ in queries], np.int64)
    matrix = np.array([v for _, v in queries], np.float64)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first query, ids, distances) of vectors and queries."""
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = [(i, v) for i, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if v is not None and len(v) == matrix.shape[1]]
                if not rows:
                    continue
                vectors = np.array([v for _, v in rows], np.float64)
                norm = np.linalg.norm(vectors, axis=1)
                good = np.isfinite(norm) & (norm > 0)
                number = np.array([i for i, _ in rows], np.int64)[good]
                unit = vectors[good] / norm[good][:, None]
                for q in range(0, len(ids), COLUMNS):
                    yield q, number, np.round(1 - unit @ matrix[q : q + COLUMNS].T, digits)

    def record(query: np.ndarray, number: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(number), pa.array(distance)], ["query_id", "id_num", "distance"])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, number, d in tiles(batches):
            r, c = np.indices(d.shape).reshape(2, -1)
            yield record(c + q, number[r], d.ravel())

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the nearest so many of each query so far, in order of distance and id, and how many there are
        near, who, have = np.full((len(ids), most), np.inf), np.zeros((len(ids), most), np.int64), np.zeros(len(ids), np.int64)
        for q, number, d in tiles(batches):
            own = slice(q, q + d.shape[1])
            last, last_id, full = near[own, -1], who[own, -1], have[own] == most
            limit = np.where(full, last, np.inf)
            if not full.all() and len(number) > most:
                limit = np.minimum(limit, np.partition(d, most - 1, axis=0)[most - 1])
            r, c = np.nonzero(d <= limit)  # ties of the last place stay
            closer = ~full[c] | (d[r, c] < last[c]) | (number[r] < last_id[c])
            r, c = r[closer], c[closer]
            if not len(r):
                continue
            changed = np.unique(c)
            old_c, old_k = np.nonzero(np.arange(most) < have[own][changed][:, None])
            old_c = changed[old_c]
            column = np.concatenate([old_c, c])
            distance = np.concatenate([near[own][old_c, old_k], d[r, c]])
            owner = np.concatenate([who[own][old_c, old_k], number[r]])
            order = np.lexsort((owner, distance, column))
            column, distance, owner = column[order], distance[order], owner[order]
            place = np.arange(len(column)) - np.searchsorted(column, column)
            kept = place < most
            near[q + column[kept], place[kept]], who[q + column[kept], place[kept]] = distance[kept], owner[kept]
            have[q + changed] = np.minimum(np.bincount(column, minlength=d.shape[1])[changed], most)
        for q in range(0, len(ids), COLUMNS):
            c, k = np.nonzero(np.arange(most) < have[q : q + COLUMNS][:, None])
            if len(c):
                yield record(c + q, who[q + c, k], near[q + c, k])

    run = every if most is None else best
    return chunks.select(F.col("id_num").cast("long").alias("id_num"), "embedding").mapInArrow(run, "query_id long, id_num long, distance double")


def query_blocks(queries: DataFrame) -> Iterator[list[tuple[int, list[float]]]]:
    """The queries with a vector, about QUERY_BLOCK at a time."""
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        if rows := [(r["query_id"], r["embedding"]) for r in part.select("query_id", "embedding").where("embedding is not null").collect()]:
            yield rows


def all_distances(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, id_num, distance of every query to every chunk, a block of queries in each pass over the chunks."""
    out = None
    for rows in query_blocks(queries):
        near = distances(chunks, rows, None)
        out = near if out is None else out.unionByName(near)
    return queries.sparkSession.createDataFrame([], "query_id long, id_num long, distance double") if out is None else out


def top_k(queries: DataFrame, chunks: DataFrame, k: int = 10, exclude_self: bool = False, digits: int = 6) -> DataFrame:
    """query_id, rank (from 1), id_num, distance: the k nearest chunks of each query (query_id, embedding); ties by id_num."""
    out = None
    for rows in query_blocks(queries):
        near = distances(chunks, rows, k + exclude_self, digits)
        out = near if out is None else out.unionByName(near)
    if out is None:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, id_num long, distance double")
    if exclude_self:
        out = out.where("query_id <> id_num")
    order = Window.partitionBy("query_id").orderBy("distance", "id_num")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id_num", "distance")


def select_context(hits: DataFrame, max_distance: float = 0.44, final_top_k: int = 5, composed: bool = False) -> DataFrame:
    """The hits (query_id, rank, distance, text, ...) that become context, with their number from 1.

    In this order: finite distance of at most max_distance, some text, the best-ranked copy of each content, the first final_top_k.
    Nothing is sorted anew and nothing filled up.
    """
    valid = hits.withColumn("distance", T.finite(F.col("distance"))).where(F.col("distance") <= max_distance)
    keyed = valid.withColumn("content_key", T.content_key(F.col("text"), composed)).where("content_key is not null")
    first = keyed.withColumn("_copy", F.row_number().over(Window.partitionBy("query_id", "content_key").orderBy("rank"))).where("_copy = 1").drop("_copy")
    return first.withColumn("number", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("number") <= final_top_k)


def context_block(selected: DataFrame) -> DataFrame:
    """query_id, n_context and context: the numbered fragments, one after another."""
    block = T.fragment(F.col("number"), F.col("text"), F.col("source_display"), F.col("source"), F.col("source_kind"), F.col("section_heading"))
    listed = F.sort_array(F.collect_list(F.struct("number", block.alias("block"))))  # final_top_k at most
    return selected.groupBy("query_id").agg(F.count("*").alias("n_context"), F.array_join(F.transform(listed, lambda x: x["block"]), "\n").alias("context"))


def source_cards(selected: DataFrame) -> DataFrame:
    """query_id, number, label, source_kind, doc_type, heading, snippet of each context fragment, numbered as in the prompt."""
    return selected.select(
        "query_id", "number", F.coalesce(T.filled(F.col("source_display"), F.col("source")), F.lit("source not specified")).alias("label"),
        F.coalesce("source_kind", F.lit("")).alias("source_kind"), F.coalesce("doc_type", F.lit("")).alias("doc_type"), F.coalesce("section_heading", F.lit("")).alias("heading"),
        T.snippet(F.col("text"), F.col("header_len").cast("string")).alias("snippet"),
    )
