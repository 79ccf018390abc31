"""The chunk index: Parquet builds under one folder and a manifest that is written last.

A build goes to a folder of its own. The collection's pointer file names the current build and holds its manifest; it is replaced by a
rename, so readers see the old index or the new one, and a broken build leaves the old one as it was, marked by no complete manifest.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import identity as I
from lodestone.operators import chunking
from lodestone.operators.retrieval import Embedder, ShaEmbedder, embed
from lodestone.sources import corpus
from lodestone.sources.config import Profile, Settings
from lodestone.sources.storage import Place, written


class IndexBuildError(RuntimeError):
    """A build did not complete; the index stays marked as incomplete."""


@dataclass
class Index:
    """A collection under a folder of any file system that Spark knows."""

    spark: SparkSession
    folder: str | Path
    collection: str = "rag_collection"

    @property
    def place(self) -> Place:
        return Place(self.spark, self.folder)

    @property
    def pointer(self) -> Place:
        return self.place / f"{self.collection}.json"

    def stored(self) -> dict:
        return json.loads(self.pointer.read_text()) if self.pointer.exists() else {}

    def manifest(self) -> dict | None:
        return I.from_manifest(self.stored())

    def chunks(self) -> DataFrame | None:
        build = self.stored().get("build")
        return self.spark.read.parquet(str(self.place / build)) if build and (self.place / build).exists() else None

    def count(self) -> int:
        rows = self.chunks()
        return 0 if rows is None else rows.count()

    def point(self, content: dict) -> None:
        self.pointer.write_text(json.dumps(content))

    def stats(self) -> dict:
        found = self.manifest() or {}
        return {"collection": self.collection, "chunks": self.count(), "state": found.get("state"), "embedding_model": found.get("embedding_model")}


def identity_of(sources: DataFrame, settings: Settings, profile: Profile) -> I.IndexIdentity:
    return I.IndexIdentity(
        **{name: getattr(settings, name) for name in ("corpus_version", "embedding_model", "chunk_size", "chunk_overlap", "min_chunk_len")},
        embedding_endpoint=I.endpoint_identity(settings.embedding_endpoint),
        corpus_fingerprint=corpus.fingerprint(sources),
        profile_fingerprint=I.fingerprint(profile.chunking_identity()),
    )


#: What a vector depends on beside its text; a new corpus version is the way to have all texts embedded again.
VECTOR_FIELDS = ("embedding_model", "embedding_endpoint", "corpus_version")


def same_vectors(expected: I.IndexIdentity, stored: dict) -> bool:
    """Whether stored vectors, of the last build or of the one before a broken one, are what the model would give now."""
    prefix = I.PREFIX if stored.get("build") else "previous_"
    return all(stored.get(f"{prefix}{k}") == getattr(expected, k) for k in VECTOR_FIELDS)


def known_vectors(index: Index, build: str) -> DataFrame | None:
    """text_hash and embedding of the different texts of a build; None where it is gone."""
    if not (index.place / build).exists():
        return None
    rows = index.spark.read.parquet(str(index.place / build)).where("embedding is not null")
    return rows.groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.first("embedding").alias("embedding"))


def write_vectors(chunks: DataFrame, known: DataFrame | None, provider: Embedder, settings: Settings, target: str) -> int:
    """Write chunks with their vectors; returns how many were embedded: those whose text has no known vector, in batches of their own."""
    hashed = chunks.withColumn("text_hash", F.sha2("text", 256))
    found = written(hashed.join(known, "text_hash", "left"), "matched") if known is not None else hashed.withColumn("embedding", F.lit(None).cast("array<double>"))
    new = found.where("embedding is null").drop("text_hash", "embedding")
    embed(new, provider, batch=settings.embed_batch, attempts=settings.embed_attempts).write.parquet(target)
    if known is not None:
        found.where("embedding is not null").select(*chunks.columns, "embedding").write.mode("append").parquet(target)
    return new.count()


def ensure_index(index: Index, sources: DataFrame, settings: Settings = Settings(), profile: Profile = Profile(), provider: Embedder | None = None) -> list[str]:
    """Reuse the index if its manifest fits, else build it anew; returns the reasons for the build (none: reused).

    Chunks are made, and found not to be empty, before anything stored is touched. Vectors of texts that the last build has too, made for the same corpus version by the same model at the same endpoint, are
    kept; only new texts are embedded (stored()["embedded"] says how many).
    """
    expected = identity_of(sources, settings, profile)
    reasons = I.index_problems(expected, index.stored(), index.count())
    if not reasons:
        return []
    build = f"{index.collection}-{uuid.uuid4().hex}"
    staged, target = index.place / f"{build}.chunks", index.place / build
    chunking.with_ids(chunking.chunk_documents(sources, profile, settings.chunk_size, settings.chunk_overlap, settings.min_chunk_len)).write.parquet(str(staged))
    try:
        chunks = index.spark.read.parquet(str(staged))
        rows = chunks.count()
        found = chunking.summary(chunks).first()
        for total, when in ((found["before_total"], "no chunks"), (found["after_total"], "no chunks that the hard limit leaves")):
            if not total:
                raise IndexBuildError(f"the corpus gives {when}")
        stored = index.stored()
        old = stored.get("build") or stored.get("previous")
        known = known_vectors(index, old) if old and same_vectors(expected, stored) else None
        index.point(I.to_manifest(expected, I.INCOMPLETE, rows) | {"build": None, "previous": old} | {f"previous_{k}": stored.get(f"{I.PREFIX}{k}") if stored.get("build") else stored.get(f"previous_{k}") for k in VECTOR_FIELDS})
        try:
            embedded = write_vectors(chunks, known, provider or ShaEmbedder(), settings, str(target))
            written = index.spark.read.parquet(str(target)).count()
            if written != rows:
                raise IndexBuildError(f"{written} of {rows} chunks were stored")
        except Exception as e:
            target.remove()
            raise e if isinstance(e, IndexBuildError) else IndexBuildError(f"the build did not complete: {type(e).__name__}") from e
        index.point(I.to_manifest(expected, I.COMPLETE, rows) | {"build": build, "embedded": embedded})
        if old:
            (index.place / old).remove()
    finally:
        staged.remove()
    return reasons


def problems_table(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """The comparison as a join: field, was, now of the fields (name, value) that differ or are missing."""
    e, s = expected.select(F.col("name"), F.col("value").alias("now")), stored.select(F.col("name"), F.col("value").alias("was"))
    return e.join(s, "name", "full_outer").where(~F.col("was").eqNullSafe(F.col("now"))).select("name", "was", "now")
