"""A training corpus made from `documents`: five stages, each an operator of lodestone.llm.

toxicity         documents that the classifier rejects go
line_dedup       lines that repeat an earlier one (Jaccard of words 0.8 or more) go; all documents stay
ngram_jaccard    one document of each near-duplicate group (5-word n-grams, Jaccard 0.8 or more) stays
decontamination  documents with a twentieth of their words or more inside benchmark windows go
bpe              the documents that are left, encoded

Each function takes (spark, docs, sf_dir); docs is what the stage before it kept, read from Parquet. All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontam, linededup, ngram_join, queries, shared, toxicity
from lodestone.runtime import query


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Labels are learned from the rows of the training fold alone; rejected: a probability of 0.5 or more."""
    model = toxicity.train(docs.where(queries.fold(5) != 0), shared.documents(spark, sf_dir, "labels").where(queries.fold(5) != 0))
    name = shared.fresh(docs, "_toxicity")
    return toxicity.score(docs, model, name).where(F.col(name) < 0.5).select(*(f"`{c}`" for c in docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, shared.documents(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, ids, and whether decoding the ids gives the text again."""
    found = bpe.encode(docs.withColumn("text", F.coalesce("text", F.lit(""))), queries.tokenizer_path())
    return found.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", query(drop_toxic)),
    ("line_dedup", query(drop_repeated_lines)),
    ("ngram_jaccard", query(drop_near_duplicates)),
    ("decontamination", query(drop_contaminated)),
    ("bpe", query(encode)),
]

#: SQL can express neither the classifier nor the encoder; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage keeps is written to the shared folder and read again."""
    docs = shared.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = shared.table(stage(spark, docs, sf_dir), f"kept-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
