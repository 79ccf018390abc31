"""The answer cache: Parquet rows in buckets by the beginning of their key, appended; the latest row of a key counts.

A look-up reads the buckets of the keys that are asked for and no others. Appended files add up until compact() rewrites the rows that count as a new generation; a
pointer file names the generation that is read.
"""

from __future__ import annotations

import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.sources.storage import Place, written

VERSION = 2
#: Hexadecimal digits of a key that name its bucket.
BUCKET_DIGITS = 2
CONTEXT = "array<struct<text string, metadata map<string,string>, id string>>"
SCHEMA = f"query_hash string, query string, answer string, context {CONTEXT}, created_at timestamp, seq long, bucket string"


def latest(rows: DataFrame, key: str = "query_hash") -> DataFrame:
    """One row for each key: the newest by (created_at, seq). An aggregate with partial maxima, so a key with very many rows is no hot task."""
    values = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), F.struct("created_at", "seq")).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in values))


def cache_stats(rows: DataFrame, *by: str) -> DataFrame:
    """entries, oldest, newest of cache rows."""
    return rows.groupBy(*by).agg(F.count("*").alias("entries"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


class AnswerCache:
    """Rows under folder/v{VERSION}; other versions are removed once. Keys carry the fingerprint of all that shapes answers."""

    def __init__(self, spark: SparkSession, folder: str | Path, fingerprint: str):
        if not isinstance(fingerprint, str) or not fingerprint.strip():
            raise ValueError("the cache needs the fingerprint of the answer settings")
        self.spark, self.fingerprint = spark, fingerprint
        place = Place(spark, folder)
        self.place = place / f"v{VERSION}"
        for old in place.children():
            if re.fullmatch(r"v\d+", old.name) and old.name != self.place.name:
                old.remove()

    def key(self, question):
        return T.question_key(question, self.fingerprint)

    @property
    def pointer(self) -> Place:
        return self.place / "generation.txt"

    def generation(self) -> Place:
        return self.place / (self.pointer.read_text() if self.pointer.exists() else "g0")

    def rows(self) -> DataFrame:
        now = self.generation()
        return self.spark.read.schema(SCHEMA).parquet(str(now)) if now.exists() else self.spark.createDataFrame([], SCHEMA)

    def asked_rows(self, keyed: DataFrame) -> DataFrame:
        """Rows whose key is one of keyed.query_hash, read from the buckets of these keys alone (their names come to the driver: 16 ** BUCKET_DIGITS at most)."""
        keys = written(keyed.select("query_hash").distinct(), "asked-keys")  # once: a key takes more work than its row has bytes
        buckets = [r[0] for r in keys.select(F.left("query_hash", F.lit(BUCKET_DIGITS)).alias("b")).distinct().collect()]
        return self.rows().where(F.col("bucket").isin(buckets)).join(keys, "query_hash", "left_semi")

    def lookup(self, questions: DataFrame) -> DataFrame:
        """questions(query_id, query) with query_hash and, on a hit, answer, context and cached_at."""
        keyed = questions.withColumn("query_hash", self.key(F.col("query")))
        # the stored question, which may be long, is not read
        found = latest(self.asked_rows(keyed).select("query_hash", "answer", "context", "created_at", "seq"))
        found = found.select("query_hash", F.col("answer").alias("cached_answer"), F.col("context").alias("cached_context"), F.col("created_at").alias("cached_at"))
        return keyed.join(found, "query_hash", "left")

    def store(self, answers: DataFrame) -> None:
        """answers: query, answer, context. An empty context is stored as null."""
        made = answers.select(self.key(F.col("query")).alias("query_hash"), "query", "answer", F.when(F.size("context") > 0, F.col("context")).cast(CONTEXT).alias("context"), F.current_timestamp().alias("created_at"), F.monotonically_increasing_id().alias("seq"))
        self._write(made.withColumn("bucket", F.left("query_hash", F.lit(BUCKET_DIGITS))), self.generation())

    @staticmethod
    def _write(rows: DataFrame, to: Place) -> None:
        """A bucket's rows are written by one task, so an append adds a file to each bucket at most."""
        rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(str(to))

    def compact(self) -> int:
        """Keep the newest row of each key, in a file a bucket; returns the number of rows. Look-ups may go on meanwhile, stores may not: what they append is not taken over."""
        old, name = self.generation(), f"g{uuid.uuid4().hex}"
        new = self.place / name
        self._write(latest(self.rows()), new)
        kept = self.spark.read.schema(SCHEMA).parquet(str(new)).count() if new.exists() else 0
        self.pointer.write_text(name)
        old.remove()
        return kept

    def clear(self) -> None:
        self.place.remove()

    def stats(self) -> dict:
        return cache_stats(latest(self.rows())).first().asDict() | {"size_mb": round(self.place.size() / 1e6, 2)}


def normal_context(raw):
    """Cached context of any older form as an array of {text, metadata, id}: texts alone get no metadata; anything else is dropped; nothing left is null.

    raw: a JSON array of strings and objects.
    """
    items = F.from_json(raw, "array<string>")

    def one(item):
        parsed = F.from_json(item, "struct<text string, metadata map<string,string>, id string>")
        return F.when(F.ltrim(item).startswith("{"), parsed).otherwise(F.struct(item.alias("text"), F.create_map().cast("map<string,string>").alias("metadata"), F.lit(None).cast("string").alias("id")))

    kept = F.filter(F.transform(items, one), lambda x: x["text"].isNotNull())
    return F.when(F.size(kept) > 0, kept)
