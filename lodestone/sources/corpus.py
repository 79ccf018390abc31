"""Corpus scan: declared UTF-8 text files as one DataFrame."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.identity import ENTRY_FIELDS, corpus_fingerprint
from lodestone.sources.config import ConfigError, load_corpus

ENTRY_SCHEMA = "entry_ord long, path string, source string, source_display string, source_kind string, doc_type string, file_name string"


def read_sources(spark: SparkSession, manifest: str | Path | list[dict]) -> DataFrame:
    """entry_ord, source, source_display, source_kind, doc_type, file_name, content_sha256, text of each entry.

    Each file is read once as a whole; malformed UTF-8 is an error. Line ends become \\n. manifest: a path, or load_corpus()'s entries.
    """
    entries = manifest if isinstance(manifest, list) else load_corpus(manifest)
    names = [c.split()[0] for c in ENTRY_SCHEMA.split(", ")]
    declared = spark.createDataFrame([tuple(e[n] for n in names) for e in entries], ENTRY_SCHEMA)
    files = spark.read.format("binaryFile").load(sorted({e["path"] for e in entries})).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.decode("content", "UTF-8").alias("raw"))
    decoded = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    found = declared.join(files.withColumn("path", decoded), "path", "left")
    text = T.unix_newlines(F.coalesce("raw", F.raise_error(F.concat(F.lit("file was not read: "), "path")).cast("string")))
    return found.withColumn("text", text).select("entry_ord", *ENTRY_FIELDS[:-1], F.sha2("text", 256).alias("content_sha256"), "text")


def single_file(path: str | Path) -> list[dict]:
    """The manifest entries of a corpus of one file."""
    file = Path(path).resolve()
    if not file.is_file():
        raise ConfigError(f"no such file: {file}")
    return [{"entry_ord": 0, "path": str(file), "source": "single_file", "source_display": file.name, "source_kind": "unknown", "doc_type": "overview", "file_name": file.name}]


def fingerprint(sources: DataFrame) -> str:
    """Of the declared entries in manifest order: as many rows as the manifest has, without their texts."""
    return corpus_fingerprint([r.asDict() for r in sources.select("entry_ord", *ENTRY_FIELDS).orderBy("entry_ord").collect()])
