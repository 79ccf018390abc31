"""Looks at retrieval without answering: what was found, how far away it is, and whether it would do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import evaluation as V
from lodestone.operators import retrieval as R


def hits(queries: DataFrame, chunks: DataFrame, top_k: int = 5) -> DataFrame:
    """query_id, query and the top_k chunks of each query (query_id, query, embedding), with all columns of chunks."""
    found = R.top_k(queries.select("query_id", "embedding"), chunks, top_k)
    return queries.select("query_id", "query").join(found, "query_id").join(chunks.drop("embedding"), "id_num")


def retrieval_report(found: DataFrame) -> DataFrame:
    """query_id, rank, distance, source_display, source, section_heading, preview of each hit; null names are empty."""
    named = [F.coalesce(c, F.lit("")).alias(c) for c in ("source_display", "source", "section_heading")]
    return found.select("query_id", "rank", "distance", *named, T.preview(F.col("text")).alias("preview"))


def threshold_report(found: DataFrame, label: Callable[[Column, Column], Column] = V.report_label) -> tuple[DataFrame, DataFrame]:
    """(each hit with its label by the topic rules for question and text; count and range of the distances of each label)."""
    shown = found.withColumn("snippet", T.preview(F.col("text")))
    seen = F.concat(T.filled(F.col("section_heading"), F.lit("-")), F.lit(" "), F.col("snippet"))
    labelled = shown.withColumn("label", label(F.col("query"), seen)).select("query_id", "rank", "distance", "label", "snippet")
    return labelled, V.distance_ranges(labelled)


def simulation(queries: DataFrame, found: DataFrame, max_distance: float = 0.44, final_top_k: int = 5, topics: dict[str, list[str]] | None = None) -> DataFrame:
    """query_id, raw, final, sources and sufficient of each query: what an answer would be based on, and whether it would be.

    sources: "name | heading" of the context in its order. topics: words of a question and the words one of which its context must hold.
    """
    chosen = R.select_context(found, max_distance, final_top_k)
    name = T.filled(T.strip(T.filled(F.col("source_display"), F.col("source"), F.lit("-"))), F.lit(""))
    heading = F.coalesce(T.filled(T.strip(F.col("section_heading"))), F.lit("(empty heading)"))
    described = chosen.withColumn("shown", F.concat(F.coalesce(name, F.lit("")), F.lit(" | "), heading))
    listed = F.sort_array(F.collect_list(F.struct("number", "shown", "text")))  # final_top_k at most
    context = described.groupBy("query_id").agg(listed.alias("c"))
    raw = found.groupBy("query_id").agg(F.count("*").alias("raw"))
    joined = queries.select("query_id", "query").join(raw, "query_id", "left").join(context, "query_id", "left")
    final = F.coalesce(F.size("c"), F.lit(0))
    text = F.array_join(F.transform("c", lambda x: x["text"]), " ")
    return joined.select(
        "query_id", F.coalesce("raw", F.lit(0)).alias("raw"), final.alias("final"),
        F.coalesce(F.transform("c", lambda x: x["shown"]), F.array().cast("array<string>")).alias("sources"),
        V.sufficient(final, F.col("query"), text, V.SUPPORT if topics is None else topics).alias("sufficient"),
    )
