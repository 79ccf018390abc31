"""Filter interaction audit: what each filter removes in every order of filters, by aggregation over lattice edges.

The subsets of k filters form a lattice; applying filter f after the set S is its edge (S, f). What f removes there depends on S alone, not on the
order within S, so k * 2**(k - 1) edges (80 for five filters) hold all k! orders. Documents are first counted by (part, set of failed filters, labels), at most
2**k * 4 rows a part whatever the corpus holds; each of these rows contributes to every edge, and each order is a path: its k steps look up k edges.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import shared

#: White space between words, in Java's and DuckDB's patterns.
WORD = r"[^\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions A to D of a text (nulls: empty), by letter."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def edges(filters: str) -> list[tuple[int, int]]:
    """(set of filters applied before, next filter) of the lattice, sets as bits."""
    return [(s, f) for s in range(1 << len(filters)) for f in range(len(filters)) if not s >> f & 1]


def paths(filters: str) -> list[tuple[str, int, int, int]]:
    """(order, step, set applied before, filter) of every step of every order."""
    out = []
    for order in itertools.permutations(range(len(filters))):
        for step, f in enumerate(order, 1):
            out.append(("".join(filters[i] for i in order), step, sum(1 << i for i in order[: step - 1]), f))
    return out


def failed_sets(docs: DataFrame, labels: DataFrame, failures: dict[str, Column], copies: str | None, part: Column) -> DataFrame:
    """part, failed (bits, in the order of `failures` and then `copies`), good, toxic and documents of docs (doc_id, text, ...).

    copies: the letter of the filter that a text fails which is also some smaller doc_id's. Texts are compared by sha256. A row fails it unless it
    holds the smallest id of its text, found by a join on (text's hash, id), so no group of copies, however large, meets in one task.
    """
    bits = sum((F.when(F.coalesce(c, F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(failures.values())), F.lit(0))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg((F.coalesce(F.max("quality"), F.lit(0)) == 1).alias("good"), (F.coalesce(F.max("toxic"), F.lit(0)) == 1).alias("toxic"))
    rows = docs.select("doc_id", part.alias("part"), bits.alias("bits"), F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).alias("hash"))
    if copies:
        rows = shared.table(rows, "failed")
        firsts = rows.groupBy("hash").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("is_first", F.lit(True))
        copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
        rows = rows.join(firsts, ["hash", "doc_id"], "left").withColumn("bits", F.col("bits") + F.when(copy, F.lit(1 << len(failures))).otherwise(F.lit(0)))
    rows = rows.join(known, "doc_id", "left")
    return rows.groupBy("part", F.col("bits").alias("failed"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.count("*").alias("documents"))


def audit(sets: DataFrame, filters: str) -> DataFrame:
    """part, filter_order, step, and kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part, order and step.

    sets: failed_sets(). Each of its rows contributes to every edge; the edges of a part are summed, and each step of an order is joined to its edge.
    """
    spark = sets.sparkSession
    k = len(filters)
    weight = {s: math.factorial(bin(s).count("1")) * math.factorial(k - 1 - bin(s).count("1")) for s in range((1 << k) - 1)}
    grid = F.explode(F.array(*(F.struct(F.lit(s).alias("before"), F.lit(f).alias("filter"), F.lit(weight[s]).alias("orders")) for s, f in edges(filters))))
    each = sets.withColumn("edge", grid).select("part", "failed", "good", "toxic", "documents", "edge.*")
    fails, reached = F.expr("(failed >> filter) & 1 = 1"), F.expr("(failed & before) = 0")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("documents")).otherwise(F.lit(0)))

    by_edge = each.groupBy("part", "before", "filter", "orders").agg(
        total(reached & ~fails).alias("kept"),
        total(reached & fails).alias("removed"),
        total(~reached & fails).alias("redundant"),
        total(F.expr("failed = (1 << filter)")).alias("unique_fails"),
        total(reached & fails & F.col("good")).alias("good_lost"),
        total(reached & fails & F.col("toxic")).alias("toxic_lost"),
    )
    by_edge = shared.table(by_edge, "edges")  # 80 rows a part
    shapley = by_edge.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    steps = spark.createDataFrame(paths(filters), "filter_order string, step int, before int, filter int")
    found = F.broadcast(steps).join(by_edge, ["before", "filter"]).join(shapley, ["part", "filter"])  # k * k! rows are broadcast
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """audit() of the filters A (under 100 words), B (under 80 % different words), C (over 10 % A-Z), D (any of #$%&*|) and E (text of a smaller doc_id) by lang.

    A null text is empty, so it fails A and, beside other empty ones, E; a null lang counts as the empty one; a row without doc_id is no copy and makes none. Rows that share a doc_id are
    counted one by one and are no copies of each other. An id with several labels counts as good or toxic if any says so. Texts of any length are read whole. An empty table of documents
    has no parts and gives no rows, one of labels no losses. There are no ties but equal ids; other columns are ignored, whatever they are called.
    """
    failures = text_failures(F.col("text"))
    sets = failed_sets(docs.select("doc_id", "text", "lang"), labels.select("doc_id", "quality", "toxic"), failures, "E", F.coalesce(F.col("lang").cast("string"), F.lit("")))
    return audit(sets, "".join(failures) + "E")
