"""N-gram Jaccard join by MinHash banding.

1. Each text becomes its set of word n-grams (hashed), a key of that set and a MinHash signature cut into bands.
2. Texts with equal sets form a class; the smallest row number stands for it from here on (doc_id itself where doc_ids are unique).
3. Representatives are shuffled on their band hashes. Members of a bucket are tied to its smallest member, never to each other,
   and the ties' connected components are the candidate groups.
4. A group is cut into blocks of texts and each pair of blocks with a common bucket is verified by one task on the full n-gram sets: all pairs of texts
   with Jaccard of the threshold or more are links. Tasks return link counts by text and a spanning forest of their links, not
   the links. Groups of any size are verified whole; blocks bound a task's memory.
5. The components of the links are the near-duplicate groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import linededup, shared, vec
from lodestone.llm.components import connected_components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 128
BLOCK_TEXTS = 4_096
BLOCK_BYTES = 12 << 20
#: N-grams of more texts of two blocks are counted by matrix products.
DENSE = 64
#: Bits of the largest table that every executor holds.
MOST_BITS = 1 << 26
#: Rows of a matrix that are looked at at a time.
STRIPE = 256
_NONE = np.uint64((1 << 64) - 1)


def choose_bands(threshold: float, recall: float, most: int) -> tuple[int, int]:
    """(bands, rows) with the most rows for which 1 - (1 - threshold**rows)**bands >= recall within `most` hashes."""
    for rows in range(16, 0, -1):
        chance = threshold**rows
        bands = 1 if chance >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-chance))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no bands reach that recall with so few hashes")


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(different n-gram hashes of each row in ascending order, first of each row); words as in the decontamination."""
    data = vec.LOWER[data]
    starts, ends, first = vec.words(data, offs, vec.WORD_BYTES)
    h, first = vec.shingles(vec.span_hashes(data, starts, ends), first, n)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(first)))


def sketches(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, set_a and set_b (128 bits that stand for the n-gram set), grams, bytes, bands (a hash for each)."""
    rng = np.random.default_rng(31)
    factor = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shift = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in vec.slices(batches):
            h, first = shingle_sets(data, offs, n)
            count = np.diff(first)
            full = np.flatnonzero(count)
            a = np.zeros(len(count), np.uint64)
            b = np.zeros(len(count), np.uint64)
            found = np.zeros((len(count), bands), np.uint64)
            if len(full):
                heads = first[:-1][full]
                a[full] = np.add.reduceat(vec.mix(h), heads)
                b[full] = np.add.reduceat(vec.mix(h ^ np.uint64(vec.BASE)), heads) ^ count[full].astype(np.uint64)
                low = (h >> np.uint64(32)).astype(np.uint32)
                for k in range(bands):
                    value = np.full(len(full), k + 1, np.uint64)
                    for j in range(k * rows, (k + 1) * rows):
                        least = np.minimum.reduceat((low ^ shift[j]) * factor[j], heads)
                        value = vec.mix(value * np.uint64(vec.BASE) + least)
                    found[full, k] = value
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(count) + 1, dtype=np.int32) * bands), pa.array(found.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(count), pa.array(np.diff(offs)), flat], ["doc_id", "set_a", "set_b", "grams", "bytes", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set_a long, set_b long, grams long, bytes long, bands array<bigint>")


def gram_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets() of any number of texts, a slice at a time."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    made = [shingle_sets(data, offs, n) for _, data, offs in vec.slices(iter([batch]), "text", 1 << 20)]
    sizes = [np.diff(first) for _, first in made]
    return np.concatenate([h for h, _ in made]), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def overlaps(h: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each of the sets `a` with each of the sets `b` (numbers of rows).

    N-grams of more than DENSE sets are counted by products of 0/1 matrices of bounded width, those of fewer pair by pair.
    """
    sets = len(first) - 1
    order = np.argsort(h, kind="stable")
    row = np.repeat(np.arange(sets, dtype=np.int32), np.diff(first))[order]
    h = h[order]
    head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    held = np.diff(np.append(head, len(h)))
    column = np.repeat(np.arange(len(held), dtype=np.int32), held)
    del h, order
    in_a, in_b = np.full(sets, -1, np.int64), np.full(sets, -1, np.int64)
    in_a[a], in_b[b] = np.arange(len(a)), np.arange(len(b))
    out = np.zeros((len(a), len(b)), np.float32 if np.diff(first).max(initial=0) < 1 << 24 else np.float64)

    def indicator(place: np.ndarray, size: int, rows: np.ndarray, columns: np.ndarray, width: int) -> np.ndarray:
        made, at = np.zeros((size, width), np.float32), place[rows]
        made[at[at >= 0], columns[at >= 0]] = 1
        return made

    dense = held > DENSE
    number, some = np.cumsum(dense) - 1, dense[column]
    rows, columns = row[some], number[column[some]]
    width = max(64, (4 << 20) // max(len(a), len(b), 1))
    for low in range(0, int(dense.sum()), width):
        begin, end = np.searchsorted(columns, [low, low + width])
        left = indicator(in_a, len(a), rows[begin:end], columns[begin:end] - low, width)
        out += left @ (left if a is b else indicator(in_b, len(b), rows[begin:end], columns[begin:end] - low, width)).T
    some = (~dense & (held > 1))[column]
    rows, columns, flat = row[some], column[some], out.reshape(-1)
    for d in range(1, DENSE):
        near = columns[d:] == columns[:-d]
        if not near.any():
            break
        x, y = rows[:-d][near], rows[d:][near]
        for p, q in ((x, y), (y, x)):
            i, j = in_a[p], in_b[q]
            both = (i >= 0) & (j >= 0)
            np.add.at(flat, i[both] * len(b) + j[both], 1)
    return out


def linked_sets(h: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the sets `a` have a Jaccard of the threshold or more with which of `b`; no set is linked to itself."""
    size, both = np.diff(first), overlaps(h, first, a, b)
    out = np.zeros(both.shape, bool)
    for at in range(0, len(a), STRIPE):
        part = both[at : at + STRIPE].astype(np.float64)
        # sizes and overlaps are whole numbers, exact in 64 bits; the slack only takes up the rounding of the threshold
        out[at : at + STRIPE] = (part > 0) & (part * (1 + threshold) >= threshold * (size[a[at : at + STRIPE], None] + size[None, b]) - 1e-6)
    if a is b:
        np.fill_diagonal(out, False)
    return out


def verify(texts: list[str], n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j), i < j, among the texts whose Jaccard is the threshold or more."""
    every = np.arange(len(texts))
    return np.nonzero(np.triu(linked_sets(*gram_sets(texts, n), every, every, threshold)))


def group_labels(link: np.ndarray, same: bool) -> np.ndarray:
    """The smallest number of the component of each row (same: rows and columns are the same sets) or of each row and then each column."""

    def least(matrix: np.ndarray, values: np.ndarray, own: np.ndarray) -> np.ndarray:
        found = [np.where(matrix[at : at + STRIPE], values[None, :], len(link) + len(link.T)).min(1, initial=len(link) + len(link.T)) for at in range(0, len(matrix), STRIPE)]
        return np.minimum(own, np.concatenate(found)) if found else own

    n = len(link)
    label = np.arange(n if same else n + link.shape[1])
    while True:
        before = label
        if same:
            label = least(link, label, label)
        else:
            rows = least(link, label[n:], label[:n])
            label = np.concatenate([rows, least(link.T, rows, label[n:])])
        label = label[label]
        if np.array_equal(label, before):
            return label


def link_sums(link: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """The copies that each row is linked to."""
    sums = [link[at : at + STRIPE].astype(np.float64) @ copies for at in range(0, len(link), STRIPE)]
    return np.concatenate(sums) if sums else np.zeros(0)


def numbered(docs: DataFrame) -> DataFrame:
    """A shared table of docs with a unique rid, ascending by doc_id (nulls last), then by text."""
    return shared.table(docs.orderBy(F.col("doc_id").asc_nulls_last(), "text").withColumn("rid", F.monotonically_increasing_id()), "rows")


def near_duplicates(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> DataFrame:
    """doc_id, class_id, copy_id, n_copies, n_links: a row for each row of docs.

    class_id: the smallest doc_id of the row's near-duplicate group, its own if it has no link. copy_id: the
    smallest doc_id with the same n-gram set; n_copies: how many rows have it. n_links: rows with a Jaccard of at least
    threshold, the other copies and those of linked classes. Texts of 1 to n - 1 words have one n-gram, of all their
    words; null texts and texts without words have none, link to nothing and are copies of nothing. Texts of any length take part whole; a block has one text at least. Ties go to the smallest doc_id. N-grams and sets are told apart by
    hashes of 64 and 128 bits. Other columns are ignored, whatever they are called; an empty table gives no rows. Rows that share a doc_id
    are compared one by one, and each has the n_links of that of them with the most. Rows with a null doc_id are compared, counted and returned like
    others, with a null doc_id; a group or set of such rows alone has a null class_id or copy_id.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if linededup.unique_ids(given):
        found = row_groups(given.select(F.col("doc_id").alias("rid"), "text"), n, threshold, recall, most_hashes)
        return found.select(F.col("rid").alias("doc_id"), F.col("class_rid").alias("class_id"), F.col("copy_rid").alias("copy_id"), "n_copies", "n_links")
    rows = numbered(given)
    ids = rows.select("rid", "doc_id")
    found = row_groups(rows.select("rid", "text"), n, threshold, recall, most_hashes).join(ids, "rid")
    for name in ("class", "copy"):  # rows without an id come last, so the smallest row of a group that has an id has one itself
        found = found.join(ids.select(F.col("rid").alias(f"{name}_rid"), F.col("doc_id").alias(f"{name}_id")), f"{name}_rid")
    found = shared.table(found.select("doc_id", "class_id", "copy_id", "n_copies", "n_links"), "found")
    most = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("n_links").alias("most")).where("rows > 1").select("doc_id", "most")
    return found.join(most, "doc_id", "left").select("doc_id", "class_id", "copy_id", "n_copies", F.coalesce("most", "n_links").alias("n_links"))


def row_groups(given: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> DataFrame:
    """rid, class_rid, copy_rid, n_copies, n_links of each row (rid, text); rids are unique. See near_duplicates()."""
    bands, rows = choose_bands(threshold, recall, most_hashes)
    given = given.select(F.col("rid").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    members = shared.table(sketches(given, n, bands, rows), "sketches")
    sets = members.where("grams > 0")
    classes = sets.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("n_copies"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("bytes", "doc_id").alias("bytes"))
    classes = shared.table(classes, "classes")
    buckets = classes.select("copy_id", F.explode("bands").alias("band"))
    heads = buckets.groupBy("band").agg(F.min("copy_id").alias("head"), F.count("*").alias("size")).where("size > 1").select("band", "head")
    tied = shared.table(buckets.join(heads, "band"), "tied")
    ties = tied.where("copy_id <> head").select(F.col("head").alias("a"), F.col("copy_id").alias("b")).distinct()
    groups = connected_components(ties)  # node, component
    links, counts = verified_links(given, classes, groups, tied, n, threshold)
    shared.forget(tied)
    found = connected_components(links)
    by_class = (
        classes.select("set_a", "set_b", "copy_id", "n_copies")
        .join(found.select(F.col("node").alias("copy_id"), F.col("component").alias("class_of")), "copy_id", "left")
        .join(counts, "copy_id", "left")
        .select("set_a", "set_b", "copy_id", "n_copies", F.coalesce("class_of", "copy_id").alias("class_id"), (F.col("n_copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    )
    placed = sets.select("doc_id", "set_a", "set_b").join(by_class, ["set_a", "set_b"]).select("doc_id", "class_id", "copy_id", "n_copies", "n_links")
    alone = members.where("grams = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return placed.unionByName(alone).toDF("rid", "class_rid", "copy_rid", "n_copies", "n_links")


def wanted_rows(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """docs without most of the texts that are not placed, so that these are not shuffled: by a table of bits of the ids, of 16 bits for each but of MOST_BITS at most.

    With more ids than the table can tell apart more rows stay; the join that follows drops them.
    """
    bits = min(max(1 << 17, 1 << (16 * placed.count()).bit_length()), MOST_BITS)
    table = shared.table(linededup.bit_table(placed.select(F.xxhash64("copy_id").alias("h")), bits), "bits")
    return docs.where(linededup.may_be_in(table, F.xxhash64("doc_id"), bits))


def verified_links(docs: DataFrame, classes: DataFrame, groups: DataFrame, tied: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(links a, b that connect all that is linked; copy_id and linked: documents in its linked classes).

    tied: copy_id, band and head of the buckets. Texts with the same smallest head lie in one block, or in blocks of their own if they are many, and only blocks with a common bucket
    are verified against each other. So a chain of loosely tied texts costs no more than its neighbours' pairs.
    """

    def parts() -> Column:
        return F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")

    label = tied.groupBy("copy_id").agg(F.min("head").alias("label"))
    node = groups.select(F.col("node").alias("copy_id"), F.col("component").alias("group")).join(label, "copy_id")
    sized = classes.select("copy_id", "n_copies", "bytes").join(node, "copy_id")
    sized = sized.join(sized.groupBy("group").agg(parts().alias("in_group")), "group").join(sized.groupBy("label").agg(parts().alias("in_label")), "label")
    alone = F.xxhash64(F.lit(1), "label", F.pmod(F.xxhash64("copy_id"), F.col("in_label")))
    block = F.when(F.col("in_label") > 1, alone).otherwise(F.xxhash64(F.lit(2), "group", F.pmod(F.xxhash64("label"), F.col("in_group"))))
    placed = shared.table(sized.select("copy_id", "n_copies", block.alias("block")), "placed")
    met = tied.select("copy_id", "band").join(placed, "copy_id").select("band", "block").distinct()
    a, b = met.alias("a"), met.alias("b")
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.block") <= F.col("b.block"))).select(F.col("a.block").alias("i"), F.col("b.block").alias("j")).distinct()
    both = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    rows = placed.join(wanted_rows(docs, placed).withColumnRenamed("doc_id", "copy_id"), "copy_id")
    keyed = rows.join(both, "block").select("i", "j", "block", "copy_id", "n_copies", "text")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("copy_id")
        ids, copies, block = table["copy_id"].to_numpy(), table["n_copies"].to_numpy().astype(np.float64), table["block"].to_numpy()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        h, first = gram_sets(table["text"].to_pylist(), n)
        rows = np.flatnonzero(block == i)
        others = rows if i == j else np.flatnonzero(block == j)
        link = linked_sets(h, first, rows, others, threshold)
        del h
        label = group_labels(link, i == j)
        members = ids[rows] if i == j else np.concatenate([ids[rows], ids[others]])
        linked = link_sums(link, copies[others])
        if i != j:
            linked = np.concatenate([linked, link_sums(link.T, copies[rows])])
        some, inner = np.flatnonzero(linked), np.flatnonzero(label != np.arange(len(label)))
        vec.release()
        none = pa.nulls(len(some), pa.int64())
        return pa.table(
            {
                "a": pa.chunked_array([pa.array(members[some]), pa.array(members[label[inner]])]),
                "b": pa.chunked_array([none, pa.array(members[inner])]),
                "linked": pa.chunked_array([pa.array(linked[some].astype(np.int64)), pa.nulls(len(inner), pa.int64())]),
            }
        )

    out = shared.table(keyed.groupBy("i", "j").applyInArrow(run, "a long, b long, linked long"), "links")
    links = out.where("b is not null").select("a", "b")
    shared.forget(placed)
    counts = out.where("b is null").groupBy(F.col("a").alias("copy_id")).agg(F.sum("linked").alias("linked"))
    return links, counts


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each near-duplicate group, the first by doc_id (nulls last), then by text; all columns stay."""
    columns = [f"`{c}`" for c in docs.columns]
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*columns).alias("row"))
    rows = given.withColumn("rid", F.col("doc_id")) if linededup.unique_ids(given) else numbered(given)
    gone = row_groups(rows.select("rid", "text"), **options).where("rid <> class_rid").select("rid")
    return rows.join(gone, "rid", "left_anti").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
