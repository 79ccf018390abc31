"""Chunking: sections, then paragraphs and sentences packed to a size with overlap, then a hard limit.

The rules work on one text at a time and are plain functions; chunk_documents() runs them on partitions of a
DataFrame. Lengths are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import sentences as S
from lodestone.sources.config import Profile

#: Fixed values, in order of preference: where a hard cut may fall.
CUTS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ")
#: What a sentence in carried-over text may begin after.
SENTENCE_ENDS = (". ", "! ", "? ", "\n")
HEADING_CHARS = 160
#: Documents, and about so many bytes of their texts, that a task cuts at a time.
ROWS, SLICE_BYTES = 256, 1 << 20


def sentences(text: str, language: str | None = None) -> list[str]:
    """By the language's rules where there are some, else cut at white space after . ! or ?; the marks stay."""
    if rules := S.rules_for(language):
        return S.sentences(text, rules)
    return [s for s in (p.strip() for p in re.split(r"(?<=[.!?])\s+", text)) if s]


def carried_over(text: str, size: int) -> str:
    """The end of a chunk that begins the next one: about `size` characters, from a sentence start if one is found.

    Size 0 carries the whole text, as slicing from -0 does.
    """
    if len(text) <= size:
        return text
    end, begin = text[-size:], 0
    for mark in SENTENCE_ENDS:
        at = end.find(mark)
        if at > begin:
            begin = at + len(mark)
    return end[begin:].strip()


def pack(units: list[str], glue: str, size: int, overlap: int, too_long=None) -> list[str]:
    """Units joined by glue while they fit into size; each new chunk begins with what the last one carries over.

    A unit longer than size that begins a chunk is given to too_long (if any), whose last chunk goes on.
    """
    chunks, now = [], ""
    for unit in units:
        if len(now) + len(unit) + len(glue) > size and now:
            chunks.append(now)
            now = carried_over(now, overlap)
        elif not now and too_long and len(unit) > size:
            *full, unit = too_long(unit) or [""]
            chunks += full
        now = f"{now}{glue}{unit}" if now else unit
    return [*chunks, now] if now else chunks


def semantic_chunks(text: str, size: int, overlap: int, least: int, language: str | None = None) -> list[str]:
    """Packed paragraphs of at least `least` characters; a long first paragraph is packed by sentences."""
    paragraphs = [p for p in (x.strip() for x in text.split("\n\n")) if p]
    return [c for c in pack(paragraphs, "\n\n", size, overlap, lambda p: pack(sentences(p, language), " ", size, overlap)) if len(c) >= least]


def natural_cut(window: str) -> int:
    """Where to cut a full window: after the last occurrence of the first kind of cut that stands in its second half."""
    for mark in CUTS:
        at = window.rfind(mark)
        if at >= max(1, len(window) // 2):
            return at + len(mark)
    return len(window)


def hard_pieces(text: str | None, limit: int, overlap: int) -> list[str]:
    """Overlapping pieces of at most limit characters; overlap counts up to half the limit; limit <= 0 does not cut."""
    body = (text or "").strip()
    if limit <= 0 or len(body) <= limit:
        return [body] if body else []
    overlap = min(max(overlap, 0), limit // 2) if limit > 1 else 0
    pieces, begin = [], 0
    while len(body) - begin > limit:
        cut = natural_cut(body[begin : begin + limit])
        piece = body[begin : begin + cut].strip()
        if piece:
            pieces.append(piece)
        else:
            cut = limit
        begin += cut - overlap if cut > overlap else limit - overlap
    last = body[begin:].strip()
    return [*pieces, last] if last else pieces


def sections_of(text: str, boundary: str | None) -> list[str]:
    parts = [p for p in (x.strip() for x in re.split(boundary, text)) if p] if boundary else []
    whole = text.strip()
    return parts if len(parts) > 1 else [whole] if whole else []


def heading_of(section: str) -> str:
    line = section.strip().partition("\n")[0].strip()
    return line if len(line) <= HEADING_CHARS else f"{line[:HEADING_CHARS]}…"


def header_for(profile: Profile, display: str, kind: str, heading: str, chunk_size: int) -> str:
    cap, label = chunk_size // 2, profile.kind_labels.get(kind, kind)
    made = profile.chunk_header.format(source_display=display, kind_label=label, heading=heading)
    over = len(made) - cap + 1
    if over > 1 and len(heading) > over:
        made = profile.chunk_header.format(source_display=display, kind_label=label, heading=f"{heading[:-over]}…")
    return made if len(made) <= cap else ""


def chunks_of(doc: Mapping, profile: Profile, size: int, overlap: int, least: int) -> Iterator[dict]:
    """Chunk rows of one document in order, after the hard limit."""
    for section in sections_of(doc["text"] or "", profile.section_boundaries.get(doc["doc_type"])):
        heading = heading_of(section)
        head = header_for(profile, doc["source_display"], doc["source_kind"], heading, size)
        short = len(section) <= size
        bodies = [(None, section)] if short else [(i, c.strip()) for i, c in enumerate(semantic_chunks(section, size, overlap, least, profile.sentence_language))]
        for sub, body in bodies:
            if not short and len(body) < least:
                continue
            for piece in hard_pieces(body, max(1, size - len(head)), overlap):
                whole = head + piece
                if len(whole) < least:
                    continue
                base = {"section_heading": heading, "subchunk_index": sub, "unlimited_len": len(whole)}
                if len(whole) <= size:
                    yield base | {"text": whole, "header_len": len(head), "hard_split_index": None}
                else:
                    for n, part in enumerate(hard_pieces(whole, size, overlap)):
                        yield base | {"text": part, "header_len": 0 if n else len(head), "hard_split_index": n}


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, at most ROWS and about SLICE_BYTES of a text column at a time, one row at least: what a task holds follows these and not the batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = min(max(int(np.searchsorted(ends, before + SLICE_BYTES, "right")), begin + 1), begin + ROWS)
        yield batch.slice(begin, end - begin)
        begin = end


CHUNK_SCHEMA = "entry_ord long, chunk_ord long, source string, source_display string, source_kind string, doc_type string, file_name string, section_heading string, header_len int, subchunk_index int, hard_split_index int, unlimited_len int, text string"


def chunk_documents(sources: DataFrame, profile: Profile = Profile(), chunk_size: int = 800, overlap: int = 200, min_len: int = 80) -> DataFrame:
    """Chunk rows of sources(entry_ord, source, source_display, source_kind, doc_type, file_name, text); order: entry_ord, chunk_ord.

    unlimited_len: the length of the chunk before the hard limit cut it. Null texts have no chunks.
    """
    fields = ("entry_ord", "source", "source_display", "source_kind", "doc_type", "file_name", "text")
    columns = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
    copied = columns[: columns.index("section_heading")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            for part in slices(batch, "text"):
                docs = zip(*(part.column(c).to_pylist() for c in fields), strict=True)
                made = [(n, i, row) for n, doc in enumerate(docs) for i, row in enumerate(chunks_of(dict(zip(fields, doc, strict=True)), profile, chunk_size, overlap, min_len))]
                of = pa.array([n for n, _, _ in made], pa.int64())
                schema = schema or {c: part.schema.field(c).type for c in copied if c != "chunk_ord"}
                own = {"chunk_ord": pa.array([i for _, i, _ in made], pa.int64())}
                own |= {c: pa.array([row[c] for _, _, row in made], pa.string() if c in ("section_heading", "text") else pa.int32()) for c in columns[len(copied) :]}
                own |= {c: part.column(c).take(of) for c in copied if c != "chunk_ord"}
                yield pa.RecordBatch.from_arrays([own[c] for c in columns], columns)

    return sources.select(F.col("entry_ord").cast("long").alias("entry_ord"), *fields[1:]).mapInArrow(run, CHUNK_SCHEMA)


def with_ids(chunks: DataFrame) -> DataFrame:
    """id_num and id (doc_{i}): the place in the whole corpus, counted from 0 in the order of entry_ord and chunk_ord.

    A place is the number of chunks of all entries before, and chunk_ord. Entries are cut into ranges; running sums are
    taken within each, and the sums of the ranges (one number for each) are added up on the driver, so no task gets all rows.
    """
    from pyspark.sql import Window

    from lodestone.sources.storage import written

    counts = chunks.groupBy("entry_ord").agg(F.count("*").alias("n")).repartitionByRange("entry_ord")
    counts = written(counts.withColumn("range", F.spark_partition_id()), "chunk-counts")
    sums = {r["range"]: r["n"] for r in counts.groupBy("range").agg(F.sum("n").alias("n")).collect()}
    begin, total = [0] * (max(sums, default=0) + 1), 0
    for k in sorted(sums):
        begin[k], total = total, total + sums[k]
    running = F.sum("n").over(Window.partitionBy("range").orderBy("entry_ord")) - F.col("n")
    before = counts.select("entry_ord", (running + F.get(F.array(*map(F.lit, begin)), F.col("range"))).alias("before"))
    numbered = chunks.join(before, "entry_ord").withColumn("id_num", F.col("before") + F.col("chunk_ord")).drop("before")
    return numbered.withColumn("id", F.concat(F.lit("doc_"), F.col("id_num").cast("string")))


def hard_limit(rows: DataFrame, limit: int, overlap: int) -> DataFrame:
    """rows with every text of more than limit characters cut into overlapping pieces, numbered by hard_split_index (null for texts that were not cut).

    Pieces after the first do not begin with the header any more, so their header_len (if rows have one) is 0. A limit of 0 or less cuts nothing. Texts within the limit stay as they are, null and
    blank ones too; a longer text of white space alone has no pieces.
    """
    kept = rows.drop("hard_split_index")
    names = kept.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "hard_split_index int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts, of, pieces, index = part.column("text").to_pylist(), [], [], []
                for n, text in enumerate(texts):
                    whole = limit <= 0 or len(text or "") <= limit
                    cut = [text] if whole else hard_pieces(text, limit, overlap)
                    of += [n] * len(cut)
                    pieces += cut
                    index += [None] if whole else range(len(cut))
                at = pa.array(of, pa.int64())
                # all columns but the text itself, of which each piece would carry a copy
                own = {c: part.column(c).take(at) for c in names if c != "text"}
                own["text"] = pa.array(pieces, part.schema.field("text").type)
                if "header_len" in names:
                    length = own["header_len"]
                    own["header_len"] = pa.array([0 if i else x for i, x in zip(index, length.to_pylist(), strict=True)], length.type)
                yield pa.RecordBatch.from_arrays([*(own[c] for c in names), pa.array(index, pa.int32())], [*names, "hard_split_index"])

    return kept.mapInArrow(run, schema)


def summary(chunks: DataFrame) -> DataFrame:
    """Number and greatest length of chunks before and after the hard limit."""
    first = F.coalesce("hard_split_index", F.lit(0)) == 0
    longest = [F.coalesce(F.max(x), F.lit(0)) for x in (F.col("unlimited_len"), F.length("text"))]
    return chunks.agg(F.count(F.when(first, 1)).alias("before_total"), longest[0].alias("before_max_len"), F.count("*").alias("after_total"), longest[1].alias("after_max_len"))


def counts_by_file(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Also files without any chunk."""
    found = chunks.groupBy("entry_ord").agg(F.count("*").alias("n"))
    return sources.select("entry_ord", "file_name").join(found, "entry_ord", "left").select("entry_ord", "file_name", F.coalesce("n", F.lit(0)).alias("chunks"))
