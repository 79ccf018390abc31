"""Token-id output as length-delimited binary records with masked checksums, and an offset index for shuffled reads.

A data file is a sequence of records, all numbers little-endian:

    uint64 length of the payload in bytes | uint32 masked crc32 of these 8 bytes | payload | uint32 masked crc32 of the payload

The payload is the sequence's ids, of 2 bytes each if the vocabulary has at most 65,536 and of 4 otherwise. The index of a
data file is a file of its own: MAGIC, the number of records and the bytes of an id as uint64, for each record four int64 (byte offset, number of ids, doc_id, 1 if doc_id is null), and the
masked crc32 of all that. A masked crc is the crc rotated right by 15 bits plus MASK_DELTA, so that checksums of
data that themselves hold checksums stay sound.

Tasks write under names of their own and report them; only reported files belong to the data set, so retried or
lost tasks leave no trace in it.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import pretokens, shared, vec

MAGIC = b"TOKIDX01"
MASK_DELTA = 0xA282EAD8
END_ID = 0


class DamagedRecord(ValueError):
    """A checksum or a length does not fit."""


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))))


def read_frame(read: Callable[[int], bytes]) -> bytes | None:
    """The next record's payload, or None at the end of the file."""
    head = read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked_crc(head[:8]):
        raise DamagedRecord("the length of a record does not fit its checksum")
    size = struct.unpack("<Q", head[:8])[0]
    rest = read(size + 4)
    if len(rest) < size + 4 or struct.unpack("<I", rest[size:])[0] != masked_crc(rest[:size]):
        raise DamagedRecord("a record does not fit its checksum")
    return rest[:size]


def index_bytes(entries: np.ndarray, width: int) -> bytes:
    body = MAGIC + struct.pack("<QQ", len(entries), width) + entries.astype("<i8").tobytes()
    return body + struct.pack("<I", masked_crc(body))


def read_index(raw: bytes) -> tuple[np.ndarray, int]:
    """(an array of (offset, ids, doc_id, doc_id is null) for each record, bytes of an id)."""
    if raw[:8] != MAGIC or struct.unpack("<I", raw[-4:])[0] != masked_crc(raw[:-4]):
        raise DamagedRecord("the index does not fit its checksum")
    return np.frombuffer(raw[24:-4], "<i8").reshape(-1, 4), struct.unpack("<Q", raw[16:24])[0]


class LibraryWords:
    """Ids of pieces by the tokenizers library; many pieces of one space and letters go into one call."""

    GROUP = 256

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        if len(special) != 1:
            raise ValueError("only a plain byte-level file with one added token is supported")
        self.special, self.split = special[0], self.library.pre_tokenizer.pre_tokenize_str
        self.words = pretokens.WordIds(self.encode)
        self.id_bytes = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        texts = [p.decode("utf-8") for p in pieces]
        joint = [i for i, t in enumerate(texts) if t[0] == " " and t[1:].isalpha()]
        apart = sorted(set(range(len(texts))) - set(joint))
        out: list[list[int]] = [[]] * len(texts)
        for i, e in zip(apart, self.library.encode_batch_fast([texts[i] for i in apart], add_special_tokens=False), strict=True):
            out[i] = e.ids
        groups = [joint[i : i + self.GROUP] for i in range(0, len(joint), self.GROUP)]
        for group, e in zip(groups, self.library.encode_batch(["".join(texts[i] for i in g) for g in groups], add_special_tokens=False), strict=True):
            ids, words = e.ids, np.asarray(e.word_ids)
            at = np.searchsorted(words, np.arange(len(group) + 1)).tolist()
            if words[-1] != len(group) - 1:  # the library splits some piece otherwise
                for i in group:
                    out[i] = self.library.encode(texts[i], add_special_tokens=False).ids
                continue
            for k, i in enumerate(group):
                out[i] = ids[at[k] : at[k + 1]]
        return out


_loaded: dict[str, LibraryWords] = {}


def library(path: str) -> LibraryWords:
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path] = LibraryWords(path)
    return _loaded[path]


def write(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID) -> dict:
    """Encode docs' texts, append end_id to each, and write data and index files in ascending doc_id order.

    Order: null doc_ids first, rows with the same doc_id by text (null first); equal rows have a record each. Null texts are empty: their record
    holds end_id alone. Texts of any length are one record. Other columns are ignored, whatever they are called; an empty table makes no files. Returns the manifest (also written as manifest.json): the folder and one entry for each
    file in order, with its first ordinal token position. Its size is that of the number of partitions.
    """
    spark = docs.sparkSession
    folder = folder or shared.new_path(spark, "records")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # ranges of ids and beginnings of texts: rows that share an id may be dealt out too, and no whole texts are in Spark's samples
    rows = rows.repartitionByRange(F.col("doc_id"), F.left("text", F.lit(64))).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = library(tokenizer_path)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        fs, inner = shared.filesystem(folder)
        width = words.id_bytes
        end = np.array([end_id], f"<u{width}").tobytes()
        entries, at, tokens, out = [], 0, 0, None
        for batch, data, offs in vec.slices(batches):
            if out is None:
                fs.create_dir(inner, recursive=True)
                out = fs.open_output_stream(f"{inner}/{name}.rec")
            starts, first = pretokens.token_starts(data, offs, words.special, words.split)
            ids, sizes = words.words(data, starts)
            first = np.concatenate([[0], np.cumsum(sizes)])[first] * width
            flat, framed = ids.astype(f"<u{width}").tobytes(), []
            for doc, a, b in zip(batch.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                framed.append(frame(flat[a:b] + end))
                entries.append((at, (b - a) // width + 1, doc or 0, doc is None))
                at += len(framed[-1])
                tokens += entries[-1][1]
            out.write(b"".join(framed))
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{inner}/{name}.idx") as f:
                f.write(index_bytes(np.array(entries, np.int64).reshape(-1, 4), width))
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "docs": [len(entries)], "tokens": [tokens]})

    files, start = [], 0
    for r in sorted(rows.mapInArrow(run, "part long, name string, docs long, tokens long").collect()):  # a row for each file
        files.append({"name": r["name"], "docs": r["docs"], "tokens": r["tokens"], "start": start})
        start += r["tokens"]
    manifest = {"folder": folder, "end_id": end_id, "files": files}
    fs, inner = shared.filesystem(folder)
    fs.create_dir(inner, recursive=True)
    with fs.open_output_stream(f"{inner}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_records(folder: str, name: str, order: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index entry, ids) of a file's records, in file order or in the given order of record numbers."""
    fs, inner = shared.filesystem(folder)
    with fs.open_input_stream(f"{inner}/{name}.idx") as f:
        index, width = read_index(f.read())
    if order is None:
        with fs.open_input_stream(f"{inner}/{name}.rec", buffer_size=1 << 20) as f:
            for entry in index:
                payload = read_frame(f.read)
                if payload is None or len(payload) != width * entry[1]:
                    raise DamagedRecord(f"{name}: the index does not fit the records")
                yield entry, np.frombuffer(payload, f"<u{width}").astype("<u4")
            if read_frame(f.read) is not None:
                raise DamagedRecord(f"{name}: records without an index entry")
    else:
        with fs.open_input_file(f"{inner}/{name}.rec") as f:
            for entry in index[order]:
                f.seek(int(entry[0]))
                yield entry, np.frombuffer(read_frame(f.read), f"<u{width}").astype("<u4")


def digests(spark: SparkSession, manifest: dict) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, read back from the files; a task for each file."""
    files, folder = manifest["files"], manifest["folder"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                out, start = [], files[k]["start"]
                for entry, ids in read_records(folder, files[k]["name"]):
                    out.append((None if entry[3] else int(entry[2]), start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(out) == 10_000:
                        yield to_batch(out)
                        out = []
                if out:
                    yield to_batch(out)

    def to_batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
