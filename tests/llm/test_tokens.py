"""Pre-tokens, the BPE encoder, decoding and record files against the tokenizers library."""

from __future__ import annotations

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lodestone.llm import bpe, recordio, vec

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", " ", "  ", "\n", "'s", "'re", "'", "l", "'ll", "é", "ß", "中", "1", "23", "!", "\t", "<|endoftext|>", "<|endo", "ftext|>", "the", " and", "՘", "\U00010940", "\r\n", "\x85", "\x1c", "😀", "ing", "T"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return ["", "<|endoftext|>", " ", "a" * 3000, "ab" * 2000, " " * 2000, "x" * 777 + " "] + ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(3000)]


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def rows_of(encode, texts):
    out = []
    for _, data, offs in vec.slices(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]), limit=5000):
        ids, first = encode(data, offs)
        out += [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def test_ids_are_the_librarys(texts, library):
    model = bpe.load(PATH)
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert rows_of(model.encode_rows, texts) == expected
    assert [model.decode(ids) for ids in expected] == texts


def test_the_librarys_words_in_groups(texts, library):
    words = recordio.library(PATH)

    def encode(data, offs):
        from lodestone.llm import pretokens

        starts, first = pretokens.token_starts(data, offs, words.special, words.split)
        ids, sizes = words.words(data, starts)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[first]

    assert rows_of(encode, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_dictionaries_that_overflow(texts, library):
    model = bpe.Bpe(PATH)
    from lodestone.llm import pretokens

    model.words = pretokens.WordIds(lambda pieces: [model.encode_piece(p) for p in pieces], bits=4)
    assert rows_of(model.encode_rows, texts[:500]) == [e.ids for e in library.encode_batch(texts[:500], add_special_tokens=False)]


ROWS = [(3, "b b"), (1, None), (2, ""), (None, "null id"), (3, "b b"), (3, "a"), (10, "zz" * 5000)]


def test_record_files(spark, library, tmp_path):
    docs = spark.createDataFrame([(i, t, 7) for i, t in ROWS], "doc_id long, text string, ids_crc32 int").repartition(3)
    manifest = recordio.write(docs, PATH, f"file://{tmp_path}/set")
    got = [tuple(r) for r in recordio.digests(spark, manifest).orderBy("start").collect()]
    expected, start = [], 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected
    name = max(manifest["files"], key=lambda f: f["docs"])["name"]
    whole = list(recordio.read_records(manifest["folder"], name))
    order = np.arange(len(whole))[::-1]
    shuffled = list(recordio.read_records(manifest["folder"], name, order))
    assert [x.tolist() for _, x in shuffled] == [x.tolist() for _, x in whole][::-1]
    file = tmp_path / "set" / f"{name}.rec"
    raw = bytearray(file.read_bytes())
    raw[-5] ^= 1
    file.write_bytes(raw)
    with pytest.raises(recordio.DamagedRecord):
        list(recordio.read_records(manifest["folder"], name))


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert recordio.digests(spark, recordio.write(empty, PATH)).count() == 0
    assert bpe.digests(empty, PATH).count() == 0


def test_digests_and_columns(spark, library):
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in ROWS], "doc_id long, text string, ids double")
    got = sorted((tuple(r) for r in bpe.digests(docs, PATH).collect()), key=str)
    expected = []
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(expected, key=str)
    full = bpe.encode(docs, PATH)
    assert full.columns == ["doc_id", "text", "ids", "decoded"] and all(r.decoded == (r.text or "") for r in full.collect())
