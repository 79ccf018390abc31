"""BPE encoding by backtracking over Aho-Corasick matches, and decoding through an offset table.

An Aho-Corasick automaton over the reversed vocabulary, run once over a reversed piece, gives at each position
all tokens that start there, longest first. The encoder takes the longest, keeps it if the pair with the token
before it is compatible (BPE on the two tokens' text would give just these two), and otherwise tries the next
shorter one or steps back; a position found to be a dead end is never entered again, so time is linear in the
piece. The result is that of the merges in rank order.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import pretokens, vec


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one byte-level BPE vocabulary file of the tokenizers library.

    Internally a token is its merge's rank plus 256, or its byte; `public` maps that to the file's ids.
    """

    MOST_PAIRS = 1 << 17

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        own = {c: b for c, b in letters.items()}
        self.left, self.right, self.pair = list(range(256)), list(range(256)), {}
        for a, b in merges:
            if a + b in own:
                raise ValueError(f"{a + b!r} is made by two merges; this encoder needs one for each token")
            i, j, k = own[a], own[b], len(self.left)
            own[a + b] = self.pair[i, j] = k
            self.left.append(i)
            self.right.append(j)
        as_bytes = [b""] * len(self.left)
        self.public = np.zeros(len(self.left), np.int64)
        for text, k in own.items():
            as_bytes[k] = bytes(letters[c] for c in text)
            self.public[k] = vocab[text]
        self.whole = {b: k for k, b in enumerate(as_bytes)}
        self.automaton = ahocorasick.Automaton()
        for k, b in enumerate(as_bytes):
            self.automaton.add_word(b[::-1].decode("latin-1"), (k, len(b)))
        self.automaton.make_automaton()
        added = spec.get("added_tokens") or []
        if len(added) != 1 or spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only a plain byte-level file with one added token is supported")
        self.special, self.special_id = added[0]["content"].encode(), added[0]["id"]
        top = max(int(self.public.max()), self.special_id) + 1
        table = [b""] * top
        for k, b in enumerate(as_bytes):
            table[self.public[k]] = b
        table[self.special_id] = self.special
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in table])])
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        digits = [f"{i},".encode() for i in range(top)]
        self.digit_offsets = np.concatenate([[0], np.cumsum([len(d) for d in digits])])
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.library = Tokenizer.from_file(path)
        self.split = self.library.pre_tokenizer.pre_tokenize_str
        self.known: dict[int, bool] = {}
        self.words = pretokens.WordIds(lambda pieces: [self.encode_piece(p) for p in pieces])

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE keeps tokens a and b apart where they meet: undo merges from the latest on and look for one across the border that would have come first."""
        key = a << 20 | b
        if (found := self.known.get(key)) is None:
            if len(self.known) >= self.MOST_PAIRS:
                self.known.clear()
            found = self.known[key] = self._compatible(a, b)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        pair, left, right = self.pair, self.left, self.right
        bound = len(left)  # a merge across the border counts if its rank is below this
        while True:
            if pair.get((a, b), bound) < bound:
                return False
            undo_left = a > b
            if undo_left and a < 256 or not undo_left and b < 256:
                undo_left = not undo_left
            if undo_left:
                if a < 256:
                    return True
                bound, a = a, right[a]
            else:
                if b < 256:
                    return True
                bound, b = b + 1, left[b]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece (the special token's text gives its id)."""
        if piece == self.special:
            return [self.special_id]
        if (k := self.whole.get(piece)) is not None:
            return [int(self.public[k])]
        n = len(piece)
        starting: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, token in self.automaton.iter(piece[::-1].decode("latin-1")):
            starting[n - 1 - end].append(token)
        alive = bytearray(b"\1") * (n + 1)
        chosen: list[tuple[int, int, int]] = []  # (position, index in starting, token)
        pos, k, before = 0, 0, -1
        while pos < n:
            options = starting[pos]
            while k < len(options):
                token, size = options[k]
                if alive[pos + size] and (before < 0 or self.compatible(before, token)):
                    break
                k += 1
            if k < len(options):
                chosen.append((pos, k, token))
                pos, k, before = pos + size, 0, token
            else:
                alive[pos] = 0
                pos, k, _ = chosen.pop()
                k += 1
                before = chosen[-1][2] if chosen else -1
        return [int(self.public[t]) for _, _, t in chosen]

    def encode_rows(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, first id of each row)."""
        starts, first = pretokens.token_starts(data, offs, self.special, self.split)
        ids, sizes = self.words(data, starts)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[first]

    def encode(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_rows(raw, np.array([0, len(raw)]))[0].tolist()

    def decode_rows(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all rows, first byte of each row)."""
        sizes = self.offsets[ids + 1] - self.offsets[ids]
        return self.bytes[vec.ragged(self.offsets[ids], sizes)], np.concatenate([[0], np.cumsum(sizes)])[first]

    def decode(self, ids: list[int]) -> str:
        found, _ = self.decode_rows(np.asarray(ids, np.int64), np.array([0, len(ids)]))
        return found.tobytes().decode("utf-8", "replace")

    def decimal_rows(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """Each row's ids in decimals joined by commas."""
        sizes = self.digit_offsets[ids + 1] - self.digit_offsets[ids]
        flat = self.digits[vec.ragged(self.digit_offsets[ids], sizes)].tobytes()
        at = np.concatenate([[0], np.cumsum(sizes)])[first].tolist()
        return [flat[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:], strict=True)]


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary of a file, built once for each Python process."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """docs with an array<int> column of each text's ids and, unless None, the text decoded from them.

    Null texts encode as empty. Columns of docs with the names of the new ones are replaced. The file must be
    at the same path on every executor.
    """
    kept = docs.drop(ids, *([decoded] if decoded else []))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), f"`{ids}` array<int>", *([f"`{decoded}` string"] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for rows, data, offs in vec.slices(batches, text):
            found, first = bpe.encode_rows(data, offs)
            columns = [*rows.columns, pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(found.astype(np.int32)))]
            if decoded:
                back, at = bpe.decode_rows(found, first)
                raw = back.tobytes()
                columns.append(pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*rows.schema.names, ids, *([decoded] if decoded else [])])

    return kept.mapInArrow(run, schema)


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 of every text.

    Null and empty texts have no tokens and the hashes of the empty string. Repeated rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        sha = hashlib.sha256
        for rows, data, offs in vec.slices(batches):
            ids, first = bpe.encode_rows(data, offs)
            back, at = bpe.decode_rows(ids, first)
            raw, at = back.tobytes(), at.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(np.diff(first)),
                    pa.array([sha(x).hexdigest() for x in bpe.decimal_rows(ids, first)]),
                    pa.array([sha(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
