"""Vectorised byte-level pre-tokenisation and a ragged word-to-ids dictionary, shared by the token operators.

The split is that of the byte-level pre-tokenizer of the public tokenizers: contractions, runs of letters, numbers
or other characters with one space before them, and runs of white space. It is computed on whole slices
of rows with numpy. Rows with a character outside SAFE, where Unicode versions differ, are split by the
tokenizers library itself, so that all texts get the library's pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from lodestone.llm import vec

#: Code point ranges whose classes do not depend on the Unicode version.
SAFE = ((0x0, 0x52F), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x3000, 0x303F), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
SPACE, LETTER, NUMBER, OTHER, UNSAFE = range(5)
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of each code point."""
    global _classes
    if _classes is None:
        import regex

        table = np.full(0x110000, UNSAFE, np.uint8)
        for a, b in SAFE:
            points = "".join(map(chr, range(a, b + 1)))
            for kind, pattern in ((OTHER, r"[^\s\p{L}\p{N}]"), (SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
                table[[ord(x) for x in regex.findall(pattern, points)]] = kind
        _classes = table
    return _classes


def token_starts(data: np.ndarray, offs: np.ndarray, special: bytes, library_split: Callable[[str], list]) -> tuple[np.ndarray, np.ndarray]:
    """(byte starts of all pieces, with the total length at the end; first piece of each row).

    `special` (an added token's text, never empty) is a piece of its own wherever it stands.
    """
    raw = data.tobytes()
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    if n == len(data):
        byte_at, rows = np.arange(n + 1), offs
    else:
        byte_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        rows = np.searchsorted(byte_at, offs)
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)  # where no piece goes on and no look-ahead sees across
    edge[rows] = True
    inner = []
    at = raw.find(special)
    while at >= 0:
        row = int(np.searchsorted(offs, at, "right")) - 1
        if at + len(special) <= offs[row + 1]:
            a, b = np.searchsorted(byte_at, [at, at + len(special)])
            edge[[a, b]] = True
            inner.append((int(a), int(b)))
            at = raw.find(special, at + len(special))
        else:
            at = raw.find(special, at + 1)
    start = edge.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    if n > 1:
        j = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:n])
        start[j] = True
        start[j[points[j] == 0x20] + 1] = False
        q = np.flatnonzero((points[:-1] == 0x27) & start[: n - 1] & (kind[1:] == LETTER) & ~edge[1:n])
        if len(q):
            one, two = points[q + 1], points[np.minimum(q + 2, n - 1)]
            both = (q + 2 < n) & ~edge[np.minimum(q + 2, n)]
            short = np.isin(one, [ord(x) for x in "stmd"])
            long = both & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
            start[q[short | long] + 1] = False
            start[q[short] + 2] = True
            start[q[long] + 3] = True
    for r in np.unique(np.searchsorted(rows, np.flatnonzero(kind == UNSAFE), "right") - 1):
        a, b = int(rows[r]), int(rows[r + 1])
        start[a:b] = False
        cuts = [a, *(x for s in inner if a <= s[0] < b for x in s), b]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo < hi:
                text = points[lo:hi].tobytes().decode("utf-32-le")
                start[[lo + s for _, (s, e) in library_split(text) if s < e] or [lo]] = True
                start[lo] = True
    for a, b in inner:
        start[a + 1 : b] = False
    start[n] = True
    pieces = np.flatnonzero(start)
    return byte_at[pieces], np.searchsorted(pieces, rows)


class WordIds:
    """Ids of pieces, found by the 64-bit hash of their bytes; `encode` gets the missing distinct pieces as bytes.

    The bytes of each entry are kept and compared whenever its hash is met, so a piece whose hash belongs to another one is encoded for itself. The dictionary is emptied when full.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], bits: int = 21, keys: Callable[..., np.ndarray] = vec.span_hashes):
        self.encode, self.memo, self.keys = encode, vec.Memo(bits), keys
        self.clear()

    def clear(self) -> None:
        self.memo.clear()
        self.at, self.len, self.ids, self.n, self.used = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.int32), 0, 0
        self.text_at, self.text_len, self.text, self.text_used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 16, np.uint8), 0

    def _append(self, pieces: list[bytes]) -> np.ndarray:
        """New entries for pieces."""
        found, joined = self.encode(pieces), np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.fromiter((x for ids in found for x in ids), np.int32, int(sizes.sum()))
        entries = self.n + len(found)
        for name, need in (("at", entries), ("len", entries), ("text_at", entries), ("text_len", entries), ("ids", self.used + len(flat)), ("text", self.text_used + len(joined))):
            old = getattr(self, name)
            if need > len(old):
                grown = np.zeros(max(need, 2 * len(old)), old.dtype)
                grown[: len(old)] = old
                setattr(self, name, grown)
        made = np.arange(self.n, entries)
        self.at[made], self.len[made] = self.used + np.cumsum(sizes) - sizes, sizes
        self.text_at[made], self.text_len[made] = self.text_used + np.cumsum(lengths) - lengths, lengths
        self.ids[self.used : self.used + len(flat)] = flat
        self.text[self.text_used : self.text_used + len(joined)] = joined
        self.n, self.used, self.text_used = entries, self.used + len(flat), self.text_used + len(joined)
        return made

    def __call__(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each piece); starts ends with the total length."""
        begin, end = starts[:-1], starts[1:]
        if self.memo.size > self.memo.limit:
            self.clear()
        keys = self.keys(data, begin, end)
        entry = self.memo.find(keys)
        missing = np.flatnonzero(entry < 0)
        raw = data.tobytes()

        def pieces(which: np.ndarray) -> list[bytes]:
            return [raw[a:b] for a, b in zip(begin[which].tolist(), end[which].tolist(), strict=True)]

        if len(missing):
            new, first, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            made = self._append(pieces(missing[first]))
            self.memo.add(new, made)
            entry[missing] = made[back]
        size = end - begin
        alike = self.text_len[entry] == size
        alike[alike] = vec.equal_spans(data, begin[alike], self.text[: self.text_used], self.text_at[entry[alike]], size[alike])
        if len(other := np.flatnonzero(~alike)):  # their hashes belong to other pieces
            entry[other] = self._append(pieces(other))
        sizes = self.len[entry].astype(np.int64)
        return self.ids[vec.ragged(self.at[entry].astype(np.int64), sizes)], sizes
