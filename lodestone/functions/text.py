"""Text rules as Column expressions: normalisation, keys, escaping, headings, headers and snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space of Python's str.split().
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Fixed value: the same characters but the blank, and all of them as a text.
NOT_BLANK = WHITE.replace(r"\x1c-\x20", r"\x1c-\x1f")
#: Most letters lie here, which are told from white space by one look.
LETTERS = r"[!-~\x{a1}-\x{167f}]"
WHITE_CHARS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Fixed value: what one trailing run of may go from a question before it is looked up.
TRAILING = "?!.,…:;"
#: Answers without a model call.
NO_BASIS = {
    "ru": "Недостаточно данных в подключенных источниках, чтобы дать обоснованный ответ.",
    "en": "The available sources do not provide enough information for a grounded answer.",
}
SNIPPET_CHARS, PREVIEW_CHARS = 280, 300


def _normalised(text: Column, compatible: bool) -> Column:
    """A normal form by the Unicode data of the ICU library that Spark itself ships. ASCII texts stay as they are in every form.

    All code points that Python's unicodedata knows get its result; forms of assigned characters never change between versions.
    """
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(compatible))
    return F.when(F.octet_length(text) == F.char_length(text), text).when(text.isNotNull(), composed)


def nfc(text: Column) -> Column:
    return _normalised(text, compatible=False)


def nfkc(text: Column) -> Column:
    return _normalised(text, compatible=True)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_CHARS))


def squeeze(text: Column) -> Column:
    """Trimmed, with each run of white space as one space; null becomes ''. Single blanks, which are most, are not touched."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"(?!{LETTERS})(?:{WHITE}{{2,}}|{NOT_BLANK})", " "))


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def content_text(text: Column, composed: bool = False) -> Column:
    """The text by which copies are told: NFC, squeezed; letter case and punctuation stay."""
    return squeeze(text if composed else nfc(text))


def content_key(text: Column, composed: bool = False) -> Column:
    """SHA-256 of content_text, null if that is empty."""
    # as a list of one element, so that the text is worked out once
    return F.get(F.transform(F.array(content_text(text, composed)), lambda t: F.when(t != "", F.sha2(t, 256))), F.lit(0))


def squeeze_nfkc(text: Column) -> Column:
    """squeeze(nfkc(text)) by the function of commons-lang that Spark ships, as NFKC leaves no white space that it doesn't know but one; a pattern takes several times as long.

    A mark at both ends keeps control characters there, which it would trim.
    """
    known = F.replace(F.coalesce(nfkc(text), F.lit("")), F.lit("\x85"), F.lit(" "))
    marked = F.reflect(F.lit("org.apache.commons.lang3.StringUtils"), F.lit("normalizeSpace"), F.concat(F.lit("|"), known, F.lit("|")))
    # as a list of one element, so that it is worked out once
    return F.get(F.transform(F.array(marked), lambda m: F.trim(F.substring(m, F.lit(2), F.char_length(m) - 2))), F.lit(0))


def question_text(question: Column) -> Column:
    """NFKC, squeezed, lower case, without one trailing run of punctuation."""
    return F.trim(F.rtrim(F.lower(squeeze_nfkc(question)), F.lit(TRAILING)))


def question_key(question: Column, answer_fingerprint: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{answer_fingerprint}||"), question_text(question)), 256)


def has_cyrillic(text: Column) -> Column:
    return F.coalesce(text.rlike("[А-Яа-яЁё]"), F.lit(False))


def no_basis_answer(question: Column) -> Column:
    return F.when(has_cyrillic(question), NO_BASIS["ru"]).otherwise(NO_BASIS["en"])


def escape_body(text: Column) -> Column:
    """Every tag begins with <, so text with that escaped can form none."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<"), F.lit("&lt;"))


def escape_attribute(value: Column) -> Column:
    out = squeeze(value)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.when(c != "", c) for c in columns))


def fragment(number: Column, text: Column, source_display: Column, source: Column, kind: Column, heading: Column) -> Column:
    """One numbered context fragment; attributes without a value are left out."""
    attributes = [F.concat(F.lit('number="'), number.cast("string"), F.lit('"'))]
    for name, value in (("source", filled(source_display, source)), ("type", filled(kind)), ("heading", filled(heading))):
        attributes.append(F.concat(F.lit(f'{name}="'), F.when(value.isNotNull(), escape_attribute(value)), F.lit('"')))
    return F.concat(F.lit("<retrieved_fragment "), F.concat_ws(" ", *attributes), F.lit(">\n"), escape_body(text), F.lit("\n</retrieved_fragment>"))


def shortened(text: Column, limit: int, mark: str) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(mark))).otherwise(text)


def snippet(text: Column, header_len: Column) -> Column:
    """A card's text: without the header, if its length is a number inside the text; trimmed and cut."""
    n = header_len.try_cast("int")
    body = F.when((n > 0) & (n < F.length(text)), F.substring(text, n + 1, F.length(text))).otherwise(text)
    return shortened(strip(F.coalesce(body, F.lit(""))), SNIPPET_CHARS, "...")


def preview(text: Column) -> Column:
    return shortened(strip(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))), PREVIEW_CHARS, "...")


def sha_embedding(text: Column) -> Column:
    """A deterministic stand-in for a model: (byte + 1) / 256 of the first 8 bytes of the SHA-256."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    return F.array(*((F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("double") + 1) / 256 for i in range(8)))


def code_point_embedding(text: Column) -> Column:
    """Another stand-in: 1.0, then for each i below 7 the sum of the code points at i, i + 7, i + 14, ... modulo 97."""
    points = F.transform(F.split(F.coalesce(text, F.lit("")), ""), lambda c: F.ascii(c))
    points = F.when(F.length(F.coalesce(text, F.lit(""))) > 0, points).otherwise(F.array().cast("array<int>"))

    def part(i: int) -> Column:
        return F.aggregate(F.filter(points, lambda _, at: at % 7 == i), F.lit(0).cast("long"), lambda a, x: a + x) % 97

    return F.array(F.lit(1.0), *(part(i).cast("double") for i in range(7)))


def finite(distance: Column) -> Column:
    d = distance.cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    hits = F.lit(0)
    for k in keywords:
        hits = hits + F.contains(text, F.lit(k)).cast("int")
    return hits
