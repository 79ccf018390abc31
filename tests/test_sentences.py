"""Sentence rules: in Python, as a Java pattern, and read character by character."""

from __future__ import annotations

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestone.functions import sentences as S
from lodestone.operators import chunking as C
from lodestone.sources.config import Profile

CASES = {
    "en": ('Dr. Smith met J. R. Hill at 5 p.m. yesterday. He paid 3.50 for e.g. bread. "Really?" he said. "Yes!" She left... and came back.', ["Dr. Smith met J. R. Hill at 5 p.m. yesterday.", "He paid 3.50 for e.g. bread.", '"Really?" he said.', '"Yes!"', "She left... and came back."]),
    "de": ("Am 3. Oktober kam Hr. Meier. Das ist z.B. Unsinn! „Wirklich?“ Ja. Und im Jahr 1990. Ende", ["Am 3. Oktober kam Hr. Meier.", "Das ist z.B. Unsinn!", "„Wirklich?“ Ja.", "Und im Jahr 1990.", "Ende"]),
    "fr": ("M. Dupont est là. Voir p. 5. «Oui.» Il part…\nFin", ["M. Dupont est là.", "Voir p. 5.", "«Oui.»", "Il part…", "Fin"]),
    "es": ("El Sr. López vino. ¿Qué? Nada.", ["El Sr. López vino.", "¿Qué?", "Nada."]),
    "ru": ("В 2020 г. Он пришёл. А. С. Пушкин писал. Конец.", ["В 2020 г. Он пришёл.", "А. С. Пушкин писал.", "Конец."]),
}


def letter(c: str) -> bool:
    return c.isalnum() or c in "_."


def slow_sentences(text: str, rules: S.Rules) -> list[str]:
    """The rules read one character after another."""
    cuts, n = [], len(text)
    for i in range(n):
        if text[i] not in S.WHITE or (i and text[i - 1] in S.WHITE):
            continue
        j = i
        while j < n and text[j] in S.WHITE:
            j += 1
        k = i
        while k and i - k < S.MOST_CLOSING and text[k - 1] in S.CLOSING:
            k -= 1
        marks = [m for m in range(k, i + 1) if m and text[m - 1] in S.MARKS and all(c in S.CLOSING for c in text[m:i])]
        if not marks:
            continue
        t = j
        lower = False
        for _ in range(S.MOST_OPENING + 1):
            if t < n and unicodedata.category(text[t]) == "Ll":
                lower = True
            if t < n and text[t] in S.OPENING:
                t += 1
            else:
                break
        if lower:
            continue
        if text[i - 1] == ".":
            before = text[: i - 1]
            if any(before.lower().endswith(w) and not (len(before) > len(w) and letter(before[-len(w) - 1])) for w in rules.words):
                continue
            if before and unicodedata.category(before[-1]) == "Lu" and not (len(before) > 1 and letter(before[-2])):
                continue
            digits = 0
            while digits < len(before) and before[-1 - digits] in "0123456789":
                digits += 1
            rest = before[: len(before) - digits]
            blanks = len(rest) - len(rest.rstrip(" \t\x0b\f"))
            if 1 <= digits <= 3 and blanks <= 19 and (len(rest) == blanks or rest[-1 - blanks] in "\n\r"):
                continue
            if rules.ordinals and 1 <= digits <= 2 and not (rest and letter(rest[-1])):
                continue
        cuts.append((i, j))
    out, begin = [], 0
    for i, j in cuts:
        out.append(text[begin:i].strip(S.WHITE))
        begin = j
    return [s for s in [*out, text[begin:].strip(S.WHITE)] if s]


def random_texts(language: str, n: int) -> list[str]:
    rng = random.Random(language)
    pool = [*S.RULES[language].words[:12], "A", "Ä", "Б", "b", "Word", "word", "3", "12", "345", "1990", "x.y", "A.B"]
    glue = [". ", ".", "! ", "?\n", "... ", "… ", '." ', ".) ", ".»\t", " ", " ", "\n", "\n  ", ", ", '. "', ". («", ".'')\") ", ".)))) ", "_", "  "]
    return ["".join(rng.choice([str.lower, str.title, str])(rng.choice(pool)) + rng.choice(glue) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


@pytest.mark.parametrize("language", sorted(CASES))
def test_sentences(spark, language):
    text, expected = CASES[language]
    rules = S.RULES[language]
    assert S.sentences(text, rules) == expected and C.sentences(text, language) == expected
    texts = ["", " \n", ".", "Mr. ", text, *random_texts(language, 400)]
    slow = [slow_sentences(t, rules) for t in texts]
    assert [S.sentences(t, rules) for t in texts] == slow
    frame = spark.createDataFrame(list(enumerate([*texts, None])), "id int, t string")
    assert [r["s"] for r in frame.select("id", S.sentence_array(F.col("t"), language).alias("s")).orderBy("id").collect()] == [*slow, None]


def test_which_rules_cut_is_part_of_the_identity():
    assert S.rules_for("en-GB") is S.rules_for(" EN ") and S.rules_for("xx") is None and S.rules_for(None) is None
    assert (S.rule_name("de_AT"), S.rule_name("xx")) == (f"rules-{S.VERSION}-de", "marks-1")
    assert C.sentences("Dr. A came. Late", "xx") == ["Dr.", "A came.", "Late"] and C.sentences("Dr. A came. Late", None) == ["Dr.", "A came.", "Late"]
    a, b = Profile(sentence_language="en").chunking_identity(), Profile(sentence_language="xx").chunking_identity()
    assert a["sentence_rules"] != b["sentence_rules"]


def test_chunks_are_cut_by_the_rules():
    text = "Then Dr. Hill said so and went. " * 30
    assert any(c.endswith("Dr.") for c in C.semantic_chunks(text, 200, 40, 10, "xx"))
    chunks = C.semantic_chunks(text, 200, 40, 10, "en")
    assert len(chunks) > 3 and not any(c.endswith("Dr.") for c in chunks)


def test_hard_limit(spark):
    rows = [(1, "a b " * 100, 4), (2, "short", 2), (3, None, 0), (4, " " * 120, 1), (5, "x" * 100, 7)]
    frame = spark.createDataFrame(rows, "id int, text string, header_len int").repartition(2)
    found = C.hard_limit(frame, 100, 20)
    assert found.columns == ["id", "text", "header_len", "hard_split_index"]
    by_id: dict[int, list] = {}
    for r in found.collect():
        by_id.setdefault(r["id"], []).append((r["hard_split_index"], r["text"], r["header_len"]))
    pieces = C.hard_pieces(rows[0][1], 100, 20)
    assert sorted(by_id[1]) == [(n, p, 0 if n else 4) for n, p in enumerate(pieces)] and len(pieces) > 3
    assert by_id[2] == [(None, "short", 2)] and by_id[3] == [(None, None, 0)] and 4 not in by_id and by_id[5] == [(None, "x" * 100, 7)]
    assert C.hard_limit(frame, 0, 20).where("hard_split_index is null").count() == 5
    assert C.hard_limit(frame.drop("header_len").limit(0), 10, 2).collect() == []
