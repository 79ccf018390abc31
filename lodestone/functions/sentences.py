"""Sentences by rules: marks, quotes, abbreviations, initials and numbers, as data for each language.

White space after . ! ? or … (and up to three closing quotes or brackets) ends a sentence, unless a lower-case letter follows (after any opening
quotes or brackets), or the mark is a single full stop after
- an abbreviation that stands before more of the same sentence,
- an initial: one capital letter by itself,
- a number that stands first in its line, or any number of one or two digits where the language writes ordinals with a full stop.
Every rule looks at a few characters on either side, so a text's boundaries do not depend on where a search begins, and the rules are one Java pattern for
split() as well as a check of single places in Python.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Raised when rules or word lists change: stored chunks depend on them.
VERSION = 1
WHITE = " \t\n\u000b\f\r"
MARKS, CLOSING, OPENING = ".!?…", "\"'»”’)]", "\"'«“„‘(["
MOST_CLOSING = MOST_OPENING = 3
#: Characters before a full stop that a rule may need.
REACH = 24


@dataclass(frozen=True)
class Rules:
    language: str
    abbreviations: str
    ordinals: bool = False

    @property
    def words(self) -> list[str]:
        return self.abbreviations.split()

    @property
    def name(self) -> str:
        return f"rules-{VERSION}-{self.language}"


#: Abbreviations, without their last full stop, that go on within a sentence.
RULES = {
    r.language: r
    for r in (
        Rules("en", "mr mrs ms dr prof rev hon st messrs capt col gen lt sgt gov sen rep pres vs nos vol fig figs ch sec pp p ed eds cf e.g i.e viz approx dept est inc ltd jan feb mar apr jun jul aug sep sept oct nov dec"),
        Rules("de", "hr fr dr prof dipl ing st nr abs bd bzw ca d.h evtl ggf gem hrsg i.d.r inkl insb max min mind o.ä s s.o s.u sog str tel u.a usf v.a vgl z.b z.t zzgl jan feb mär apr jun jul aug sep sept okt nov dez", True),
        Rules("fr", "m mm mme mmes mlle mlles dr pr st ste av bd cf chap env ex fig p pp p.ex vol tél janv févr avr juill sept oct nov déc"),
        Rules("es", "sr sra srta sres dr dra prof d dña lic ing av avda cap cf ed fig núm p pp p.ej pág págs tel vol ud uds ee.uu ene feb abr jun jul ago sept oct nov dic"),
        Rules("ru", "г гг ст стст п пп ч см ср рис табл стр с т д ул им проф акад тов гр т.е т.к т.н напр н.э"),
    )
}


def rules_for(language: str | None) -> Rules | None:
    """The rules of a language by its code ("en", "en-GB", "EN"); None where there are none."""
    return RULES.get(re.split(r"[-_]", (language or "").strip().lower())[0])


def rule_name(language: str | None) -> str:
    """What cuts sentences of this language, with its version: part of an index's identity."""
    rules = rules_for(language)
    return rules.name if rules else "marks-1"


def _class(characters: str) -> str:
    return "[" + "".join(re.escape(c) for c in characters) + "]"


@functools.cache
def _before(language: str) -> re.Pattern:
    """What a full stop stands behind where it ends no sentence; to be matched at the end of the text up to it."""
    rules = RULES[language]
    words = "|".join(re.escape(w) for w in sorted(rules.words, key=len, reverse=True))
    return re.compile(rf"(?:^|[^\w.])(?:{words})$", re.IGNORECASE)


def _ends(text: str, mark: int, rules: Rules) -> bool:
    """Whether the full stop at `mark` ends a sentence, as far as what stands before it goes."""
    head = text[max(0, mark - REACH) : mark]
    if _before(rules.language).search(head):
        return False
    alone = len(head) < 2 or not (head[-2].isalnum() or head[-2] in "._")
    if alone and unicodedata.category(head[-1:] or " ") == "Lu":
        return False
    if re.search(r"(?:^|[\n\r])[ \t\x0b\f]{0,19}[0-9]{1,3}$", head):
        return False
    return not (rules.ordinals and re.search(r"(?:^|[^\w.])[0-9]{1,2}$", head))


def sentences(text: str, rules: Rules) -> list[str]:
    """The sentences of a text, trimmed; empty ones are left out."""
    out, begin = [], 0
    for m in re.finditer(rf"({_class(MARKS)}+){_class(CLOSING)}{{0,{MOST_CLOSING}}}({_class(WHITE)}+)", text):
        after = text[m.end() : m.end() + MOST_OPENING + 1]
        follows = re.sub(rf"^{_class(OPENING)}{{0,{MOST_OPENING}}}", "", after)[:1]
        if follows and unicodedata.category(follows) == "Ll":
            continue
        if m[1] == "." and m.start(2) == m.end(1) and not _ends(text, m.start(1), rules):
            continue
        out.append(text[begin : m.start(2)].strip(WHITE))
        begin = m.end()
    out.append(text[begin:].strip(WHITE))
    return [s for s in out if s]


def boundary(language: str) -> str:
    """The Java pattern of the white space between sentences."""
    rules = RULES[language]
    words = "|".join(re.escape(w).replace(r"\.", "[.]") for w in sorted(rules.words, key=len, reverse=True))
    letter, white = r"[\p{L}\p{N}_.]", r"[ \t\n\x0B\f\r]"
    kept = [rf"(?<!{letter})(?iu:{words})", rf"(?<!{letter})\p{{Lu}}", r"(?<=(?:^|[\n\r])[ \t\x0B\f]{0,19})[0-9]{1,3}"]
    if rules.ordinals:
        kept.append(rf"(?<!{letter})[0-9]{{1,2}}")
    closing, opening = (rf"[{re.escape(x)}]" for x in (CLOSING, OPENING))
    ends = rf"(?<=[.!?…]{closing}{{0,{MOST_CLOSING}}})(?<!(?:{'|'.join(kept)})[.])"
    return rf"{ends}(?<!{white}){white}+(?!{opening}{{0,{MOST_OPENING}}}\p{{Ll}})(?!{white})"


def sentence_array(text: Column, language: str) -> Column:
    """sentences() as an expression; null for null."""
    parts = F.split(text, boundary(language))
    trimmed = F.transform(parts, lambda s: F.regexp_replace(s, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", ""))
    return F.filter(trimmed, lambda s: s != "")
