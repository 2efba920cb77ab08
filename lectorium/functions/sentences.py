"""Splitting a text into sentences, by rules for Russian and English."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations that don't end a sentence, and those that do before a capital of their script.
ABBREVIATIONS = {
    "т", "е", "д", "г", "гг", "стр", "см", "им", "ул", "св", "проф", "др", "пр", "тыс", "млн", "млрд",
    "с", "гл", "в", "вв", "ст", "п", "ч", "н", "к", "изд", "ок", "акад", "англ", "нем", "франц", "фр", "лат",
    "кит", "греч", "санскр", "рис", "табл", "прим", "ред", "пер", "ср", "напр", "сокр", "букв", "вып",
    "e", "g", "i", "mr", "mrs", "dr", "st", "vs", "etc", "p", "pp", "ch", "vol",
}
WEAK = {
    "т", "е", "д", "г", "с", "в", "п", "ч", "н", "к", "e", "g", "i", "p",
    "им", "кит", "ок", "ст", "гл", "изд", "пер", "ред", "нем", "лат", "англ", "франц", "рис", "букв",
    "млн", "млрд", "тыс", "стр", "др", "пр",
}
OPENERS = "«\"“'–—-(["
HEADINGS = frozenset(("title", "subtitle"))

_END = re.compile(r"[.!?…]+[»\"”)\]]*")
_GAP = re.compile(r"[ \n]*")
_LETTER = "А-яЁёA-Za-z"
_WORD_BEFORE = re.compile(rf"[{_LETTER}]*\Z")
_NUMBER = re.compile(r"[0-9]{1,3}|[IVXLC]{1,6}")
_AND_SO_ON = re.compile(rf"(?:(?<![{_LETTER}])и[ \n]+(?:др|пр|т\.[ \n]*[дп])|(?<![{_LETTER}])etc)\Z", re.I)
_ANSWERS = re.compile(r"(?:[!?…][»\"”)\]]*[ \n]*(?:[—–][ \n]*)?|[.:][»\"”)\]]*[ \n]*[—–][ \n]*)\Z")
_OPENS_DIALOGUE = re.compile(r"[ \n]*[—–][ \n]*\Z")
_IS_LETTER = re.compile(f"[{_LETTER}]")


def _script(c: str) -> str:
    return "" if not _IS_LETTER.match(c) else "latin" if c < "\x80" else "cyrillic"


def _initial_ends(text: str, at: int, dot: int, follow: int) -> bool:
    """Whether a single capital at ``at`` ends a sentence before the capital at ``follow``."""
    if text[follow + 1 : follow + 2] == ".":
        return False
    before = text[:at].rstrip(" \n")
    own_script = _script(text[follow]) == _script(text[at]) or not _IS_LETTER.match(before[-1:])
    surname = own_script and _IS_LETTER.match(text[follow + 1 : follow + 2])
    if not surname or "\n" in text[dot:follow]:
        return True
    window = text[max(0, at - 200) : at]
    return bool(_ANSWERS.search(window)) or at <= 200 and bool(_OPENS_DIALOGUE.fullmatch(window))


def _goes_on(text: str, begin: int, mark: re.Match, follow: int, first: bool) -> bool:
    """Whether the full stop belongs to an abbreviation, an initial or a list number."""
    dot = mark.start()
    word = _WORD_BEFORE.search(text, max(begin, dot - 40), dot)[0]
    at = dot - len(word)
    after = text[follow : follow + 1]
    low = word.lower()
    if len(word) == 1 and word.isupper():
        return not (after.isupper() and _initial_ends(text, at, dot, follow))
    if low in WEAK or low in ABBREVIATIONS:
        final = low not in WEAK and bool(_AND_SO_ON.search(text, max(begin, dot - 40), dot))
        if low in WEAK:
            return not after.isupper() or _script(after) != _script(word)
        return not (after.isupper() and final)
    return first and mark.end() == dot + 1 and bool(_NUMBER.fullmatch(text[begin:dot].strip()))


def sentence_ranges(text: str) -> list[tuple[int, int]]:
    """Sentences as (start, end) in code points, without white space at their ends."""
    cuts, begin = [], 0
    for mark in _END.finditer(text):
        follow = _GAP.match(text, mark.end()).end()
        if mark.end() == len(text) or follow == mark.end():
            continue
        if text[mark.start()] == "." and _goes_on(text, begin, mark, follow, not cuts):
            continue
        after = text[follow : follow + 1]
        if after and not (after.isupper() or after.isdigit() or after in OPENERS):
            continue
        cuts.append((begin, mark.end()))
        begin = follow
    out = []
    for a, b in [*cuts, (begin, len(text))]:
        piece = text[a:b]
        a += len(piece) - len(piece.lstrip(" \n"))
        b -= len(piece) - len(piece.rstrip(" \n"))
        if a < b:
            out.append((a, b))
    return out


def block_ranges(text: str, kind: str) -> list[tuple[int, int]]:
    """A heading is one sentence; other blocks are split."""
    return [(0, len(text))] if kind in HEADINGS else sentence_ranges(text)


def row_ranges(cells: Iterable[Iterable[tuple[int, int]]], text: str) -> list[tuple[int, int]]:
    """A table's rows as sentences, each from its first to its last cell, trimmed."""
    out = []
    for row in cells:
        row = list(row)
        a, b = min(c[0] for c in row), max(c[1] for c in row)
        piece = text[a:b]
        if piece.strip():
            out.append((a + len(piece) - len(piece.lstrip()), b - len(piece) + len(piece.rstrip())))
    return out


def sentences(text: Column) -> Column:
    """Ranges of a text's sentences."""

    @F.pandas_udf("array<struct<s: int, e: int>>")
    def ranges(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"s": a, "e": b} for a, b in sentence_ranges(t or "")])

    return ranges(text)
