"""Two-letter language codes from names and three-letter codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Three-letter codes (both forms) and English names of languages.
CODES = {
    "eng": "en", "rus": "ru", "ger": "de", "deu": "de", "fre": "fr", "fra": "fr", "spa": "es", "ita": "it", "dut": "nl",
    "nld": "nl", "por": "pt", "pol": "pl", "ukr": "uk", "chi": "zh", "zho": "zh", "jpn": "ja", "lat": "la", "gre": "el",
    "ell": "el", "heb": "he", "ara": "ar", "swe": "sv", "dan": "da", "fin": "fi", "hun": "hu", "cze": "cs", "ces": "cs",
    "tur": "tr", "yid": "yi", "kor": "ko",
}
NAMES = {
    "chinese": "zh", "danish": "da", "dutch": "nl", "english": "en", "finnish": "fi", "french": "fr", "german": "de",
    "greek": "el", "hungarian": "hu", "italian": "it", "japanese": "ja", "latin": "la", "polish": "pl", "portuguese": "pt",
    "russian": "ru", "spanish": "es", "swedish": "sv", "ukrainian": "uk", "czech": "cs", "hebrew": "he",
}


def language_code(stated: Column) -> Column:
    """The two-letter code of the first language that a text states, by code or English name; '' if it states none."""
    first = F.lower(F.trim(F.get(F.split(F.coalesce(stated, F.lit("")), ","), F.lit(0))))
    known = F.create_map(*[F.lit(x) for pair in (CODES | NAMES).items() for x in pair])
    return F.coalesce(F.element_at(known, first), F.when(F.length(first) == 2, first), F.lit(""))


def title_language(title: Column) -> Column:
    """The title without a language in brackets at its end, and that language's code: a struct (title, lang)."""
    name = F.regexp_extract(title, r"\(([A-Za-z]+)\)\s*$", 1)
    known = F.element_at(F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair]), F.lower(name))
    return F.struct(F.when(known.isNotNull(), F.rtrim(F.regexp_replace(title, r"\s*\([A-Za-z]+\)\s*$", ""))).otherwise(title).alias("title"), F.coalesce(known, F.lit("")).alias("lang"))
