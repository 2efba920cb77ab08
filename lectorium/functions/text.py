"""Words, titles and names as columns, built from JVM functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LETTERS = r"\p{L}\p{N}_"
WORD = rf"[{LETTERS}]+(?:[-'’][{LETTERS}]+)*"
VOLUME = r"\b(?:т|том|кн|книга|ч|часть|vol|volume|part)\.?\s*(\d+|[IVXLC]+)\b"
STOP_WORDS = "и в во на с со по за как для о об от до из не ни то что это его их при над под без the a an of and or".split()
NARRATOR = r"(?:читает|читают|чтец|исполняет|озвучка|озвучил[аи]?)\s*[:\-–—]?\s*([^,.|()\[\]/]{3,60})"
COUNTRY_LANGUAGES = {"CN": "zh"}
CHAPTERS = r"\bгл\.?\s.*$"
TAGS = r"\[[^\]]*\]|\([^)]*$"
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def normalize_word(word: Column) -> Column:
    """Lower case, ё as е, without anything but letters, digits and underscores."""
    return F.regexp_replace(F.translate(F.lower(word), "ё", "е"), f"[^{LETTERS}]", "")


def normal_words(text: Column) -> Column:
    """The normalised words of a text: as ``normalize_word`` gives them for ``words``, but by one regular expression over the whole text."""
    even = F.translate(F.lower(F.translate(text, "İ", "i")), "ё", "е")
    return F.transform(words(even), lambda w: F.translate(w, "-'’", ""))


def norm_title(title: Column) -> Column:
    """A title for comparison: no case, volume marks, chapter ranges, bracketed tags or signs."""
    t = F.translate(F.lower(F.coalesce(title, F.lit(""))), "ё", "е")
    t = F.regexp_replace(t, f"(?iU){VOLUME}", " ")
    t = F.regexp_replace(t, f"(?U){CHAPTERS}", " ")
    t = F.regexp_replace(t, TAGS, " ")
    return F.trim(F.regexp_replace(t, f"[^{LETTERS}]+", " "))


def title_words(title: Column) -> Column:
    return F.filter(F.split(norm_title(title), " "), lambda w: w != "")


def stop_words() -> Column:
    return F.array(*[F.lit(w) for w in STOP_WORDS])


def terms(query: Column) -> Column:
    """Meaningful distinct words of a query, longest first, else in their order."""
    kept = F.array_distinct(F.filter(title_words(query), lambda w: (F.length(w) > 2) & ~F.array_contains(stop_words(), w)))
    placed = F.transform(kept, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    return F.transform(F.array_sort(placed), lambda x: x["w"])


def said_words(query: Column) -> Column:
    """Words of a query that judge a row: two letters or more, no stop words, in their order."""
    return F.filter(title_words(query), lambda w: (F.length(w) > 1) & ~F.array_contains(stop_words(), w))


def same_word(a: Column, b: Column) -> Column:
    """Equal up to the ending."""
    short = F.least(F.length(a), F.length(b))
    gap = F.abs(F.length(a) - F.length(b))
    stem = F.greatest(F.lit(3), short - 2)
    return (a == b) | ((short >= 3) & (gap <= F.when(short == 3, 2).otherwise(3)) & (F.substring(a, F.lit(1), stem) == F.substring(b, F.lit(1), stem)))


def matched(query_words: Column, row_text: Column) -> Column:
    """How many of the query's words a row names."""
    said = title_words(row_text)
    return F.size(F.filter(query_words, lambda w: (F.length(w) > 1) & F.exists(said, lambda x: same_word(w, x))))


def title_score(query: Column, query_words: Column, title: Column, row_text: Column) -> Column:
    """How close a row is to what was typed; ``row_text`` is title, author and translator."""
    want, own = norm_title(query), norm_title(title)
    said = title_words(title)
    meaningful = lambda ws: F.filter(ws, lambda w: ~F.array_contains(stop_words(), w))
    exact = F.when(own == want, 6).when(F.startswith(own, want), 4).when((want != "") & F.contains(own, want), 2).otherwise(0)
    named, asked = meaningful(said), meaningful(title_words(query))
    covered = F.when((F.size(named) > 0) & F.forall(named, lambda t: F.exists(asked, lambda w: same_word(t, w))), 5).otherwise(0)
    count = matched(query_words, row_text)
    answered = F.when((F.size(query_words) > 0) & (count == F.size(query_words)), 6).otherwise(0)
    in_title = F.size(F.filter(query_words, lambda w: F.exists(said, lambda x: same_word(w, x))))
    return exact + covered + answered + 2 * in_title + count


def roman_value(text: Column) -> Column:
    """A roman number; letters that are none count 0."""
    values = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    letters = F.reverse(F.filter(F.split(F.upper(text), ""), lambda c: c != ""))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        v = F.coalesce(F.element_at(values, c), F.lit(0))
        return F.struct((acc["total"] + F.when(v < acc["most"], -v).otherwise(v)).alias("total"), F.greatest(acc["most"], v).alias("most"))

    return F.aggregate(letters, start, step, lambda acc: acc["total"])


def volume_number(title: Column) -> Column:
    """The number after a volume word, arabic or roman; null if none or 0."""
    mark = F.regexp_extract(F.coalesce(title, F.lit("")), f"(?iU){VOLUME}", 1)
    number = F.when(mark.rlike(r"^\d+$"), mark.try_cast("int")).when(mark != "", roman_value(mark))
    return F.nullif(number, F.lit(0))


def clean_title(title: Column) -> Column:
    """One line without control characters or doubled white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(title, r"[\x00-\x1f\x7f]", " "), r"\s+", " "))


def slug(title: Column, table: dict[str, str] | None = None) -> Column:
    """Lower case ASCII with dashes, 48 characters at most, ``book`` if nothing is left; ``table`` transliterates."""
    t = F.lower(title)
    if table:
        letters = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        t = F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(F.element_at(letters, c), c)), "")
    t = F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(t, 1, 48), F.lit("")), F.lit("book"))


def stems(title: Column, letters: int = 5) -> Column:
    """The distinct beginnings of a title's words of three letters or more."""
    return F.array_distinct(F.transform(F.filter(title_words(title), lambda w: F.length(w) > 2), lambda w: F.left(w, F.lit(letters))))


def natural_key(name: Column, width: int = 12) -> Column:
    """A sort key in which runs of digits count as numbers."""
    padded = F.regexp_replace(F.lower(name), r"(\d+)", "0" * width + "$1")
    return F.regexp_replace(padded, rf"0*(\d{{{width}}})(?!\d)", "$1")


def marker(text: Column) -> Column:
    """A note's marker without brackets and spaces."""
    return F.trim(F.trim(F.trim(text), F.lit("[]{}()")))


def join_title(lines: Column) -> Column:
    """Title lines as one, with a full stop between lines that don't end in punctuation."""
    return F.aggregate(
        F.filter(lines, lambda x: F.trim(x) != ""),
        F.lit(""),
        lambda acc, x: F.when(acc == "", F.trim(x)).when(acc.rlike(r"[.!?…:;,]\z"), F.concat(acc, F.lit(" "), F.trim(x))).otherwise(F.concat(acc, F.lit(". "), F.trim(x))),
    )


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_label(url: Column) -> Column:
    """A name from a URL: its host's main label and its longest run of digits, the last among equals."""
    labels = F.split(F.regexp_replace(url_host(url), r"^(www|m|blog)\.", ""), r"\.")
    runs = F.regexp_extract_all(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), F.lit(r"(\d+)"), F.lit(1))
    best = F.get(F.array_sort(F.transform(runs, lambda r, i: F.struct((-F.length(r)).alias("n"), (-i).alias("i"), r.alias("r")))), F.lit(0))["r"]
    return F.concat_ws("-", F.regexp_replace(F.get(labels, F.lit(0)), "-", ""), best)


def typed_match(text: Column, typed: Column) -> Column:
    """Whether a text holds what was typed, both without case and signs; nothing typed is in every text."""
    even = lambda c: F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё", "е"), r"[^\p{L}\p{N}]+", " "))
    return (F.coalesce(typed, F.lit("")) == "") | F.contains(even(text), even(typed))


def is_video(name: Column, seconds: Column, live: Column) -> Column:
    """Whether a video can be a reading: a proper id, five minutes or more, neither live nor announced."""
    return F.coalesce(name.rlike("^[A-Za-z0-9_-]{11}$") & (seconds >= 300), F.lit(False)) & ~F.coalesce(live.isin("is_live", "is_upcoming"), F.lit(False))


def narrator(title: Column, channel: Column) -> Column:
    """Who reads, where the title says so, else the channel."""
    named = F.trim(F.regexp_extract(title, f"(?iu){NARRATOR}", 1), F.lit(" -–—"))
    return F.when(title.rlike(f"(?iu){NARRATOR}"), named).otherwise(channel)


def file_parts(name: Column, author: str, full_name: str) -> Column:
    """A struct (title, lang, author) of a file's name: words joined by hyphens, a code in capitals at the end, the author's name (a pattern) anywhere."""
    spaced = F.regexp_replace(name, r"(?U)(?<=\w)-(?=\w)", " ")
    code = F.regexp_extract(spaced, r"[\s-]([A-Z]{2})$", 1)
    languages = F.create_map(*[F.lit(x) for pair in COUNTRY_LANGUAGES.items() for x in pair])
    bare = F.regexp_replace(F.regexp_replace(spaced, r"[\s-][A-Z]{2}$", ""), rf"(?iU)[\s-]*{author}\b", " ")
    title = F.trim(F.regexp_replace(bare, r"\s+", " "), F.lit(" -"))
    return F.struct(
        F.coalesce(F.nullif(title, F.lit("")), name).alias("title"),
        F.coalesce(F.element_at(languages, code), F.lower(code)).alias("lang"),
        F.when(spaced.rlike(f"(?iU){author}"), full_name).otherwise("").alias("author"),
    )
