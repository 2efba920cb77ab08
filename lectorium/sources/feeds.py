"""Answers of catalogues as hits and recordings: feeds, JSON searches, item metadata, pages with a player.

Each takes rows with the body of an answer and gives one row for each thing in it, with the
columns ``keep`` of the answer's row. Only what a catalogue states is taken over; what is
not stated is '' or null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.languages import language_code, title_language
from ..functions.num import clock_seconds
from ..functions.queries import spoken_seconds
from ..functions.text import file_parts, is_video, narrator, natural_key
from ..operators.markup import Node, tree

# File formats of texts and of sound, best first (with their kind, and whether
# only the uploader's own file counts), and the rate at which a site encodes its recordings.
TEXT_FORMATS = (("EPUB", "epub", True), ("DjVuTXT", "txt", False), ("Text PDF", "pdf", False), ("Additional Text PDF", "pdf", False))
SOUND_FORMATS = ("VBR MP3", "128Kbps MP3", "64Kbps MP3", "MP3")
SITE_KBPS = 128


def plain(markup: Column) -> Column:
    """The text of a piece of markup that may be escaped twice."""

    @F.pandas_udf("string")
    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else " ".join(re.sub(r"<[^>]*>", " ", unescape(unescape(t))).split()))

    return of(markup)


def address(url: Column, base: str) -> Column:
    return F.when(F.startswith(url, F.lit("/")), F.concat(F.lit(base), url)).otherwise(url)


def found(text: Column, pattern: str) -> Column:
    """The first group of a pattern, null if it is not there."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def entries(df: DataFrame, body: str = "body") -> DataFrame:
    """The entries of Atom feeds: the columns of ``df``, ``pos`` and ``entry``."""
    each = F.regexp_extract_all(body, F.lit(r"(?s)<entry\b[^>]*>(.*?)</entry>"), F.lit(1))
    return df.select("*", F.posexplode(each).alias("pos", "entry"))


def authors(entry: Column) -> Column:
    names = F.regexp_extract_all(entry, F.lit(r"(?s)<author>\s*<name>(.*?)</name>"), F.lit(1))
    return F.array_join(names, ", ")


def feed_hits(df: DataFrame, source: str, base: str = "", body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """Books of OPDS feeds. The link is that of the FB2 file, else of the EPUB, else made of the book's page; entries without any are none."""
    e = F.col("entry")
    link = lambda kind: F.coalesce(found(e, rf'href="([^"]+)"[^>]*type="application/{kind}\+zip"'), found(e, rf'type="application/{kind}\+zip"[^>]*href="([^"]+)"'))
    page = F.coalesce(found(e, r'href="(?:https?://[^/"]+)?/b/(\d+)"'), found(e, r'href="[^"]*/i/\d+/(\d+)/cover'))
    fb2 = F.coalesce(link("fb2"), F.when(link("epub").isNull() & page.isNotNull(), F.concat(F.lit("/b/"), page, F.lit("/fb2"))))
    url = F.coalesce(fb2, link("epub"))
    told = entries(df, body).withColumn("_info", plain(F.regexp_extract(e, r"(?s)<content[^>]*>(.*?)</content>", 1))).where(url.isNotNull())
    info = F.col("_info")
    kind = F.coalesce(F.lower(found(info, r"(?i)Формат:\s*([a-z0-9]+)")), F.when(fb2.isNotNull(), "fb2").otherwise("epub"))
    translator = F.trim(F.coalesce(found(info, r"Перевод(?:чик)?:\s*(.+?)\s*(?:Год издания|Формат|Язык|Размер|Скачиваний|$)"), F.lit("")), F.lit(" .,;"))
    return told.select(
        *keep, F.lit(source).alias("source"), "pos", plain(F.regexp_extract(e, r"(?s)<title>(.*?)</title>", 1)).alias("title"), plain(authors(e)).alias("author"), translator.alias("translator"),
        F.coalesce(found(info, r"Год издания:\s*(\d{4})"), F.lit("")).alias("year"), found(info, r"Размер:\s*(\d+)\s*[KК][bБ]").cast("int").alias("size_kb"),
        F.coalesce(found(e, "<dc:language>(.*?)</dc:language>"), F.lit("")).alias("lang"), address(url, base).alias("url"), kind.alias("kind"),
    )


def next_page(body: Column, base: str = "") -> Column:
    """The address of a feed's next page, null on the last one."""
    href = F.coalesce(found(body, r'<link[^>]*href="([^"]+)"[^>]*rel="next"'), found(body, r'<link[^>]*rel="next"[^>]*href="([^"]+)"'))
    return address(F.replace(href, F.lit("&amp;"), F.lit("&")), base)


def paged(spark: SparkSession, fetch: Callable[[str], str], url: str, base: str = "", most: int = 5) -> DataFrame:
    """A feed's pages (``page``, ``body``), fetched one after another, so many at most; the driver sees only this one feed."""

    def walk(at: str | None) -> Iterator[tuple[int, str]]:
        for k in range(most):
            if not at:
                return
            body = fetch(at)
            yield k, body
            m = re.search(r'<link[^>]*href="([^"]+)"[^>]*rel="next"', body) or re.search(r'<link[^>]*rel="next"[^>]*href="([^"]+)"', body)
            at = unescape(m[1]) if m else None
            at = base + at if at and at.startswith("/") else at

    return spark.createDataFrame(list(walk(url)), "page int, body string")


def download_hits(df: DataFrame, source: str, url_format: str, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """Books of a feed whose entries name them by number (``…/ebooks/N.opds``); a language may stand after the title."""
    e = F.col("entry")
    number = found(e, r"<id>[^<]*/ebooks/(\d+)\.opds</id>")
    named = title_language(plain(F.regexp_extract(e, r"(?s)<title>(.*?)</title>", 1)))
    by = plain(F.regexp_extract(e, r"(?s)<content[^>]*>(.*?)</content>", 1))
    author = F.when(by.rlike(r"^\d+ downloads?$"), "").otherwise(by)
    return entries(df, body).where(number.isNotNull()).select(*keep, F.lit(source).alias("source"), "pos", named["title"].alias("title"), author.alias("author"), named["lang"].alias("lang"), F.format_string(url_format, number).alias("url"), F.lit("epub").alias("kind"))


def wiki_hits(df: DataFrame, source: str, lang: str, url_format: str, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """Whole works of a wiki's search, in its order: no parts of works, no lists of editions."""
    schema = "query struct<pages: array<struct<title: string, index: int, pageprops: map<string, string>>>>"
    pages = df.select("*", F.inline(F.from_json(body, schema)["query"]["pages"]))
    works = pages.where(~F.contains("title", F.lit("/")) & ~F.coalesce(F.map_contains_key("pageprops", "disambiguation"), F.lit(False)))

    @F.pandas_udf("string")
    def quoted(titles: pd.Series) -> pd.Series:
        return titles.map(lambda t: url_format.format(lang=lang, page=quote(t.replace(" ", "_"), safe="()_,'")))

    return works.select(*keep, F.lit(source).alias("source"), F.coalesce("index", F.lit(0)).alias("pos"), "title", quoted("title").alias("url"), F.lit("epub").alias("kind"), F.lit(lang).alias("lang"))


def media_hits(df: DataFrame, source: str, author_pattern: str, author: str, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """Files of a media library's JSON list; title, language and author are in a file's name. Only PDF files with a name count."""
    schema = "array<struct<source_url: string, title: struct<rendered: string>, media_details: struct<filesize: long>>>"
    items = df.select("*", F.posexplode(F.from_json(body, schema)).alias("pos", "item")).where("item.title.rendered <> ''")
    pdf = items.where(F.endswith(F.lower("item.source_url"), F.lit(".pdf")))
    named = file_parts(plain(F.col("item.title.rendered")), author_pattern, author)
    return pdf.select(*keep, F.lit(source).alias("source"), "pos", named["title"].alias("title"), named["author"].alias("author"), named["lang"].alias("lang"), F.col("item.source_url").alias("url"), F.lit("pdf").alias("kind"), F.floor(F.nullif("item.media_details.filesize", F.lit(0)) / 1024).cast("int").alias("size_kb"))


def search_hits(df: DataFrame, source: str, url_format: str, most: int = 10, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """The first books of a JSON search, with their recording if they have one."""
    schema = "books array<struct<id: long, title: string, author_name: string, author_surname: string, year: string, lang_code: string, yt_id: string, yt_reader: string>>"
    books = df.select("*", F.posexplode(F.slice(F.from_json(body, schema)["books"], 1, most)).alias("pos", "b"))
    name = F.concat_ws(" ", F.nullif("b.author_name", F.lit("")), F.nullif("b.author_surname", F.lit("")))
    text = lambda c: F.coalesce(F.col(f"b.{c}"), F.lit(""))
    return books.select(*keep, F.lit(source).alias("source"), "pos", text("title").alias("title"), name.alias("author"), text("year").alias("year"), text("lang_code").alias("lang"), F.format_string(url_format, F.col("b.id")).alias("url"), F.lit("html").alias("kind"), F.nullif("b.yt_id", F.lit("")).alias("video"), text("yt_reader").alias("narrator"))


ITEM = (
    "metadata struct<title: string, creator: string, year: string, language: string, volume: string, `access-restricted-item`: string>, "
    "files array<struct<name: string, format: string, source: string, size: string, title: string, length: string>>"
)


def text_files(df: DataFrame, id_col: str, body: str = "body") -> DataFrame:
    """Of each item's metadata the one text file of the best format it has; none where two share it or the item is lent only."""
    item = df.select(id_col, F.from_json(body, ITEM).alias("i")).where(F.lower(F.coalesce(F.col("i.metadata")["access-restricted-item"], F.lit(""))) != "true")
    files = item.select(id_col, "i.metadata", F.explode("i.files").alias("f")).where("f.name <> ''")
    ranks = [(F.col("f.format") == name) & (F.lit(not own) | (F.col("f.source") == "original")) for name, _, own in TEXT_FORMATS]
    rank = F.coalesce(*[F.when(r, k) for k, r in enumerate(ranks)])
    ranked = files.withColumn("_rank", rank).where("_rank is not null").groupBy(id_col, "metadata", "_rank").agg(F.count(F.lit(1)).alias("n"), F.first("f").alias("f"))
    best = ranked.groupBy(id_col).agg(F.min_by(F.struct("metadata", "_rank", "n", "f"), "_rank").alias("x")).where("x.n = 1")
    m = F.col("x.metadata")
    title = F.concat(m["title"], F.when(F.trim(F.coalesce(m["volume"], F.lit(""))) != "", F.concat(F.lit(", т. "), F.trim(m["volume"]))).otherwise(""))
    size = F.col("x.f.size").try_cast("long")
    return best.select(
        id_col, title.alias("title"), F.coalesce(m["creator"], F.lit("")).alias("author"), F.coalesce(found(m["year"], "(1[0-9]{3}|20[0-9]{2})"), F.lit("")).alias("year"), language_code(m["language"]).alias("lang"),
        F.col("x.f.name").alias("file"), F.element_at(F.array(*[F.lit(k) for _, k, _ in TEXT_FORMATS]), F.col("x._rank") + 1).alias("kind"), F.floor(F.nullif(size, F.lit(0)) / 1024).cast("int").alias("size_kb"),
    )


def sound_files(df: DataFrame, id_col: str, body: str = "body") -> DataFrame:
    """Of each item's metadata the MP3 files of one format, in the natural order of their names: the best one it has, else that with most files."""
    files = df.select(id_col, F.posexplode(F.from_json(body, ITEM)["files"]).alias("p", "f")).where(F.endswith(F.lower("f.name"), F.lit(".mp3")))
    kind = F.coalesce("f.format", F.lit(""))
    rank = F.coalesce(*[F.when(kind == name, k) for k, name in enumerate(SOUND_FORMATS)], F.lit(len(SOUND_FORMATS)))
    formats = files.groupBy(id_col, kind.alias("_kind")).agg(F.min(rank).alias("_rank"), (-F.count(F.lit(1))).alias("_n"), F.min("p").alias("_p"))
    chosen = formats.groupBy(id_col).agg(F.min(F.struct("_rank", "_n", "_p", "_kind")).alias("x")).select(id_col, F.col("x._kind").alias("_kind"))
    stem = F.regexp_replace(F.regexp_replace("f.name", "^.*/", ""), r"\.[^.]*$", "")
    seconds = clock_seconds(F.nullif(F.trim("f.length"), F.lit("")))
    return files.withColumn("_kind", kind).join(chosen, [id_col, "_kind"]).select(id_col, natural_key(F.col("f.name")).alias("place"), F.coalesce(F.nullif("f.title", F.lit("")), stem).alias("title"), seconds.alias("duration_s"), F.col("f.name").alias("file"), F.col("f.size").try_cast("long").alias("size_bytes"))


def totals(tracks: DataFrame, by: str) -> DataFrame:
    """Recordings of tracks (by, duration_s, size_bytes): their number, sums where anything is known, and the rate."""
    sums = tracks.groupBy(by).agg(F.count(F.lit(1)).alias("parts"), F.nullif(F.sum(F.coalesce("duration_s", F.lit(0.0))), F.lit(0.0)).alias("_d"), F.nullif(F.sum(F.coalesce("size_bytes", F.lit(0))), F.lit(0)).alias("size_bytes"))
    return sums.select(by, "parts", F.col("_d").cast("int").alias("duration_s"), "size_bytes", F.bround(F.col("size_bytes") * 8 / F.col("_d") / 1000, 0).cast("int").alias("bitrate_kbps"))


def video_hits(df: DataFrame, source: str, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """Videos of a JSON search that can be a reading; who reads is in the title, else it is the channel."""
    schema = "entries array<struct<id: string, title: string, duration: double, live_status: string, channel: string, uploader: string>>"
    videos = df.select("*", F.posexplode(F.from_json(body, schema)["entries"]).alias("pos", "v")).where(is_video(F.col("v.id"), F.col("v.duration"), F.col("v.live_status")))
    title, channel = F.coalesce("v.title", F.lit("")), F.coalesce(F.nullif("v.channel", F.lit("")), "v.uploader", F.lit(""))
    return videos.select(*keep, F.lit(source).alias("source"), "pos", F.concat(F.lit("yt:"), "v.id").alias("ref"), title.alias("title"), narrator(title, channel).alias("narrator"), F.col("v.duration").cast("int").alias("duration_s"), F.lit(1).alias("parts"))


def player_tracks(df: DataFrame, id_col: str, host: str, trial_host: str, body: str = "body") -> DataFrame:
    """Tracks of pages with a player: id, ``pos``, title, seconds and address; only those on the site's own hosts.

    A page that is blocked has none, and neither has one that offers trials only.
    """
    pages = df.where(~F.col(body).rlike(r'"blocked"\s*:\s*true')).select(id_col, F.regexp_extract(body, r"(?s)new\s+BookPlayer\(\s*[0-9]+\s*,\s*(\[.*?\])\s*[,)]", 1).alias("_json"))
    schema = "array<struct<title: string, url: string, duration: double, duration_float: double>>"
    tracks = pages.select(id_col, F.posexplode(F.from_json("_json", schema)).alias("pos", "t"))
    own = F.lower(F.regexp_extract("t.url", r"^https://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    ours = (own == host) | F.endswith(own, F.lit(f".{host}"))
    kept = tracks.where(ours & ~F.contains("t.url", F.lit(trial_host)))
    return kept.select(id_col, "pos", F.coalesce("t.title", F.lit("")).alias("title"), F.coalesce(F.nullif("t.duration_float", F.lit(0.0)), F.nullif("t.duration", F.lit(0.0))).alias("duration_s"), F.col("t.url").alias("url"))


def recording_rows(html: str) -> list[tuple]:
    """Recordings of a search page: slug, book's number, title, authors, readers, length in words, whether a trial."""

    def words(node: Node) -> str:
        return " ".join(node.text().split())

    def of_class(node: Node, name: str) -> list[Node]:
        return [n for n in node.walk() if name in n.attrs.get("class", "").split()]

    rows = []
    for item in of_class(tree(html), "bookkitem"):
        name = next((n for n in of_class(item, "bookkitem_name") if n.name == "a"), None)
        slug = re.fullmatch(r"/book/([a-z0-9][a-z0-9_-]*)/?", name.attrs.get("href", "")) if name is not None else None
        if not slug:
            continue
        values = [v for n in item.walk() for k, v in n.attrs.items() if k in ("src", "style", "data-id", "data-book-id")]
        numbers = [m for v in values if (m := re.search(r"/covers/([0-9]{1,9})/", v) or re.fullmatch(r"([0-9]{1,9})", v))]
        writers = [words(a) for holder in of_class(item, "bookkitem_author") for a in holder.walk() if a.name == "a"]
        readers = [words(a) for a in item.walk() if a.name == "a" and a.attrs.get("href", "").startswith("/reader/")]
        length = next((words(n) for n in of_class(item, "bookkitem_meta_time")), "")
        trial = any("litres" in n.attrs.get("class", "") for n in item.walk())
        rows.append((slug[1], numbers[0][1] if numbers else "0", words(name), ", ".join(filter(None, writers)), ", ".join(filter(None, readers)), length, trial))
    return rows


def recording_hits(df: DataFrame, source: str, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """Recordings of search pages of a site that encodes all at one rate."""
    names = ["slug", "number", "title", "author", "narrator", "length", "licensed_trial"]

    @F.pandas_udf("array<struct<slug: string, number: string, title: string, author: string, narrator: string, length: string, licensed_trial: boolean>>")
    def rows(pages: pd.Series) -> pd.Series:
        return pages.map(lambda html: [dict(zip(names, r)) for r in recording_rows(html or "")])

    each = df.select(*keep, F.posexplode(rows(body)).alias("pos", "r")).select(*keep, "pos", "r.*").withColumn("duration_s", spoken_seconds(F.col("length")))
    ref = F.concat_ws(":", F.lit(source), "number", "slug")
    return each.select(*keep, F.lit(source).alias("source"), "pos", ref.alias("ref"), "title", "author", "narrator", "duration_s", F.floor(F.col("duration_s") * SITE_KBPS * 125).alias("size_bytes"), F.lit(SITE_KBPS).alias("bitrate_kbps"), "licensed_trial")
