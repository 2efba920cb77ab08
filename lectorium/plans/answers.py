"""Queries over answers of catalogues and over small functions: answers are written from ``part`` and ``lineitem`` and read again.

A search's answer is that for one brand; its rows are the brand's parts in the order of their keys.
"""

from __future__ import annotations

import io
import wave
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import num, signals, styles
from ..functions import queries as fq
from ..functions.sentences import sentences
from ..operators.markup import single_member, sniff
from ..registry import Tables, query
from ..sources import feeds, files
from ..streaming.activity import translate_late



def key() -> Column:
    return F.col("p_partkey")


def digits() -> Column:
    return F.col("p_partkey").cast("string")


_PARTS = "WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, p_partkey AS k FROM part)"


def _answer(df: DataFrame, by: str, order: list[str], item: Column) -> DataFrame:
    """``by`` and ``items``, an array in order."""
    every = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, item.alias("_item")))).alias("_all"))
    return every.select(by, F.transform("_all", lambda x: x["_item"]).alias("items"))


def _feed(t: Tables, entry: Column) -> DataFrame:
    return _answer(t.part, "p_brand", ["p_partkey"], entry).select("p_brand", F.concat(F.lit("<feed>"), F.array_join("items", "\n"), F.lit("</feed>")).alias("body"))


def _json(answer: DataFrame, by: str, name: str = "") -> DataFrame:
    body = F.to_json(F.struct(F.col("items").alias(name))) if name else F.to_json("items")
    return answer.select(by, body.alias("body"))


def when(*cases: tuple, otherwise: object = "") -> Column:
    out = F
    for condition, value in cases:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


@query(_PARTS + """
SELECT p_brand, pos, p_name || ' & co' AS title, CASE WHEN k % 4 = 0 THEN '' ELSE p_type || ', Other' END AS author, CASE WHEN k % 3 = 0 THEN 'T. Tr' ELSE '' END AS translator, CASE WHEN k % 2 = 0 THEN '19' || (10 + p_size) ELSE '' END AS year,
       CASE WHEN k % 3 = 1 THEN p_size * 10 END AS size_kb, CASE WHEN k % 2 = 1 THEN 'ru' ELSE '' END AS lang, CASE k % 5 WHEN 0 THEN 'https://c/b/' || k || '/fb2' WHEN 1 THEN 'https://c/x/' || k WHEN 2 THEN 'https://c/e/' || k WHEN 3 THEN 'https://c/f/' || k END AS url,
       CASE WHEN k % 5 = 2 THEN 'epub' WHEN k % 5 = 3 THEN 'rtf' ELSE 'fb2' END AS kind FROM p WHERE k % 5 < 4
""")
def q_feed_hits(t: Tables) -> DataFrame:
    """Entries with a link to the book's page, to an FB2 or an EPUB file, in either order of the attributes, or none."""
    link = when(
        (key() % 5 == 0, F.concat(F.lit('<link href="/b/'), digits(), F.lit('"/>'))),
        (key() % 5 == 1, F.concat(F.lit('<link type="application/fb2+zip" href="/x/'), digits(), F.lit('"/>'))),
        (key() % 5 == 2, F.concat(F.lit('<link href="/e/'), digits(), F.lit('" type="application/epub+zip"/>'))),
        (key() % 5 == 3, F.concat(F.lit('<link href="/f/'), digits(), F.lit('" type="application/fb2+zip"/><link href="/g" type="application/epub+zip"/>'))),
    )
    info = F.concat(
        when((key() % 3 == 0, "Перевод: T. Tr. ")),
        when((key() % 2 == 0, F.concat(F.lit("Год издания: 19"), (10 + F.col("p_size")).cast("string"), F.lit(" ")))),
        when((key() % 5 == 3, "Формат: RTF ")),
        when((key() % 3 == 1, F.concat(F.lit("Размер: "), (F.col("p_size") * 10).cast("string"), F.lit(" Kb")))),
    )
    author = when((key() % 4 != 0, F.concat(F.lit("<author><name>"), "p_type", F.lit("</name></author><author>\n<name>Other</name></author>"))))
    content = F.concat(F.lit('<content type="html">&lt;b&gt;'), info, F.lit("&lt;/b&gt;</content>"))
    entry = F.concat(F.lit("<entry><title>"), "p_name", F.lit(" &amp;amp; co</title>"), author, when((key() % 2 == 1, "<dc:language>ru</dc:language>")), link, content, F.lit("</entry>"))
    return feeds.feed_hits(_feed(t, entry), "c", "https://c", keep=("p_brand",)).drop("source")


@query(_PARTS + """
SELECT p_brand, pos, p_name AS title, CASE WHEN k % 3 = 0 THEN '' ELSE p_type END AS author, CASE k % 4 WHEN 0 THEN 'zh' WHEN 1 THEN 'fr' ELSE '' END AS lang, 'https://g/' || k || '.epub' AS url FROM p WHERE k % 7 <> 0
""")
def q_download_hits(t: Tables) -> DataFrame:
    name = F.concat("p_name", when((key() % 4 == 0, " (Chinese)"), (key() % 4 == 1, " (French)")))
    by = when((key() % 3 == 0, "12 downloads"), otherwise=F.col("p_type"))
    entry = F.concat(F.lit("<entry><title>"), name, F.lit("</title>"), when((key() % 7 != 0, F.concat(F.lit("<id>https://g/ebooks/"), digits(), F.lit(".opds</id>")))), F.lit('<content type="text">'), by, F.lit("</content></entry>"))
    return feeds.download_hits(_feed(t, entry), "g", "https://g/%s.epub", keep=("p_brand",)).select("p_brand", "pos", "title", "author", "lang", "url")


@query(_PARTS + "SELECT p_brand, k AS pos, p_name AS title, 'https://w/ru/' || replace(p_name, ' ', '_') AS url FROM p WHERE k % 5 <> 0 AND k % 6 <> 1")
def q_wiki_hits(t: Tables) -> DataFrame:
    title = F.concat("p_name", when((key() % 5 == 0, "/Part")))
    page = F.struct(title.alias("title"), key().cast("int").alias("index"), F.when(key() % 6 == 1, F.struct(F.lit("").alias("disambiguation"))).alias("pageprops"))
    answers = _answer(t.part, "p_brand", ["p_partkey"], page).select("p_brand", F.to_json(F.struct(F.struct(F.col("items").alias("pages")).alias("query"))).alias("body"))
    return feeds.wiki_hits(answers, "w", "ru", "https://w/{lang}/{page}", keep=("p_brand",)).select("p_brand", "pos", "title", "url")


@query(_PARTS + """
SELECT p_brand, pos, p_name AS title, CASE WHEN k % 2 = 0 THEN 'Ivan Petrov' ELSE '' END AS author, CASE WHEN k % 2 = 0 THEN 'id' ELSE '' END AS lang, 'https://m/' || k || '.PDF' AS url, CASE WHEN p_size % 3 <> 0 THEN p_size * 500 // 1024 END AS size_kb FROM p WHERE k % 4 <> 3
""")
def q_media_hits(t: Tables) -> DataFrame:
    url = F.concat(F.lit("https://m/"), digits(), when((key() % 4 == 3, ".jpg"), otherwise=".PDF"))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), when((key() % 2 == 0, "-Ivan Petrov-ID")))
    item = F.struct(url.alias("source_url"), F.struct(name.alias("rendered")).alias("title"), F.struct(F.when(F.col("p_size") % 3 != 0, F.col("p_size") * 500).alias("filesize")).alias("media_details"))
    return feeds.media_hits(_json(_answer(t.part, "p_brand", ["p_partkey"], item), "p_brand"), "m", r"(?:Ivan\s+)?Petrov", "Ivan Petrov", keep=("p_brand",)).select("p_brand", "pos", "title", "author", "lang", "url", "size_kb")


@query(_PARTS + "SELECT p_brand, pos, p_name AS title, CASE WHEN k % 2 = 0 THEN p_type ELSE p_type || ' Sur' END AS author, CAST(1900 + p_size AS VARCHAR) AS year, 'https://s/' || k AS url, CASE WHEN k % 3 = 0 THEN 'v' || k END AS video FROM p WHERE pos < 10")
def q_search_hits(t: Tables) -> DataFrame:
    book = F.struct(
        key().alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("author_name"), when((key() % 2 == 0, ""), otherwise="Sur").alias("author_surname"), (1900 + F.col("p_size")).cast("string").alias("year"),
        F.when(key() % 3 == 0, F.concat(F.lit("v"), digits())).alias("yt_id"),
    )  # fmt: skip
    return feeds.search_hits(_json(_answer(t.part, "p_brand", ["p_partkey"], book), "p_brand", "books"), "s", "https://s/%d", keep=("p_brand",)).select("p_brand", "pos", "title", "author", "year", "url", "video")


# An order is an item, its lines the files, their formats as the lines' numbers say.
_ITEMS = """
WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN 'EPUB' WHEN 1 THEN 'Text PDF' WHEN 2 THEN 'DjVuTXT' ELSE 'Image' END AS format, CASE WHEN l_returnflag = 'N' THEN 'original' ELSE 'derivative' END AS source, CAST(l_quantity AS BIGINT) * 100 AS size FROM lineitem)
"""


def _files(t: Tables, format: Column, name: Column, **others: Column) -> DataFrame:
    """Each order's files in the order that the SQL gives them, a number of line and part; whether ``orders`` has the order says nothing."""
    file = F.struct(name.alias("name"), format.alias("format"), *[c.alias(k) for k, c in others.items()])
    placed = t.lineitem.withColumn("_place", F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey"))
    return _answer(placed, "l_orderkey", ["_place"], file)


def _items(t: Tables, format: Column, name: Column, **others: Column) -> DataFrame:
    answers = _files(t, format, name, **others).join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority"), "l_orderkey")
    meta = F.struct(
        F.col("o_orderpriority").alias("title"), when((F.col("o_custkey") % 2 == 0, "Au Thor"), otherwise=None).alias("creator"), F.concat(F.lit("c"), (1900 + F.col("o_custkey") % 99).cast("string"), F.lit("?")).alias("year"), F.lit("rus").alias("language"),
        when((F.col("l_orderkey") % 3 == 0, " 2 "), otherwise=None).alias("volume"), when((F.col("l_orderkey") % 10 == 1, "true"), otherwise=None).alias("access-restricted-item"),
    )  # fmt: skip
    return answers.select("l_orderkey", F.to_json(F.struct(meta.alias("metadata"), F.col("items").alias("files"))).alias("body"))


@query(_ITEMS + """
, r AS (SELECT *, CASE WHEN format = 'EPUB' AND source = 'original' THEN 0 WHEN format = 'DjVuTXT' THEN 1 WHEN format = 'Text PDF' THEN 2 END AS rank FROM f),
b AS (SELECT l_orderkey, rank, count(*) AS n, min('f' || l_linenumber || '_' || l_partkey) AS file, min(size) AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY rank) AS rn FROM r WHERE rank IS NOT NULL GROUP BY l_orderkey, rank)
SELECT l_orderkey, o_orderpriority || CASE WHEN l_orderkey % 3 = 0 THEN ', т. 2' ELSE '' END AS title, CASE WHEN o_custkey % 2 = 0 THEN 'Au Thor' ELSE '' END AS author, CAST(1900 + o_custkey % 99 AS VARCHAR) AS year, 'ru' AS lang, file,
       ['epub', 'txt', 'pdf'][rank + 1] AS kind, size // 1024 AS size_kb FROM b JOIN orders ON o_orderkey = l_orderkey WHERE rn = 1 AND n = 1 AND l_orderkey % 10 <> 1
""")
def q_text_files(t: Tables) -> DataFrame:
    line = F.col("l_linenumber") % 4
    format = when((line == 0, "EPUB"), (line == 1, "Text PDF"), (line == 2, "DjVuTXT"), otherwise="Image")
    name = F.concat(F.lit("f"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_partkey").cast("string"))
    items = _items(t, format, name, source=when((F.col("l_returnflag") == "N", "original"), otherwise="derivative"), size=(F.col("l_quantity").cast("long") * 100).cast("string"))
    return feeds.text_files(items, "l_orderkey")


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, ['MP3', 'VBR MP3', 'Odd', 'Other'][l_partkey % 4 + 1] AS format, l_quantity * 60 + l_linenumber AS seconds, CAST(l_quantity AS BIGINT) * 90000 AS size FROM lineitem WHERE l_partkey % 5 <> 0),
g AS (SELECT l_orderkey, format, CASE format WHEN 'VBR MP3' THEN 0 WHEN 'MP3' THEN 3 ELSE 4 END AS rank, count(*) AS n, min(l_linenumber * 1000000 + l_partkey) AS p FROM f GROUP BY ALL),
b AS (SELECT l_orderkey, first(format ORDER BY rank, n DESC, p) AS format FROM g GROUP BY 1)
SELECT f.l_orderkey, count(*) AS parts, CAST(trunc(sum(seconds)) AS INTEGER) AS duration_s, CAST(sum(size) AS BIGINT) AS size_bytes, CAST(round_even(sum(size) * 8 / sum(seconds) / 1000, 0) AS INTEGER) AS bitrate_kbps FROM f JOIN b ON f.l_orderkey = b.l_orderkey AND f.format = b.format GROUP BY 1
""")
def q_sound_files(t: Tables) -> DataFrame:
    """Recordings of items: the tracks of their best format, with lengths as clocks or seconds."""
    number = F.col("l_partkey") % 4
    format = when((number == 0, "MP3"), (number == 1, "VBR MP3"), (number == 2, "Odd"), otherwise="Other")
    name = F.concat(F.lit("t"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_partkey").cast("string"), when((F.col("l_partkey") % 5 == 0, ".ogg"), otherwise=".Mp3"))
    minutes, seconds = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")
    length = when((F.col("l_linenumber") % 2 == 0, F.concat_ws(":", minutes, seconds)), otherwise=(F.col("l_quantity").cast("int") * 60 + F.col("l_linenumber")).cast("string"))
    answers = _json(_files(t, format, name, size=(F.col("l_quantity").cast("long") * 90000).cast("string"), length=length), "l_orderkey", "files")
    return feeds.totals(feeds.sound_files(answers, "l_orderkey"), "l_orderkey")


@query(_PARTS + "SELECT p_brand, pos, 'yt:' || left(md5(CAST(k AS VARCHAR)), 11) AS ref, CASE WHEN k % 2 = 0 THEN p_type ELSE 'Chan' END AS narrator, p_size * 12 AS duration_s FROM p WHERE p_size >= 25 AND k % 4 <> 1")
def q_video_hits(t: Tables) -> DataFrame:
    title = F.concat("p_name", when((key() % 2 == 0, F.concat(F.lit(", читает "), "p_type"))))
    video = F.struct(F.left(F.md5(digits()), F.lit(11)).alias("id"), title.alias("title"), (F.col("p_size") * 12).cast("double").alias("duration"), when((key() % 4 == 1, "is_live"), otherwise=None).alias("live_status"), F.lit("Chan").alias("channel"))
    return feeds.video_hits(_json(_answer(t.part, "p_brand", ["p_partkey"], video), "p_brand", "entries"), "v", keep=("p_brand",)).select("p_brand", "pos", "ref", "narrator", "duration_s")


@query(_PARTS + "SELECT p_brand, pos, p_name AS title, CAST(p_size AS DOUBLE) AS duration_s, 'https://a.k.org/' || k AS url FROM p WHERE k % 3 = 0 AND p_brand <> 'Brand#2'")
def q_player_tracks(t: Tables) -> DataFrame:
    """Tracks in pages with a player; one brand's page is blocked, and other hosts' tracks are left out."""
    host = when((key() % 3 == 0, "https://a.k.org/"), (key() % 3 == 1, "https://trial.ru/"), otherwise="https://evilk.org/")
    track = F.struct(F.col("p_name").alias("title"), F.concat(host, digits()).alias("url"), F.col("p_size").cast("double").alias("duration"))
    tracks = _json(_answer(t.part, "p_brand", ["p_partkey"], track), "p_brand")
    page = F.concat(F.lit("<script>var p = new BookPlayer(17, "), "body", F.lit(', {"blocked": '), when((F.col("p_brand") == "Brand#2", "true"), otherwise="false"), F.lit("});</script>"))
    return feeds.player_tracks(tracks.select("p_brand", page.alias("body")), "p_brand", "k.org", "trial.ru")


@query(_PARTS + """
SELECT p_brand, pos, 'k:' || (k + 1) || ':b' || k AS ref, p_name AS title, p_type || ', B' AS author, CASE WHEN k % 2 = 0 THEN 'R' ELSE '' END AS narrator, CASE WHEN k % 3 <> 0 THEN p_size * 3600 + 240 END AS duration_s, k % 4 = 0 AS licensed_trial FROM p
""")
def q_recording_hits(t: Tables) -> DataFrame:
    item = F.concat(
        F.lit('<div class="bookkitem"><a class="cover" style="x"><img src="/covers/'), (key() + 1).cast("string"), F.lit('/1.jpg"></a><a class="bookkitem_name" href="/book/b'), digits(), F.lit('/">'), F.replace("p_name", F.lit(" "), F.lit("<b> </b>")),
        F.lit('</a><div class="bookkitem_author"><a>'), "p_type", F.lit("</a> <a>B</a></div>"), when((key() % 2 == 0, '<a href="/reader/1">R</a>')), when((key() % 3 != 0, F.concat(F.lit('<span class="bookkitem_meta_time">'), F.col("p_size").cast("string"), F.lit(" часов 4 минуты</span>")))),
        when((key() % 4 == 0, '<i class="bookkitem_meta_block -litres"></i>')), F.lit("</div>"),
    )  # fmt: skip
    pages = _answer(t.part, "p_brand", ["p_partkey"], item).select("p_brand", F.concat(F.lit("<html><body>"), F.array_join("items", "\n"), F.lit("</body></html>")).alias("body"))
    return feeds.recording_hits(pages, "k", keep=("p_brand",)).select("p_brand", "pos", "ref", "title", "author", "narrator", "duration_s", "licensed_trial")


# Small functions


@query("""
WITH w AS (SELECT p_partkey, ['author' || p_size, p_name, 'и', p_type] AS x FROM part), l AS (SELECT p_partkey, string_split(lower(array_to_string(x, ' ')), ' ') AS w FROM w),
k AS (SELECT p_partkey, w, list_filter(w, lambda a: a <> 'и') AS t FROM l),
s AS (SELECT p_partkey, list_concat([array_to_string(t[:2], ' ')], CASE WHEN len(w) - 1 BETWEEN 2 AND 4 THEN [array_to_string(w[2:], ' '), array_to_string(w[:-2], ' ')] ELSE [] END) AS phrases FROM k)
SELECT p_partkey, phrases[1] AS first, phrases[2] AS second, phrases[3] AS third FROM s
""")
def q_shorter_queries(t: Tables) -> DataFrame:
    tries = fq.shorter_queries(F.concat_ws(" ", F.concat(F.lit("Author"), F.col("p_size").cast("string")), "p_name", F.lit("и"), F.col("p_type")))
    return t.part.select("p_partkey", *[F.get(tries, F.lit(k)).alias(name) for k, name in enumerate(("first", "second", "third"))])


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 3600 + 120 WHEN 1 THEN p_size * 60 WHEN 2 THEN p_size END AS seconds FROM part")
def q_spoken_seconds(t: Tables) -> DataFrame:
    n = F.col("p_size").cast("string")
    text = when((key() % 4 == 0, F.concat(n, F.lit(" Часов 2 мин."))), (key() % 4 == 1, F.concat(n, F.lit(" минут"))), (key() % 4 == 2, F.concat(n, F.lit("с"))), otherwise="долго")
    return t.part.select("p_partkey", fq.spoken_seconds(text).alias("seconds"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN p_size END AS number FROM part")
def q_page_number(t: Tables) -> DataFrame:
    n = F.col("p_size").cast("string")
    line = when((key() % 5 == 0, n), (key() % 5 == 1, F.concat(F.lit("- "), n, F.lit(" -"))), (key() % 5 == 2, fq.roman(F.col("p_size"))), (key() % 5 == 3, F.concat(F.lit("Стр. "), n)), otherwise=F.concat(fq.roman(F.col("p_size")), F.lit("iiii")))
    return t.part.select("p_partkey", fq.page_number(line).alias("number"))


@query("SELECT doc_id, strip_accents(text) AS text FROM documents")
def q_fold_accents(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fq.fold_accents(F.col("text")).alias("text"))


@query("SELECT doc_id, length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) + 1 AS units FROM (SELECT doc_id, text || '😀' AS text FROM documents)")
def q_utf16_offsets(t: Tables) -> DataFrame:
    """Where a text with a letter beyond the basic plane ends, in UTF-16 units, less one."""

    @F.pandas_udf("long")
    def end(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else fq.utf16_offsets(x, [len(x)])[0]).astype("Int64")

    return t.documents.select("doc_id", (end(F.concat("text", F.lit("😀"))) + 1).alias("units"))


@query("""
SELECT p_partkey, replace(p_name, ' ', '_') || '_' || p_size || '.txt' AS safe_name, p_partkey % 3 <> 0 AS slug, p_partkey % 4 NOT IN (0, 1) AS plain_file, p_partkey % 2 = 0 AS own_site, '"' || p_name || '\\"' || chr(92) || chr(92) || 'n\\n' || p_size || '"' AS toml FROM part
""")
def q_name_checks(t: Tables) -> DataFrame:
    slug = F.concat(when((key() % 3 == 0, "../")), F.lit("a-"), digits())
    file = F.concat(when((key() % 4 == 0, "."), (key() % 4 == 1, "x/")), digits(), F.lit(".txt"))
    url = F.concat(F.lit("https://u:p@"), when((key() % 2 == 0, "sub.Own.org"), otherwise="evilown.org"), F.lit(":8/x"))
    written = files.toml_string(F.concat("p_name", F.lit('"\\n\n'), F.col("p_size").cast("string")))
    path = F.concat(F.lit("../x\\"), F.lit(". "), F.replace("p_name", F.lit(" "), F.lit("?")), F.lit(":"), F.col("p_size").cast("string"), F.lit(".txt."))
    return t.part.select("p_partkey", files.safe_name(path).alias("safe_name"), fq.is_slug(slug).alias("slug"), fq.is_plain_file(file).alias("plain_file"), fq.same_site(url, F.lit("own.org")).alias("own_site"), written.alias("toml"))


@query("SELECT doc_id, ['html', 'fb2', 'pdf', 'txt', 'epub'][doc_id % 5 + 1] AS kind FROM documents")
def q_formats(t: Tables) -> DataFrame:
    """What files are by how they begin, or by their names where that says nothing."""
    number = F.col("doc_id") % 5
    start = when((number == 0, "\n<!DOCTYPE html><html>"), (number == 1, "<?xml version='1.0'?><FictionBook>"), (number == 2, "%PDF-1.7\n"))

    @F.pandas_udf("string")
    def kind(contents: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([sniff(bytes(c), n) for c, n in zip(contents, names)])

    content = F.concat(start, F.coalesce("text", F.lit(""))).cast("binary")
    return t.documents.select("doc_id", kind(content, when((number == 4, "a.EPUB"), otherwise="a.bin")).alias("kind"))


# Each part is a book of one element, whose style sheet follows from the part.
_STYLED = """
WITH e AS (SELECT p_partkey, ['p', 'title', 'author', 'verse'][p_partkey % 4 + 1] AS kind, p_partkey % 3 AS c, p_size AS n FROM part),
s AS (SELECT *, CASE WHEN c = 1 THEN 'c' WHEN kind = 'p' THEN 'r' END AS own_a, CASE WHEN c = 2 THEN CAST(floor(least(n * 10 / 16, 1e6) + 0.5) AS INTEGER) WHEN kind = 'p' THEN 20 END AS own_i, CASE WHEN c = 1 THEN n * 10 WHEN kind = 'p' THEN CAST(floor(n * 10 / 12 + 0.5) AS INTEGER) END AS ml, CASE WHEN c = 0 THEN n * 3 END AS pl FROM e),
t AS (SELECT *, coalesce(own_a, CASE WHEN kind <> 'title' THEN 'j' END) AS a, coalesce(own_i, CASE WHEN kind <> 'title' THEN 15 END) AS i, coalesce(ml, 0) + coalesce(pl, 0) AS m FROM s)
SELECT p_partkey, CASE WHEN a IS DISTINCT FROM CASE kind WHEN 'title' THEN 'c' WHEN 'author' THEN 'r' WHEN 'verse' THEN 'l' END THEN a END AS a,
       CASE WHEN i <= 100 AND (i > 0 OR kind = 'p') THEN least(i, 30) / 10 END AS i, CASE WHEN m > 0 AND m <= 300 THEN least(m, 100) / 10 END AS m, CASE WHEN n % 5 > 0 THEN least(n % 5, 3) END AS g FROM t
"""


@query(_STYLED)
def q_css_looks(t: Tables) -> DataFrame:
    """Looks of blocks by sheets of rules for elements and classes, with what is inherited and the blank lines before."""
    n = F.col("p_size").cast("string")
    css = F.concat(
        F.lit("/* x */ @media print {p {text-indent: 9em}} p {text-indent: 2em; text-align: end; margin: 1em "), n, F.lit("pt} .k1 {text-align: CENTER !important; margin-left: "), n, F.lit("em} .k2 {text-indent: "), n,
        F.lit("px} .k0 {padding: 0 1px 2px "), n, F.lit("%} .k1.other, div > p {text-align: left}"),
    )  # fmt: skip
    elements = t.part.select(
        key().alias("p_partkey"), F.lit(0).alias("id"), when((key() % 4 == 0, "p"), (key() % 4 == 1, "title"), (key() % 4 == 2, "author"), otherwise="verse").alias("kind"), F.array(F.concat(F.lit("k"), (key() % 3).cast("string"))).alias("classes"), F.lit(None).cast("string").alias("style"), (F.col("p_size") % 5).alias("gap")
    ).withColumn("name", when((F.col("kind") == "p", "p"), otherwise="div"))
    written = t.part.select("p_partkey", css.alias("css")).repartition("p_partkey")  # so that a small file's sheets are read by many tasks
    sheets = written.select("p_partkey", styles.sheet_rules(F.col("css")).alias("rules"))
    own = styles.own_says(elements, sheets, ["p_partkey"], ["id"])
    inherited = F.struct(F.lit("j").alias("a"), F.lit(15).alias("i"))
    return own.select("p_partkey", styles.block_look(F.col("kind"), F.col("own"), inherited, F.col("gap")).alias("x")).select("p_partkey", "x.*")


# Captions: a turn is an event, a line a segment, half a second after the one before.
@query("""
WITH s AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS seg, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM conversations),
w AS (SELECT conv_id, turn, k, unnest(x) AS raw, generate_subscripts(x, 1) AS p FROM (SELECT conv_id, turn, k, string_split_regex(trim(seg, ' ' || chr(9)), '[ \\t\\n\\x0B\\f\\r]+') AS x FROM s)),
c AS (SELECT conv_id, turn, k, p, (turn * 60000 + k * 500) / 1000 AS t0, regexp_replace(replace(lower(raw), 'ё', 'е'), '[^\\p{L}\\p{N}_]', '', 'g') AS word FROM w)
SELECT conv_id, row_number() OVER o - 1 AS pos, word, t0, least(coalesce(lead(t0) OVER o, t0 + 0.5), t0 + 2) AS t1 FROM c WHERE word <> '' WINDOW o AS (PARTITION BY conv_id ORDER BY turn, k, p)
""")
def q_captions(t: Tables) -> DataFrame:
    segs = F.transform(F.split("text", "\n"), lambda x, k: F.struct(x.alias("utf8"), (k * 500).cast("bigint").alias("tOffsetMs")))
    events = t.conversations.select("conv_id", "turn", F.struct((F.col("turn") * 60_000).cast("bigint").alias("tStartMs"), segs.alias("segs")).alias("e"))
    tracks = events.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "e"))), lambda x: x["e"]).alias("events"))
    return files.captions(tracks, ["conv_id"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(2 * l_quantity - l_tax * 10 + 5, 6) AS x, round(l_discount * l_quantity + l_tax * 30 - 7, 6) AS y FROM lineitem")
def q_affine(t: Tables) -> DataFrame:
    """A point through two transforms in one: scaled and shifted, then turned about."""
    first = num.matrix(2.0, 0.0, 0.0, 10.0, 5.0, -7.0)
    second = [F.lit(1.0), F.col("l_discount") / 2, F.lit(-1.0), F.lit(3.0), -F.lit(7.0), F.lit(14.0) - F.col("l_discount") * 2.5]
    x, y = num.transformed(num.after(first, second), F.col("l_quantity"), F.col("l_tax"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("""
SELECT p_partkey, CASE WHEN n >= 1000 THEN replace(printf('%.1f', floor(n / 1024.0 * 10 + 0.5) / 10), '.', ',') || ' МБ' ELSE n || ' КБ' END AS size, CASE WHEN s >= 3600 THEN s // 3600 || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock
FROM (SELECT p_partkey, p_size * 64 AS n, p_partkey * 13 % 9000 AS s FROM part)
""")
def q_display(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", num.shown_size(F.col("p_size") * 64).alias("size"), num.shown_clock(key() * 13 % 9000).alias("clock"))


@query("SELECT c_custkey, '{\"title\":\"' || c_name || '\",' || CASE WHEN c_custkey % 2 = 0 THEN '\"author\":\"a\",' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN '\"tags\":[' || c_nationkey || '],' ELSE '' END || '\"n\":' || c_custkey || '}' AS value FROM customer")
def q_book_json(t: Tables) -> DataFrame:
    """Documents with their keys in order, empty ones left out."""
    c = F.col("c_custkey")
    rows = t.customer.select(c, F.col("c_name").alias("title"), when((c % 2 == 0, "a")).alias("author"), when((c % 3 == 0, F.array("c_nationkey")), otherwise=F.array().cast("array<long>")).alias("tags"), c.alias("n"))
    return files.book_json(rows, ["title", "author", "tags", "n"], keep=("c_custkey",))


@query("SELECT user_id, row_number() OVER w - 1 AS pos, event_type AS word, (epoch_us(ts) // 1000 - 1704067200000) / 1000.0 AS t0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_type, event_id)")
def q_caption_events(t: Tables) -> DataFrame:
    """Timed words written as captions, a segment an hour, and read again."""
    at = (F.unix_millis(F.col("ts").cast("timestamp")) - 1_704_067_200_000) / 1000.0
    words = t.events.select("user_id", F.floor(at / 3600).alias("hour"), at.alias("t0"), F.col("event_type").alias("word"))
    return files.captions(files.caption_events(words, ["user_id"], "hour"), ["user_id"]).select("user_id", "pos", "word", "t0")


@query("""
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(least(greatest(round_even(CAST(x AS DOUBLE) * 8000, 0), -32768), 32767) AS BIGINT)) AS v FROM embeddings)
SELECT vec_id, len(v) - 2 AS n, list_sum(list_transform(v[3:], lambda x: x)) AS total FROM s
""")
def q_samples(t: Tables) -> DataFrame:
    """Recordings of two equal channels, from the third sample on."""

    @F.pandas_udf("binary")
    def recorded(vectors: pd.Series) -> pd.Series:
        def one(v: np.ndarray) -> bytes:
            out = io.BytesIO()
            with wave.open(out, "wb") as sound:
                sound.setparams((2, 2, 16_000, 0, "NONE", ""))
                sound.writeframes(np.repeat(np.rint(np.asarray(v, np.float64) * 8000).clip(-32768, 32767), 2).astype("<i2").tobytes())
            return out.getvalue()

        return vectors.map(one)

    values = signals.samples(recorded("embedding"), F.lit(2 / 16_000), F.lit(60.0))
    whole = F.aggregate(values, F.lit(0).cast("long"), lambda total, x: total + F.rint(x * 32768).cast("long"))
    return t.embeddings.select("vec_id", F.size(values).cast("long").alias("n"), whole.alias("total"))


@query("SELECT p_partkey, p_name AS title, p_brand AS author, CAST(p_size AS VARCHAR) AS edition FROM part")
def q_flat_manifest(t: Tables) -> DataFrame:
    """Flat manifests, in which a key may come twice and lines may be something else."""
    line = lambda key, value: F.concat(F.lit(f'{key} = "'), value, F.lit('"\n'))  # noqa: E731
    text = F.concat(line("title", F.lit("old")), line("author", F.col("p_brand")), F.lit("bad line\n[table]\nn = 1\n"), line("title", F.col("p_name")), line("edition", F.col("p_size").cast("string")))
    found = files.flat_manifest(text)
    return t.part.select("p_partkey", *[F.element_at(found, k).alias(k) for k in ("title", "author", "edition")])


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS source, CASE WHEN p_partkey % 4 <> 0 THEN p_size / 4 END AS duration FROM part")
def q_headers(t: Tables) -> DataFrame:
    """What the heads of long JSON files say."""
    head = F.concat(F.lit("{"), when((key() % 3 != 0, F.concat(F.lit('"source": "'), "p_brand", F.lit('", ')))), when((key() % 4 != 0, F.concat(F.lit('"duration" : '), (F.col("p_size") / 4).cast("string"), F.lit(", ")))))
    whole = F.concat(head, F.lit('"words": ['), F.repeat("p_name", F.lit(200)), F.lit('], "source": "late", "duration": 1}'))
    return t.part.select("p_partkey", files.header(whole.cast("binary")).alias("h")).select("p_partkey", "h.*")


@query("""
WITH e AS (SELECT user_id, event_id % 3 AS device, max(value) AS pos, max(event_id) AS seen FROM events GROUP BY ALL)
SELECT user_id, device, 'pos' AS key, CAST(floor(pos) AS BIGINT) AS value, CASE WHEN device = 1 THEN 0 ELSE CAST(seen AS DOUBLE) END AS at_ms FROM e WHERE device <> 2 UNION ALL SELECT user_id, device, 'mode', NULL, 0 FROM e WHERE device <> 2
""")
def q_state_rows(t: Tables) -> DataFrame:
    """Keys of devices' states; a time that is no number is none, a key of no value is there, and an unreadable state has none."""
    rows = t.events.groupBy("user_id", (F.col("event_id") % 3).alias("device")).agg(F.floor(F.max("value")).cast("string").alias("pos"), F.max("event_id").cast("string").alias("at"))
    at = F.when(F.col("device") == 1, F.concat(F.lit('"'), "at", F.lit('"'))).otherwise(F.col("at"))
    text = F.when(F.col("device") == 2, "{broken").otherwise(F.concat(F.lit('{"pos": '), "pos", F.lit(', "posAt": '), at, F.lit(', "mode": null, "modeAt": true, "other": 1}')))
    states = rows.select(F.col("user_id").cast("string").alias("slug"), F.col("device").cast("string").alias("device"), F.try_parse_json(text).alias("state")).withColumn("readable", F.col("state").isNotNull())
    return files.state_rows(states).select(F.col("slug").cast("long").alias("user_id"), F.col("device").cast("long").alias("device"), "key", F.nullif("value", F.lit("null")).cast("long").alias("value"), "at_ms")


@query("SELECT doc_id, text FROM documents")
def q_single_member(t: Tables) -> DataFrame:
    """Texts found in archives of one file, in archives."""

    @F.pandas_udf("binary")
    def packed(texts: pd.Series, depths: pd.Series) -> pd.Series:
        def one(text: str | None, depth: int) -> bytes | None:
            raw = None if text is None else text.encode()
            for _ in range(depth if raw is not None else 0):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("folder/member", raw)
                raw = out.getvalue()
            return raw

        return pd.Series([one(*x) for x in zip(texts, depths)])

    @F.pandas_udf("string")
    def unpacked(files_: pd.Series) -> pd.Series:
        return files_.map(lambda raw: None if raw is None else single_member(bytes(raw)).decode())

    return t.documents.select("doc_id", unpacked(packed("text", (F.col("doc_id") % 3).cast("int"))).alias("text"))


@query(r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&amp;', '&'), '[ 	

]+', ' ', 'g')) AS text FROM pages
""")
def q_plain_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", files.plain_text(F.col("html")).alias("text"))


@query("SELECT vec_id, vec_id % 5 AS lag, NULL AS of_silence FROM embeddings")
def q_lag(t: Tables) -> DataFrame:
    """By how much a signal that begins some samples late comes late."""
    silence = F.array_repeat(F.lit(0.0), (F.col("vec_id") % 5).cast("int"))
    own = F.transform("embedding", lambda x: x.cast("double"))
    late = F.concat(silence, own)
    padded = F.concat(own, silence)
    quiet = F.array_repeat(F.lit(0.0), 8)
    return t.embeddings.select("vec_id", signals.lag(late, padded, 5, 0.3).cast("long").alias("lag"), signals.lag(quiet, own, 5).alias("of_silence"))


# Sentences of known ends, some with abbreviations, initials, quotes and numbers inside.
PIECES = ("Mr. Brown came home at 7.30 today.", "She said «No!» and left…", "See e.g. page 7 of it?", "Он жил там и т. д. всюду!", "Книгу Н. Петрова мы видели.", "Year 1999.")


@query(f"SELECT user_id, row_number() OVER w - 1 AS number, [{', '.join(repr(x) for x in PIECES)}][event_id % 6 + 1] AS sentence FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def q_known_sentences(t: Tables) -> DataFrame:
    piece = F.get(F.array(*map(F.lit, PIECES)), (F.col("event_id") % 6).cast("int"))
    texts = t.events.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", piece.alias("x")))), lambda x: x["x"]), " ").alias("text"))
    ranges = texts.select("user_id", "text", F.posexplode(sentences(F.col("text"))).alias("number", "r"))
    return ranges.select("user_id", "number", F.expr("substring(text, r.s + 1, r.e - r.s)").alias("sentence"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(least(greatest(CAST(trunc(value) AS INTEGER), 0), 9) * 3 AS DOUBLE) WHEN 1 THEN value WHEN 2 THEN value END AS value FROM events WHERE event_id % 4 < 3
""")
def q_translate_late(t: Tables) -> DataFrame:
    """Writes of an older edition carried over, those of the current one and of none left, those of a lost one dropped."""
    edition = F.get(F.array(F.lit("old"), F.lit("now"), F.lit(None), F.lit("gone")), (F.col("event_id") % 4).cast("int"))
    writes = t.events.select("event_id", "value", edition.alias("edition"), F.lit("now").alias("now"))
    editions = t.events.sparkSession.sql("select 'old' as edition, transform(sequence(0, 9), i -> i * 3) as map")
    return translate_late(writes, editions).select("event_id", "value")
