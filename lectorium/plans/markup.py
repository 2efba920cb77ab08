"""Queries over files as books: web pages as they are, and conversations written as FB2, EPUB, a reader's page, a web page, a plain text and pages of lines."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import text_model as tm
from ..operators.books import part_of
from ..operators.page_lines import page_line_blocks
from ..registry import Tables, query


@query()
def q_html_blocks(t: Tables) -> DataFrame:
    return tm.html_blocks(t.pages, "page_id", "html")


@query()
def q_html_main(t: Tables) -> DataFrame:
    """How much text the main part of each page has."""
    blocks = tm.html_blocks(t.pages, "page_id", "html")
    return blocks.groupBy("page_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).alias("n_chars"), F.max("chapter").alias("last_chapter"))


_LINKS = r"""
WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>.*?</a>') AS l FROM pages)
SELECT page_id, k - 1 AS pos, regexp_extract(l[k], '(?is)href="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_replace(l[k], '(?s)<[^>]*>', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text
FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS k FROM a)
"""


@query(_LINKS)
def q_html_links(t: Tables) -> DataFrame:
    return tm.html_links(t.pages, "page_id", "html")


# Conversations as books: each turn is a chapter, named after who speaks, of one paragraph,
# with a note at its end. What a reader must find again is plain SQL over the table.

_TURNS = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS j, role || ' speaks' AS title, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM conversations)
"""
_BLOCKS = _TURNS + """
SELECT conv_id, 2 * j AS block, 'title' AS kind, j AS chapter, title AS text, '' AS notes FROM t
UNION ALL SELECT conv_id, 2 * j + 1, 'p', j, text, length(text) || ':n' || j FROM t
"""
_NOTES = _TURNS + "SELECT conv_id, 'n' || j AS note, 'A note on ' || title || ' (' || j || ').' AS text FROM t"


def _turns(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", (F.row_number().over(w) - 1).cast("string").alias("j"), F.concat("role", F.lit(" speaks")).alias("title"), "text", "turn")


def _escaped(c: str) -> Column:
    return F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _written(t: Tables, part: list, between: str = "", extra: dict[str, list] | None = None) -> DataFrame:
    """Per conversation the parts of its turns, in order, as one text; ``extra`` are other texts of the kind."""
    parts = {"body": part} | (extra or {})
    rows = _turns(t).select("conv_id", "turn", *[F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs]).alias(name) for name, xs in parts.items()])
    ordered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", *parts))).alias("x"))
    return ordered.select("conv_id", *[F.array_join(F.col(f"x.{name}"), between).alias(name) for name in parts])


def _shown(blocks: DataFrame, *more: str) -> DataFrame:
    notes = F.array_join(F.transform("notes", lambda n: F.concat_ws(":", n["pos"].cast("string"), n["note"])), ",")
    return blocks.select("conv_id", "block", "kind", "chapter", "text", notes.alias("notes"), *more)


def _fb2(t: Tables) -> DataFrame:
    section = ["<section><title><p>", F.col("title"), '</p></title><p>', _escaped("text"), ' <a l:href="#n', F.col("j"), '" type="note">[', F.col("j"), "]</a></p></section>"]
    note = ['<section id="n', F.col("j"), '"><title><p>', F.col("j"), "</p></title><p>A note on ", F.col("title"), " (", F.col("j"), ").</p></section>"]
    texts = _written(t, section, extra={"notes": note})
    return texts.select("conv_id", F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?><FictionBook><body>'), "body", F.lit('</body><body name="notes">'), "notes", F.lit("</body></FictionBook>")).cast("binary").alias("file"))


@query(_BLOCKS)
def q_fb2_blocks(t: Tables) -> DataFrame:
    return _shown(tm.file_blocks(_fb2(t), "conv_id", "file"))


@query(_NOTES)
def q_fb2_notes(t: Tables) -> DataFrame:
    return tm.file_blocks(_fb2(t), "conv_id", "file", "notes").select("conv_id", "note", "text")


def _epub(t: Tables) -> DataFrame:
    """A file for each conversation: a document for each turn, and one of the notes, named by a table of contents."""
    chapter = ["<html><body><p>", _escaped("text"), ' <a epub:type="noteref" href="notes.xhtml#n', F.col("j"), '">', F.col("j"), "</a></p></body></html>"]
    note = ['<aside epub:type="footnote" id="n', F.col("j"), '"><p>A note on ', F.col("title"), " (", F.col("j"), ").</p></aside>"]
    texts = _written(t, chapter, "\x00", {"titles": [F.col("title")], "notes": note})

    @F.pandas_udf("binary")
    def packed(bodies: pd.Series, titles: pd.Series, notes: pd.Series) -> pd.Series:
        def one(body: str, title: str, note: str) -> bytes:
            out, documents = io.BytesIO(), body.split("\x00")
            items = "".join(f'<item id="d{k}" href="text/d{k}.xhtml" media-type="application/xhtml+xml"/>' for k in range(len(documents)))
            refs = "".join(f'<itemref idref="d{k}"/>' for k in range(len(documents)))
            points = "".join(f'<navPoint><navLabel><text>{x}</text></navLabel><content src="text/d{k}.xhtml"/></navPoint>' for k, x in enumerate(title.split("\x00")))
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("mimetype", "application/epub+zip")
                z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
                z.writestr("OPS/p.opf", f'<package><manifest>{items}<item id="n" href="text/notes.xhtml" media-type="application/xhtml+xml"/><item id="x" href="t.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="x">{refs}<itemref idref="n"/></spine></package>')
                z.writestr("OPS/t.ncx", f"<ncx><navMap>{points}</navMap></ncx>")
                z.writestr("OPS/text/notes.xhtml", f"<html><body>{note.replace(chr(0), '')}</body></html>")
                for k, x in enumerate(documents):
                    z.writestr(f"OPS/text/d{k}.xhtml", x)
            return out.getvalue()

        return pd.Series([one(*x) for x in zip(bodies, titles, notes)])

    return texts.select("conv_id", packed("body", "titles", "notes").alias("file"))


@query(_TURNS + "SELECT conv_id, j AS block, 'p' AS kind, j AS chapter, text, length(text) || ':n' || j AS notes FROM t")
def q_epub_blocks(t: Tables) -> DataFrame:
    return _shown(tm.file_blocks(_epub(t), "conv_id", "file"))


@query(_TURNS + "SELECT conv_id, j AS chapter, title, 1 AS level, j AS first_block FROM t")
def q_epub_chapters(t: Tables) -> DataFrame:
    return tm.file_blocks(_epub(t), "conv_id", "file", "chapters").select("conv_id", "chapter", "title", "level", "first_block")


@query(_NOTES)
def q_epub_notes(t: Tables) -> DataFrame:
    return tm.file_blocks(_epub(t), "conv_id", "file", "notes").select("conv_id", "note", "text")


def _reader_page(t: Tables) -> DataFrame:
    section = ['<section id="c', F.col("j"), '"><h2><p>', F.col("title"), "</p></h2><p>", _escaped("text"), ' <sup class="note"><a data-note-id="n', F.col("j"), '">{', F.col("j"), "}</a></sup></p></section>"]
    note = ['<div class="note" id="note-n', F.col("j"), '"><div class="note__body"><p>A note on ', F.col("title"), " (", F.col("j"), ").</p></div></div>"]
    texts = _written(t, section, extra={"notes": note})
    page = F.concat(F.lit('<html><body><nav>Menu</nav><article id="book-content">'), "body", F.lit('<section class="notes">'), "notes", F.lit("</section></article></body></html>"))
    return texts.select("conv_id", page.alias("html"))


@query(_BLOCKS)
def q_reader_page_blocks(t: Tables) -> DataFrame:
    return _shown(tm.html_blocks(_reader_page(t), "conv_id", "html"))


@query(_NOTES)
def q_reader_page_notes(t: Tables) -> DataFrame:
    return tm.html_notes(_reader_page(t), "conv_id", "html").select("conv_id", "note", "text")


def _web_page(t: Tables) -> DataFrame:
    """Pages of no layout, with chrome around the text and short links to notes further down."""
    text = ["<h2>", F.col("title"), "</h2><p>", _escaped("text"), '<sup><a href="#n', F.col("j"), '">', F.col("j"), "</a></sup></p>"]
    note = ['<p id="n', F.col("j"), '">A note on ', F.col("title"), " (", F.col("j"), ").</p>"]
    texts = _written(t, text, extra={"notes": note})
    top = F.lit('<html><head><title>x</title></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><header><p>Name of the site</p></header><div><div>')
    return texts.select("conv_id", F.concat(top, "body", "notes", F.lit("</div></div><footer><p>All rights reserved</p></footer></body></html>")).alias("html"))


@query(_BLOCKS)
def q_web_blocks(t: Tables) -> DataFrame:
    """The main part of pages, headings and paragraphs, without what is around it."""
    return _shown(tm.html_blocks(_web_page(t), "conv_id", "html"))


@query(_NOTES)
def q_html_notes(t: Tables) -> DataFrame:
    return tm.html_notes(_web_page(t), "conv_id", "html").select("conv_id", "note", "text")


# A table of the turns: a row is read as one sentence, a heading as well.
@query("""
WITH t AS (SELECT conv_id, turn, role || chr(9) || length(text) AS row FROM conversations),
b AS (SELECT conv_id, string_agg(row, chr(10) ORDER BY turn) AS text, count(*) AS n FROM t GROUP BY 1)
SELECT conv_id, 0 AS block, 'title' AS kind, 'All. Turns of it.' AS text, 1 AS n_sentences, 17 AS last_end, 0 AS n_cells, true AS spoken FROM b UNION ALL SELECT conv_id, 1, 'table', text, n, length(text), n * 2, false FROM b
""")
def q_fb2_tables(t: Tables) -> DataFrame:
    row = ["<tr><th>", F.col("role"), "</th><td><p>", F.length("text").cast("string"), "</p></td></tr>"]
    rows = t.conversations.select("conv_id", "turn", F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in row]).alias("row"))
    tables = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "row"))), lambda r: r["row"]), "\n").alias("rows"))
    file = F.concat(F.lit("<FictionBook><body><section><title><p>All. Turns of it.</p></title><table>"), "rows", F.lit("</table></section></body></FictionBook>"))
    blocks = tm.file_blocks(tables.select("conv_id", file.cast("binary").alias("file")), "conv_id", "file")
    n_cells = F.aggregate("cells", F.lit(0), lambda n, r: n + F.size(r))
    return blocks.select("conv_id", "block", "kind", "text", F.size("sentences").alias("n_sentences"), F.array_max(F.transform("sentences", lambda x: x["e"])).alias("last_end"), n_cells.alias("n_cells"), "spoken")


def _plain(t: Tables) -> DataFrame:
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    part = ["Chapter ", F.col("j"), "\n\n", flat, "*\n\n* A note on ", F.col("title"), " (", F.col("j"), ").\n\n* * *\n\nAfter a break.\n"]
    return _written(t, part, "\n").select("conv_id", F.col("body").alias("text"))


@query(_TURNS + """
SELECT conv_id, 3 * j AS block, 'title' AS kind, j AS chapter, 'Chapter ' || j AS text, '' AS notes, 0 AS gap FROM t
UNION ALL SELECT conv_id, 3 * j + 1, 'p', j, text, length(text) || ':n' || (j + 1), 0 FROM t UNION ALL SELECT conv_id, 3 * j + 2, 'p', j, 'After a break.', '', 1 FROM t
""")
def q_txt_blocks(t: Tables) -> DataFrame:
    """Plain texts with numbered chapters, footnotes by asterisks and scene breaks."""
    return _shown(tm.txt_blocks(_plain(t), "conv_id", "text"), "gap")


@query(_TURNS + "SELECT conv_id, 'n' || (j + 1) AS note, 'A note on ' || title || ' (' || j || ').' AS text FROM t")
def q_txt_notes(t: Tables) -> DataFrame:
    return part_of(_plain(t), "conv_id", "text", tm.txt_book, "notes").select("conv_id", "note", "text")


# Pages of lines: a running head, a heading, the text in lines of some sixty letters, a number;
# three closing pages, so that each book has heads and numbers that can be told.
@query(_TURNS + """
, c AS (SELECT conv_id, count(*) + x AS j, 'Closing page' AS title, 'The end of it all.' AS text FROM t CROSS JOIN (SELECT unnest([0, 1, 2]) AS x) GROUP BY conv_id, x),
a AS (SELECT * FROM t UNION ALL SELECT * FROM c)
SELECT conv_id, 2 * j AS block, 'title' AS kind, j AS chapter, title AS text, '' AS notes FROM a UNION ALL SELECT conv_id, 2 * j + 1, 'p', j, text, '' FROM a
""")
def q_page_lines(t: Tables) -> DataFrame:
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    turns = _turns(t).select("conv_id", F.col("j").cast("int").alias("page"), "title", flat.alias("text"))
    closing = turns.groupBy("conv_id").agg((F.max("page") + 1).alias("n")).select("conv_id", F.explode(F.sequence("n", F.col("n") + 2)).alias("page"), F.lit("Closing page").alias("title"), F.lit("The end of it all.").alias("text"))
    runs = F.regexp_extract_all("text", F.lit(r"\S.{0,59}(?= |$)|\S{60,}"), F.lit(0))
    number = F.concat(F.lit("- "), (F.col("page") + 11).cast("string"), F.lit(" -"))
    pages = turns.union(closing).select("conv_id", "page", F.concat(F.array(F.lit("Running head of all")), F.array("title"), runs, F.array(number)).alias("lines"))
    lines = pages.select("conv_id", "page", F.size("lines").alias("n"), F.posexplode("lines").alias("k", "text"))
    title, edge = F.col("k") == 1, (F.col("k") == 0) | (F.col("k") == F.col("n") - 1)
    placed = lines.select(
        "conv_id", "page", "text", F.when(title, 200.0).when(F.col("k") == 2, 70.0).otherwise(50.0).alias("x0"), F.when(title, 300.0).when(edge, 150.0).otherwise(400.0).alias("x1"),
        (900.0 - 12.0 * F.col("k") - F.when(F.col("k") > 1, 20.0).otherwise(0.0)).alias("y"), F.when(title, 16.0).when(edge, 8.0).otherwise(10.0).alias("size"), F.lit(False).alias("bold"),
    )
    return _shown(page_line_blocks(placed, "conv_id"))
