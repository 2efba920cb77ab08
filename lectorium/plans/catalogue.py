"""Queries over catalogues and libraries: ``part`` rows are hits, suppliers are sources, orders are books with ``lineitem`` files, customers readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.num import clock_seconds
from ..operators import catalogue as cat
from ..operators import library as lib
from ..registry import Tables, query

ASKED = "The large red widget of steel"
STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)

# A hit's title has a volume mark for two parts of three; its author is the brand, its source the key modulo 5.
_HITS = """
WITH hits AS (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_name || ', vol. ' || (p_partkey % 4) ELSE p_name || ' Part ' || ['I', 'II', 'IV', 'IX'][p_partkey % 4 + 1] || ' [litres]' END AS title,
         p_brand AS author, p_type AS translator, p_partkey % 5 AS source, 1990 + p_size AS year, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size * 10 END AS size_kb,
         'u' || (p_partkey % 1500) AS url, ['fb2', 'epub', 'pdf', 'djvu'][p_partkey % 4 + 1] AS kind
  FROM part
), normal AS (
  SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '(?i)\\b(?:т|том|кн|книга|ч|часть|vol|volume|part)\\.?\\s*(\\d+|[ivxlc]+)\\b', ' ', 'g'), '\\[[^\\]]*\\]|\\([^)]*$', ' ', 'g'), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS norm FROM hits
)
""".replace("\\\\", "\\")


def _hits(t: Tables) -> DataFrame:
    p = t.part
    k = F.col("p_partkey")
    roman = F.get(F.array(*[F.lit(x) for x in ("I", "II", "IV", "IX")]), (k % 4).cast("int"))
    title = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.concat("p_name", F.lit(", vol. "), (k % 4).cast("string"))).otherwise(F.concat("p_name", F.lit(" Part "), roman, F.lit(" [litres]")))
    kind = F.get(F.array(*[F.lit(x) for x in ("fb2", "epub", "pdf", "djvu")]), (k % 4).cast("int"))
    return p.select(
        k.alias("id"), title.alias("title"), F.col("p_brand").alias("author"), F.col("p_type").alias("translator"), (k % 5).alias("source"), (F.lit(1990) + F.col("p_size")).alias("year"),
        F.when(k % 7 != 0, F.col("p_size") * 10).alias("size_kb"), F.concat(F.lit("u"), (k % 1500).cast("string")).alias("url"), kind.alias("kind"),
    )


@query(_HITS + "SELECT id, title, norm FROM normal")
def q_norm_title(t: Tables) -> DataFrame:
    return _hits(t).select("id", "title", tx.norm_title(F.col("title")).alias("norm"))


_TERMS = _HITS + f"""
, w AS (SELECT id, norm, list_filter(string_split(norm, ' '), lambda w: w <> '') AS ws FROM normal),
q AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM w),
d AS (SELECT id, w, min(pos) AS pos FROM q WHERE length(w) > 2 AND w NOT IN ({STOP}) GROUP BY ALL)
"""


@query(_TERMS + "SELECT id, string_agg(w, ',' ORDER BY -length(w), pos) AS terms FROM d GROUP BY id")
def q_terms(t: Tables) -> DataFrame:
    return _hits(t).select("id", F.array_join(tx.terms(F.col("title")), ",").alias("terms"))


@query(_TERMS + "SELECT id, first(w ORDER BY -length(w), pos) AS longest, max(length(w)) AS length FROM d GROUP BY id")
def q_terms_longest(t: Tables) -> DataFrame:
    best = F.get(tx.terms(F.col("title")), F.lit(0))
    return _hits(t).select("id", best.alias("longest"), F.length(best).alias("length"))


_SAME = "({0} = {1} OR least(length({0}), length({1})) >= 3 AND abs(length({0}) - length({1})) <= CASE WHEN least(length({0}), length({1})) = 3 THEN 2 ELSE 3 END AND left({0}, greatest(3, least(length({0}), length({1})) - 2)) = left({1}, greatest(3, least(length({0}), length({1})) - 2)))"


def same(a: str, b: str) -> str:
    return _SAME.format(a, b)


_WORDS = "list_filter(string_split({0}, ' '), lambda z: z <> '')"
_SCORED = (
    _HITS
    + f"""
, w AS (
  SELECT n.*, {_WORDS.format('norm')} AS said, list_filter({_WORDS.format("trim(regexp_replace(lower(norm || ' ' || author || ' ' || translator), '[^a-z0-9]+', ' ', 'g'))")}, lambda z: z <> '') AS named, ['large', 'red', 'widget', 'steel'] AS asked FROM normal n
), m AS (
  SELECT *, len(list_filter(asked, lambda a: len(list_filter(named, lambda b: {same('a', 'b')})) > 0)) AS matched,
         len(list_filter(asked, lambda a: len(list_filter(said, lambda b: {same('a', 'b')})) > 0)) AS in_title,
         list_filter(said, lambda s: s NOT IN ({STOP})) AS own FROM w
), s AS (
  SELECT *, CASE WHEN norm = 'the large red widget of steel' THEN 6 WHEN starts_with(norm, 'the large red widget of steel') THEN 4 WHEN contains(norm, 'the large red widget of steel') THEN 2 ELSE 0 END
         + CASE WHEN len(own) > 0 AND len(list_filter(own, lambda b: len(list_filter(asked, lambda a: {same('b', 'a')})) > 0)) = len(own) THEN 5 ELSE 0 END
         + CASE WHEN matched = 4 THEN 6 ELSE 0 END + 2 * in_title + matched AS score FROM m
)
"""
)


def _row_text() -> F.Column:
    return F.concat_ws(" ", tx.norm_title(F.col("title")), F.col("author"), F.col("translator"))


def _scored(t: Tables) -> DataFrame:
    words = tx.said_words(F.lit(ASKED))
    return _hits(t).withColumns({"matched": tx.matched(words, _row_text()), "score": tx.title_score(F.lit(ASKED), words, F.col("title"), _row_text())})


@query(_SCORED + "SELECT id, matched FROM s")
def q_matched(t: Tables) -> DataFrame:
    return _scored(t).select("id", "matched")


@query(_SCORED + "SELECT id, score FROM s")
def q_title_score(t: Tables) -> DataFrame:
    return _scored(t).select("id", "score")


@query(_SCORED + "SELECT id, title FROM s WHERE contains(' ' || norm || ' ', ' large widget ') OR matched >= 2")
def q_relevant(t: Tables) -> DataFrame:
    phrase = F.contains(F.concat(F.lit(" "), tx.norm_title(F.col("title")), F.lit(" ")), F.lit(" large widget "))
    return _scored(t).where(phrase | (F.col("matched") >= 2)).select("id", "title")


NEEDLES = ("red w", "", "Brand#13", "  LARGE  ", "ё")


@query(_HITS + f"""
, f AS (SELECT id, trim(regexp_replace(replace(lower(title || ' ' || author || ' ' || translator), 'ё', 'е'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS text FROM hits),
q AS (SELECT unnest([{", ".join(f"'{x}'" for x in NEEDLES)}]) AS typed)
SELECT typed, id FROM f JOIN q ON typed = '' OR contains(text, trim(regexp_replace(replace(lower(typed), 'ё', 'е'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))
""")
def q_live_filter(t: Tables) -> DataFrame:
    """What stays in a list while something is typed; nothing typed leaves all."""
    rows = _hits(t).select("id", F.explode(F.array(*map(F.lit, NEEDLES))).alias("typed"), F.concat_ws(" ", "title", "author", "translator").alias("_text"))
    return rows.where(tx.typed_match(F.col("_text"), F.col("typed"))).select("typed", "id")


@query(_HITS + """
, RECURSIVE_ROWS AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY source, id) AS pos, norm AS file_title FROM normal),
fold AS (
  SELECT author, list({'id': id, 'url': url, 'file': CASE WHEN size_kb IS NULL THEN NULL ELSE norm || ':' || size_kb END} ORDER BY pos) AS rows FROM RECURSIVE_ROWS GROUP BY author
), kept AS (
  SELECT author, list_reduce(list_prepend({'ids': CAST([] AS BIGINT[]), 'urls': CAST([] AS VARCHAR[]), 'files': CAST([] AS VARCHAR[])}, list_transform(rows, lambda r: {'ids': [r.id], 'urls': [r.url], 'files': CASE WHEN r.file IS NULL THEN CAST([] AS VARCHAR[]) ELSE [r.file] END})),
    lambda a, r: CASE WHEN list_has_any(a.urls, r.urls) OR list_has_any(a.files, r.files) THEN a ELSE {'ids': list_concat(a.ids, r.ids), 'urls': list_concat(a.urls, r.urls), 'files': list_concat(a.files, r.files)} END) AS k FROM fold
)
SELECT author, unnest(k.ids) AS id FROM kept
""")
def q_unique_hits(t: Tables) -> DataFrame:
    """One search per author: a hit goes if its link, or its title and size, was seen on a hit kept before."""
    file_key = F.when(F.col("size_kb").isNotNull(), F.concat_ws(":", tx.norm_title(F.col("title")), F.col("size_kb").cast("string")))
    rows = _hits(t).select("author", "source", "id", "url", file_key.alias("file"))
    return cat.first_of_two_keys(rows, ["author"], ["source", "id"], "url", "file").select("author", "id")


_EDITIONS = _HITS + """
, v AS (SELECT *, CASE WHEN id % 3 = 1 AND id % 4 > 0 THEN id % 4 WHEN id % 3 = 2 THEN [1, 2, 4, 9][id % 4 + 1] END AS vol FROM normal),
n AS (SELECT *, row_number() OVER (PARTITION BY source, norm, author, vol ORDER BY id) AS rn FROM v WHERE vol IS NOT NULL),
e AS (
  SELECT source, norm, author, first(id ORDER BY vol, id) AS first_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY vol, id) AS parts, first(year ORDER BY vol, id) AS year, first(title ORDER BY vol, id) AS title FROM n WHERE rn = 1 GROUP BY ALL
  UNION ALL SELECT source, norm, author, id, CAST(id AS VARCHAR), year, title FROM v WHERE vol IS NULL
)
"""


def _editions(t: Tables) -> DataFrame:
    h = _hits(t).withColumn("norm", tx.norm_title(F.col("title")))
    e = cat.editions(h, ["source", "norm", "author"], tx.volume_number(F.col("title")), ["id"], F.struct("id", "year", "title"))
    first = F.get("parts", F.lit(0))
    ids = F.array_join(F.transform("parts", lambda p: p["id"].cast("string")), ",")
    return e.select("source", "norm", "author", first["id"].alias("first_id"), ids.alias("parts"), first["year"].alias("year"), first["title"].alias("title"))


@query(_EDITIONS + "SELECT source, norm, author, first_id, parts FROM e")
def q_editions(t: Tables) -> DataFrame:
    return _editions(t).select("source", "norm", "author", "first_id", "parts")


@query(_EDITIONS + "SELECT source, first_id, place FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY source, year DESC, title, first_id) AS place FROM e) WHERE place <= 30")
def q_top_hits(t: Tables) -> DataFrame:
    return cat.top_per_group(_editions(t), ["author"], ["source", F.desc("year"), "title", "first_id"], 30, "place").select("source", "first_id", "place")


@query(_SCORED + "SELECT id, place FROM (SELECT id, row_number() OVER (PARTITION BY source ORDER BY score DESC, year DESC, title, id) AS place FROM s) WHERE place <= 5")
def q_top5(t: Tables) -> DataFrame:
    return cat.top_per_group(_scored(t), ["source"], [F.desc("score"), F.desc("year"), "title", "id"], 5, "place").select("id", "place")


@query(_HITS + "SELECT kind, id % 5 AS source, author, n FROM (SELECT kind, source AS id, author, count(*) AS n, row_number() OVER (PARTITION BY kind, source ORDER BY count(*) DESC, min(id)) AS rn FROM hits GROUP BY kind, source, author) WHERE rn = 1")
def q_best_author(t: Tables) -> DataFrame:
    return cat.first_mode(_hits(t), ["kind", "source"], "author", "id").select("kind", "source", F.col("mode_value").alias("author"), "n")


@query("SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY CAST(regexp_extract(s_name, '(\\d+)', 1) AS BIGINT) % 50, s_suppkey) AS place FROM supplier")
def q_natural_sort(t: Tables) -> DataFrame:
    number = F.regexp_extract("s_name", r"(\d+)", 1).cast("long") % 50
    name = F.concat(F.lit("track "), number.cast("string"), F.lit(".mp3"))
    w = Window.partitionBy("s_nationkey").orderBy(tx.natural_key(name), "s_suppkey")
    return t.supplier.select("s_suppkey", F.row_number().over(w).alias("place"))


@query("""
SELECT l_orderkey, nullif(sum(coalesce(l_quantity, 0)), 0) AS duration_s, CAST(nullif(sum(coalesce(l_extendedprice, 0)), 0) AS DOUBLE) AS size_bytes, count(*) AS parts,
       round_even(sum(l_extendedprice) * 8 / sum(l_quantity) / 1000, 0) AS kbps FROM lineitem GROUP BY 1
""")
def q_recording_totals(t: Tables) -> DataFrame:
    total = lambda c: F.nullif(F.sum(F.coalesce(c, F.lit(0.0))), F.lit(0.0))
    return t.lineitem.groupBy("l_orderkey").agg(
        total("l_quantity").alias("duration_s"), total("l_extendedprice").alias("size_bytes"), F.count(F.lit(1)).alias("parts"), F.bround(F.sum("l_extendedprice") * 8 / F.sum("l_quantity") / 1000, 0).alias("kbps")
    )


_FORMATS = """
WITH f AS (SELECT l_orderkey, l_returnflag AS format, count(*) AS n, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL)
"""


@query(_FORMATS + "SELECT l_orderkey, format FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE format WHEN 'R' THEN 0 ELSE 1 END, n DESC, pos, format) AS rn FROM f) WHERE rn = 1")
def q_best_format(t: Tables) -> DataFrame:
    f = t.lineitem.groupBy("l_orderkey", F.col("l_returnflag").alias("format")).agg(F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("pos"))
    best = F.min(F.struct(F.when(F.col("format") == "R", 0).otherwise(1).alias("a"), (-F.col("n")).alias("b"), "pos", "format"))
    return f.groupBy("l_orderkey").agg(best.alias("b")).select("l_orderkey", F.col("b.format").alias("format"))


@query(_FORMATS + "SELECT l_orderkey, format, CASE WHEN n = 1 THEN pos END AS single FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE format WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS rn FROM f) WHERE rn = 1")
def q_best_single_file(t: Tables) -> DataFrame:
    f = t.lineitem.groupBy("l_orderkey", F.col("l_returnflag").alias("format")).agg(F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("pos"))
    rank = F.when(F.col("format") == "R", 0).when(F.col("format") == "A", 1).otherwise(2)
    best = f.groupBy("l_orderkey").agg(F.min(F.struct(rank.alias("r"), "format", "n", "pos")).alias("b"))
    return best.select("l_orderkey", F.col("b.format").alias("format"), F.when(F.col("b.n") == 1, F.col("b.pos")).alias("single"))


_JUDGED = _HITS + """
, g AS (SELECT *, nullif(size_kb, 0) AS len, list_distinct(list_transform(list_filter(string_split(norm, ' '), lambda w: length(w) > 2), lambda w: left(w, 5))) AS stem FROM normal),
r AS (SELECT *, len(list_intersect(stem, ['large', 'red', 'small'])) >= 1 AS related FROM g),
m AS (SELECT author, list_sort(list(len))[count(*) // 2 + 1] AS median FROM r WHERE related AND len IS NOT NULL GROUP BY 1),
j AS (SELECT r.id, r.author, NOT related AS other, coalesce(CASE WHEN source = 3 THEN 120 END, m.median) AS expected, coalesce(related AND len < 0.35 * coalesce(CASE WHEN source = 3 THEN 120 END, m.median), false) AS fragment FROM r LEFT JOIN m ON r.author = m.author)
"""


def _judged(t: Tables) -> DataFrame:
    """Recordings held against a book: one in five books has a length of its own."""
    related = F.size(F.array_intersect(tx.stems(F.col("title")), F.array(*map(F.lit, ("large", "red", "small"))))) >= 1
    return cat.judged(_hits(t), ["author"], related, "size_kb", F.when(F.col("source") == 3, 120))


@query(_JUDGED + "SELECT id, other, expected, fragment FROM j")
def q_judge_fragments(t: Tables) -> DataFrame:
    return _judged(t).select("id", "other", "expected", "fragment")


@query(_JUDGED + "SELECT id, author, row_number() OVER (PARTITION BY author, other ORDER BY fragment, id) AS place FROM j")
def q_fragment_mark(t: Tables) -> DataFrame:
    """Recordings of a book in order, fragments last; other books' apart."""
    w = Window.partitionBy("author", "other").orderBy("fragment", "id")
    return _judged(t).select("id", "author", F.row_number().over(w).alias("place"))


@query(_HITS + "SELECT id, list_distinct(list_transform(list_filter(string_split(norm, ' '), lambda w: length(w) > 2), lambda w: left(w, 5))) IS NOT NULL AS has, array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split(norm, ' '), lambda w: length(w) > 2), lambda w: left(w, 5)))), ',') AS stems FROM normal")
def q_stem(t: Tables) -> DataFrame:
    stems = tx.stems(F.col("title"))
    return _hits(t).select("id", stems.isNotNull().alias("has"), F.array_join(F.array_sort(stems), ",").alias("stems"))


@query(_EDITIONS + "SELECT id, vol FROM v")
def q_volume(t: Tables) -> DataFrame:
    return _hits(t).select("id", tx.volume_number(F.col("title")).cast("long").alias("vol"))


@query(_HITS + "SELECT id, kind, count(*) FILTER (WHERE kind = 'djvu') OVER (PARTITION BY author) AS dropped FROM hits QUALIFY kind <> 'djvu'")
def q_openable(t: Tables) -> DataFrame:
    dropped = F.count_if(F.col("kind") == "djvu").over(Window.partitionBy("author"))
    return _hits(t).withColumn("dropped", dropped).where("kind <> 'djvu'").select("id", "kind", "dropped")


@query("""
WITH v AS (SELECT p_partkey, left(md5(CAST(p_partkey AS VARCHAR)), 11 - CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 0 END) || CASE WHEN p_partkey % 13 = 0 THEN '!' ELSE '' END AS id, p_size * 12 AS seconds, p_partkey % 11 AS l FROM part)
SELECT p_partkey, id FROM v WHERE regexp_full_match(id, '[A-Za-z0-9_-]{11}') AND seconds >= 300 AND l NOT IN (0, 1)
""")
def q_min_length(t: Tables) -> DataFrame:
    """Videos that can be a reading: a proper id, five minutes or more, not live now or later."""
    k = F.col("p_partkey")
    name = F.left(F.md5(k.cast("string")), F.when(k % 9 == 0, 10).otherwise(11))
    video = F.concat(name, F.when(k % 13 == 0, "!").otherwise(""))
    live = F.when(k % 11 == 0, "is_live").when(k % 11 == 1, "is_upcoming").when(k % 11 == 2, "was_live")
    rows = t.part.select("p_partkey", video.alias("id"), (F.col("p_size") * 12).alias("seconds"), live.alias("live"))
    return rows.where(tx.is_video(F.col("id"), F.col("seconds"), F.col("live"))).select("p_partkey", "id")


@query("SELECT doc_id, coalesce(toxic = 0, true) AS narrated FROM documents LEFT JOIN labels USING (doc_id)")
def q_default_true(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "toxic"), "doc_id", "left").select("doc_id", F.coalesce(F.col("toxic") == 0, F.lit(True)).alias("narrated"))


@query("SELECT p_partkey, coalesce(nullif(left(trim(regexp_replace(lower(p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-'), 48), ''), 'book') AS slug FROM part")
def q_slug(t: Tables) -> DataFrame:
    long = F.concat_ws(" ", "p_name", "p_brand", "p_type", "p_name", "p_brand")
    return t.part.select("p_partkey", tx.slug(long).alias("slug"))


@query("""
WITH u AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^(www|m|blog)\\.', '') AS host,
  regexp_extract_all(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '(\\d+)', 1) AS runs FROM pages)
SELECT page_id, concat_ws('-', replace(string_split(host, '.')[1], '-', ''), list_filter(runs, lambda r: length(r) = list_max(list_transform(runs, lambda x: length(x))))[-1]) AS label,
       contains('.' || host || '.', '.' || string_split(host, '.')[1] || '.') AS labelled FROM u
""")
def q_url_label(t: Tables) -> DataFrame:
    host = F.regexp_replace(tx.url_host(F.col("url")), r"^(www|m|blog)\.", "")
    label = F.get(F.split(host, r"\."), F.lit(0))
    return t.pages.select("page_id", tx.url_label(F.col("url")).alias("label"), F.contains(F.concat(F.lit("."), host, F.lit(".")), F.concat(F.lit("."), label, F.lit("."))).alias("labelled"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity * 3600 + l_linenumber * 60 + l_suppkey % 60 AS DOUBLE) AS seconds FROM lineitem")
def q_durations(t: Tables) -> DataFrame:
    parts = [F.col("l_quantity").cast("int"), F.col("l_linenumber"), F.col("l_suppkey") % 60]
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", clock_seconds(F.concat_ws(":", *[p.cast("string") for p in parts])).alias("seconds"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_extendedprice / 100, 0) AS half_even, CAST(floor(l_extendedprice / 100 + 0.5) AS BIGINT) AS half_up, CAST(trunc(l_tax * 100) AS INTEGER) AS cents FROM lineitem")
def q_rounding(t: Tables) -> DataFrame:
    x = F.col("l_extendedprice") / 100
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.bround(x, 0).alias("half_even"), F.floor(x + 0.5).alias("half_up"), (F.col("l_tax") * 100).cast("int").alias("cents"))


# Libraries

_BOOKS = """
WITH b AS (SELECT o_orderkey AS slug, o_custkey AS reader, o_orderstatus AS status, o_orderpriority AS edition, o_orderdate AS added FROM orders),
f AS (SELECT l_orderkey AS slug, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS size, l_returnflag AS flag FROM lineitem)
"""


def _files(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("slug"), "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("size"), F.col("l_returnflag").alias("flag"))


@query(_BOOKS + "SELECT slug, string_agg(l_partkey || ':' || size, ',' ORDER BY l_linenumber, l_partkey || ':' || size) AS files FROM f GROUP BY 1")
def q_manifest(t: Tables) -> DataFrame:
    return lib.pack_files(_files(t), ["slug"], "l_linenumber", F.col("l_partkey"), F.col("size"))


@query(_BOOKS + "SELECT slug, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (WHERE flag = 'N') AS done, count(*) AS files, CASE WHEN sum(size) = 0 THEN count(*) FILTER (WHERE flag = 'N') / count(*) ELSE round(coalesce(sum(size) FILTER (WHERE flag = 'N'), 0) / sum(size), 6) END AS progress FROM f GROUP BY 1")
def q_sync_progress(t: Tables) -> DataFrame:
    done = F.col("flag") == "N"
    n, size = F.count(F.lit(1)), F.sum("size")
    progress = F.when(size == 0, F.count_if(done) / n).otherwise(F.round(F.coalesce(F.sum(F.when(done, F.col("size"))), F.lit(0)) / size, 6))
    return _files(t).groupBy("slug").agg(size.alias("bytes"), F.count_if(done).alias("done"), n.alias("files"), progress.alias("progress"))


@query(_BOOKS + "SELECT reader, count(*) AS books, CAST(sum(bytes) AS BIGINT) AS bytes FROM b JOIN (SELECT slug, sum(size) AS bytes FROM f GROUP BY 1) s ON b.slug = s.slug GROUP BY 1")
def q_shelf_bytes(t: Tables) -> DataFrame:
    bytes_ = _files(t).groupBy("slug").agg(F.sum("size").alias("bytes"))
    books = t.orders.select(F.col("o_orderkey").alias("slug"), F.col("o_custkey").alias("reader"))
    return books.join(bytes_, "slug").groupBy("reader").agg(F.count(F.lit(1)).alias("books"), F.sum("bytes").alias("bytes"))


_STATES = _BOOKS + """
, here AS (SELECT slug, list_sort(list(DISTINCT l_partkey || ':' || size) FILTER (WHERE flag <> 'R')) AS own, list_sort(list(DISTINCT l_partkey || ':' || size)) AS files, count(*) AS n FROM f GROUP BY 1),
s AS (SELECT b.slug, b.reader, b.edition, CASE WHEN status = 'O' THEN 'absent' WHEN edition LIKE '5%' THEN 'outdated' WHEN own IS NULL THEN 'textOnly' WHEN own = files THEN 'here' ELSE 'outdated' END AS state FROM b JOIN here ON b.slug = here.slug)
"""


def _copy_states(t: Tables) -> DataFrame:
    entry = F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("size").cast("string"))
    maps = _files(t).groupBy("slug").agg(
        F.map_from_entries(F.collect_set(F.struct(entry.alias("k"), F.col("size")))).alias("files"), F.map_from_entries(F.collect_set(F.when(F.col("flag") != "R", F.struct(entry.alias("k"), F.col("size"))))).alias("own")
    )
    books = t.orders.select(F.col("o_orderkey").alias("slug"), F.col("o_custkey").alias("reader"), F.col("o_orderpriority").alias("edition"), F.col("o_orderstatus").alias("status")).join(maps, "slug")
    mine = F.when(F.startswith("edition", F.lit("5")), "old").otherwise(F.col("edition"))
    return books.withColumn("state", lib.copy_state(F.col("status") != "O", mine, F.col("edition"), F.col("own"), F.col("files")))


@query(_STATES + "SELECT slug, state FROM s")
def q_copy_state(t: Tables) -> DataFrame:
    return _copy_states(t).select("slug", "state")


@query(_STATES + """
SELECT slug, reader FROM s WHERE reader % 10 <> 3 AND slug % 11 <> 5 AND slug % 13 <> 1 AND (state = 'absent' OR state = 'outdated' AND slug % 4 <> 0)
""")
def q_to_sync(t: Tables) -> DataFrame:
    """Some readers' books are skipped, some books done, some failed as they are, some in use."""
    slug = F.col("slug")
    signature = F.concat_ws("|", "edition", slug.cast("string"))
    marks = {"skipped": F.col("reader") % 10 == 3, "done": slug % 11 == 5, "busy": slug % 4 == 0, "signature": signature, "failed_signature": F.when(slug % 13 == 1, signature).when(slug % 13 == 2, "another")}
    return lib.to_sync(_copy_states(t).select("slug", "reader", "edition", "state").withColumns(marks)).select("slug", "reader")


@query(_BOOKS + """
, z AS (SELECT b.reader, b.slug, sum(size) AS size FROM b JOIN f ON b.slug = f.slug GROUP BY ALL),
l AS (SELECT reader, list({'id': slug, 'size': CAST(size AS DOUBLE)} ORDER BY size, slug) AS items FROM z GROUP BY 1),
k AS (SELECT reader, list_reduce(list_prepend({'left': CAST(380 AS DOUBLE), 'ids': CAST([] AS BIGINT[])}, list_transform(items, lambda x: {'left': x.size, 'ids': [x.id]})),
  lambda a, x: CASE WHEN x.left * 2 <= a.left THEN {'left': a.left - x.left, 'ids': list_concat(a.ids, x.ids)} ELSE a END) AS r FROM l)
SELECT reader, array_to_string(r.ids, ',') AS taken FROM k
""")
def q_greedy_fit(t: Tables) -> DataFrame:
    sizes = _files(t).groupBy("slug").agg(F.sum("size").cast("double").alias("size"))
    books = t.orders.select(F.col("o_orderkey").alias("slug"), F.col("o_custkey").alias("reader")).join(sizes, "slug")
    items = books.groupBy("reader").agg(F.array_sort(F.collect_list(F.struct("size", F.col("slug").alias("id")))).alias("items"))
    taken = lib.greedy_fit(F.col("items"), F.lit(400.0), 20)
    return items.select("reader", F.array_join(taken.cast("array<string>"), ",").alias("taken"))


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000) AND NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = c.c_nationkey AND s.s_suppkey % 7 = c.c_custkey % 7)")
def q_own_not_in_library(t: Tables) -> DataFrame:
    by_id = t.customer.join(t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    folders = t.supplier.select(F.col("s_nationkey").alias("c_nationkey"), (F.col("s_suppkey") % 7).alias("_f")).distinct()
    return by_id.withColumn("_f", F.col("c_custkey") % 7).join(folders, ["c_nationkey", "_f"], "left_anti").select("c_custkey")


@query("SELECT p_partkey, min(p_partkey) OVER (PARTITION BY lower(replace(p_name, ' ', '')), p_brand) AS first_key FROM part QUALIFY count(*) OVER (PARTITION BY lower(replace(p_name, ' ', '')), p_brand) > 1")
def q_duplicate_title(t: Tables) -> DataFrame:
    keyed = t.part.select("p_partkey", F.replace(F.lower("p_name"), F.lit(" "), F.lit("")).alias("k"), "p_brand")
    groups = keyed.groupBy("k", "p_brand").agg(F.min("p_partkey").alias("first_key"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(groups, ["k", "p_brand"]).select("p_partkey", "first_key")


# A book is an order: its lines are its files, its customer's events the reading, its date when it was added.
@query("""
WITH f AS (SELECT l_orderkey AS slug, bool_or(l_returnflag = 'R') AS m4a, bool_or(l_returnflag = 'A') AS mp3, bool_or(l_returnflag = 'N') AS webm, bool_or(l_linenumber = 4) AS timing, bool_or(l_linenumber = 2) AS text, bool_or(l_linenumber = 5) AS hits,
             min(CASE WHEN l_linenumber = 3 THEN 'cover.' || l_linestatus END) AS cover, sum(l_quantity) * 60 AS duration FROM lineitem GROUP BY 1),
e AS (SELECT user_id, max(event_id) AS opened, max(CASE WHEN event_type = 'view' THEN value END) AS pos, max(CASE WHEN event_type = 'click' THEN value END) / 5 AS sent_pct, sum(coalesce(value, 0)) AS seconds FROM events GROUP BY 1),
b AS (
  SELECT o_orderkey AS slug, o_custkey, coalesce(text, false) AS ready, CASE WHEN m4a THEN 'audio.m4a' WHEN mp3 THEN 'audio.mp3' WHEN webm THEN 'yt.webm' END AS audio, coalesce(timing, false) AS timed, o_orderstatus = 'P' AS building, epoch_ms(o_orderdate) AS added,
         coalesce(hits, false) AS has_hits, 'images/' || cover AS cover, CASE WHEN timing THEN duration ELSE 0 END AS duration, CASE WHEN o_orderkey % 5 = 0 THEN 'pages' ELSE '' END AS mode FROM orders LEFT JOIN f ON f.slug = o_orderkey
)
SELECT slug, ready, audio, audio IS NOT NULL AND timed AS has_audio, building, added, has_hits, cover, coalesce(opened, 0) AS opened, coalesce(pos, 0) AS pos, CAST(duration AS DOUBLE) AS duration, round(coalesce(sent_pct, 0), 6) AS sent_pct, mode, round(coalesce(seconds, 0), 4) AS seconds,
       CASE WHEN duration = 0 OR mode = 'pages' THEN coalesce(sent_pct, 0) >= 99 ELSE coalesce(pos, 0) >= duration - 60 END AS at_end FROM b LEFT JOIN e ON e.user_id = o_custkey
""")
def q_library_listing(t: Tables) -> DataFrame:
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    cover = F.min(F.when(line == 3, F.concat(F.lit("cover."), F.col("l_linestatus"))))
    files = t.lineitem.groupBy(F.col("l_orderkey").alias("slug")).agg(
        has(flag == "R").alias("m4a"), has(flag == "A").alias("mp3"), has(flag == "N").alias("webm"), has(line == 4).alias("timing"), has(line == 2).alias("text"), has(line == 5).alias("hits"), cover.alias("cover"), (F.sum("l_quantity") * 60).alias("length")
    )
    of = lambda kind, c: F.max(F.when(F.col("event_type") == kind, c))
    reading = t.events.groupBy(F.col("user_id").alias("o_custkey")).agg(F.max("event_id").alias("opened"), of("view", F.col("value")).alias("pos"), (of("click", F.col("value")) / 5).alias("pct"), F.sum(F.coalesce("value", F.lit(0.0))).alias("sec"))
    books = t.orders.select(F.col("o_orderkey").alias("slug"), "o_custkey", "o_orderstatus", "o_orderdate").join(files, "slug", "left").join(reading, "o_custkey", "left")
    return lib.listing(books.withColumns({"building": F.col("o_orderstatus") == "P", "added": F.unix_millis(F.col("o_orderdate").cast("timestamp")), "mode": F.when(F.col("slug") % 5 == 0, "pages").otherwise("")}))


@query("""
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderdate AS DATE) ELSE DATE '1990-01-01' END DESC, lower(p), o_orderkey) AS place
FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority[3:]) ELSE lower(o_orderpriority[3:]) END AS p FROM orders)
""")
def q_shelf_activity(t: Tables) -> DataFrame:
    """What was opened last comes first, then titles as a Russian reader orders them, whatever their case."""
    opened = F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate").cast("date")).otherwise(F.lit("1990-01-01").cast("date"))
    word = F.substring("o_orderpriority", 3, 100)
    title = F.when(F.col("o_orderkey") % 2 == 0, F.upper(word)).otherwise(F.lower(word))
    w = Window.partitionBy("o_custkey").orderBy(F.desc(opened), F.collate(title, "ru_CI"), "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place"))


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F' AND starts_with(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '1997-')) AS done_this_year, max(CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END) AS last_done FROM orders GROUP BY 1")
def q_shelf_done(t: Tables) -> DataFrame:
    day = F.col("o_orderdate").cast("date").cast("string")
    done = F.col("o_orderstatus") == "F"
    return t.orders.groupBy("o_custkey").agg(F.count_if(done & F.startswith(day, F.lit("1997-"))).alias("done_this_year"), F.max(F.when(done, day)).alias("last_done"))


@query("SELECT reader, slug FROM (SELECT o_custkey AS reader, o_orderkey AS slug, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def q_current_book(t: Tables) -> DataFrame:
    best = F.min(F.struct(F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("a"), (-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("b"), F.col("o_orderkey").alias("slug")))
    return t.orders.groupBy(F.col("o_custkey").alias("reader")).agg(best.alias("b")).select("reader", F.col("b.slug").alias("slug"))


@query("""
WITH new AS (SELECT p_partkey + 1000000 AS p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name || ' new' END AS p_name, p_size FROM part)
SELECT p_partkey, p_name, p_size FROM part UNION ALL SELECT * FROM new WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part)
""")
def q_dml_insert_unique(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_name", "p_size")
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit(" new")))
    new = rows.select((F.col("p_partkey") + 1_000_000).alias("p_partkey"), name.alias("p_name"), "p_size")
    return lib.insert_unless_title(rows, new, "p_name")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 10 <> 0 THEN 'renamed ' || c_custkey ELSE c_name END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def q_update_rows(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal")
    name = F.when(F.col("c_custkey") % 10 == 0, " ").otherwise(F.concat(F.lit("renamed "), F.col("c_custkey").cast("string")))
    patch = rows.where("c_custkey % 5 = 0").select("c_custkey", name.alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    return lib.update_by_id(rows, patch, "c_custkey", ["c_name", "c_acctbal"], required="c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def q_delete_rows(t: Tables) -> DataFrame:
    gone = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return lib.delete_by(t.customer.select("c_custkey", "c_name"), gone, "c_custkey")


@query("SELECT p_partkey, CASE WHEN p_partkey = 7 THEN 'A new name' ELSE p_name END AS p_name, CASE WHEN p_partkey = 7 THEN '' ELSE p_brand END AS saved_query FROM part")
def q_rename(t: Tables) -> DataFrame:
    one = F.col("p_partkey") == 7
    return t.part.select("p_partkey", F.when(one, "A new name").otherwise(F.col("p_name")).alias("p_name"), F.when(one, "").otherwise(F.col("p_brand")).alias("saved_query"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN md5(p_name || p_partkey) ELSE p_brand END AS id FROM part")
def q_backfill(t: Tables) -> DataFrame:
    stored = F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand"))
    return t.part.select("p_partkey", F.coalesce(stored, F.md5(F.concat("p_name", F.col("p_partkey").cast("string")))).alias("id"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def q_sweep(t: Tables) -> DataFrame:
    live = t.lineitem.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.where("o_orderstatus = 'O'").select("o_orderkey").join(live, "o_orderkey", "left_anti")


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, l_returnflag, count(*) FILTER (WHERE l_returnflag = 'A') OVER (PARTITION BY l_orderkey) AS audios FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey FROM f WHERE l_shipdate < TIMESTAMP '1998-01-01' AND (l_returnflag = 'R' OR l_returnflag = 'A' AND audios > 1)
""")
def q_leftovers(t: Tables) -> DataFrame:
    audios = F.count_if(F.col("l_returnflag") == "A").over(Window.partitionBy("l_orderkey"))
    old = t.lineitem.withColumn("audios", audios).where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return old.where("l_returnflag = 'R' or (l_returnflag = 'A' and audios > 1)").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey, sum(coalesce(nullif(CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE l_extendedprice END, 0), l_quantity * 16000) + l_quantity * 38000) AS needed, sum(l_quantity * 54000) > 5000000 AS too_much FROM lineitem GROUP BY 1")
def q_space_needed(t: Tables) -> DataFrame:
    known = F.nullif(F.when(F.col("l_linenumber") % 2 == 0, 0.0).otherwise(F.col("l_extendedprice")), F.lit(0.0))
    needed = F.sum(F.coalesce(known, F.col("l_quantity") * 16000) + F.col("l_quantity") * 38000)
    return t.lineitem.groupBy("l_orderkey").agg(needed.alias("needed"), (F.sum(F.col("l_quantity") * 54000) > 5_000_000).alias("too_much"))


@query(_BOOKS + "SELECT b.slug, b.edition || '|' || string_agg(l_partkey || ':' || size, ',' ORDER BY l_partkey || ':' || size) AS signature FROM b JOIN f ON b.slug = f.slug GROUP BY b.slug, b.edition")
def q_signature(t: Tables) -> DataFrame:
    files = _files(t).groupBy("slug").agg(F.array_sort(F.collect_list(F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("size").cast("string")))).alias("f"))
    books = t.orders.select(F.col("o_orderkey").alias("slug"), F.col("o_orderpriority").alias("edition"))
    return books.join(files, "slug").select("slug", F.concat("edition", F.lit("|"), F.array_join("f", ",")).alias("signature"))


@query(_HITS + "SELECT author, min(id) AS first_id, count(*) AS n, row_number() OVER (PARTITION BY min(source) ORDER BY min(id)) AS place FROM hits GROUP BY author")
def q_fold_rows(t: Tables) -> DataFrame:
    g = _hits(t).groupBy("author").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.min("source").alias("_s"))
    return g.select("author", "first_id", "n", F.row_number().over(Window.partitionBy("_s").orderBy("first_id")).alias("place"))


@query(_BOOKS + "SELECT slug, l_partkey, l_linenumber, row_number() OVER (PARTITION BY slug ORDER BY size, l_partkey, l_linenumber) AS place FROM f")
def q_smallest_first(t: Tables) -> DataFrame:
    w = Window.partitionBy("slug").orderBy("size", "l_partkey", "l_linenumber")
    return _files(t).select("slug", "l_partkey", "l_linenumber", F.row_number().over(w).alias("place"))


@query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS place FROM part")
def q_new_first(t: Tables) -> DataFrame:
    return t.part.select("p_brand", "p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_partkey"))).alias("place"))


@query("SELECT n_nationkey, s_suppkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_name) AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def q_listing_order(t: Tables) -> DataFrame:
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select("n_nationkey", "s_suppkey", F.row_number().over(Window.partitionBy("n_nationkey").orderBy("s_name")).alias("place"))


@query("SELECT 0 AS source_rank, p_partkey AS pos, p_name AS title FROM part UNION ALL SELECT 1, s_suppkey, s_name FROM supplier UNION ALL SELECT 2, c_custkey, c_name FROM customer")
def q_union_sources(t: Tables) -> DataFrame:
    parts = [t.part.select(F.lit(0).alias("source_rank"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("title"))]
    parts.append(t.supplier.select(F.lit(1), "s_suppkey", "s_name"))
    parts.append(t.customer.select(F.lit(2), "c_custkey", "c_name"))
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT o_custkey AS id, 'shared' AS kind FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL SELECT c_custkey, 'local' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def q_union_local(t: Tables) -> DataFrame:
    shared = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).distinct()
    local = t.customer.select(F.col("c_custkey").alias("id")).join(shared, "id", "left_anti")
    return shared.withColumn("kind", F.lit("shared")).union(local.withColumn("kind", F.lit("local")))


@query("SELECT o_custkey, string_agg(p, ',' ORDER BY first_key) AS priorities FROM (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS first_key FROM orders GROUP BY ALL) GROUP BY 1")
def q_distinct_first(t: Tables) -> DataFrame:
    listed = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("l"))
    return listed.select("o_custkey", F.array_join(F.array_distinct(F.transform("l", lambda x: x["o_orderpriority"])), ",").alias("priorities"))


@query("SELECT l_orderkey AS job FROM lineitem WHERE l_linestatus = 'O' UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def q_jobs_union(t: Tables) -> DataFrame:
    return t.lineitem.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("job")).union(t.orders.where("o_orderstatus = 'P'").select("o_orderkey")).distinct()


@query(_HITS + "SELECT id, list_has_all(string_split(regexp_replace(lower(author), '[^a-z0-9]+', ' ', 'g'), ' '), ['brand', '13']) AS in_block FROM hits")
def q_author_block(t: Tables) -> DataFrame:
    want = F.array(F.lit("brand"), F.lit("13"))
    return _hits(t).select("id", (F.size(F.array_except(want, tx.title_words(F.col("author")))) == 0).alias("in_block"))


@query("SELECT c_custkey AS wish FROM customer WHERE c_custkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def q_wish_loaded(t: Tables) -> DataFrame:
    loaded = t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("wish"))
    return t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("wish")).join(loaded, "wish", "left_anti")


@query("""
WITH n AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity AS q, row_number() OVER w AS rn FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
SELECT l_orderkey, rn, coalesce(lag(q) OVER w = q - 1, false) OR coalesce(lag(q, 2) OVER w = q - 2, false) OR coalesce(lead(q) OVER w = q + 1, false) OR coalesce(lead(q, 2) OVER w = q + 2, false) AS counts_on FROM n WINDOW w AS (PARTITION BY l_orderkey ORDER BY rn)
""")
def q_count_on(t: Tables) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    q = F.col("l_quantity")
    near = [F.lag(q, k).over(order) == q - k for k in (1, 2)] + [F.lead(q, k).over(order) == q + k for k in (1, 2)]
    hit = F.lit(False)
    for x in near:
        hit = hit | F.coalesce(x, F.lit(False))
    return t.lineitem.select("l_orderkey", F.row_number().over(order).alias("rn"), hit.alias("counts_on"))


@query("SELECT p_partkey, CASE WHEN rn = 1 THEN p_name ELSE p_name || '-' || rn END AS unique_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)")
def q_unique_names(t: Tables) -> DataFrame:
    return cat.unique_names(t.part.select("p_partkey", "p_name"), "p_name", ["p_partkey"]).select("p_partkey", "unique_name")


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace('  ' || p_name || chr(9) || p_brand || chr(10) || ' ' || p_type, '[\\x00-\\x1f\\x7f]', ' ', 'g'), '[ \\t]+', ' ', 'g')) AS title FROM part")
def q_clean_title(t: Tables) -> DataFrame:
    dirty = F.concat(F.lit("  "), "p_name", F.lit("\t"), "p_brand", F.lit("\n "), "p_type")
    return t.part.select("p_partkey", tx.clean_title(dirty).alias("title"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN p_type WHEN 2 THEN replace(p_brand, '#', ' ') ELSE p_name END AS narrator FROM part
""")
def q_reader_name(t: Tables) -> DataFrame:
    """Who reads a video: as its title says («читает …»), else its channel."""
    title = F.when(F.col("p_partkey") % 4 == 1, F.concat("p_name", F.lit(", ЧИТАЕТ: "), "p_type", F.lit(" (2020)"))).when(F.col("p_partkey") % 4 == 2, F.concat("p_name", F.lit(" | озвучила – "), F.replace("p_brand", F.lit("#"), F.lit(" ")), F.lit(" - ")))
    title = title.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit(" чтец x"))).otherwise(F.col("p_name"))
    channel = F.when(F.col("p_partkey") % 4 == 0, F.col("p_type")).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", tx.narrator(title, channel).alias("narrator"))


@query("""
WITH m AS (SELECT CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'c' || c_custkey END AS id, 'book' || c_custkey AS slug, c_acctbal >= 0 AS movable FROM customer),
t AS (SELECT 'c' || s_suppkey * 5 AS id, 'book' || s_suppkey * 2 AS slug FROM supplier UNION ALL SELECT '', 'book' || s_suppkey * 2 || '-2' FROM supplier WHERE s_suppkey % 2 = 0)
SELECT m.id, m.slug, CASE WHEN k.id IS NOT NULL THEN 'already' WHEN movable THEN 'moved' ELSE 'failed' END AS outcome,
       CASE WHEN k.id IS NOT NULL THEN k.slug WHEN m.slug NOT IN (SELECT slug FROM t) THEN m.slug WHEN m.slug || '-2' NOT IN (SELECT slug FROM t) THEN m.slug || '-2' ELSE m.slug || '-3' END AS target
FROM m LEFT JOIN t k ON k.id = m.id AND k.id <> ''
""")
def q_move_books(t: Tables) -> DataFrame:
    name = lambda n: F.concat(F.lit("book"), n.cast("string"))
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    mine = t.customer.select(F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("c"), k.cast("string"))).alias("id"), name(k).alias("slug"), (F.col("c_acctbal") >= 0).alias("movable"))
    there = t.supplier.select(F.concat(F.lit("c"), (s * 5).cast("string")).alias("id"), name(s * 2).alias("slug"))
    there = there.union(t.supplier.where("s_suppkey % 2 = 0").select(F.lit(""), F.concat(name(s * 2), F.lit("-2"))))
    return lib.move_books(mine, there)


@query("SELECT o_custkey, max(CASE WHEN o_orderstatus = 'O' AND o_orderdate > lib_at THEN o_orderkey END) AS local_wins FROM (SELECT *, max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) OVER (PARTITION BY o_custkey) AS lib_at FROM orders) GROUP BY 1")
def q_newer_local(t: Tables) -> DataFrame:
    lib_at = F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).over(Window.partitionBy("o_custkey"))
    newer = (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") > F.col("lib_at"))
    return t.orders.withColumn("lib_at", lib_at).groupBy("o_custkey").agg(F.max(F.when(newer, F.col("o_orderkey"))).alias("local_wins"))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN 'folder' WHEN c_acctbal < 0 THEN 'changed' WHEN c_acctbal < 1000 THEN 'space' ELSE '' END AS reason FROM customer")
def q_stop_reason(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.when(F.col("c_nationkey") == 0, "folder").when(F.col("c_acctbal") < 0, "changed").when(F.col("c_acctbal") < 1000, "space").otherwise("").alias("reason"))


@query(_HITS + """
, w AS (SELECT *, CASE WHEN id % 5 = 0 THEN title || '/' || id ELSE title END AS page FROM hits)
SELECT id, row_number() OVER (PARTITION BY author ORDER BY size_kb NULLS FIRST, id) AS place FROM w WHERE NOT contains(page, '/') AND id % 7 <> 3
""")
def q_whole_works(t: Tables) -> DataFrame:
    """Pages of a search that are whole works, in the order of the search."""
    page = F.when(F.col("id") % 5 == 0, F.concat("title", F.lit("/"), F.col("id").cast("string"))).otherwise(F.col("title"))
    works = cat.whole_works(_hits(t).withColumn("page", page), "page", F.col("id") % 7 == 3)
    return works.select("id", F.row_number().over(Window.partitionBy("author").orderBy("size_kb", "id")).alias("place"))


@query(_SCORED + "SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS rn FROM s) WHERE rn <= 10 AND (contains(norm, 'widget') OR matched >= 2)")
def q_first_ten(t: Tables) -> DataFrame:
    first = cat.top_per_group(_scored(t), ["source"], ["id"], 10)
    return first.where(F.contains(tx.norm_title(F.col("title")), F.lit("widget")) | (F.col("matched") >= 2)).select("id", "source")


@query(_SCORED + "SELECT id, source FROM (SELECT *, max(matched) OVER (PARTITION BY source) AS most FROM s) WHERE CASE WHEN most >= 2 THEN matched >= 2 ELSE matched >= 1 END")
def q_relevant_or_any(t: Tables) -> DataFrame:
    scored = _scored(t)
    most = scored.groupBy(F.col("source").alias("_s")).agg(F.max("matched").alias("most"))
    told = scored.join(F.broadcast(most), F.col("source") == F.col("_s"))  # five sources
    return told.where(F.when(F.col("most") >= 2, F.col("matched") >= 2).otherwise(F.col("matched") >= 1)).select("id", "source")


@query("""
WITH f AS (SELECT p_partkey, replace(p_name, ' ', '-') || CASE p_partkey % 4 WHEN 0 THEN '-Ivan Petrov-ID' WHEN 1 THEN ' - petrov' WHEN 2 THEN '-CN' ELSE '' END AS file FROM part)
SELECT p_partkey, p_name AS title, CASE p_partkey % 4 WHEN 0 THEN 'id' WHEN 2 THEN 'zh' ELSE '' END AS lang, CASE WHEN p_partkey % 4 < 2 THEN 'Ivan Petrov' ELSE '' END AS author FROM f JOIN part USING (p_partkey)
""")
def q_suffix(t: Tables) -> DataFrame:
    """Title, language and author from a file's name."""
    k = F.col("p_partkey")
    file = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.when(k % 4 == 0, "-Ivan Petrov-ID").when(k % 4 == 1, " - petrov").when(k % 4 == 2, "-CN").otherwise(""))
    return t.part.select("p_partkey", tx.file_parts(file, r"(?:Ivan\s+)?Petrov", "Ivan Petrov").alias("x")).select("p_partkey", "x.*")


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x > 0.1)) AS light, len(list_filter(embedding, lambda x: x < -0.1)) AS dark, len(list_filter(embedding, lambda x: abs(x) <= 0.1)) * 2 < len(embedding) AS ink FROM embeddings")
def q_pixels(t: Tables) -> DataFrame:
    count = lambda f: F.size(F.filter("embedding", f)).cast("long")
    limit = F.lit(0.1)
    return t.embeddings.select(
        "vec_id", count(lambda x: x.cast("double") > limit).alias("light"), count(lambda x: x.cast("double") < -limit).alias("dark"), (count(lambda x: F.abs(x.cast("double")) <= limit) * 2 < F.size("embedding")).alias("ink")
    )


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
c AS (SELECT vec_id, list_transform(v, lambda x: x - list_avg(v)) AS v FROM e)
SELECT a.vec_id, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) AS correlation FROM c a JOIN c b ON b.vec_id = a.vec_id + 1
""")
def q_correlation(t: Tables) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size("embedding")
    centred = t.embeddings.select("vec_id", F.transform(v, lambda x: x - mean).alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    following = centred.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("n"))
    return centred.join(following, "vec_id").select("vec_id", F.round(dot("v", "n") / F.sqrt(dot("v", "v") * dot("n", "n")), 6).alias("correlation"))


@query("SELECT page_id, len(string_split(url || '  ' || url || ',x', ' ')) - 1 AS n, 1 AS one FROM pages")
def q_split_links(t: Tables) -> DataFrame:
    links = F.filter(F.split(F.concat("url", F.lit("  "), "url", F.lit(",x")), r"\s+"), lambda x: x != "")
    return t.pages.select("page_id", F.size(links).cast("long").alias("n"), F.lit(1).alias("one"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1), '\\.[a-z0-9]{2,4}$', ''), '[_-]+', ' ', 'g')) AS title FROM pages")
def q_file_title(t: Tables) -> DataFrame:
    name = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "([^/]*)$", 1)
    return t.pages.select("page_id", F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[a-z0-9]{2,4}$", ""), "[_-]+", " ")).alias("title"))
