import numpy as np
from pyspark.sql import functions as F

from lectorium.functions import queries as q
from lectorium.functions import signals, styles
from lectorium.operators.back_matter import text_end, text_ends


def test_lengths():
    assert [styles.length(x) for x in ("1.5em", "16px", "12pt", "5%", "0", "3", "auto", "1e3em", "0.0", "")] == [15, 10, 10, 15, 0, None, None, None, 0, None]
    assert styles.declared("text-align: CENTER !important; margin: 1em 2em; padding:0 0 0 .5em; color: red; text-indent") == {"a": "c", "ml": 20, "pl": 5}
    assert [styles.left_of(x) for x in ("1", "1 2", "1 2 3", "1 2 3 4", "1 2 3 4 5", "")] == ["1", "2", "2", "4", "", ""]


def test_plain_rules():
    css = "\ufeff/* p{a:b} */ @import 'x;y'; p{x:1}@media print { p { y:2 } q{z:3} } q { content: '} ;' ; w:'a\\'}' } a{b{c:d}} .open{e:f"
    assert [(s, b.strip()) for s, b in styles.plain_rules(css)] == [("p", "x:1"), ("q", "content: '} ;' ; w:'a\\'}'")]


def test_cascade(spark):
    css = "/* p{text-align:left} */ @media print { p { text-indent: 9em } } p { text-indent: 1em; content: '} ;' } .x{text-indent:2em} p.x, div > p {text-indent:3em} .y{text-align:right}"
    sheets = spark.createDataFrame([("b", css)], "book string, css string").select("book", styles.sheet_rules(F.col("css")).alias("rules"))
    rows = [("b", 1, "P", [], None), ("b", 2, "p", ["x"], ""), ("b", 3, "div", ["x", "y"], "text-align: left"), ("c", 1, "p", ["x"], "margin:1em")]
    elements = spark.createDataFrame(rows, "book string, id int, name string, classes array<string>, style string")
    own = {(r.book, r.id): {k: v for k, v in r.own.asDict().items() if v is not None} for r in styles.own_says(elements, sheets, ["book"], ["id"]).collect()}
    assert own == {("b", 1): {"i": 10}, ("b", 2): {"i": 30}, ("b", 3): {"i": 20, "a": "l"}, ("c", 1): {"ml": 10}}
    says = lambda a=None, i=None, ml=None, pl=None: (a, i, ml, pl)
    looks = spark.createDataFrame([("p", says(i=0, ml=15), says(a="j"), 5), ("title", says(a="c"), says(i=20), 0), ("p", says(i=101), says(a="l", i=10), None)], f"kind string, own struct<{styles.SAYS}>, inherited struct<{styles.SAYS}>, gap int".replace("string, i int, ml int, pl int", "string,i int,ml int,pl int"))
    got = [tuple(r.x) for r in looks.select(styles.block_look(F.col("kind"), F.col("own"), F.col("inherited"), F.col("gap")).alias("x")).collect()]
    assert got == [("j", 0.0, 1.5, 3), (None, None, None, None), ("l", None, None, None)]


def test_lag(spark):
    rng = np.random.default_rng(1)
    sound = rng.normal(size=4000)
    assert signals.best_lag(sound[100:3100], sound[112:3112], 50) == 12
    assert signals.best_lag(sound[112:3112], sound[100:3100], 50) == -12
    assert signals.best_lag(rng.normal(size=3000), sound[:3000], 50) is None
    assert signals.best_lag(np.zeros(100), sound[:100], 9) is None and signals.best_lag(np.array([]), sound, 9) is None
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert e.select(signals.lag(F.col("embedding"), F.col("embedding"), 5).alias("l")).distinct().collect()[0].l == 0


def test_wave_windows():
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as sound:
        sound.setparams((2, 2, 8000, 0, "NONE", ""))
        sound.writeframes(np.stack([np.arange(0, 8000, 2), np.arange(0, 8000, 2) + 8], 1).astype("<i2").tobytes())
    got = signals.wave_window(out.getvalue(), 0.25, 0.125)
    assert len(got) == 2000 and abs(got[0] * 32768 - 4004) < 1e-3 and abs(got[1] * 32768 - 4005) < 1e-3
    assert len(signals.wave_window(out.getvalue(), 0.4, 5.0)) == 1600 and len(signals.wave_window(out.getvalue(), 9.0, 1.0)) == 0


def test_query_helpers(spark):
    def values(f, texts):
        return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(f(F.col("t"))).collect()]

    tries = values(q.shorter_queries, ["Толстой Война и мир", "мир", "", "a b", "один два три четыре пять шесть"])
    assert tries == [["толстой война", "война и мир", "толстой война и"], ["мир"], [], [], ["один два", "четыре", "шесть"]]
    assert values(q.spoken_seconds, ["97 часов 37 минут", "5 сек", "нет", None, "1ч 2 мин 3с"]) == [351420, 5, None, None, 3723]
    assert values(q.page_number, ["12", "- 12 -", "xiv", "стр. 7", "civil", "two", "", "[IX].", "12345", "iiii", "mcmxcix", "mmm", None]) == [12, 12, 14, 7, None, None, None, 9, None, None, 1999, 3000, None]
    assert q.utf16_offsets("a😀b", [0, 1, 2, 3, 9]) == [0, 1, 3, 4, 4]
    assert q.collapsed(" a\n b  ", [0, 1, 2, 3, 4, 5, 9]) == ("a b", [0, 0, 1, 2, 2, 3, 3])
    row = spark.range(1).select(
        q.fold_accents(F.lit("Éloïse ё")), q.is_slug(F.lit("a-1")), q.is_slug(F.lit("../a")), q.is_plain_file(F.lit("a.txt")), q.is_plain_file(F.lit(".hid")), q.same_site(F.lit("https://x.Org:8/a"), F.lit("org")),
        q.same_site(F.lit("https://evilx.org"), F.lit("x.org")),
    ).first()
    assert list(row) == ["Eloise е", True, False, True, False, True, False]


def test_text_end(spark):
    book = [("One", 1, 40), ("Two", 1, 40), ("Примечания", 1, 5), ("К первой главе", 2, 5)]
    assert text_end(book) == 2
    assert text_end([("One", 1, 90), ("А", 1, 3), ("Б", 1, 3), ("Вв", 1, 3)]) == 1
    assert text_end([("One", 1, 90), ("А", 1, 3), ("Б", 1, 3)]) == 3
    assert text_end([("One", 1, 90), ("Index", 1, 3), ("Эпилог", 1, 3)]) == 3
    assert text_end([("One", 1, 30), ("Index", 1, 70)]) == 2
    assert text_end([("One", 1, 5000), ("Colophon", 1, 1)]) == 1 and text_end([]) == 0
    rows = spark.createDataFrame([(1, k, *c) for k, c in enumerate(book)], "book int, chapter int, title string, level int, sentences int")
    assert text_ends(rows, "book").first().text_end == 2
