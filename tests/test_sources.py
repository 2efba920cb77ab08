import io
import json
import zipfile

from pyspark.sql import functions as F

from lectorium.operators import books, epub, fb2, markup, page_lines, reader_page, text_model
from lectorium.sources import catalogues, feeds, files

PAGE = """<html><head><title>x</title></head><body><nav><a href="/">Home page of the site</a></nav><div id=main><h1>On <em>water</em></h1>
<p>Water is   wet<a href="#n1">[1]</a>. It flows.<p>A second <b>bold</b> paragraph here, long enough to hold the text.</p>
<blockquote><p>Quoted words of another.</p></blockquote><table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>
<ul><li>One point</li><li>Two points</li></ul><p id=n1><a href="#b1">1</a> A note on being wet.</p></div><footer>Imprint</footer></body></html>"""


def test_html_book():
    book = markup.html_book(PAGE)
    blocks, notes = book.blocks, {k: n.text for k, n in book.notes.items()}
    assert [b.kind for b in blocks] == ["title", "p", "p", "cite", "table", "p", "p"]
    assert blocks[0].text == "On water" and blocks[0].marks == [("em", 3, 8)]
    assert blocks[1].text == "Water is wet. It flows." and blocks[1].notes == [(12, "n1")]
    assert len(blocks[1].sentences()) == 2 and blocks[4].sentences() == [(0, 3), (4, 7)]
    assert notes == {"n1": "1 A note on being wet."}
    assert "Imprint" not in " ".join(b.text for b in blocks)


def test_many_notes_are_quick():
    import time

    page = "<body>" + "".join(f"<p>Text number {i}<a href='#f{i}'>{i}</a> goes on.</p>" for i in range(2000)) + "".join(f"<p id=f{i}>Note number {i} has text.</p>" for i in range(2000)) + "</body>"
    began = time.time()
    book = markup.html_book(page)
    blocks, notes = book.blocks, book.notes
    assert time.time() - began < 2.0 and len(notes) == 2000 and len(blocks) == 2000


def test_damaged_pages():
    for page in ("", "<", "<p", "<p>a<div>b", "</div></p>x", "<table><tr><td>", "<div>" * 3000 + "deep", "<p>&bogus; &#x41;"):
        assert isinstance(reader_page.web_book(page).blocks, list)


FB2 = """<?xml version="1.0"?><FictionBook xmlns:l="x"><description><title-info><book-title>T</book-title></title-info></description>
<body><section><title><p>Part one</p><p>The road</p></title><epigraph><p>Wise words.</p><text-author>A. Wise</text-author></epigraph>
<p>It began<a l:href="#n1" type="note">1</a>. It&nbsp;went on & on.</p><subtitle>* * *</subtitle><poem><stanza><v>A line</v><v>Another</v></stanza></poem></section></body>
<body name="notes"><section id="n1"><title><p>1</p></title><p>A note.</p></section></body></FictionBook>"""


def test_fb2():
    book = fb2.fb2_book(FB2)
    assert [(b.kind, b.text) for b in book.blocks] == [
        ("title", "Part one"), ("title", "The road"), ("epigraph", "Wise words."), ("author", "A. Wise"), ("p", "It began. It went on & on."), ("subtitle", "* * *"), ("verse", "A line"), ("verse", "Another"),
    ]
    assert book.blocks[4].notes == [(8, "n1", "1")] and book.notes["n1"].text == "A note." and book.title == "T"
    assert [(c.title, c.level, c.first_block) for c in book.chapters] == [("Part one. The road", 1, 0)] and [b.stanza for b in book.blocks[6:]] == [1, 1]


def fb2_of(body: str, rest: str = "") -> str:
    return f'<FictionBook xmlns:l="x"><body><section><title><p>T</p></title>{body}</section></body>{rest}</FictionBook>'


NOTES = '<body name="notes"><section id="n1"><title><p>1</p></title><p>One <emphasis>word</emphasis>:<image l:href="#p.png"/></p><poem><stanza><v>first</v><v>second</v></stanza></poem><p>end</p></section></body>'
PICTURES = '<binary id="p.png">AAAA</binary><binary id="q.png">BBBB</binary><binary id="bad.png">*</binary>'


def test_fb2_notes_and_pictures():
    book = fb2.fb2_book(fb2_of('<p>A whale <a l:href="#n1" type="note">{1}</a>. In<a l:href="#n1">[1]</a>water <a l:href="#n1">1</a> "so".</p><p><a l:href="#n1">1</a></p><p>See <a l:href="#none" type="note">there</a></p>', NOTES + PICTURES))
    p = book.blocks[1]
    assert p.text == 'A whale. In water "so".' and p.notes == [(7, "n1", "1"), (11, "n1", "1"), (17, "n1", "1"), (23, "n1", "1")]
    assert book.blocks[2].text == "See there"
    note = book.notes["n1"]
    assert note.text == "One word:\n\nfirst\nsecond\n\nend" and note.kinds == [(11, 23, "verse")]
    assert note.marks == [("em", 4, 8)] and note.pictures == [(9, "images/p.png")]
    shown = fb2.fb2_book(fb2_of('<image l:href="#p.png"/><p>One<image l:href="#q.png"/> two</p><image l:href="#q.png"/><image l:href="#bad.png"/></section><section><title><p>U</p></title><p>x</p>', PICTURES))
    assert [(b.text, b.images, b.pictures) for b in shown.blocks] == [("T", [], []), ("One two", [("images/p.png", False), ("images/q.png", True)], [(3, "images/q.png")]), ("U", [], []), ("x", [], [])]


def test_fb2_tables_gaps_and_stars():
    table = "<table><tr><th>a</th><th>b</th></tr><tr><td><strong>c</strong></td><td>d</td></tr></table>"
    book = fb2.fb2_book(fb2_of(f"<p>x</p><empty-line/><empty-line/><p>word* and 5*3</p><p>* About it.</p><p>* * *</p>{table}"))
    assert [(b.kind, b.text, b.gap) for b in book.blocks] == [("title", "T", 0), ("p", "x", 0), ("p", "word and 5*3", 2), ("p", "* * *", 0), ("table", "a\tb\nc\td", 0)]
    assert book.blocks[2].notes == [(4, "star1", "*")] and book.notes["star1"].text == "About it."
    assert book.blocks[4].cells == [[(0, 1, True), (2, 3, True)], [(4, 5, False), (6, 7, False)]] and not book.blocks[4].spoken and book.blocks[4].marks == [("strong", 4, 5)]


def test_fb2_sections_and_bodies():
    book = fb2.fb2_book('<FictionBook><body><title><p>Book</p></title><section id="a"><title><p>A</p></title><section><p>no title</p></section><section><title><p>A1</p></title><p id="a">x</p></section></section><section><subtitle>Heading</subtitle><p>y</p></section></body><body name="other"><section><title><p>Extra</p></title><p>z</p></section></body></FictionBook>')
    assert [(c.id, c.title, c.level, c.first_block) for c in book.chapters] == [("body", "Book", 1, 0), ("a", "A", 1, 1), ("s2", "A1", 2, 3), ("s3", "Heading", 1, 5), ("s4", "Extra", 1, 7)]
    assert [b.id for b in book.blocks] == ["b0", "b1", "b2", "b3", "a", "b5", "b6", "b7", "b8"] and [b.chapter for b in book.blocks] == [0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_damaged_fb2():
    assert fb2.repaired("a &amp; b & c &foo; &nbsp;&#1;&#x41;&#xD800;\x01") == "a &amp; b &amp; c &amp;foo; \xa0&#x41;"
    assert fb2.fb2_book("<?xml version='1.0' encoding='windows-1251'?><FictionBook><body><section><p>Ёж</p></section></body></FictionBook>".encode("cp1251")).blocks[0].text == "Ёж"
    for broken in ("", "<", "<FictionBook>", "<FictionBook><body><section><p>a", fb2_of("<emphasis>" * 3000 + "x")):
        assert isinstance(fb2.fb2_book(broken).blocks, list)


LAYOUT = """<html><head><title>Title</title><meta name="author" content="Au Thor"></head><body><p>chrome</p><article id="book-content">
<section id="s1"><h2><p>One</p><p>Two</p></h2><div id="annotation"><p>About.</p></div><div class="epigraph"><p>Wise.</p><p class="text-author">W.</p></div>
<p>Кит <sup class="note"><a data-note-id="n1">{1}</a></sup>. Он <a href="#note-n2">2</a>плыл.</p><div class="empty-line"></div><div class="img-wrap"><img src="x/pic.jpg"></div>
<div class="poem"><p class="title">Song</p><div class="stanza"><p>la</p><p>lo</p></div><div class="stanza"><p>li</p></div><p class="date">1900</p></div>
<section id="s2"><h2>&lt;title unassigned&gt;</h2><cite><p>Quoted</p></cite><h3>Sub</h3></section></section>
<section class="notes"><div class="note" id="note-n1"><div class="note__body"><p>First <em>note</em>.</p><p>More.</p></div></div><div class="note" id="note-n2"></div></section></article></body></html>"""


def test_reader_page():
    book = reader_page.web_book(LAYOUT)
    assert (book.title, book.author) == ("Title", "Au Thor")
    assert [(c.id, c.title, c.level, c.first_block) for c in book.chapters] == [("s1", "One. Two", 1, 0), ("s2", "* * *", 2, 10)]
    assert [(b.kind, b.text) for b in book.blocks] == [
        ("title", "One Two"), ("annotation", "About."), ("epigraph", "Wise."), ("author", "W."), ("p", "Кит. Он плыл."), ("subtitle", "Song"), ("verse", "la"), ("verse", "lo"), ("verse", "li"), ("date", "1900"),
        ("title", "<title unassigned>"), ("cite", "Quoted"), ("subtitle", "Sub"),
    ]
    assert book.blocks[4].notes == [(3, "n1", "1"), (7, "n2", "2")]
    assert (book.blocks[5].gap, book.blocks[5].images) == (1, [("images/pic.jpg", False)]) and [b.stanza for b in book.blocks[6:9]] == [1, 1, 2]
    assert not book.blocks[1].spoken and book.notes["n1"].text == "First note.\n\nMore." and book.notes["n1"].marks == [("em", 6, 10)] and book.notes["n2"].text == ""


def small_epub() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        z.writestr("OPS/p.opf", '<package><manifest><item id="a" href="a%20b.xhtml"/><item id="c" href="c.xhtml"/></manifest><spine><itemref idref="c"/><itemref idref="a"/></spine></package>')
        z.writestr("OPS/a b.xhtml", "<html><body><h2>Two</h2><p>Second text.</p></body></html>")
        z.writestr("OPS/c.xhtml", "<html><body><h1>One</h1><p>First text.</p></body></html>")
    return out.getvalue()


def epub_of(documents: dict[str, str], toc: str = "", opf: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
        items = "".join(f'<opf:item id="{k}" href="{k}" media-type="application/xhtml+xml"/>' for k in documents)
        nav = '<item id="toc" href="toc.xhtml" properties="nav" media-type="application/xhtml+xml"/>' if toc else ""
        z.writestr("p.opf", f'<package><dc:title>A  Book</dc:title><dc:creator>Au</dc:creator><manifest>{items}{nav}{opf}</manifest><spine>{"".join(f"<itemref idref={k!r}/>" for k in documents)}</spine></package>')
        for k, x in (documents | ({"toc.xhtml": toc} if toc else {})).items():
            z.writestr(k, x)
    return out.getvalue()


def test_epub_chapters():
    documents = {"a.xhtml": "<body><p>Cover</p><p id='x'>Inner</p></body>", "B.xhtml": "<body><h2>Not in the list</h2><p>b</p></body>"}
    toc = '<body><nav epub:type="toc"><ol><li><a href="A.xhtml">First</a><ol><li><a href="a.xhtml#x">Deeper</a></li></ol></li><li><span>none</span></li><li><a href="b.xhtml">Second</a></li></ol></nav></body>'
    book = epub.epub_book(epub_of(documents, toc))
    assert (book.title, book.author) == ("A Book", "Au")
    assert [(c.title, c.level, c.first_block) for c in book.chapters] == [("First", 1, 0), ("Deeper", 2, 1), ("Second", 1, 2)]
    assert [(b.kind, b.text, b.chapter) for b in book.blocks] == [("p", "Cover", 0), ("p", "Inner", 1), ("title", "Not in the list", 2), ("p", "b", 2)]
    by_heads = epub.epub_book(epub_of({"a.xhtml": "<body><h1>One</h1><p>x</p><h1>Two<br/>lines</h1><p>y</p></body>"}))
    assert [(c.title, c.level) for c in by_heads.chapters] == [("One", 1), ("Two. lines", 1)]


def test_epub_notes():
    text = """<body><p id="back">Whale <a href="notes.xhtml#f1" id="r1"><sup>1</sup></a>. In<sup><a href="#own">2</a></sup>water, see <a href="b.xhtml#ch">chapter</a> and <a epub:type="noteref" href="#side">*</a></p>
    <p id="own"><a href="#back">2</a>. A note below.</p><aside id="side" epub:type="footnote"><p>Aside.</p><p>Twice.</p></aside></body>"""
    notes = '<body><div class="footnotes"><ol><li id="f1">See <i>this</i> <a href="a.xhtml#r1">&#8617;</a></li></ol></div></body>'
    book = epub.epub_book(epub_of({"a.xhtml": text, "b.xhtml": "<body><h2 id='ch'>Chapter</h2><p>z</p></body>", "notes.xhtml": notes}))
    assert [b.text for b in book.blocks] == ["Whale. In water, see chapter and", "Chapter", "z"]
    assert book.blocks[0].notes == [(5, "f1", "1"), (9, "own", "2"), (32, "side", "*")]
    assert {k: n.text for k, n in book.notes.items()} == {"f1": "1. See this", "own": "A note below.", "side": "Aside.\n\nTwice."} or {k: n.text for k, n in book.notes.items()} == {"f1": "See this", "own": "A note below.", "side": "Aside.\n\nTwice."}


def test_epub_blocks_and_styles(spark):
    page = """<head><style>p {text-indent: 2em} .r {text-align: right; margin-left: 5em} body {text-align: justify}</style></head><body><blockquote><p>Motto</p></blockquote><p>One</p><p>&#160;</p><p class="r">Two</p>
    <ol start="3"><li>three</li><li value="7">seven</li></ol><ul><li>dot</li><li>1) own</li></ul><p>a<br/>b<br/>c<br/>d</p><table><tr><td>x</td><td>y</td></tr><tr><td>1</td><td>2</td></tr></table>
    <table><tr><td><p>laid</p></td><td><p>out</p></td></tr></table><div class="noprint">no</div><pre>k
  l</pre><p>Pic <img src="i/p q.png"/></p></body>"""
    df = spark.createDataFrame([(1, bytearray(epub_of({"a.xhtml": page, "i/p q.png": ""})))], "id int, content binary")
    rows = books.with_looks(text_model.file_blocks(df, "id", "content")).orderBy("block").collect()
    assert [(r.kind, r.text) for r in rows] == [
        ("cite", "Motto"), ("p", "One"), ("p", "Two"), ("p", "3. three"), ("p", "7. seven"), ("p", "• dot"), ("p", "1) own"), ("verse", "a\nb\nc\nd"), ("table", "x\ty\n1\t2"), ("p", "laid"), ("p", "out"), ("p", "k\nl"), ("p", "Pic"),
    ]
    looks = {r.text: tuple(r.look) for r in rows}
    assert looks["One"] == ("j", 2.0, None, None) and looks["Two"] == ("r", 2.0, 5.0, 1) and rows[12].pictures[0].src == "images/p_q.png" and [c.e for c in rows[8]["cells"][1]] == [5, 7]


def test_epub_and_sniff():
    assert [b.text for b in epub.epub_book(small_epub()).blocks] == ["One", "First text.", "Two", "Second text."]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("b.fb2", FB2)
    assert [markup.sniff(x, n) for x, n in ((small_epub(), ""), (FB2.encode(), "x.txt"), (PAGE.encode(), ""), (b"%PDF-1.4", ""), (b"words", "a.txt"), (packed.getvalue(), ""))] == ["epub", "fb2", "html", "pdf", "txt", "fb2zip"]
    assert markup.single_member(packed.getvalue()) == FB2.encode() and markup.single_member(small_epub()) == small_epub()


def test_plain_texts():
    items = lambda text: [tuple(x) for x in text_model.txt_items(text)]
    assert items("ГЛАВА ПЕРВАЯ\n\nОдин абзац здесь.\nДругой абзац.\n\nChapter 2\n\nLast words.") == [("title", "ГЛАВА ПЕРВАЯ"), ("p", "Один абзац здесь. Другой абзац."), ("title", "Chapter 2"), ("p", "Last words.")]
    line = "This line of text is about as wide as the page is, and goes on over"
    wrapped = "\n".join([line] * 15 + ["and ends."] + [""] + [line] * 10 + ["short end.", line, "    " + line])
    assert [len(x) for _, x in items(wrapped)] == [15 * 68 + 9, 10 * 68 + 10, 67, 67]
    hyphens = "\n".join(["Some words that fill the line up to its very end and then a bro-", "ken word, and кое-", "как it goes on, and чем-", "то, and long lines that are as wide as all of the others here", line])
    assert items(hyphens)[0][1].startswith("Some words that fill the line up to its very end and then a broken word, and кое-как it goes on, and чем-то, and")
    assert items("IV\n\nText.\n* * *\nMore.\n\nПролог был долгим и скучным.\n\n— Глава 5\n\nГлава 5,\n\nA LINE IN CAPITALS\n\nsmall letters enough of them") == [
        ("title", "IV"), ("p", "Text."), ("break", ""), ("p", "More."), ("p", "Пролог был долгим и скучным."), ("p", "— Глава 5"), ("p", "Глава 5,"), ("title", "A LINE IN CAPITALS"), ("p", "small letters enough of them"),
    ]
    assert items("") == [] and items("\n \n") == [] and items("\ufeffx\r\ny\rz") == [("p", "x y z")]


def test_plain_text_notes():
    book = text_model.txt_book("Часть 1\n\nA word* and *another* one** here.\n\n* The word.\n\n** The one.\n\n*** nothing\n\nГлава 2\n\n* not of this chapter\n\n5*3 and word*\n\na\n\nb\n\nc\n\n* too late")
    assert [(c.title, c.level, c.first_block) for c in book.chapters] == [("Часть 1", 1, 0), ("Глава 2", 2, 3)]
    assert [b.text for b in book.blocks] == ["Часть 1", "A word and *another* one here.", "*** nothing", "Глава 2", "* not of this chapter", "5*3 and word*", "a", "b", "c", "* too late"]
    assert book.blocks[1].notes == [(6, "n1", "*"), (24, "n2", "**")] and {k: n.text for k, n in book.notes.items()} == {"n1": "The word.", "n2": "The one."}
    assert text_model.star_runs("*a* b**c **d**") == [(0, 1, True), (2, 1, True), (5, 2, False), (9, 2, True), (12, 2, True)]


def test_page_lines(spark):
    lines = []
    for page in range(1, 5):
        lines.append((1, page, "A running head", 50.0, 200.0, 800.0, 9.0, False))
        lines.append((1, page, f"A title of page {page}", 50.0, 150.0, 760.0, 18.0, True))
        lines.append((1, page, "    An indented paragraph that goes on to the very right and is con-", 70.0, 400.0, 740.0, 11.0, False))
        lines.append((1, page, "tinued here to the right margin of the page, that it is, and so on", 50.0, 400.0, 728.0, 11.0, False))
        lines.append((1, page, "and ends.", 50.0, 120.0, 716.0, 11.0, False))
        lines.append((1, page, str(page), 200.0, 210.0, 40.0, 9.0, False))
    df = spark.createDataFrame(lines, "doc int, page int, text string, x0 double, x1 double, y double, size double, bold boolean")
    got = [(r.kind, r.text) for r in page_lines.page_line_blocks(df, "doc").orderBy("block").collect()]
    assert len(got) == 8 and got[0] == ("title", "A title of page 1") and "continued here" in got[1][1] and got[1][1].endswith("and ends.")


L = page_lines.Line


def column(page, texts, y=700.0, size=10.0, x0=50.0, wide=True):
    return [L(page, t, x0, 400.0 if wide else 200.0, y - 12 * k, size) for k, t in enumerate(texts)]


def test_page_numbers_and_heads():
    pages = [[L(p, f"Chapter head {p}", 50, 200, 800, 8.0), *column(p, [f"text {p} goes on to the margin", "and so on it goes to the margin"]), L(p, n, 200, 210, 40, 8.0)] for p, n in enumerate(["12", "- 13 -", "xiv", "15", "99"])]
    left = page_lines.without_furniture(pages)
    assert [[x.text for x in page][2:] for page in left] == [[], [], [], [], ["99"]] and len(left[0]) == 2
    assert [page_lines.page_number(x) for x in ("7", "[ 7 ].", "xiv", "стр. 7", "civil", "iiii", "12345", "a")] == [7, 7, 14, 7, None, None, None, None]
    contents = [[*column(0, ["Contents", "One ........ 5", "Two …… 19", "Three ...... 30"])], *[column(k, ["text", "Four ..... 9"]) for k in range(1, 12)]]
    assert [[x.text for x in page] for page in page_lines.without_contents(contents)[:2]] == [[], ["text"]]


def test_page_line_notes():
    body = ["The first line of the page has a word1 and goes on to the", "very right, with an abbreviation т.2 of it, and a closing»2 here", "and ends at the right side of the page as lines do, with star*."]
    foot = [L(0, x, 50, 300, 600 - 10 * k, 8.0) for k, x in enumerate(["1 A note that goes", "on, of hy-", "phens.", "2. Second.", "7 is no marker", "* Third"])]
    nxt = [*column(1, ["Another page with lines that go on to the right margin of it"] * 3), L(1, "goes on here.", 50, 300, 600, 8.0)]
    book = page_lines.lines_book([*column(0, body), *foot, *nxt])
    assert {k: n.text for k, n in book.notes.items()} == {"n1": "A note that goes on, of hyphens.", "n2": "Second. 7 is no marker", "n3": "Third goes on here."}
    text = "".join(b.text for b in book.blocks)
    assert "a word and" in text and "т.2 of" in text and "closing» here" in text and "with star." in text
    assert [(n, m) for b in book.blocks for _, n, m in b.notes] == [("n1", "1"), ("n2", "2"), ("n3", "*")]


def test_page_line_paragraphs():
    lines = [L(0, "THE BOOK", 150, 300, 800, 20.0), L(0, "by someone", 150, 300, 750, 10.0)]
    for p in (1, 2):
        lines += [L(p, f"Part {p}", 180, 270, 780, 16.0), L(p, "of the whole", 160, 290, 762, 16.0), *column(p, ["First lines of the paragraph go on to the very right of the co-", "lumn, and so on they go to the right margin as they should do", "and end."], 720)]
        lines += [L(p, "An indented paragraph begins here and goes to the right mar", 65, 400, 684, 10.0), L(p, "and ends.", 50, 100, 672, 10.0), L(p, "A note in bold", 50, 120, 650, 10.0, True), *column(p, ["More text up to the right margin of the column as it should be"], 620)]
    book = page_lines.lines_book(lines)
    assert [(c.title, c.level) for c in book.chapters] == [("", 1), ("Part 1 of the whole", 1), ("Part 2 of the whole", 1)]
    assert [(b.kind, b.text[:24]) for b in book.blocks[:7]] == [
        ("subtitle", "THE BOOK"), ("p", "by someone"), ("title", "Part 1 of the whole"), ("p", "First lines of the parag"), ("p", "An indented paragraph be"), ("subtitle", "A note in bold"), ("p", "More text up to the righ"),
    ]
    assert "column, and so on" in book.blocks[3].text


def test_file_blocks(spark):
    df = spark.createDataFrame([(1, bytearray(small_epub())), (2, bytearray(FB2.encode("cp1251", "replace"))), (3, bytearray("Просто текст.".encode("cp1251") * 30)), (4, None)], "id int, content binary")
    got = text_model.file_blocks(df, "id", "content").groupBy("id").count().collect()
    assert {r.id: r["count"] for r in got} == {1: 4, 2: 8, 3: 1}


def test_library_files(spark, tmp_path):
    for slug, text in (("b", 'title = "Бе"\nyear = "1900"\nedition = "e1"\n'), ("a", 'title = "A"\n'), ("c", "broken = ")):
        (tmp_path / slug / "state").mkdir(parents=True)
        (tmp_path / slug / "book.toml").write_text(text, encoding="utf-8")
    (tmp_path / "a" / "timing.json").write_text('{"source": "captions", "duration": 12.5, "words": [[' + "1," * 2000 + "1]]}")
    one, two = "0" * 32, "f" * 32
    (tmp_path / "a" / "state" / f"{one}.json").write_text(json.dumps({"pos": 5, "posAt": 10, "mode": None, "modeAt": True, "shelf": "done", "shelfAt": "7"}))
    (tmp_path / "a" / "state" / f"{two}.json").write_text("{broken")
    (tmp_path / "a" / "state" / f"{one} copy.json").write_text("{}")
    m = files.manifests(spark, str(tmp_path)).orderBy("slug").collect()
    assert [r.slug for r in m] == ["a", "b", "c"] and m[1].fields["title"] == "Бе" and m[2].error and m[2].fields is None
    h = files.headers(spark, str(tmp_path), "timing.json").first()
    assert (h.slug, h.source, h.duration) == ("a", "captions", 12.5)
    states = files.device_states(spark, str(tmp_path)).orderBy("slug", "device")
    assert [(r.slug, r.device, r.readable) for r in states.select("slug", "device", "readable").collect()] == [("a", one, True), ("a", two, False)]
    (tmp_path / "a" / "state" / f"{one}.json").rename(tmp_path / "kept.txt")
    (tmp_path / "a" / "state" / f"{one}.json").write_text("{broken")
    now = files.last_good(files.device_states(spark, str(tmp_path)), spark.createDataFrame([("a", one, "{}", True), ("a", two, None, False)], "slug string, device string, state string, readable boolean").withColumn("state", F.try_parse_json("state")))
    assert sorted((r.device, r.readable, r.stale) for r in now.select("device", "readable", "stale").collect()) == [(one, True, True), (two, False, True)]
    (tmp_path / "kept.txt").rename(tmp_path / "a" / "state" / f"{one}.json")
    rows = {r.key: (r.value, r.at_ms) for r in files.state_rows(states).collect()}
    assert rows == {"pos": ("5", 10.0), "mode": (rows["mode"][0], 0.0), "shelf": ('"done"', 0.0)}


def test_small_readers(spark):
    flat = spark.createDataFrame([('title = "A"\nbad line\nslug = "s"\ntitle = "B"\n',)], "t string").select(files.flat_manifest(F.col("t"))).first()[0]
    assert flat == {"title": "B", "slug": "s"}
    caps = spark.createDataFrame([(1, [(1000, [("Hello big", 0), ("\n", 50), ("World!", 500)]), (9000, [("end", None)])])], "id int, events array<struct<tStartMs: bigint, segs: array<struct<utf8: string, tOffsetMs: bigint>>>>")
    got = [(r.word, r.t0, r.t1) for r in files.captions(caps, ["id"]).orderBy("pos").collect()]
    assert got == [("hello", 1.0, 1.0), ("big", 1.0, 1.5), ("world", 1.5, 3.5), ("end", 9.0, 9.5)]
    assert spark.range(1).select(files.toml_string(F.lit('a"b\\c\nd'))).first()[0] == '"a\\"b\\\\c\\nd"'
    doc = spark.sql("select 't' title, '' author, array() tags, array(1) n")
    assert files.book_json(doc, ["title", "author", "tags", "n"]).first()[0] == '{"title":"t","n":[1]}'
    names = spark.createDataFrame([("../../etc/passwd",), ("a\\b:c.txt",), ("..",), ("x/",)], "n string").select(files.safe_name(F.col("n"))).collect()
    assert [r[0] for r in names] == ["passwd", "b_c.txt", "file", "file"]


def test_landing(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("set spark.sql.sources.partitionOverwriteMode=static")
    files.land(spark.createDataFrame([("a", 1), ("b", 1)], "slug string, n int"), path, "slug")
    files.land(spark.createDataFrame([("a", 2)], "slug string, n int"), path, "slug")
    assert sorted((r.slug, r.n) for r in spark.read.parquet(path).collect()) == [("a", 2), ("b", 1)]


def test_a_book_lands_with_its_stamp(spark, tmp_path):
    root = str(tmp_path)
    text = lambda x: {"book": spark.createDataFrame([(x,)], "text string"), "timing": spark.createDataFrame([(len(x),)], "n int")}
    files.land_book(text("old"), root, "b", "e1")
    files.land_book(text("other"), root, "c", "e7")
    # A run that is stopped before the stamp changes nothing that readers see.
    text("new text")["book"].write.parquet(f"{root}/book/slug=b/edition=e2")
    assert {r.slug: r.text for r in files.landed(spark, root, "book").collect()} == {"b": "old", "c": "other"}
    files.land_book(text("new text"), root, "b", "e2")
    assert {r.slug: r.text for r in files.landed(spark, root, "book").collect()} == {"b": "new text", "c": "other"}
    assert {r.slug: r.n for r in files.landed(spark, root, "timing").collect()} == {"b": 8, "c": 5}


def test_pages_of_a_feed(spark):
    bodies = {"u": '<feed><link rel="next" href="/2?a=1&amp;b=2"/><entry><title>A</title></entry></feed>', "https://c/2?a=1&b=2": '<link href="https://c/3" rel="next">', "https://c/3": "<feed/>"}
    rows = feeds.paged(spark, bodies.__getitem__, "u", "https://c", 5).collect()
    assert [(r.page, r.body) for r in rows] == list(enumerate(bodies.values())) and len(feeds.paged(spark, bodies.__getitem__, "u", "https://c", 2).collect()) == 2
    nxt = spark.createDataFrame([(x,) for x in bodies.values()], "b string").select(feeds.next_page(F.col("b"), "https://c")).collect()
    assert [r[0] for r in nxt] == ["https://c/2?a=1&b=2", "https://c/3", None]


def test_catalogue_source(spark):
    spark.dataSource.register(catalogues.CatalogueSource)
    lines = "\n".join(json.dumps({"source": s, "title": f"T{k}", "kind": "fb2"}) for k, s in enumerate("xyx"))
    df = spark.read.format("catalogue").option("hits", lines).option("partitions", 2).load()
    assert sorted(r.title for r in df.where("source = 'x'").collect()) == ["T0", "T2"]
    assert df.count() == 3
