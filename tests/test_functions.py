import random

import pytest
from pyspark.sql import functions as F

from lectorium.functions import num
from lectorium.functions import text as tx
from lectorium.functions.encoding import NO_EVIDENCE, PER_THOUSAND, decode_bytes, encoding_of, russian_score
from lectorium.functions.languages import language_code, title_language
from lectorium.functions.sentences import block_ranges, row_ranges, sentence_ranges


def split(text):
    return [text[a:b] for a, b in sentence_ranges(text)]


@pytest.mark.parametrize(
    "parts",
    [
        ["Мы видели книгу Н. Петрова вчера.", "Она хороша."],
        ["Редактор А. Б. Ветрова.", "Тираж мал."],
        ["Смотри (гл. 3) выше.", "Там всё есть."],
        ["Сад, лес и т. д.", "Потом поле."],
        ["Проплыл кит.", "Он велик."],
        ["См. также ср. Третью главу.", "Конец."],
        ["See e.g. the man Mr. Brown on p. 7.", "He knows."],
        ["1. Первый пункт списка.", "Второе."],
        ["Кто пришёл? ", "Я. ", "Ну входи."],
        ["— Он ушёл?", "— Я. ", "Да."],
        ["Витамин C. ", "Его много."],
        ["«Всё!»", "Он умолк…", "И сел."],
        ["Год 1999.", "Зима."],
    ],
)
def test_sentences(parts):
    assert split(" ".join(p.strip() for p in parts)) == [p.strip() for p in parts]


def test_sentences_go_on():
    for text in ("Травы и т. д. росли всюду.", "Это т. н. предел и ок. ста лет.", "Он жил в III в. до н. э., давно.", "Цена 3.50 рубля", "", "   "):
        assert split(text) == ([text.strip()] if text.strip() else [])


def test_sentence_ranges_are_disjoint():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("аБв. Гд!?… «»\nXy.1") for _ in range(60))
        ranges = sentence_ranges(text)
        assert all(a < b for a, b in ranges) and all(x[1] <= y[0] for x, y in zip(ranges, ranges[1:]))
        covered = set().union(*[range(a, b) for a, b in ranges]) if ranges else set()
        assert all(text[i] in " \n" for i in range(len(text)) if i not in covered)


def test_headings_and_rows():
    assert block_ranges("Глава 1. Начало. Путь", "title") == [(0, 21)]
    assert row_ranges([[(0, 1), (2, 3)], [(4, 4)], [(5, 8)]], "a b  cd ") == [(0, 3), (5, 7)]


def test_encodings():
    russian = "Это длинный русский текст, в котором много обычных слов и предложений. " * 20
    for name in ("cp1251", "koi8_r", "cp866", "utf-8"):
        assert decode_bytes(russian.encode(name)) == russian
    assert decode_bytes(b"\xff\xfe" + russian.encode("utf-16-le")) == russian
    assert decode_bytes(("plain text " * 50).encode("utf-16-be")) == "plain text " * 50
    assert encoding_of(b"caf\xe9")[0] == "latin-1"
    assert decode_bytes(b"") == ""
    assert decode_bytes(russian.encode() + b"\xff").startswith(russian)
    assert encoding_of("Ärger über Öl, größer. ".encode("cp1252"))[0] == "latin-1"


def slow_score(text):
    """The rule letter by letter."""
    small = lambda c: c in PER_THOUSAND
    capital = lambda c: not small(c) and c.lower() in PER_THOUSAND
    latin = lambda c: c.isascii() and c.isalpha()
    padded, score = "  " + text + " ", 0
    for two, one, c, after in zip(padded, padded[1:], text, padded[3:]):
        if c.isascii():
            continue
        if not small(c) and not capital(c):
            score -= 0 if c in NO_EVIDENCE else 30
        elif latin(one) or latin(after) or capital(c) and small(one) or small(c) and capital(one) and capital(two):
            score -= 30
        elif any(small(x) or capital(x) for x in (one, after)):
            score += PER_THOUSAND[c.lower()]
    return score


def test_russian_score():
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice("абвЁёЯЖщъ  xYz1.«—§€▓é中😀") for _ in range(rng.randrange(0, 40)))
        assert russian_score(text) == slow_score(text)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_titles(spark):
    lit = F.lit
    assert value(spark, tx.norm_title(lit("Война и Мир. Том II [litres]"))) == "война и мир"
    assert value(spark, tx.norm_title(lit("Ёж (сборник"))) == "еж"
    assert value(spark, tx.terms(lit("Дао и мир мирный"))) == ["мирный", "дао", "мир"]
    assert value(spark, tx.said_words(lit("а Лунь юй"))) == ["а", "лунь", "юй"][1:]
    for a, b, same in (("войны", "война", True), ("мире", "мир", True), ("владимир", "мир", False), ("дао", "дао", True), ("да", "дао", False)):
        assert value(spark, tx.same_word(lit(a), lit(b))) is same
    for title, n in (("Книга, т. 3", 3), ("Part IX", 9), ("Том XIV", 14), ("Vol. 0", None), ("Без номера", None)):
        assert value(spark, tx.volume_number(lit(title))) == n
    words = tx.said_words(lit("Война и мир"))
    score = value(spark, tx.title_score(lit("Война и мир"), words, lit("Война и мир"), lit("Война и мир Толстой")))
    assert score == 6 + 5 + 6 + 4 + 2
    assert value(spark, tx.slug(lit("Щука", ), {"щ": "shch", "у": "u", "к": "k", "а": "a"})) == "shchuka"
    assert value(spark, tx.slug(lit("***"))) == "book"
    assert value(spark, tx.marker(lit("{721}"))) == "721"
    assert value(spark, tx.join_title(F.array(lit("Часть первая"), lit(""), lit("Дорога!"), lit("Дом")))) == "Часть первая. Дорога! Дом"


def test_names_of_files_and_readers(spark):
    assert tuple(value(spark, tx.file_parts(F.lit("Large-red-widget-Petrov-ID"), "Petrov", "I. Petrov"))) == ("Large red widget", "id", "I. Petrov")
    assert tuple(value(spark, tx.file_parts(F.lit("Petrov"), "Petrov", "P"))) == ("Petrov", "", "P")
    assert value(spark, tx.narrator(F.lit("Книга (Читает Иван Клюквин)"), F.lit("x"))) == "Иван Клюквин" and value(spark, tx.narrator(F.lit("Книга"), F.lit("x"))) == "x"
    assert [value(spark, language_code(F.lit(x))) for x in ("Russian", "deu", "en, fr", "", "Klingon")] == ["ru", "de", "en", "", ""]
    assert tuple(value(spark, title_language(F.lit("道德經 (Chinese)")))) == ("道德經", "zh")


def test_natural_order(spark):
    names = ["a10.mp3", "a2.mp3", "A1.mp3", "b1.mp3", "a02.mp3"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(tx.natural_key(F.col("n")), "n").collect()
    assert [r.n for r in rows] == ["A1.mp3", "a02.mp3", "a2.mp3", "a10.mp3", "b1.mp3"]


def test_numbers(spark):
    assert [value(spark, num.clock_seconds(F.lit(x))) for x in ("1:02:03", "20:34", "1234.5", "x:1")] == [3723.0, 1234.0, 1234.5, None]
    assert [value(spark, num.js_round(F.lit(x))) for x in (-0.5, 0.5, 2.5)] == [0, 1, 3]
    assert value(spark, num.floor_to_tenth(F.lit(0.8456))) == "84,5"
    assert value(spark, num.upper_index(F.array(*map(F.lit, (1, 2, 3, 4))), 5)) == 3
    assert value(spark, num.upper_index(F.array().cast("array<int>"), 9)) is None
