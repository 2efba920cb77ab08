"""Where the main text of a book ends, by the titles and sizes of its chapters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
REFERENCE = re.compile(
    r"примечани|комментари|библиограф|литератур|указател|словар|глоссари|об автор|о художник|над книгой работал|благодарност|оглавлени|содержани|приложени|список сокращ"
    r"|summary|notes|index|bibliograph|acknowledg",
    re.I,
)
MAIN = re.compile(r"эпилог|послеслови|заключени|финал", re.I)
LETTER = re.compile(r"[А-ЯЁA-Z][а-яёa-z]?\.?")
RUN, NOTHING, MOST = 3, 0.001, 0.35


def text_end(chapters: list[tuple[str, int, int]]) -> int:
    """How many chapters (title, level, sentences) are main text.

    From the end, a chapter is left out if its title or that of one it is under names reference
    matter, if it is one of three letters in a row or more, or if it has next to nothing. More
    than 35 % left out means that none is.
    """
    titles = [" ".join(t.split()) for t, _, _ in chapters]
    total = sum(n for *_, n in chapters)
    run = [0] * (len(chapters) + 1)
    for k in range(len(chapters)):
        run[k] = run[k - 1] + 1 if LETTER.fullmatch(titles[k]) else 0
    for k in range(len(chapters) - 2, -1, -1):
        run[k] = max(run[k], run[k + 1]) if run[k] and run[k + 1] else run[k]
    above: list[tuple[int, bool]] = []
    under: list[bool] = []
    for (_, level, _), title in zip(chapters, titles):
        above = [(lv, hit) for lv, hit in above if lv < level]
        under.append(bool(REFERENCE.search(title)) or any(hit for _, hit in above))
        above.append((level, bool(REFERENCE.search(title))))
    end = len(chapters)
    while end and not MAIN.search(titles[end - 1]) and (under[end - 1] or run[end - 1] >= RUN or chapters[end - 1][2] < NOTHING * total):
        end -= 1
    return len(chapters) if sum(n for *_, n in chapters[end:]) > MOST * total else end


def text_ends(df: DataFrame, by: str) -> DataFrame:
    """``text_end`` of each book from rows (book, chapter, title, level, sentences)."""
    kind = df.schema[by].dataType.simpleString()

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("chapter")
        return pd.DataFrame({by: [pdf[by].iloc[0]], "text_end": [text_end(list(zip(rows["title"], rows["level"], rows["sentences"])))]})

    return df.groupBy(by).applyInPandas(work, f"`{by}` {kind}, text_end int")


def audio_ends(words: DataFrame, ends: DataFrame, durations: DataFrame, by: str) -> DataFrame:
    """Per book the end of the last word read before the back matter, else its ``duration``.

    ``words`` (by, chapter, t1), ``ends`` as of ``text_ends``, ``durations`` (by, duration).
    """
    main = words.join(ends, by).where(F.col("chapter") < F.col("text_end")).groupBy(by).agg(F.max("t1").alias("_t1"))
    return durations.join(main, by, "left").select(by, F.coalesce("_t1", "duration").alias("audio_end"))
