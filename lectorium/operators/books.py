"""Books as they are read from files: rich text, blocks, chapters and notes, and the builder that all readers share."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions.sentences import block_ranges, row_ranges
from ..functions.styles import block_look

BLOCK_ROWS = (
    "block int, block_id string, kind string, level int, chapter int, stanza int, gap int, text string, marks array<struct<kind: string, s: int, e: int>>, "
    "notes array<struct<pos: int, note: string, marker: string>>, pictures array<struct<pos: int, src: string>>, images array<struct<src: string, after: boolean>>, "
    "cells array<array<struct<s: int, e: int, head: boolean>>>, spoken boolean, says struct<a: string, i: int, ml: int, pl: int>, inherited struct<a: string, i: int, ml: int, pl: int>, sentences array<struct<s: int, e: int>>"
)
CHAPTER_ROWS = "chapter int, chapter_id string, title string, level int, first_block int"
NOTE_ROWS = "note string, text string, marks array<struct<kind: string, s: int, e: int>>, pictures array<struct<pos: int, src: string>>, kinds array<struct<s: int, e: int, kind: string>>"

# Signs that close what stands before them, and how many blocks back a note's asterisk may be.
CLOSING = frozenset(".,:;!?…»”’)]}")
STAR_WINDOW = 3
MOST_GAP = 3


class RichText:
    """Characters, each with its marks, and anchors (place, kind, value, marker) between them."""

    def __init__(self, text: str = "") -> None:
        self.chars: list[str] = list(text)
        self.marks: list[frozenset[str]] = [frozenset()] * len(self.chars)
        self.anchors: list[list] = []

    def add(self, text: str, marks: frozenset[str] = frozenset()) -> None:
        self.chars += text
        self.marks += [marks] * len(text)

    def anchor(self, kind: str, value: str, marker: str = "") -> None:
        self.anchors.append([len(self.chars), kind, value, marker])

    @property
    def text(self) -> str:
        return "".join(self.chars)

    def kept(self, places: list[int], chars: list[str] | None = None) -> None:
        """Keep the characters at these places, as ``chars`` if given; anchors go to the next kept one."""
        at, k = [], 0
        for i in range(len(self.chars) + 1):
            while k < len(places) and places[k] < i:
                k += 1
            at.append(k)
        self.chars = chars if chars is not None else [self.chars[i] for i in places]
        self.marks = [self.marks[i] for i in places]
        for anchor in self.anchors:
            anchor[0] = at[anchor[0]]

    def cut(self, a: int, b: int) -> None:
        """Take out the characters from a to b."""
        self.kept([i for i in range(len(self.chars)) if not a <= i < b])

    def insert(self, at: int, char: str) -> None:
        """A character with the marks that both its neighbours have; anchors at its place stay before it."""
        self.chars.insert(at, char)
        self.marks.insert(at, self.marks[at - 1] & self.marks[at])
        for anchor in self.anchors:
            anchor[0] += anchor[0] > at

    def even(self, lead: bool = False, lines: bool = False) -> RichText:
        """White space as single spaces, none at the ends; ``lead`` keeps spaces at the start, ``lines`` line feeds."""
        chars = ["\n" if lines and c == "\n" else " " if c.isspace() else c for c in self.chars]
        start = next((i for i, c in enumerate(chars) if c not in " \n"), len(chars))
        places = [i for i in range(start) if chars[i] == " "] if lead and start < len(chars) else []
        i = start
        while i < len(chars):
            end = next((k for k in range(i, len(chars)) if chars[k] not in " \n"), len(chars)) if chars[i] in " \n" else i + 1
            if chars[i] not in " \n":
                places.append(i)
            elif end < len(chars):
                feeds = [k for k in range(i, end) if chars[k] == "\n"]
                places += feeds or [i]
            i = end
        self.kept(places, [chars[i] for i in places])
        return self

    def close_up_notes(self) -> RichText:
        """What a note's link leaves when it is taken out: no space before what closes, one between words it parted."""
        for anchor in reversed([a for a in self.anchors if a[1] == "note"]):
            at = anchor[0]
            start = len("".join(self.chars[:at]).rstrip())
            if closes("".join(self.chars[at : at + 2])):
                self.cut(start, at)
            elif at and self.chars[at - 1].isalnum() and self.chars[at : at + 1] and self.chars[at].isalnum():
                self.insert(at, " ")
            else:
                anchor[0] = start
        return self

    def append(self, other: RichText) -> None:
        for place, *rest in other.anchors:
            self.anchors.append([len(self.chars) + place, *rest])
        self.chars += other.chars
        self.marks += other.marks

    def ranges(self) -> list[tuple[str, int, int]]:
        """Marks as (kind, start, end)."""
        if not any(self.marks):
            return []
        found: list[tuple[str, int, int]] = []
        open_at: dict[str, int] = {}
        for i, own in enumerate([*self.marks, frozenset()]):
            for kind in [k for k in open_at if k not in own]:
                found.append((kind, open_at.pop(kind), i))
            for kind in own:
                open_at.setdefault(kind, i)
        return sorted(found, key=lambda r: (r[1], r[2], r[0]))

    def of(self, kind: str) -> list[tuple[int, str, str]]:
        return [(min(p, len(self.chars)), v, m) for p, k, v, m in self.anchors if k == kind]


def closes(following: str) -> bool:
    """Whether what follows a note's link lets go of the space before it: the end, or a closing sign; a straight quote closes before white space and punctuation."""
    if following[:1] in ("'", '"') and following:
        after = following[1:2]
        return not after or after.isspace() or unicodedata.category(after).startswith("P")
    return not following or following[0] in CLOSING


@dataclass
class Block:
    kind: str
    text: str
    level: int = 0
    marks: list[tuple[str, int, int]] = field(default_factory=list)
    notes: list[tuple[int, str]] = field(default_factory=list)  # and maybe a marker
    cells: list[list[tuple]] = field(default_factory=list)  # of a table's rows: start, end, and maybe whether it heads
    id: str = ""
    chapter: int | None = None
    stanza: int | None = None
    gap: int = 0
    pictures: list[tuple[int, str]] = field(default_factory=list)
    images: list[tuple[str, bool]] = field(default_factory=list)
    spoken: bool = True
    says: dict = field(default_factory=dict)
    inherited: dict = field(default_factory=dict)

    def sentences(self) -> list[tuple[int, int]]:
        return row_ranges([[c[:2] for c in row] for row in self.cells], self.text) if self.cells else block_ranges(self.text, self.kind)


@dataclass
class Chapter:
    id: str
    title: str
    level: int
    first_block: int


@dataclass
class Note:
    text: str
    marks: list[tuple[str, int, int]] = field(default_factory=list)
    pictures: list[tuple[int, str]] = field(default_factory=list)
    kinds: list[tuple[int, int, str]] = field(default_factory=list)


@dataclass
class Book:
    title: str = ""
    author: str = ""
    blocks: list[Block] = field(default_factory=list)
    chapters: list[Chapter] = field(default_factory=list)
    notes: dict[str, Note] = field(default_factory=dict)


class Builder:
    """Puts a book together from what a reader meets, in order."""

    def __init__(self, title: str = "", author: str = "", given_ids: Iterable[str] = ()) -> None:
        self.book = Book(title, author)
        self.given, self.used = set(given_ids), set()
        self.gap = 0
        self.waiting_images: list[str] = []
        self.waiting_notes: list[tuple[int, str, str]] = []

    def blank(self) -> None:
        self.gap += 1

    def image(self, src: str) -> None:
        """A picture that stands alone: it goes with the next block of its chapter, else after the last one."""
        self.waiting_images.append(src)

    def end_images(self) -> None:
        if self.book.blocks:
            self.book.blocks[-1].images += [(src, True) for src in self.waiting_images]
            self.waiting_images.clear()

    def chapter(self, title: str, level: int, id: str = "") -> None:
        self.gap = 0
        self.end_images()
        n = len(self.book.chapters)
        self.book.chapters.append(Chapter(id or f"s{n}", title, level, len(self.book.blocks)))

    def block_id(self, own: str) -> str:
        """The block's own id once, else one that no element of the text has."""
        base = own or f"b{len(self.book.blocks)}"
        names = (base if k == 1 else f"{base}-{k}" for k in range(1, len(self.used) + 2 + len(self.given)))
        found = next(x for x in names if x not in self.used and (x == own or x not in self.given))
        self.used.add(found)
        return found

    def put(self, kind: str, rich: RichText, own_id: str = "", stanza: int | None = None, cells: list | None = None, level: int = 0) -> Block | None:
        """A block; one without text leaves its pictures to the next, and its notes to the last one's end or the next one's start."""
        notes = rich.of("note")
        if not rich.text.strip():
            for _, src, _ in rich.of("picture"):
                self.image(src)
            if self.book.blocks:
                last = self.book.blocks[-1]
                last.notes += [(len(last.text), n, m) for _, n, m in notes]
            else:
                self.waiting_notes += [(0, n, m) for _, n, m in notes]
            return None
        if not self.book.chapters:
            self.chapter("", 1)
        block = Block(
            kind, rich.text, level, rich.ranges(), [*self.waiting_notes, *notes], cells or [], self.block_id(own_id), len(self.book.chapters) - 1, stanza, min(self.gap, MOST_GAP),
            [(p, src) for p, src, _ in rich.of("picture")], [(src, False) for src in self.waiting_images], not cells,
        )
        self.book.blocks.append(block)
        self.gap = 0
        self.waiting_images, self.waiting_notes = [], []
        return block

    def put_rows(self, rows: list[list[tuple[RichText, bool]]], own_id: str = "") -> None:
        """A table as one block: cells joined by tabs, rows by line feeds; it is not read aloud."""
        whole, cells = RichText(), []
        for row in (r for r in rows if r):
            if cells:
                whole.add("\n")
            ranges = []
            for k, (cell, head) in enumerate(row):
                if k:
                    whole.add("\t")
                start = len(whole.chars)
                whole.append(cell)
                ranges.append((start, len(whole.chars), head))
            cells.append(ranges)
        self.put("table", whole, own_id, cells=cells)

    def star_note(self, rich: RichText, bare: RichText) -> bool:
        """Whether a paragraph of asterisks and text is the footnote of a word with as many in one of the last blocks of its chapter; if so it becomes one."""
        stars = re.match(r"(\*{1,3})\s", rich.text)
        if not stars or not rich.text.replace("*", "").strip():
            return False
        closing = "".join(map(re.escape, sorted(CLOSING)))
        mark = re.compile(rf"(?<=[^\W_])(?<!\*)\*{{{len(stars[1])}}}(?=[\s{closing}]|\Z)")
        for block in self.book.blocks[: -STAR_WINDOW - 1 : -1]:
            if block.chapter != len(self.book.chapters) - 1:
                return False
            found = mark.search(block.text) if block.kind != "table" else None
            if not found:
                continue
            k = next(k for k in range(1, len(self.book.notes) + 2) if f"star{k}" not in self.book.notes)
            start = re.match(r"\s*\*+\s*", bare.text)
            bare.cut(0, start.end() if start else 0)
            self.book.notes[f"star{k}"] = as_note(bare)
            self.without(block, found.start(), found.end(), f"star{k}", stars[1])
            return True
        return False

    @staticmethod
    def without(block: Block, a: int, b: int, note: str, marker: str) -> None:
        """Take a marker out of a block and put a note's anchor in its place."""
        moved = lambda x: x - (b - a) if x >= b else min(x, a)
        block.text = block.text[:a] + block.text[b:]
        block.marks = [(k, moved(s), moved(e)) for k, s, e in block.marks if moved(s) < moved(e)]
        block.pictures = [(moved(p), src) for p, src in block.pictures]
        before = [x for x in block.notes if x[0] <= a]
        block.notes = [*before, (a, note, marker), *((moved(x[0]), *x[1:]) for x in block.notes if x[0] > a)]

    def done(self, untitled_first: bool = False) -> Book:
        """The book; an untitled first chapter that nothing is in goes, if the reader began one."""
        self.end_images()
        chapters = self.book.chapters
        if untitled_first and len(chapters) > 1 and not chapters[0].title and chapters[1].first_block == 0:
            del chapters[0]
            for block in self.book.blocks:
                block.chapter = max(0, block.chapter - 1)
        return self.book


def as_note(rich: RichText, kinds: list[tuple[int, int, str]] | None = None) -> Note:
    return Note(rich.text, rich.ranges(), [(p, src) for p, src, _ in rich.of("picture")], kinds or [])


def join_lines(lines: Iterable[str]) -> str:
    """Title lines as one, with full stops between them where none ends a phrase."""
    out = ""
    for line in lines:
        if line:
            out += line if not out else f" {line}" if out[-1] in ".,!?:;…—-" else f". {line}"
    return out


# Rows


def _chapters_of(book: Book) -> list[int]:
    """The chapter of each block: its own, else counted by titles, -1 before the first."""
    out, n = [], -1
    for b in book.blocks:
        n += b.kind == "title"
        out.append(n if b.chapter is None else b.chapter)
    return out


def block_rows(book: Book) -> list[tuple]:
    rows = []
    for k, (b, chapter) in enumerate(zip(book.blocks, _chapters_of(book))):
        marks = [{"kind": m, "s": s, "e": e} for m, s, e in b.marks]
        notes = [{"pos": n[0], "note": n[1], "marker": n[2] if len(n) > 2 else ""} for n in b.notes]
        cells = [[{"s": c[0], "e": c[1], "head": len(c) > 2 and c[2]} for c in row] for row in b.cells]
        pictures, images = [{"pos": p, "src": s} for p, s in b.pictures], [{"src": s, "after": a} for s, a in b.images]
        sentences = [{"s": s, "e": e} for s, e in b.sentences()]
        says, inherited = ({name: own.get(name) for name in ("a", "i", "ml", "pl")} for own in (b.says, b.inherited))
        rows.append((k, b.id or f"b{k}", b.kind, b.level, chapter, b.stanza, b.gap, b.text, marks, notes, pictures, images, cells, b.spoken, says, inherited, sentences))
    return rows


def chapter_rows(book: Book) -> list[tuple]:
    if book.chapters:
        return [(k, c.id, c.title, c.level, c.first_block) for k, c in enumerate(book.chapters)]
    titles = [(i, b) for i, b in enumerate(book.blocks) if b.kind == "title"]
    return [(k, f"s{k}", b.text, b.level, i) for k, (i, b) in enumerate(titles)]


def note_rows(book: Book) -> list[tuple]:
    return [
        (k, n.text, [{"kind": m, "s": s, "e": e} for m, s, e in n.marks], [{"pos": p, "src": s} for p, s in n.pictures], [{"s": s, "e": e, "kind": kind} for s, e, kind in n.kinds])
        for k, n in book.notes.items()
    ]


#: Parts of a book as tables: the columns, and how a book gives their rows.
PARTS: dict[str, tuple[str, Callable[[Book], list[tuple]]]] = {"blocks": (BLOCK_ROWS, block_rows), "chapters": (CHAPTER_ROWS, chapter_rows), "notes": (NOTE_ROWS, note_rows)}


def with_looks(blocks: DataFrame) -> DataFrame:
    """Blocks with ``look``, what their style sheets and the blank lines before them make of them."""
    return blocks.withColumn("look", block_look(F.col("kind"), F.col("says"), F.col("inherited"), F.col("gap")))


def part_of(df: DataFrame, id_col: str, content_col: str, reader: Callable[[object], Book], part: str = "blocks") -> DataFrame:
    """Rows of one part of the book that each content is; a null content has none. One Arrow batch comes of each."""
    ddl, rows_of = PARTS[part]
    fields = StructType.fromDDL(ddl).fields
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner: list[int] = []
            rows: list[tuple] = []
            for k, content in enumerate(batch.column(1)):
                found = rows_of(reader(content.as_py())) if content.is_valid else []
                owner += [k] * len(found)
                rows += found
            keys = batch.column(0).take(pa.array(owner, pa.int64()))
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([keys, *columns], names=[id_col, *(f.name for f in fields)])

    return df.select(id_col, content_col).mapInArrow(work, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {ddl}")
