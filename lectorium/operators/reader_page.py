"""Pages of a reading site's own layout: an ``article`` with the id ``book-content``, its sections, notes and poems."""

from __future__ import annotations

from urllib.parse import unquote

from .books import Book, Builder, Note, RichText, as_note, join_lines
from .markup import Node, page_book, tree

# Fixed values.
MARKS = {"em": "em", "i": "em", "strong": "strong", "b": "strong", "sup": "sup", "sub": "sub"}
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNTITLED = "<title unassigned>"
NO_TITLE = "* * *"


def kids(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node)]


def classes(node: Node) -> set[str]:
    return set(node.attrs.get("class", "").split())


def below(node: Node, name: str, of_class: str = "") -> list[Node]:
    return [n for n in node.walk() if n is not node and n.name == name and (not of_class or of_class in classes(n))]


class Page:
    """An article of the layout: its notes, and what is a link to one."""

    def __init__(self, article: Node) -> None:
        sections = [c for c in kids(article) if c.name == "section"]
        self.sections = [s for s in sections if "notes" not in classes(s)]
        self.bodies: dict[str, Node | None] = {}
        self.targets: dict[str, str] = {}
        for holder in (s for s in sections if "notes" in classes(s)):
            for note in below(holder, "div", "note"):
                name = note.attrs.get("id", "").replace("note-", "")
                if name:
                    self.bodies[name] = next(iter(below(note, "div", "note__body")), None)
                    self.targets |= {name: name, note.attrs["id"]: name}
                    for inner in note.walk():
                        self.targets.setdefault(inner.attrs.get("id", ""), name)
        self.targets.pop("", None)

    def note_of(self, node: Node) -> str | None:
        """The note that a link leads to, written as the layout's ``sup.note`` or as a plain link."""
        if node.name == "sup" and "note" in classes(node):
            return next((a.attrs["data-note-id"] for a in below(node, "a") if a.attrs.get("data-note-id")), None)
        href = node.attrs.get("href", "") if node.name == "a" else ""
        return self.targets.get(unquote(href[1:])) if href.startswith("#") else None

    def rich(self, node: Node, verse: bool = False, links: bool = True) -> RichText:
        rich = RichText()
        todo: list[tuple] = [(node, frozenset())]
        while todo:
            x, marks = todo.pop()
            if isinstance(x, str):
                rich.add(x.replace("\n", " "), marks)
            elif links and (note := self.note_of(x)):
                rich.anchor("note", note, x.text().strip().strip("[]{}()").strip())
            elif x.name == "br":
                rich.add("\n", marks)
            elif x.name not in ("script", "style", "template"):
                inner = marks | {MARKS[x.name]} if x.name in MARKS and x is not node else marks
                apart = x.name in ("p", "div", "li") and x is not node
                todo += [(" ", marks)] * apart + [(c, inner) for c in reversed(x.children)] + [(" ", marks)] * apart
        return (rich.close_up_notes() if links else rich).even(verse, lines=True)


def picture(node: Node) -> str:
    """An illustration's path; covers are none."""
    image = next(iter(below(node, "img")), None)
    source = (image.attrs.get("data-src") or image.attrs.get("src") or "") if image is not None else ""
    return "" if not source or source.startswith("cover") else "images/" + source.rpartition("/")[2]


def note_text(page: Page, body: Node | None) -> Note:
    """A note's paragraphs with empty lines between them."""
    if body is None:
        return Note("")
    whole = RichText()
    paragraphs = below(body, "p") or [body]
    for k, p in enumerate(paragraphs):
        if k:
            whole.add("\n\n")
        whole.append(page.rich(p, links=False))
    return as_note(whole)


class Walk:
    """Puts the parts of the sections into a builder."""

    def __init__(self, page: Page, builder: Builder) -> None:
        self.page, self.builder, self.stanzas = page, builder, 0

    def line(self, node: Node, kind: str, own_id: str = "", stanza: int | None = None, spoken: bool = True) -> None:
        level = self.builder.book.chapters[-1].level if kind == "title" else 0
        block = self.builder.put(kind, self.page.rich(node, kind == "verse"), own_id or node.attrs.get("id", ""), stanza, level=level)
        if block is not None:
            block.spoken = spoken

    def section(self, section: Node, level: int) -> None:
        head = next((c for c in kids(section) if c.name == "h2"), None)
        lines = [self.page.rich(p).text for p in below(head, "p") or [head]] if head is not None else []
        title = " ".join(join_lines(lines).split())
        own = section.attrs.get("id", "")
        self.builder.chapter(NO_TITLE if title == UNTITLED else title, level, own)
        if head is not None:
            self.line(head, "title", f"t-{own}")
        for child in kids(section):
            if child is not head:
                self.part(child, level)

    def part(self, node: Node, level: int, kind: str = "", stanza: int | None = None, spoken: bool = True) -> None:
        own = classes(node)
        inner, number = kind, stanza
        if node.name in ("script", "img", "svg"):
            return
        if node.name == "section":
            return self.section(node, level + 1)
        if node.name in HEADS or own & {"title", "subtitle"}:
            return self.line(node, "subtitle", f"h3-{len(self.builder.book.blocks)}" if node.name == "h3" else "", spoken=spoken)
        if node.name == "p":
            told = "author" if "text-author" in own else "date" if "date" in own and kind == "verse" else kind or ("verse" if "verse" in own else "p")
            return self.line(node, told, stanza=stanza, spoken=spoken)
        if node.name == "cite":
            inner, number = "cite", None
        elif node.name == "div":
            if "img-wrap" in own:
                if source := picture(node):
                    self.builder.image(source)
                return
            if "empty-line" in own:
                return self.builder.blank()
            if own & {"poem", "stanza"}:
                inner = "verse"
                if "stanza" in own:
                    self.stanzas += 1
                    number = self.stanzas
            elif "epigraph" in own:
                inner, number = "epigraph", None
            elif node.attrs.get("id") == "annotation":
                for p in (c for c in kids(node) if c.name == "p"):
                    self.part(p, level, "annotation", spoken=False)
                return
        for child in kids(node):
            self.part(child, level, inner, number, spoken)


def web_book(source: str) -> Book:
    """A page as a book: in the layout if it has its article, else its main part."""
    root = tree(source)
    article = next((n for n in root.walk() if n.name == "article" and n.attrs.get("id") == "book-content"), None)
    title = next((" ".join(n.text().split()) for n in root.walk() if n.name == "title"), "")
    author = next((n.attrs.get("content", "") for n in root.walk() if n.name == "meta" and n.attrs.get("name") == "author"), "")
    if article is None:
        book = page_book(root)
        book.title, book.author = title, author
        return book
    page = Page(article)
    ids = [n.attrs["id"] for s in page.sections for n in s.walk() if n.attrs.get("id")]
    builder = Builder(title, author, ids)
    walk = Walk(page, builder)
    for section in page.sections:
        walk.section(section, 1)
    builder.book.notes = {name: note_text(page, body) for name, body in page.bodies.items()}
    return builder.done()
