"""Trees of marked-up sources, web pages as books, and what kind a file is.

Python kernels, one document at a time; a damaged document gives what can be read of it.
"""

from __future__ import annotations

import io
import re
import zipfile
from dataclasses import dataclass, field
from html.parser import HTMLParser

from .books import Block, Book, Note

# Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CHROME = frozenset("nav header footer aside form script style noscript template iframe button select textarea svg head".split())
MARKS = {"em": "em", "i": "em", "emphasis": "em", "strong": "strong", "b": "strong", "sup": "sup", "sub": "sub"}
HEADINGS = {f"h{k}": k for k in range(1, 7)}
SPACE = " \t\n\r\f\x0b"
DEEPEST = 200
LARGEST_MEMBER = 500_000_000


@dataclass
class Node:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and strings

    def walk(self):
        """This node and all below, without recursion."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo += reversed(x.children)
        return "".join(out)


class _Tree(HTMLParser):
    """A tree that forgives; elements deeper than ``DEEPEST`` are put beside each other."""

    def __init__(self, xml: bool = False):
        super().__init__(convert_charrefs=True)
        if xml:  # no element of XML holds raw text
            self.CDATA_CONTENT_ELEMENTS = self.RCDATA_CONTENT_ELEMENTS = ()
        self.root = Node("")
        self.stack = [self.root]
        self.xml = xml

    def handle_starttag(self, tag, attrs):
        if not self.xml:
            top = self.stack[-1].name
            if tag in BLOCKS and top == "p" or tag == top and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                self.stack.pop()
        own = {k: v or "" for k, v in reversed(attrs)}
        for k in [k for k in own if k.endswith(":href")]:
            own.setdefault("href", own[k])  # whatever prefix links have
        node = Node(tag.rpartition(":")[2] if self.xml else tag, own)
        self.stack[-1].children.append(node)
        if (self.xml or tag not in VOID) and len(self.stack) < DEEPEST:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        depth = len(self.stack)
        self.handle_starttag(tag, attrs)
        del self.stack[depth:]

    def handle_endtag(self, tag):
        name = tag.rpartition(":")[2] if self.xml else tag
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].name == name:
                del self.stack[k:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def tree(source: str, xml: bool = False) -> Node:
    parser = _Tree(xml)
    parser.feed(source)
    parser.close()
    return parser.root


def inline(node: Node, note_ids: frozenset[str] = frozenset()) -> Block:
    """One paragraph: white space collapsed, marks and note anchors by their place in the text."""
    out: list[str] = []
    marks: list[list] = []
    notes: list[tuple[int, str]] = []
    length = 0
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, list):  # the end of a mark
            x[2] = length
            continue
        if isinstance(x, str):
            for c in x:
                if c in SPACE:
                    if length and out[-1] != " ":
                        out.append(" ")
                        length += 1
                else:
                    out.append(c)
                    length += 1
            continue
        if x is not node and x.name in CHROME:
            continue
        target = x.attrs.get("href", "").partition("#")[2]
        if x.name == "a" and target in note_ids:
            while out and out[-1] == " ":
                out.pop()
                length -= 1
            notes.append((length, target))
            continue
        if x is not node and (x.name in BLOCKS or x.name == "br"):
            todo.append(" ")
        if x.name in MARKS and x is not node:
            mark = [MARKS[x.name], length, length]
            marks.append(mark)
            todo.append(mark)
        todo += reversed(x.children)
    text = "".join(out)
    end = len(text.rstrip())
    text = text[:end]
    kept = []
    for kind, a, b in marks:
        b = min(b, end)
        while a < b and text[a] == " ":
            a += 1
        while b > a and text[b - 1] == " ":
            b -= 1
        if a < b:
            kept.append((kind, a, b))
    return Block("p", text, marks=kept, notes=[(min(p, end), n) for p, n in notes])


def is_data_table(node: Node) -> bool:
    """Rows of the same number of cells, two or more, without blocks of text inside; else a layout."""
    rows = [[c for c in r.children if isinstance(c, Node) and c.name in ("td", "th")] for r in node.walk() if r.name == "tr"]
    rows = [r for r in rows if r]
    flat = all(x.name not in ("p", "table", "ul", "ol", "h1", "h2", "h3") for r in rows for c in r for x in c.walk() if x is not c)
    return bool(rows) and max(map(len, rows)) > 1 and len({len(r) for r in rows}) == 1 and flat


def table_block(node: Node) -> Block:
    parts, cells, at = [], [], 0
    for r in node.walk():
        if r.name != "tr":
            continue
        row = []
        for c in r.children:
            if isinstance(c, Node) and c.name in ("td", "th"):
                piece = inline(c).text
                row.append((at, at + len(piece)))
                parts.append(piece)
                at += len(piece) + 1
        if row:
            cells.append(row)
    return Block("table", "\t".join(parts), cells=cells)


def main_container(root: Node, share: float = 0.8) -> Node:
    """The smallest element that holds four fifths of the text of paragraphs."""
    size: dict[int, int] = {}
    order = list(root.walk())
    for node in reversed(order):
        own = len(node.text().split()) if node.name == "p" else 0
        size[id(node)] = own or sum(size[id(c)] for c in node.children if isinstance(c, Node) and c.name not in CHROME)
    total = size[id(root)]
    node = root
    while total:
        best = max((c for c in node.children if isinstance(c, Node)), key=lambda c: size[id(c)], default=None)
        if best is None or size[id(best)] < share * total or best.name == "p":
            break
        node = best
    return node


def note_targets(root: Node) -> dict[str, Node]:
    """Elements that short links (numbers, asterisks) point to: footnotes. One pass for ids, one for links."""
    by_id = {n.attrs["id"]: n for n in root.walk() if n.attrs.get("id")}
    found = {}
    for n in root.walk():
        target = n.attrs.get("href", "").partition("#")[2] if n.name == "a" else ""
        if target in by_id and re.fullmatch(r"[\[({]?\s*(?:\d{1,4}|\*{1,3}|[a-z])\s*[\])}]?", n.text().strip()):
            inside = by_id[target]
            if inside.name in BLOCKS and len(inside.text()) > len(n.text()):
                found[target] = inside
    back = {n.attrs.get("href", "").partition("#")[2] for t in found.values() for n in t.walk() if n.name == "a"}
    return {k: v for k, v in found.items() if k not in back or not any(v is w for j, w in found.items() if j != k and j in back)}


def html_book(source: str) -> Book:
    """A page's main part, and its notes by id."""
    return page_book(tree(source))


def page_book(root: Node) -> Book:
    notes = note_targets(root)
    ids = frozenset(notes)
    skip = {id(n) for n in notes.values()}
    blocks: list[Block] = []

    def put(block: Block) -> None:
        if block.text:
            blocks.append(block)

    def run(nodes: list) -> None:
        put(inline(Node("p", {}, nodes), ids))

    def walk(node: Node, kind: str) -> None:
        loose: list = []
        for child in node.children:
            if isinstance(child, str) or child.name not in BLOCKS and child.name not in CHROME and not any(n.name in BLOCKS for n in child.walk() if n is not child):
                loose.append(child)
                continue
            run(loose)
            loose = []
            if child.name in CHROME or id(child) in skip:
                continue
            if child.name in HEADINGS:
                block = inline(child, ids)
                block.kind, block.level = ("title", HEADINGS[child.name])
                put(block)
            elif child.name == "table" and is_data_table(child):
                put(table_block(child))
            elif child.name == "pre":
                for line in child.text().split("\n"):
                    put(Block("verse", line.strip()))
            elif child.name in ("p", "li", "dt", "dd", "figcaption", "caption") and not any(n.name in BLOCKS for n in child.walk() if n is not child):
                block = inline(child, ids)
                block.kind = kind
                put(block)
            else:
                walk(child, "cite" if child.name == "blockquote" else kind)
        run(loose)

    walk(main_container(root), "p")
    return Book(blocks=blocks, notes={k: Note(inline(v).text) for k, v in notes.items()})


def single_member(raw: bytes, times: int = 2) -> bytes:
    """What an archive of one file holds, so many archives deep at most."""
    for _ in range(times):
        if not raw.startswith(b"PK\x03\x04"):
            break
        with zipfile.ZipFile(io.BytesIO(raw)) as archive:
            files = [i for i in archive.infolist() if not i.is_dir()]
            if len(files) != 1 or files[0].filename == "mimetype" or files[0].file_size > LARGEST_MEMBER:
                break
            raw = archive.read(files[0])
    return raw


def sniff(raw: bytes, name: str = "") -> str:
    """html, fb2, fb2zip, epub, pdf or txt: by content, then by name."""
    head = raw[:4096].lstrip(b"\xef\xbb\xbf \t\r\n").lower()
    if raw.startswith(b"%PDF"):
        return "pdf"
    if raw.startswith(b"PK\x03\x04"):
        with zipfile.ZipFile(io.BytesIO(raw)) as archive:
            names = archive.namelist()
        return "epub" if "META-INF/container.xml" in names else "fb2zip" if any(n.lower().endswith(".fb2") for n in names) else "zip"
    if b"<fictionbook" in head:
        return "fb2"
    if head.startswith((b"<!doctype html", b"<html")) or b"<html" in head or b"<body" in head:
        return "html"
    ending = name.lower().rpartition(".")[2]
    return ending if ending in ("fb2", "html", "htm", "epub", "pdf") else "txt"
