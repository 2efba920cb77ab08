"""Main text of HTML pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. A word scores above 0, a tag below, by weights that
come from labelled pages: those of the table with exactly one ``article`` or ``main``
element, whose inside is content. Counted there are, in words that are content and words
that aren't, the tags that enclose them, the tag right above them, classes, ids and roles,
and how much of an element's text is links. Elements of a kind that clearly was not content
are one tag with their whole inside. The tags of the labelling elements were never inside
content, so they weigh as much as all words of a page. One linear scan finds the contiguous
region of the greatest sum: its words are the main text.

Few pages show all that a page can hold, so kinds start with the counts that ``PRIOR``
gives them; what the labelled pages say is added to these.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Pages whose own ``article`` or ``main`` labels them that training reads at most.
MOST_LABELLED = 300
#: A kind of element is one tag with its inside when the log-odds of content under it are below this.
LEFT_OUT = -1.5
#: What such an element scores.
GAP = -4.0
#: Words of evidence that a prior is worth.
PRIOR = 40
#: Words by which the share of content under a tag is drawn to a half.
DRAWN = 100
#: Links from which on the share of linked words is looked at.
LINKS = 3

# HTML's elements that are void, that hold raw text, that are never shown as
# text, that are blocks, that end others without an end tag, and that end tags don't cross.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title iframe xmp noembed noframes".split())
UNSHOWN = RAW | frozenset("head template svg math object canvas select audio video datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - {"br", "html", "body", "head", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup"}
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
WALLS = frozenset("ul ol dl table div article section main aside nav body html form td th blockquote header footer".split())
CONTENT = frozenset(("article", "main"))
# Elements and roles that the standards give other uses than content, and
# words that classes and ids of such elements are made of.
OTHER_NAMES = frozenset("nav aside header footer form dialog menu button label fieldset".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
OTHER_WORDS = frozenset(
    "ad ads advert advertisement sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar widget related masthead footer copyright "
    "cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login share sharing social "
    "comment comments disqus reply replies respond responses feedback reactions pagination pager toolbar".split()
)
PREFIXES = tuple(sorted(w for w in OTHER_WORDS if len(w) > 6))

PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)\s*+(/?)>")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
TAG_STOP = re.compile(r"=\s*+([\"'])|>")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]*+)))?""")
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W_a-zA-Z]+")


@dataclass
class Element:
    name: str
    kinds: tuple[str, ...]
    parent: int
    start: int  # of its items, without its own tags
    end: int = -1


@dataclass
class Page:
    """Elements, parents first, and items (kind, value, element): 't' a text, '<' and '>' tags, of the element they are in."""

    elements: list[Element] = field(default_factory=lambda: [Element("", (), -1, 0)])
    items: list[tuple[str, str, int]] = field(default_factory=list)


def kinds_of(attributes: str) -> tuple[str, ...]:
    """Kinds by class, id and role: the words of these, and what the words are made of."""
    found: dict[str, None] = {}
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            for word in value.split():
                found["." + word.lower()] = None
                for part in PARTS.findall(word):
                    found["." + part.lower()] = None
        elif key == "role":
            found["role=" + value.strip().lower()] = None
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            found["hidden"] = None
    return tuple(found)


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """Texts ('t', text, ''), start tags ('<', name, attributes) and end tags ('>', name, ''), in time linear in the source.

    Comments, declarations and the inside of raw elements are left out. A quotation mark
    that never closes quotes nothing; a tag that never ends takes the rest, as in a browser.
    """
    at, n = 0, len(source)
    unclosed: set[str] = set()
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            yield "t", source[at:], ""
            return
        if lt > at:
            yield "t", source[at:lt], ""
        if m := PLAIN_TAG.match(source, lt):
            at, name, attributes = m.end(), m[2].lower(), m[3]
            end_tag = bool(m[1])
        elif m := NAME.match(source, lt):
            name, end_tag, k = m[1].lower(), source[lt + 1] == "/", m.end()
            while True:
                stop = TAG_STOP.search(source, k)
                if stop is None:
                    return
                if stop[1] is None:
                    break
                k = stop.end()
                if stop[1] not in unclosed:
                    closing = source.find(stop[1], k)
                    if closing < 0:
                        unclosed.add(stop[1])
                    else:
                        k = closing + 1
            at, attributes = stop.end(), source[m.end() : stop.start()]
        else:
            following = source[lt + 1 : lt + 2]
            if following == "!" or following == "?" or following == "/":
                opened = "<!--" if source.startswith("<!--", lt) else "<![CDATA[" if source.startswith("<![CDATA[", lt) else ""
                ending = {"<!--": "-->", "<![CDATA[": "]]>", "": ">"}[opened]
                k = source.find(ending, lt + max(1, len(opened)))
                at = n if k < 0 else k + len(ending)
            else:
                yield "t", "<", ""
                at = lt + 1
            continue
        if end_tag:
            yield ">", name, ""
            continue
        yield "<", name, attributes
        if name in RAW:
            m = RAW_ENDS[name].search(source, at)
            at = m.start() if m else n


class Stack:
    """Open elements, and where the last of each name and the last wall are."""

    def __init__(self) -> None:
        self.open = [0]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.walls: list[int] = []

    def push(self, element: int, name: str) -> None:
        self.places[name].append(len(self.open))
        if name in WALLS:
            self.walls.append(len(self.open))
        self.open.append(element)

    def pop(self, name: str) -> int:
        self.places[name].pop()
        if name in WALLS:
            self.walls.pop()
        return self.open.pop()

    def place(self, names: tuple[str, ...], through_walls: bool = False) -> int:
        """Where the last open element of these names is, if no wall is above it; 0 if there is none."""
        found = max((self.places[n][-1] for n in names if self.places[n]), default=0)
        return found if through_walls or not self.walls or found >= self.walls[-1] else 0


def parse(source: str) -> Page:
    """Elements and items of a page; unknown, unclosed and crossing tags do no harm."""
    page, stack = Page(), Stack()
    elements, items = page.elements, page.items

    def close(place: int) -> None:
        while len(stack.open) > place:
            e = stack.open[-1]
            elements[stack.pop(elements[e].name)].end = len(items)
            items.append((">", elements[e].name, elements[e].parent))

    for kind, value, attributes in tokens(source):
        if kind == "t":
            items.append(("t", html.unescape(value), stack.open[-1]))
        elif kind == ">":
            if place := stack.place((value,), value in WALLS):
                close(place)
            elif value == "br":
                items.append(("<", value, stack.open[-1]))
        else:
            if ends := IMPLIED.get(value, ()) + (("p",) if value in CLOSES_P else ()):
                if place := stack.place(ends):
                    close(place)
            items.append(("<", value, stack.open[-1]))
            if value in VOID or attributes.endswith("/") and value not in BLOCK:
                continue
            elements.append(Element(value, (value, *kinds_of(attributes)) if attributes else (value,), stack.open[-1], len(items)))
            stack.push(len(elements) - 1, value)
    close(1)
    elements[0].end = len(items)
    return page


def words_under(page: Page, counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per element: its words, those of them in links, and its links."""
    n = len(page.elements)
    words, linked, links = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    in_link = [False] * n
    for e, x in enumerate(page.elements):
        in_link[e] = x.name == "a" or e > 0 and in_link[x.parent]
        links[e] = x.name == "a"
    for (kind, _, e), c in zip(page.items, counts):
        if kind == "t" and c:
            words[e] += c
            if in_link[e]:
                linked[e] += c
    for e in range(n - 1, 0, -1):
        up = page.elements[e].parent
        words[up] += words[e]
        linked[up] += linked[e]
        links[up] += links[e]
    return words, linked, links


def link_kinds(page: Page, counts: list[int]) -> list[str]:
    """Per element with some links, how much of its text is linked, in quarters; else ''."""
    words, linked, links = words_under(page, counts)
    return [f"links={min(3, 4 * b // a)}" if c >= LINKS and a and x.name in BLOCK else "" for x, a, b, c in zip(page.elements, words.tolist(), linked.tolist(), links.tolist())]


def word_counts(page: Page) -> list[int]:
    return [len(v.split()) if k == "t" else 0 for k, v, _ in page.items]


def prior(kind: str) -> tuple[int, int]:
    """Words of content and of others that a kind starts with."""
    if kind in CONTENT or kind in ("role=main", "role=article"):
        return PRIOR, 0
    word = kind[1:] if kind[:1] == "." else ""
    other = kind in OTHER_NAMES or kind[5:] in OTHER_ROLES and kind.startswith("role=") or word in OTHER_WORDS or word.startswith(PREFIXES) and word != ""
    return (0, PRIOR) if other or kind in ("hidden", "links=3") else (0, 0)


class TagWeights:
    """Counts of words by kind of element above them, by tag, and by the tag right above; what tags and words score follows."""

    def __init__(self) -> None:
        self.kinds: dict[str, list[int]] = {}
        self.tags: dict[str, list[int]] = {}
        self.above: dict[str, list[int]] = {}

    def odds(self, kind: str) -> float:
        """Log-odds of content under a kind of element."""
        inside, outside = (a + b for a, b in zip(self.kinds.get(kind, (0, 0)), prior(kind)))
        return float(np.log((inside + 2) / (outside + 2)))

    @staticmethod
    def _share(counts: list[int] | None) -> float:
        inside, outside = counts or (0, 0)
        return (inside + DRAWN / 2) / (inside + outside + DRAWN)

    def tag(self, name: str) -> float:
        """What a tag scores: below 0, the more the less of what it encloses was content."""
        return -0.05 - 0.45 * (1 - self._share(self.tags.get(name)))

    def word(self, name: str) -> float:
        """What a word right under a tag scores: above 0, the more the more of such words were content."""
        return 0.1 + 1.4 * self._share(self.above.get(name))

    def gap(self, kinds: tuple[str, ...], within: bool) -> bool:
        """Whether an element of these kinds is one tag; within an article its header is part of it."""
        if kinds and kinds[0] in UNSHOWN:
            return True
        if any(k in CONTENT for k in kinds[:1]):
            return any(self.odds(k) < LEFT_OUT for k in kinds[1:] if k)
        told = [k for k in kinds if k[:1] == "." or "=" in k or k == "hidden" or k in OTHER_NAMES]
        return any(self.odds(k) < LEFT_OUT for k in told if not (within and k == "header"))


def train(sources: list[str]) -> TagWeights:
    """Weights from pages with exactly one ``article``, else one ``main``, whose inside is content; others say nothing."""
    weights = TagWeights()
    kinds, tags, above = (defaultdict(lambda: [0, 0]) for _ in range(3))
    for source in sources:
        page = parse(source)
        counts = word_counts(page)
        label = next((own[0] for own in ([e for e, x in enumerate(page.elements) if x.name == name] for name in ("article", "main")) if len(own) == 1), None)
        if label is None:
            continue
        a, b = page.elements[label].start, page.elements[label].end
        hidden = [False] * len(page.elements)
        direct = np.zeros((len(page.elements), 2), np.int64)
        for e, x in enumerate(page.elements):
            hidden[e] = x.name in UNSHOWN or e > 0 and hidden[x.parent]
        for i, ((kind, _, e), c) in enumerate(zip(page.items, counts)):
            if kind == "t" and c and not hidden[e]:
                direct[e, 0 if a <= i < b else 1] += c
        for e, x in enumerate(page.elements):
            if x.name:
                above[x.name][0] += int(direct[e, 0])
                above[x.name][1] += int(direct[e, 1])
        under = direct.copy()
        for e in range(len(page.elements) - 1, 0, -1):
            under[page.elements[e].parent] += under[e]
        for e, (x, linked) in enumerate(zip(page.elements, link_kinds(page, counts))):
            own = under[e].tolist()
            if x.name in ("", "html", "body") or hidden[e] or not sum(own):
                continue
            for k in (*x.kinds, linked) if linked else x.kinds:
                kinds[k][0] += own[0]
                kinds[k][1] += own[1]
            tags[x.name][0] += own[0]
            tags[x.name][1] += own[1]
    weights.kinds, weights.tags, weights.above = dict(kinds), dict(tags), dict(above)
    return weights


def best_region(scores: list[float]) -> tuple[int, int]:
    """The maximum-scoring subsequence as [start, end), by one linear scan; the first and shortest of equals."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, at = total, (start, i + 1)
    return at


def scored(page: Page, weights: TagWeights) -> list[tuple[str, str, float]]:
    """The page as (kind, value, score): texts 't', tags '<' and '>', and elements '-' that are one tag."""
    elements = page.elements
    counts = word_counts(page)
    linked = link_kinds(page, counts)
    words, _, _ = words_under(page, counts)
    # The article is that content element with the most words; what holds it is never a gap.
    known: dict[tuple, bool] = {}

    def gap(e: int, within: bool) -> bool:
        kinds = (*elements[e].kinds, linked[e]) if linked[e] else elements[e].kinds
        if (kinds, within) not in known:
            known[kinds, within] = weights.gap(kinds, within)
        return known[kinds, within]

    articles = [e for e, x in enumerate(elements) if x.name in CONTENT and not gap(e, True)]
    main = max(articles, key=lambda e: words[e], default=0)
    for e in articles:  # parents first: an article that only wraps another is not yet the one
        if e > main and elements[e].start < elements[main].end and 2 * words[e] > words[main]:
            main = e
    holds, e = {0}, main
    while e > 0:
        holds.add(e)
        e = elements[e].parent
    within = [0] * len(elements)  # the outermost content element that an element is or lies in
    left, in_article = [False] * len(elements), [False] * len(elements)
    for e, x in enumerate(elements[1:], 1):
        answer = x.name == "article" and in_article[x.parent]  # an article in an article, as comments are
        in_article[e] = in_article[x.parent] or x.name == "article"
        left[e] = left[x.parent] or e not in holds and x.name not in ("html", "body") and (answer or gap(e, within[x.parent] > 0))
        within[e] = within[x.parent] or (e if x.name in CONTENT and not left[e] else 0)
    gain = {name: max(0.0, weights.odds(name)) for name in CONTENT}
    edges = {}
    for e, x in enumerate(elements):
        if within[e] == e and e:
            edges[x.start - 1] = edges[x.end] = True
    word = {x.name: weights.word(x.name) for x in elements}
    tag: dict[str, float] = {}
    out: list[tuple[str, str, float]] = []
    gaps = {x.start: x for e, x in enumerate(elements) if e and left[e] and not left[x.parent]}
    most = 1 + sum(counts) * (1.5 + max(gain.values()))
    i, n = 0, len(page.items)
    while i < n:
        kind, value, e = page.items[i]
        if kind == "<" and i + 1 in gaps and gaps[i + 1].parent == e:
            out.append(("-", value, GAP))
            i = gaps[i + 1].end + 1
            continue
        if kind == "t":
            top = within[e]
            out.append(("t", value, counts[i] * (word[elements[e].name] + (gain[elements[top].name] if top else 0.0))))
        else:
            if value not in tag:
                tag[value] = weights.tag(value)
            out.append((kind, value, -most if i in edges else tag[value]))
        i += 1
    return out


def main_text(source: str | None, weights: TagWeights) -> str:
    """The main text of a page: blocks joined by spaces, all white space one space; '' if there is none."""
    if not source:
        return ""
    sequence = scored(parse(source), weights)
    a, b = best_region([s for _, _, s in sequence])
    return " ".join("".join(v if k == "t" else " " if v in BLOCK else "" for k, v, _ in sequence[a:b]).split())


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = MOST_LABELLED) -> TagWeights:
    """Weights from at most ``most`` pages that label themselves, those with the smallest hashes of their ids."""
    own = pages.where(F.lower(html_col).rlike("<(article|main)[\\s>]")).select(F.col(id_col).alias("_id"))
    chosen = own.where("_id is not null").orderBy(F.xxhash64("_id"), "_id").limit(most).distinct()
    rows = pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html")).join(F.broadcast(chosen), "_id").orderBy("_id").limit(most).collect()
    return train([r[1] for r in rows if r[1]])


def extract_text(pages: DataFrame, weights: TagWeights, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Per row its id, columns ``keep`` and ``text``; a null or empty page gives an empty text.

    Rows keep their number, repeated ones too; a null id stays null. Pages of any length
    are read whole, in time linear in it. Columns that aren't named are not read, whatever
    their names; of a column ``text`` in ``keep`` the new one takes the place. An empty
    table gives an empty result.
    """
    rows = pages.select(F.col(id_col), *[c for c in keep if c != "text"], F.col(html_col).alias("_html"))
    fields = rows.schema.fields[:-1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])

    return rows.mapInArrow(tidy(work), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", text string")
