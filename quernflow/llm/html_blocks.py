"""DOM leaf blocks of a page: text between block-level tags, with its ancestors and a few text measures.

Any byte string of markup gives blocks; nothing raises. Scripts, styles, templates and comments hold no text. A block's
white space is one space; character references are decoded as browsers decode them. One scan forward: time grows with the
page's length whatever is left open or nested in it. Elements are linked nodes which hold only what they add to their
ancestors, so blocks share them.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from html import unescape

#: Elements that begin and end blocks, elements without an end tag, elements whose content is not text.
BLOCK_TAGS = frozenset(
    "html head title body article section nav aside header footer main div p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd "
    "table caption thead tbody tfoot tr td th form fieldset legend blockquote pre figure figcaption address details "
    "summary dialog menu search hr noscript iframe select option optgroup textarea button label center canvas "
    "object video audio svg math".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style xmp noembed noframes".split())
#: Elements whose content is text without tags.
PLAIN_TAGS = frozenset("title textarea".split())
#: Open elements that a start tag closes.
CLOSES = {
    **dict.fromkeys("article section nav aside header footer main div p h1 h2 h3 h4 h5 h6 ul ol dl table form blockquote pre figure address hr fieldset details menu center".split(), ("p",)),
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",),
    "body": ("head", "title"),
}
#: Elements across which a start tag closes nothing.
WALLS = frozenset("article section nav aside header footer main div ul ol dl table td th form blockquote body html figure fieldset".split())

#: Class and id words of articles that are readers' replies, which wrap no main text.
REPLIES = frozenset("comment comments reply replies response responses".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: An attribute up to its value: a name, and where a value follows, how it is quoted.
_ATTRIBUTE = re.compile(r"[\s/]*(?:([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(?:(['\"])|([^\s>]*)))?|(>))")
_NAMED = frozenset(("class", "id", "role"))
_PARTS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_END = {t: re.compile(rf"</{t}(?=[\s/>])|\Z", re.IGNORECASE) for t in RAW_TAGS | PLAIN_TAGS}


@dataclass(slots=True, eq=False)
class Element:
    """An open element: its parent, its class and id words, and the names of the features that it and its words add to
    those of its ancestors. `in_article`: it is an article or below one, `in_main` likewise."""

    tag: str
    words: tuple[str, ...]
    parent: Element | None
    in_article: bool = False
    in_main: bool = False
    adds: list[str] = field(default_factory=list)


@dataclass(slots=True)
class Block:
    """A leaf block: its text, innermost element and share of links."""

    text: str
    element: Element | None
    linked: float


class _Scanner:
    """Tags of a page. What is known to be missing ahead is not sought again."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        got = self.page.find(what, at)
        if got < 0:
            self.missing.add(what)
        return got

    def comment(self, at: int) -> int:
        """The end of the comment that begins at `at`."""
        page = self.page
        for empty in ("<!-->", "<!--->"):
            if page.startswith(empty, at):
                return at + len(empty)
        ends = [(i + len(e)) for e in ("-->", "--!>") if (i := self.find(e, at + 4)) >= 0]
        return min(ends, default=len(page))

    def attributes(self, at: int) -> tuple[int, list[str]]:
        """The end of a tag (-1: the page ends before) and the values of the attributes that name things."""
        page, values = self.page, []
        while True:
            m = _ATTRIBUTE.match(page, at)
            if m is None:
                return -1, values
            at = m.end()
            if m.group(4):
                return at, values
            value = m.group(3)
            if quote := m.group(2):
                end = self.find(quote, at)
                if end < 0:  # never closed: the tag ends at the next bracket
                    stop = self.find(">", at)
                    return (stop + 1 if stop >= 0 else -1), values
                value, at = (at, end), end + 1
            if value and m.group(1).lower() in _NAMED:
                values.append(page[value[0] : value[1]] if isinstance(value, tuple) else value)


class _Tree:
    """The open elements of a page, with the places of each tag and of the walls, and the features they hold."""

    def __init__(self):
        self.open: list[Element] = []
        self.where: dict[str, list[int]] = defaultdict(list)
        self.walls: list[int] = []
        self.held: Counter[str] = Counter()

    @property
    def top(self) -> Element | None:
        return self.open[-1] if self.open else None

    def close(self, i: int) -> None:
        """Close the elements from the i-th on."""
        while len(self.open) > i:
            e = self.open.pop()
            self.where[e.tag].pop()
            if self.walls and self.walls[-1] == len(self.open):
                self.walls.pop()
            for f in e.adds:
                del self.held[f]

    def end(self, tag: str) -> None:
        if self.where[tag]:
            self.close(self.where[tag][-1])

    def start(self, tag: str, values: list[str]) -> None:
        for other in CLOSES.get(tag, ()):
            at = self.where[other][-1] if self.where[other] else -1
            if at >= 0 and (other in ("head", "title") or not self.walls or self.walls[-1] <= at):
                self.close(at)
        if tag in VOID_TAGS:
            return
        up = self.top
        words = tuple(w for x in values for w in _PARTS.findall(x.lower()))
        below = up is not None and up.in_article
        own = tag == "article" and REPLIES.isdisjoint(words)
        e = Element(tag, words, up, below or own, tag == "main" or (up is not None and up.in_main))
        names = [f"in:{tag}", *(f"word:{w}" for w in words)]
        if below:
            names += [f"article>{tag}", *(f"article>word:{w}" for w in words)]
        for f in names:
            if f not in self.held:
                self.held[f] = 1
                e.adds.append(f)
        self.where[tag].append(len(self.open))
        if tag in WALLS:
            self.walls.append(len(self.open))
        self.open.append(e)


def leaf_blocks(html: str | None) -> list[Block]:
    """The blocks of a page in its order, without empty ones."""
    page = html or ""
    out: list[Block] = []
    tree, scan = _Tree(), _Scanner(page)
    texts: list[str] = []
    links, linked, hidden, at, size = 0, 0, 0, 0, len(page)

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not hidden:
            got = unescape(raw) if "&" in raw else raw
            texts.append(got)
            if links:
                linked += len(got)

    def flush() -> None:
        nonlocal linked
        if texts:
            whole = "".join(texts)
            texts.clear()
            clean = _SPACE.sub(" ", whole).strip()
            if clean:
                out.append(Block(clean, tree.top, min(1.0, linked / len(clean))))
        linked = 0

    while at < size:
        begin = scan.find("<", at)
        if begin < 0:
            text(page[at:])
            break
        text(page[at:begin])
        if page.startswith("<!--", begin):
            at = scan.comment(begin)
            continue
        closing = page.startswith("/", begin + 1)
        name = _NAME.match(page, begin + 1 + closing)
        if name is None:
            if closing or page[begin + 1 : begin + 2] in ("!", "?"):  # declarations and the like
                stop = scan.find(">", begin)
                at = size if stop < 0 else stop + 1
            else:
                text("<")
                at = begin + 1
            continue
        tag = name.group().lower()
        at, values = scan.attributes(name.end())
        if at < 0:  # the page ends inside a tag
            break
        if tag == "template":
            hidden = max(0, hidden - 1) if closing else hidden + 1
        elif hidden and tag not in RAW_TAGS:
            continue
        elif tag in RAW_TAGS or tag in PLAIN_TAGS:
            if closing:
                continue
            end = _END[tag].search(page, at)
            if tag in PLAIN_TAGS:
                flush()
                tree.start(tag, values)
                links = 0
                text(page[at : end.start()])
                flush()
                tree.end(tag)
            stop = scan.find(">", end.end())
            at = size if stop < 0 else stop + 1
        elif tag == "br":
            texts.append(" ")
        elif tag == "a":
            links = max(0, links - 1) if closing else 1
        elif tag in BLOCK_TAGS:
            flush()
            links = 0
            if closing:
                tree.end(tag)
            else:
                tree.start(tag, values)
    flush()
    return out
