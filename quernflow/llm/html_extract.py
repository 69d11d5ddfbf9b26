"""Operator 1: HTML main text by a linear-chain conditional random field over DOM leaf blocks.

A page's leaf blocks are labelled together as article or not: each block gives ancestor-tag, class-word and text
features, neighbours depend on each other, and Viterbi decodes the page. The field is trained on pages that a generator
writes block by block with their labels, over many layouts; a training set is a parameter, so own labelled pages can
take its place. Training takes the driver a second; weights are a few thousand numbers and travel with the tasks.

Defined cases: a null or empty page, and one without article blocks, has an empty text; broken markup gives the blocks
that can be read, a page that ends inside a tag those before it; very long pages, deeply nested or full of tags that are
never closed, take time in proportion to their length; a tie between two labellings goes to the one with fewer article
blocks at its end; repeated rows each give a row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .crf import ChainCRF
from .html_blocks import Block, Element, leaf_blocks

#: Pages of the generated training set.
TRAINING_PAGES = 1200


def _own(blocks: list[Block]) -> list[list[str]]:
    """Each block's features besides those of its ancestors."""
    out = []
    n = len(blocks)
    wrapper = ["none" if b.element is None else "article" if b.element.in_article else "main" if b.element.in_main else "none" for b in blocks]
    best = min(wrapper, default="none")  # the page's closest one
    for i, b in enumerate(blocks):
        e = b.element
        up = e.parent if e else None
        leaf = e.tag if e else ""
        got = [f"leaf:{leaf}", f"pair:{up.tag if up else ''}>{leaf}", f"wrapped: {wrapper[i]} of {best}"]
        if wrapper[i] == "none":
            got.append(f"bare {best}: {leaf if up is None or up.tag in ('body', 'html') else ''}")
        if leaf in ("li", "dt", "dd") and up is not None and up.parent is not None:
            got.append(f"list in {up.parent.tag}")
        size = len(b.text)
        got.append(f"length:{0 if size < 25 else 1 if size < 80 else 2 if size < 250 else 3}")
        got.append(f"linked:{int(b.linked * 3)}")
        got.append("stop" if b.text[-1] in ".!?…:;”\"" else "no stop")
        if b.text[0] in "©®" or "copyright" in b.text[:40].lower():
            got.append("rights")
        if "|" in b.text or "»" in b.text:
            got.append("bars")
        got.append("first" if i == 0 else "last" if i == n - 1 else "inner")
        out.append(got)
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """Feature names of each block of a page."""
    out = []
    for b, own in zip(blocks, _own(blocks), strict=True):
        e, named = b.element, False
        while e is not None:
            own += e.adds
            if e.words and not named:
                own += _near(e)
                named = True
            e = e.parent
        out.append(sorted(set(own)))
    return out


def _near(e: Element) -> list[str]:
    """The features of an element with class or id words that hold for its blocks until another such element opens."""
    return [f"near:{w}" for w in dict.fromkeys(e.words)]


def labels_of(blocks: list[Block], model: ChainCRF) -> list[int]:
    """The likeliest labels. What an element's ancestors weigh is summed once for all of its blocks."""
    sums: dict[Element | None, tuple[float, float]] = {None: (0.0, 0.0)}
    near: dict[Element | None, tuple[float, float]] = {None: (0.0, 0.0)}
    for b in blocks:
        chain, e = [], b.element
        while e not in sums:
            chain.append(e)
            e = e.parent
        for e in reversed(chain):
            a, c = sums[e.parent]
            x, y = model.weight(e.adds)
            sums[e] = (a + x, c + y)
            near[e] = model.weight(_near(e)) if e.words else near[e.parent]
    both = [(*sums[b.element], *near[b.element]) for b in blocks]
    return model.decode(_own(blocks), [(a + x, c + y) for a, c, x, y in both])


class _Writer:
    """Writes labelled pages: layouts, names of page parts and texts are drawn, labels follow from the part."""

    SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo za el an or is um et au ei ou ch st tr".split()
    #: Parts of a page that are not its article, as elements and class words.
    PARTS = {
        "nav": "menu navbar nav navigation breadcrumb breadcrumbs topnav links main-menu site-nav nav-list menubar sitemap skip-link main-nav".split(),
        "aside": "sidebar side related widget rail recommended popular widget-area secondary trending more-stories read-next also-like most-read".split(),
        "header": "header masthead site-header top branding logo site-title page-header top-bar brand".split(),
        "footer": "footer site-footer bottom copyright legal site-info colophon credits foot page-footer disclaimer terms".split(),
        "ad": "ad ads advert advertisement sponsored promo banner adbox advertising ad-slot ad-container sponsor promoted adsense banner-ad".split(),
        "notice": "cookie notice consent cookie-banner gdpr alert newsletter popup modal paywall subscribe cookies privacy signup subscription overlay toast cookie-notice".split(),
        "comments": "comments comment comment-list reader-comments discussion replies disqus responses comments-area commentlist respond reply user-comments feedback".split(),
        "share": "share social sharing toolbar buttons tags pagination social-links share-buttons follow-us pager tag-list".split(),
    }
    CONTENT = "content post entry article article-body story text body post-content entry-content page main-content article-content story-body article-text post-body hentry".split()

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        got = ["".join(r.choices(self.SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
        marks = r.choice(("", "", "", "!!", "%%%", "***"))
        return " ".join(w.upper() + marks if marks == "!!" else w + marks for w in got).capitalize()

    def sentence(self, low: int = 2, high: int = 60) -> str:
        return self.words(low, high) + self.r.choice((".", ".", ".", "", "!", "?"))

    def part(self, kind: str) -> list[tuple[str, int]]:
        """Markup pieces with labels of one part that is not the article."""
        r = self.r
        name = r.choice(self.PARTS[kind])
        own = kind if kind in ("nav", "aside", "header", "footer") and r.random() < 0.6 else r.choice(("div", "section", "div")) if kind != "comments" else r.choice(("section", "div", "aside", "ol"))
        mark = f' {r.choice(("class", "id"))}="{name}"' if own in ("div", "section", "ol", "ul") or r.random() < 0.5 else ""
        inner: list[tuple[str, int]] = []
        if kind in ("nav", "share") or (kind in ("aside", "header", "footer") and r.random() < 0.5):
            inner += [("<ul>", -1)]
            for _ in range(r.randint(1, 7)):
                inner += [("<li>", -1), (f'<a href="/{r.randint(1, 99)}">{self.words(1, 4)}</a>', 0), ("</li>", -1)]
            inner += [("</ul>", -1)]
        if kind == "footer":
            inner.append((r.choice(("&copy; ", "Copyright ", "")) + self.words(1, 30), 0))
        if kind in ("ad", "notice", "aside", "comments", "header") or not inner:
            for _ in range(r.randint(1, 4)):
                tag = r.choice(("h1", "h1", "h2", "p", "div", "") if kind == "header" else ("p", "div", "h3", "h4", "", "p", "span"))
                text = self.sentence(1, 40)
                text = f'<a href="#">{text}</a>' if r.random() < 0.2 else text
                inner += [(f"<{tag}>", -1), (text, 0), (f"</{tag}>", -1)] if tag else [(text, 0)]
                if kind in ("ad", "header") and r.random() < 0.6:
                    break
                if not tag:
                    break
        if kind == "comments" and r.random() < 0.3:  # each one an article of its own
            one = ('<article class="comment">', "</article>")
            inner = [(one[0], -1), *inner, (one[1], -1), (one[0] + "<p>", -1), (self.sentence(1, 40), 0), ("</p>" + one[1], -1)]
            mark = mark or f' class="{name}"'
        return [(f"<{own}{mark}>", -1), *inner, (f"</{own}>", -1)]

    def form(self) -> list[tuple[str, int]]:
        r = self.r
        out = [(f'<form{r.choice(("", " class=search", " id=login"))}>', -1)]
        for _ in range(r.randint(1, 3)):
            tag = r.choice(("label", "p", "button", "legend", "div"))
            out += [(f"<{tag}>", -1), (self.sentence(1, 12), 0), (f"</{tag}>", -1)]
        return [*out, ("</form>", -1)]

    def body(self) -> list[tuple[str, int]]:
        """The article's own blocks, with strays between them."""
        r = self.r
        out: list[tuple[str, int]] = []
        if r.random() < 0.85:
            level = r.choice(("h1", "h1", "h2"))
            head = [(f"<{level}>", -1), (self.words(1, 12), 1), (f"</{level}>", -1)]
            out += [("<header>", -1), *head, ("</header>", -1)] if r.random() < 0.15 else head
        for _ in range(r.choice((0, 1, 2, 3, 5, 8, 14))):
            kind = r.random()
            if kind < 0.75:
                text = self.sentence(1, r.choice((2, 20, 90)))
                if r.random() < 0.15:
                    text = f'{text} <a href="/x">{self.words(1, 4)}</a>'
                text = f"<b>{text}" + r.choice(("</b>", "<br>")) if r.random() < 0.2 else text
                out += [("<p>", -1), (text, 1), (r.choice(("</p>", "</p>", "")), -1)]
            elif kind < 0.82:
                tag = r.choice(("h2", "h3", "h4"))
                out += [(f"<{tag}>", -1), (self.words(1, 8), 1), (f"</{tag}>", -1)]
            elif kind < 0.9:
                own, linked = r.choice(("ul", "ol")), r.random() < 0.4
                out.append((f"<{own}>", -1))
                for _ in range(r.randint(1, 5)):
                    item = f'<a href="/{r.randint(1, 99)}">{self.words(1, 6)}</a>' if linked else self.sentence(1, 20)
                    out += [("<li>", -1), (item, 1), ("</li>", -1)]
                out.append((f"</{own}>", -1))
            elif kind < 0.95:
                tag = r.choice(("blockquote", "pre", "figcaption", "td", "dd"))
                wrap = {"td": ("<table><tr>", "</tr></table>"), "dd": ("<dl>", "</dl>"), "figcaption": ("<figure>", "</figure>")}.get(tag, ("", ""))
                out += [(wrap[0] + f"<{tag}>", -1), (self.sentence(2, 40), 1), (f"</{tag}>" + wrap[1], -1)]
            else:
                out += [("<div>", -1), (self.sentence(3, 50), 1), ("</div>", -1)]
            if r.random() < 0.15:
                out += self.part(r.choice(("ad", "share", "aside", "notice", "nav", "comments")))
            if r.random() < 0.03:
                out += self.form()
        if r.random() < 0.2:
            out += self.part(r.choice(("comments", "share", "footer")))
        return out

    def page(self) -> list[tuple[str, int]]:
        r = self.r
        if r.random() < 0.05:  # a fragment: nothing but the article's blocks, or text without markup
            return self.body() if r.random() < 0.6 else [(self.sentence(), 1)]
        out = [("<html><head><title>", -1), (self.words(1, 12), 0), ("</title></head><body>", -1)]
        for kind in r.sample(("nav", "header", "ad", "notice", "share"), r.randint(0, 4)):
            out += self.part(kind)
        if r.random() < 0.2:
            out += self.form()
        layout = r.random()
        if layout < 0.55:
            wrap = ("<article>", "</article>") if r.random() < 0.7 else (f'<article class="{r.choice(self.CONTENT)}">', "</article>")
            wrap = ("<main>" + wrap[0], wrap[1] + "</main>") if r.random() < 0.3 else wrap
        elif layout < 0.75:
            wrap = ("<main>", "</main>")
        elif layout < 0.85:  # the article stands in the body as it is
            wrap = ("", "")
        else:
            wrap = (f'<div {r.choice(("id", "class"))}="{r.choice(self.CONTENT)}">', "</div>")
        out += [(wrap[0], -1), *self.body(), (wrap[1], -1)]
        for kind in r.sample(("comments", "aside", "ad", "footer", "notice", "share"), r.randint(0, 4)):
            out += self.part(kind)
        if r.random() < 0.15:
            out += self.form()
        return [*out, ("</body></html>", -1)]


def training_pages(count: int = TRAINING_PAGES, seed: int = 20) -> list[tuple[str, list[int]]]:
    """Pages with the label of each leaf block (1: article). Labels are the parts' own; the few pages whose markup
    leaves blocks and labels at odds are passed over."""
    writer, out = _Writer(seed), []
    while len(out) < count:
        pieces = writer.page()
        blocks = leaf_blocks("".join(x for x, _ in pieces))
        labels = [y for x, y in pieces if y >= 0]
        if len(blocks) == len(labels) and blocks:
            out.append(("".join(x for x, _ in pieces), labels))
    return out


@cache
def default_model() -> ChainCRF:
    return fit(training_pages())


def fit(pages: list[tuple[str, list[int]]]) -> ChainCRF:
    """Train on (html, label of each leaf block)."""
    return ChainCRF.train([features(leaf_blocks(h)) for h, _ in pages], [y for _, y in pages])


def main_text(html: str | None, model: ChainCRF) -> str:
    """The article's blocks in page order, joined by line feeds."""
    blocks = leaf_blocks(html)
    return "\n".join([b.text for b, y in zip(blocks, labels_of(blocks, model), strict=True) if y])


def extract(pages: DataFrame, model: ChainCRF | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    bound_batches(pages.sparkSession)
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, model) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
