"""Main text of web pages, with the templates of their sites removed.

Every element subtree is hashed. Spark counts, for each host, on how many different articles a subtree
stands; one that recurs on many, and on a share of them, is part of the site's template and is deleted. What tags, roles and
class names declare as navigation, notices, adverts, forms or comments is deleted as well, and
the blocks of the article that remain are joined.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator, Mapping
from types import MappingProxyType

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_pieces, text_column

# A subtree on this many different articles of a host, and on this share of them, is part of its
# template, as text that single pages share by chance or by quoting is not.
TEMPLATE_PAGES = 8
TEMPLATE_SHARE = 0.1
# On hosts with fewer articles, this many of them and this share of them are enough.
SMALL_PAGES, SMALL_SHARE = 4, 0.75
# Longest blocks that near copies of an article are known by.
_BODIES = 4
# Template hashes that are sent to every task; more are joined to the pages instead.
BROADCAST_HASHES = 200_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<end>>|\Z)"
    r"|<(?=[a-zA-Z/])[^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {
    "script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes",
}
_VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
_BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt",
    "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main",
    "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_ENDS_P = _BLOCKS | {"aside", "footer", "form", "nav", "fieldset", "menu", "search"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_TEXT = {"p", "pre", "blockquote", *_HEADINGS}
# Parts of lists and tables, which in a marked article go with the whole list or table only.
_PARTS = {"li", "dt", "dd", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "figcaption", "summary"}
# Elements that an opening tag ends, and the elements that its search stops at.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "option": ({"option"}, {"select", "datalist"}),
}
# What never belongs to an article.
_DROPPED = {
    "head", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "button", "select",
    "textarea", "iframe", "object", "svg", "canvas", "audio", "video", "menu", "dialog", "datalist", "title",
    "fieldset", "label", "input", "map", "search", "noframes", "noembed", "annotation",
    "annotation-xml",
}
_DROPPED_ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog",
    "menu", "menubar", "toolbar", "advertisement",
}
# Words of class names and ids.
_DROPPED_NAMES = {
    "ad", "ads", "adv", "advert", "advertisement", "adverts", "advertising", "banner", "breadcrumb",
    "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disclaimer", "disqus",
    "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notices", "notification", "pager", "pagination", "popup", "promo", "promotion", "related",
    "replies", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored",
    "subscribe", "toolbar", "topbar", "widget",
}
_LAYOUT = {"has", "with", "without", "no"}
# What stands beside such a word in the name of a part of a page. Inside a marked article a name with
# any other word ("market-share-table", "ad-hoc") is taken for one of the article's own.
_PART_NAMES = {
    "and", "area", "article", "articles", "author", "bar", "block", "blocks", "body", "bottom", "box", "button",
    "buttons", "card", "cards", "col", "container", "content", "feed", "form", "global", "group", "head", "icon",
    "icons", "inline", "inner", "item", "items", "label", "left", "link", "links", "list", "main", "media",
    "message", "module", "outer", "overlay", "page", "panel", "placeholder", "post", "posts", "primary", "reader",
    "readers", "right", "row", "secondary", "section", "site", "slot", "stories", "story", "teaser", "text",
    "thread", "title", "top", "unit", "user", "wrap", "wrapper", "zone",
}
_WORD = re.compile(r"[a-z]+")


class Element:
    """A tag with its attributes and, in order, the texts and elements inside it."""

    __slots__ = ("name", "attributes", "inside", "digest")

    def __init__(self, name: str, attributes: str):
        self.name, self.attributes, self.inside, self.digest = name, attributes, [], None

    def attribute(self, *names: str) -> Iterator[str]:
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() in names:
                yield entities.unescape(m[2] or m[3] or m[4] or "").lower()


def parse(page: str) -> Element:
    """The element tree of a page. Open elements end with their parent or with the page."""
    root = Element("#page", "")
    stack, at = [root], 0
    end = len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        if not found:
            stack[-1].inside.append(page[at:])
            break
        if found.start() > at:
            stack[-1].inside.append(page[at : found.start()])
        at = found.end()
        name = found["name"]
        if not name or not found["end"]:
            continue
        name = name.lower()
        if found["close"]:
            _close(stack, name)
            continue
        _make_room(stack, name)
        element = Element(name, found["attributes"])
        stack[-1].inside.append(element)
        if name in _RAW:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            element.inside.append(page[at : close.start()] if close else page[at:])
            at = close.end() if close else end
        elif name not in _VOID:
            stack.append(element)
    return root


def _close(stack: list[Element], name: str) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].name == name:
            del stack[depth:]
            return
        # An inline end tag doesn't reach out of the block that it stands in.
        if name not in _ENDS_P and name not in _ENDS and stack[depth].name in _ENDS_P:
            return


def _make_room(stack: list[Element], name: str) -> None:
    """End the elements that cannot hold a new one of this name."""
    if name in _ENDS_P:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].name == "p":
                del stack[depth:]
                break
            if stack[depth].name in _ENDS_P:
                break
    if name in _HEADINGS and stack[-1].name in _HEADINGS:
        stack.pop()
    names, stops = _ENDS.get(name, ((), ()))
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].name in names:
            del stack[depth:]
            return
        if stack[depth].name in stops or not names:
            return


def _ordered(root: Element) -> list[Element]:
    """Every element, parents first."""
    out, todo = [], [root]
    while todo:
        element = todo.pop()
        out.append(element)
        todo += [x for x in reversed(element.inside) if isinstance(x, Element)]
    return out


def subtree_hashes(root: Element) -> list[Element]:
    """Give each element a 64-bit hash of its tag, attributes, texts and elements."""
    elements = _ordered(root)
    for element in reversed(elements):
        text = hashlib.blake2b(f"{element.name}\x00{element.attributes.strip()}".encode(errors="replace"), digest_size=8)
        for x in element.inside:
            text.update(x.digest if isinstance(x, Element) else b"\x01" + " ".join(x.split()).encode(errors="replace"))
        element.digest = text.digest()
    return elements


def _declared(element: Element, in_article: bool) -> bool:
    """True if tag, role or class names say that an element is not part of an article."""
    if element.name in _DROPPED or element.name == "header" and not in_article:
        return True
    if not element.attributes or element.name in ("html", "body", "article", "main"):
        return False
    if any(r in _DROPPED_ROLES for v in element.attribute("role") for r in v.split()):
        return True
    if any(True for _ in element.attribute("hidden")) or "true" in element.attribute("aria-hidden"):
        return True
    if any("display:none" in v.replace(" ", "") for v in element.attribute("style")):
        return True
    # The name of a page's layout ("with-sidebar") says nothing of the element itself, and the
    # header of an article holds its headline.
    text = element.name in ("p", *_HEADINGS)
    # Ids of headings and paragraphs in an article are often made from its own words.
    sources = ("class",) if text and in_article else ("class", "id")
    for token in (t for v in element.attribute(*sources) for t in v.split()):
        words = [token] if text else _WORD.findall(token)
        if any(w in _LAYOUT for w in words) or in_article and "header" in words:
            continue
        if in_article and any(w not in _DROPPED_NAMES and w not in _PART_NAMES for w in words):
            continue
        if any(w in _DROPPED_NAMES for w in words):
            return True
    return False


def article_root(elements: list[Element]) -> tuple[list[Element], bool]:
    """Where the article is: the outer article elements, or main, or else the whole page."""
    for test in (
        lambda e: e.name == "article",
        lambda e: e.name == "main" or "main" in e.attribute("role"),
        lambda e: "articlebody" in e.attribute("itemprop"),
    ):
        found = [e for e in elements if test(e)]
        if found:
            inner = {id(x) for e in found for x in _ordered(e)[1:]}
            return [e for e in found if id(e) not in inner], True
    return [elements[0]], False


def blocks(
    roots: list[Element],
    marked: bool,
    template: Mapping[bytes, bool] = MappingProxyType({}),
    candidates: list[Element] | None = None,
    headings: list[bool] | None = None,
) -> list[str]:
    """Texts of the blocks below the roots, without declared and template parts.

    A recurring paragraph or heading, or a part of a list or table of a marked article, is text that
    pages share, with all that is inside it, and so is an inline element beside text; only other
    recurring elements are templates. ``template`` says of each if it is kept, with all inside it, as
    most of an article. Those that could be are added to ``candidates``, and to ``headings``
    whether each block is one.
    """
    out: list[str] = []
    current: list[str] = []

    def flush(heading: bool = False) -> None:
        text = " ".join(entities.unescape("".join(current)).split())
        current.clear()
        if text:
            out.append(text)
            if headings is not None:
                headings.append(heading)

    for root in roots:
        todo: list = [(root, False, False, False)]
        while todo:
            x, closing, in_text, beside = todo.pop()
            if isinstance(x, str):
                current.append(x)
                continue
            block = x.name in _BLOCKS
            if closing:
                flush(x.name in _HEADINGS)
                continue
            if x is not root:
                # A comment of a reader is an article inside the article.
                if _declared(x, marked) or marked and x.name == "article":
                    current.append(" ")
                    continue
                in_text = in_text or x.name in _TEXT or marked and x.name in _PARTS
                if x.inside and not in_text and not (beside and x.name not in _ENDS_P):
                    kept = template.get(x.digest)
                    if kept is False:
                        continue
                    in_text = bool(kept)
                    if candidates is not None:
                        candidates.append(x)
            if x.name == "header" and marked:
                flush()
                todo += [(e, False, True, False) for e in reversed(_ordered(x)) if e.name in _HEADINGS]
                continue
            if x.name in ("br", "wbr"):
                current.append(" " if x.name == "br" else "")
                continue
            if block:
                flush()
                todo.append((x, True, False, False))
            # Inline elements of a block with text of its own stand in its sentences.
            beside = beside and not block or any(isinstance(y, str) and y.strip() for y in x.inside)
            todo += [(y, False, in_text, beside) for y in reversed(x.inside)]
        flush()
    return out


def host(url: Column) -> Column:
    """The host of an address in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _text_sizes(elements: list[Element]) -> dict[int, int]:
    """Characters of text in each element, by its id."""
    sizes: dict[int, int] = {}
    for e in reversed(elements):
        inside = (sizes[id(x)] if isinstance(x, Element) else len(" ".join(x.split())) for x in e.inside)
        sizes[id(e)] = 0 if e.name in _DROPPED else sum(inside)
    return sizes


def _bodies(texts: list[str], headings: list[bool]) -> int:
    """Six bits of a hash of each of the longest blocks that are no headings, 11 bits apart.

    Bits 6 to 10 of each say whether there is such a block.
    """
    body = [t for t, h in zip(texts, headings) if not h] or texts
    packed = 0
    for rank, text in enumerate(sorted(set(body), key=lambda t: (-len(t), t))[:_BODIES]):
        low = hashlib.blake2b(text.encode(errors="replace"), digest_size=1).digest()[0] & 63
        packed |= (64 | low) << 11 * rank
    return packed


def _subtrees(page: str) -> tuple[str, int, list[tuple[int, bool]]]:
    """A hash of the page's article, its bodies, and the elements that could be templates.

    Of an element its hash, and if it is most of a marked article.
    """
    elements = subtree_hashes(parse(page))
    roots, marked = article_root(elements)
    found, headings = [], []
    texts = blocks(roots, marked, candidates=found, headings=headings)
    own = hashlib.blake2b("\n".join(texts).encode(errors="replace"), digest_size=8).hexdigest()
    sizes = _text_sizes(elements)
    whole = sum(sizes[id(e)] for e in roots)
    most = {e.digest: marked and 2 * sizes[id(e)] > whole for e in found}
    return own, _bodies(texts, headings), [(int.from_bytes(d, "little", signed=True), m) for d, m in most.items()]


def template_subtrees(pages: DataFrame, min_pages: int = TEMPLATE_PAGES) -> DataFrame:
    """(host, subtree, kept): hashes of element subtrees on ``min_pages`` different articles.

    On a host with few articles, ``SMALL_PAGES`` that are ``SMALL_SHARE`` of them are enough. They must
    also stand on ``TEMPLATE_SHARE`` of the host's different articles. Those that are most of
    a marked article on most of their pages are kept. Pages whose articles are equal count once, so that copies of an article,
    however many, do not make a template of it. Nor do near copies: the articles must differ in
    one of their longest blocks. Rows are made distinct in each task before they are shuffled.
    """
    from ..session import materialise

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            rows = set()
            for where, page in zip(batch.column(1).to_pylist(), text_column(batch, "html").to_pylist()):
                own, bodies, found = _subtrees(page)
                # The row without a subtree counts the article itself.
                rows.add((where, None, own, bodies, False))
                rows.update((where, d, own, bodies, most) for d, most in found)
            names = ("host", "subtree", "article", "bodies", "most")
            return {name: [r[i] for r in rows] for i, name in enumerate(names)}

        return work

    placed = pages.select("html", host(F.col("url")).alias("host"))
    schema = "host string, subtree long, article string, bodies long, most boolean"
    found = map_pieces(placed, "html", schema, make).distinct()
    # A bit for each different body of a rank: up to 64, enough to tell copies from articles.
    seen = []
    for rank in range(_BODIES):
        own = F.shiftright("bodies", 11 * rank).bitwiseAND(F.lit(127))
        bit = F.expr(f"shiftleft(1L, CAST(shiftright(bodies, {11 * rank}) & 63 AS INT))")
        seen.append(F.bit_count(F.coalesce(F.bit_or(F.when(own >= 64, bit)), F.lit(0))))
    counted = found.groupBy("host", "subtree").agg(
        F.count(F.lit(1)).alias("articles"),
        F.greatest(*seen).alias("bodies"),
        (F.avg(F.col("most").cast("int")) > 0.5).alias("kept"),
    )
    counted = materialise(
        counted.filter(
            F.col("subtree").isNull()
            | (F.col("articles") >= min(SMALL_PAGES, min_pages))
            & (F.col("bodies") >= F.greatest(F.lit(min(SMALL_PAGES, min_pages) / 2), F.least("articles", F.lit(64)) / 8))
        ),
        "recurring-subtrees",
    )
    sizes = counted.filter(F.col("subtree").isNull()).select(F.col("host").alias("of"), F.col("articles").alias("whole"))
    recurring = counted.filter(F.col("subtree").isNotNull())
    shared = recurring.join(sizes, F.col("host") == F.col("of"))
    least = F.least(F.lit(min_pages), F.greatest(F.lit(SMALL_PAGES), SMALL_SHARE * F.col("whole")))
    often = (F.col("articles") >= least) & (F.col("articles") >= TEMPLATE_SHARE * F.col("whole"))
    return shared.filter(often & (F.col("bodies") >= least / 2)).select("host", "subtree", "kept")


def _extract(pages: DataFrame, hosts, key: str) -> DataFrame:
    """Main texts of (page_id, url, html, key).

    ``hosts`` is a broadcast of template hashes by host, which ``key`` names; without it, ``key``
    holds a page's own list of them. With each hash goes whether it is kept.
    """

    def make():
        by_host = {h: _digests(found) for h, found in hosts.value.items()} if hosts else None

        def work(batch: pa.RecordBatch) -> dict:
            texts = []
            known = batch.column(batch.schema.names.index(key)).to_pylist()
            for of, page in zip(known, text_column(batch, "html").to_pylist()):
                template = by_host.get(of, {}) if hosts else _digests([(t["subtree"], t["kept"]) for t in of or ()])
                root = parse(page)
                roots, marked = article_root(subtree_hashes(root))
                texts.append("\n".join(blocks(roots, marked, template)))
            n_chars = [len(t) for t in texts]
            return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": n_chars}

        return work

    return map_pieces(pages, "html", "page_id long, url string, text string, n_chars long", make)


def _digests(found: list[tuple[int, bool]]) -> dict[bytes, bool]:
    return {number.to_bytes(8, "little", signed=True): kept for number, kept in found}


def extract_pages(pages: DataFrame, min_pages: int = TEMPLATE_PAGES) -> DataFrame:
    """Per page: page_id, url, text (blocks joined by a line break, empty if none), n_chars.

    ``pages`` needs page_id, url and html; other columns are ignored. A NULL html is an empty page, a
    NULL url belongs to the host without a name. Repeated rows stay separate rows. An empty
    table gives an empty table.

    Up to ``BROADCAST_HASHES`` template hashes are sent to all tasks. More are joined: to each page
    the hashes of its host's template, which then travel as a column beside the page.
    """
    from ..session import materialise

    spark = pages.sparkSession
    found = materialise(template_subtrees(pages, min_pages), "template-subtrees")
    named = pages.select(F.col("page_id").cast("long"), "url", "html", host(F.col("url")).alias("host"))
    rows = found.limit(BROADCAST_HASHES + 1).collect()
    if len(rows) <= BROADCAST_HASHES:
        by_host: dict[str, list[tuple[int, bool]]] = {}
        for row in rows:
            by_host.setdefault(row["host"], []).append((row["subtree"], row["kept"]))
        return _extract(named, spark.sparkContext.broadcast(by_host), "host")
    per_host = found.groupBy(F.col("host").alias("of")).agg(F.collect_list(F.struct("subtree", "kept")).alias("template"))
    joined = named.join(per_host, F.col("host") == F.col("of"), "left").drop("of", "host")
    return _extract(joined, None, "template")
