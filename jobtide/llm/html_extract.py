"""HTML main text by consensus host paths.

First pass: every page scores its containers (plain text of the blocks in them, less link text) and
names the best one by its generalised path, the tags from the root with the first class of each,
digits removed. Spark adds up these votes per host. Second pass: each page is read again and its
containers on the host's winning path are extracted; a page without one, or without a host, goes
by its own best container.

Left out are navigation, headers, footers, sidebars, forms, scripts, styles and elements whose class
or id names a notice, advert, menu, comment section or the like. A name is only a guess: such an
element stays if the page's largest <article> or <main> lies in it, or most of the page's unlinked text; so does a
form. Names of comments, adverts, consent and the like (``FOREIGN``) mark more: as a whole name they always go, as a
part of one (sponsored-content, notice-board) unless no other unlinked text is left. Names that speak of the layout
(no-sidebar, has-sidebar, with-sidebar) mark nothing. Blocks are joined by one line feed.

Rows: null and empty html has no text; broken or cut-off markup is read as far as it goes. Null and
unreadable urls have no host. Repeated rows, equal and null ids are kept, each with its own text.
Extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from jobtide.llm.common import per_value, struct_of
from jobtide.session import cut

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*+)(?:>|\Z)", re.S)
# a whole name with its value, so that nothing inside other names and values counts
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Element kinds.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike",
          "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
DROPPED = {"head", "nav", "footer", "aside", "noscript", "template", "svg", "math", "button", "select", "dialog",
           "menu", "object", "audio", "video", "canvas", "datalist", "map", *RAW}
WHOLE = {"html", "body", "article", "main"}
WRAPPERS = {"html", "body"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
# Words of class names and ids that mark what is not the article.
NOISE = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "banners", "sponsor", "sponsored",
         "promo", "promotion", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "footer",
         "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "newsletter", "subscribe",
         "subscription", "comment", "comments", "commentlist", "disqus", "replies", "respond", "share", "sharing",
         "social", "related", "recommended", "recommendations", "widget", "widgets", "toolbar", "pagination", "pager", "login",
         "signup", "skip", "copyright", "paywall", "alert", "disclaimer"}
# Those of them that name text which may well outweigh an article.
FOREIGN = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
           "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "newsletter", "subscribe", "subscription", "comment",
           "comments", "commentlist", "disqus", "replies", "respond", "paywall", "alert", "disclaimer"}
NOISE_OUTSIDE = {"header", "masthead", "topbar", "search"}  # inside an article these may hold its title
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu"}
NAME_WORD = re.compile(r"[a-z]+")
# names of a layout: what the page has or lacks, to the end of the name
LAYOUT = re.compile(r"(?<![a-z])(?:no|not|non|has|have|with|without)[-_]+\S+")
KEPT, GUESSED, GUESSED_FOREIGN, FOREIGN_NAME, SURE = range(5)
SPACES = re.compile(r"\s+")
FOUND = "struct<path: string, score: double>"


class Element:
    __slots__ = ("tag", "name", "parent", "noise", "dropped", "in_article", "linked", "holder", "score", "first", "size")

    def __init__(self, tag: str, name: str, parent: Element | None, noise: int, first: int):
        self.tag, self.name, self.parent, self.noise, self.first = tag, name, parent, noise, first
        self.dropped = noise == SURE or bool(parent and parent.dropped)
        self.size = 0  # characters in it outside links
        self.in_article = tag in ("article", "main") or bool(parent and parent.in_article)
        inline = tag in INLINE and parent is not None
        self.linked = tag == "a" or inline and parent.linked
        self.holder = parent.holder if inline else self  # the nearest element that is not inline
        self.score = 0.0


def attributes(text: str) -> dict[str, str]:
    """Names in lower case with their values; of a repeated name the first counts."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text) if text.strip() else ():
        found.setdefault(m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or "")
    return found


def noise_words(attrs: dict[str, str]) -> set[str]:
    return set(NAME_WORD.findall(LAYOUT.sub(" ", f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())))


def noise_of(tag: str, attrs: dict[str, str], inside: bool) -> int:
    """How surely an element is no part of the article: KEPT, GUESSED, GUESSED_FOREIGN, FOREIGN_NAME or SURE."""
    if tag in DROPPED or tag == "header" and not inside:
        return SURE
    if tag in WHOLE and not (tag == "article" and inside):
        return KEPT
    role = attrs.get("role", "").lower()
    if (role in NOISE_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true"
            or "display:none" in attrs.get("style", "").lower().replace(" ", "")):
        return SURE
    words = noise_words(attrs)
    if words & FOREIGN:
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()
        return FOREIGN_NAME if FOREIGN.intersection(names) else GUESSED_FOREIGN
    return GUESSED if "form" in (tag, role) or words & NOISE or not inside and words & NOISE_OUTSIDE else KEPT


class Page:
    """The blocks of text of a page, each with the element that holds it, and the elements."""

    def __init__(self, html: str):
        self.root = self.at = Element("", "", None, KEPT, 0)
        self.elements = [self.root]
        self.every = [self.root]  # inline ones, too
        self.articles: list[Element] = []
        self.guesses: set[int] = set()
        self.blocks: list[tuple[Element, str, int]] = []  # holder, text, characters in links
        self.pieces: list[tuple[Element, list[tuple[Element, str]]]] = []  # blocks, guessed noise included
        self.text: list[tuple[Element, str]] = []
        self.opened = Counter()
        pos = 0
        while m := TOKEN.search(html, pos):
            self.add(html[pos:m.start()])
            pos = m.end()
            tag = (m.group("tag") or m.group("tag2") or "").lower()
            if not tag:
                continue
            if m.group("close") or m.group("close2"):
                self.close(tag)
                continue
            attrs = m.group("attrs") or m.group("attrs2") or ""
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, pos)
                pos = end.end() if end else len(html)
                continue
            self.open(tag, attrs)
        self.add(html[pos:])
        self.flush()
        if self.guesses:
            self.judge()
        for holder, pieces in self.pieces:
            kept = [piece for piece in pieces if not piece[0].dropped]
            text = SPACES.sub(" ", entities.unescape("".join([t for _, t in kept]))).strip()
            if text:
                self.blocks.append((holder, text, sum(len(t) for node, t in kept if node.linked)))

    def add(self, text: str) -> None:
        if text and not self.at.dropped:
            self.text.append((self.at, text))

    def flush(self) -> None:
        """Ends a block: its text belongs to the nearest element that is not inline."""
        if self.text:
            self.pieces.append((self.at.holder, self.text))
            self.text = []

    def judge(self) -> None:
        """Drops guessed noise, but for elements around the article, and names in part foreign or common that hold (most of) what is left."""
        self.measure()
        around: set[Element] = set()
        for tag in ("article", "main"):  # the largest of each
            node = max((e for e in self.articles if e.tag == tag and not e.dropped), key=lambda e: e.size, default=None)
            while node is not None:
                around.add(node)
                node = node.parent
        for kind in (FOREIGN_NAME, GUESSED_FOREIGN, GUESSED):
            if kind not in self.guesses:
                continue
            before = [node.dropped for node in self.every]
            for node in self.every[1:]:  # parents come first
                over = node.noise == kind and node not in around and (kind != GUESSED or 2 * node.size <= self.root.size)
                node.dropped = node.dropped or over or node.parent.dropped
            self.measure()
            if kind == GUESSED_FOREIGN and not self.root.size:  # nothing else is there, so the guess was wrong
                for node, dropped in zip(self.every, before):
                    node.dropped = dropped
                self.measure()

    def measure(self) -> None:
        """Sets the characters that each element holds outside links and dropped elements."""
        for node in self.every:
            node.size = 0
        for _, pieces in self.pieces:
            for node, text in pieces:
                if not node.linked and not node.dropped:
                    node.size += len(text) if text.strip() else 0
        for node in reversed(self.every[1:]):
            node.parent.size += node.size

    def leave(self, node: Element) -> None:
        """Ends ``node`` and all in it."""
        while self.at is not node.parent:
            self.opened[self.at.tag] -= 1
            self.at = self.at.parent

    def open(self, tag: str, raw: str) -> None:
        if tag not in INLINE:
            self.flush()
            self.imply_ends(tag)
        elif tag in ("br", "wbr", "img"):
            if tag == "br":
                self.add(" ")
            return
        if tag in VOID:
            return
        attrs = attributes(raw)
        noise = noise_of(tag, attrs, self.at.in_article)
        label = NAME_WORD.search(attrs.get("class", "").lower())
        node = Element(tag, f"{tag}.{label.group()}" if label else tag, self.at, noise, len(self.pieces))
        self.at = node
        self.opened[tag] += 1
        self.every.append(node)
        if noise in (GUESSED, GUESSED_FOREIGN, FOREIGN_NAME):
            self.guesses.add(noise)
        if tag in ("article", "main") and noise == KEPT and not noise_words(attrs) & NOISE:
            self.articles.append(node)
        if tag not in INLINE:
            self.elements.append(node)

    def imply_ends(self, tag: str) -> None:
        """Ends the open elements that a start tag ends (a paragraph, a list item, a cell)."""
        ended = CLOSES.get(tag, {"p"}) | ({"p"} if tag not in ("td", "th", "tr") else set())
        if not any(self.opened[t] for t in ended):
            return
        fence = FENCE.get(tag, set())
        node, last = self.at, None
        while node.parent is not None and node.tag not in fence:
            if node.tag in ended:
                last = node
            elif node.tag not in INLINE and node.tag not in ended and tag not in FENCE:
                break
            node = node.parent
        if last is not None:
            self.leave(last)

    def close(self, tag: str) -> None:
        node = self.at if self.opened[tag] else self.root
        while node.parent is not None and node.tag != tag:
            if tag in INLINE and node.tag not in INLINE:
                return  # an inline end tag does not end blocks
            node = node.parent
        if node.parent is None:
            return
        if tag not in INLINE:
            self.flush()
        self.leave(node)

    def path(self, node: Element) -> str:
        names = []
        while node.parent is not None:
            names.append(node.name)
            node = node.parent.holder
        return "/".join(n for n in reversed(names) if n not in WRAPPERS)

    def best(self) -> Element | None:
        """The container with the most text in its blocks, lifted to the article around it if there is one."""
        for holder, text, linked in self.blocks:
            gain = max(len(text) - 2.0 * linked, 0.0)
            node = holder if holder.tag not in ("p", "li", "blockquote", "pre", "td", "th", "tr", "dd", "dt", "ul", "ol", "dl", "table",
                                               "tbody", "thead", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6") else holder.parent
            share = 1.0
            while node is not None and share > 0.2:
                node.holder.score += gain * share
                node, share = node.holder.parent, share * 0.5
        top = max(self.elements, key=lambda e: (e.score, -e.first), default=None)
        if top is None or top.score <= 0:
            return None
        node, lifted = top, None
        while node is not None:
            if node.tag == "article" or node.tag == "main" and lifted is None:
                lifted = node
            node = node.parent
        return lifted or top

    def within(self, path: str) -> str | None:
        """The text in the containers on a path; None if the page has none."""
        names = path.split("/") if path else []
        steps: dict[Element, int] = {}  # how much of the path leads to an element, -1 if it left the path
        inside: set[Element] = set()
        for node in self.elements:  # parents come first
            above = node.parent.holder if node.parent else None
            at = steps[above] if above else 0
            if node.parent and node.name not in WRAPPERS:
                at = at + 1 if 0 <= at < len(names) and names[at] == node.name else -1
            steps[node] = at
            if at == len(names) and not node.dropped or above in inside:
                inside.add(node)
        return "\n".join(text for holder, text, _ in self.blocks if holder in inside) if inside else None


def vote(html: str | None) -> dict | None:
    page = Page(html or "")
    best = page.best()
    return {"path": page.path(best), "score": best.score} if best else None


def main_text(html: str | None, path: str | None) -> str:
    """Text on ``path`` or, where the page has nothing there, in the page's own best container."""
    page = Page(html or "")
    text = page.within(path) if path is not None else None
    if not text:
        best = page.best()
        text = page.within(page.path(best)) if best else ""
    return text or ""


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path) by the votes of the host's pages; ties go to the higher score, then the lesser path."""
    ballot = per_value(pages.sparkSession, lambda: vote, FOUND, struct_of(path=pa.string(), score=pa.float64()))
    votes = (pages.select(host_of(F.col(url_col)).alias("host"), ballot(F.col(html_col)).alias("vote"))
             .where(F.col("host").isNotNull() & F.col("vote").isNotNull())
             .groupBy("host", F.col("vote.path").alias("path"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("vote.score")).alias("score")))
    best = F.max_by("path", F.struct(F.col("n"), F.col("score"), -F.length("path"), "path"))
    return votes.groupBy("host").agg(best.alias("path"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every page.

    The winning paths, one row a host, are written first: if they are few, the optimizer sees the
    true size and broadcasts them; if many, the pages are shuffled by host and adaptive execution
    splits the hot ones.
    """
    paths = cut(host_paths(pages, url_col, html_col).withColumnRenamed("host", "path_host"), "host-paths")
    text = per_value(pages.sparkSession, lambda: lambda page: main_text(page["html"], page["path"]), "string", pa.string())
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                        host_of(F.col(url_col)).alias("host"))
    return (rows.join(paths, rows.host == paths.path_host, "left")
            .select(F.col("id").alias(id_col), F.col("url").alias(url_col), text(F.struct("html", "path")).alias("text")))
