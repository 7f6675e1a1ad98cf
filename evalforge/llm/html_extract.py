"""Main text of web pages by tree scoring.

A page is read into a light tree. Blocks of running text earn points for their length and
commas; the points pass to the parent in full, to the grandparent by half and to further
ancestors by a third and so on, and each container's sum is discounted by its link
density. The best container is taken (or the <article> or <main> around it), with those of
its siblings that score well or are plain prose. Subtrees that are no article by their
element or role - menus, headers and footers of the page, sidebars, forms - are left out, and
so are those that their class or id calls so (adverts, notices, comments), unless that leaves
out most of the page's prose: a name alone does not outweigh the text. Elements may be nested
to any depth; the tree is read and scored in time linear in the page.

Each page is a row of its own; pages are neither shuffled nor gathered.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(
    r"<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S
)
#: Attributes one after the other, each with its value, so that no word of a value counts as an attribute.
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

# Fixed values of HTML and of common page vocabularies.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noframes", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "math", "mfrac", "mi", "mn", "mo", "mover", "mrow", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtext", "munder", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
NEVER = {
    "head", "nav", "footer", "aside", "form", "menu", "button", "select", "input", "svg", "canvas", "object", "embed", "audio", "video", "map",
    "dialog", "fieldset", "option", "datalist",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "tablist"}
OUTSIDE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "sponsors", "promo", "promotion", "promoted", "banner",
    "nav", "navbar", "navigation", "menu", "submenu", "breadcrumb", "breadcrumbs", "masthead", "topbar", "header", "footer", "sidebar", "aside", "widget",
    "widgets", "related", "recommended", "recommendations", "trending", "popular", "share", "sharing", "social", "comment", "comments", "disqus", "respond",
    "replies", "reply", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter",
    "subscribe", "subscription", "signup", "signin", "login", "paywall", "search", "pagination", "pager", "toolbar", "copyright", "legal", "disclaimer",
    "hidden", "skip", "outbrain", "taboola", "tags", "taglist", "byline",
}
#: Words that say nothing of what an element holds.
GENERIC = {
    "area", "bar", "block", "bottom", "box", "button", "buttons", "card", "center", "col", "column", "container", "content", "div", "fixed", "global", "group", "head", "heading",
    "holder", "id", "inner", "item", "items", "left", "link", "links", "list", "main", "message", "module", "outer", "page", "panel", "placeholder", "primary", "region", "right",
    "row", "secondary", "section", "site", "slot", "sticky", "text", "thread", "title", "top", "unit", "wrap", "wrapper", "zone",
}
#: Words of OUTSIDE that articles are also about.
AMBIGUOUS = {"alert", "banner", "header", "legal", "menu", "notice", "notices", "popular", "search", "skip", "social", "tags", "trending", "disclaimer", "copyright", "consent", "notification"}
INSIDE = {"article", "body", "content", "entry", "main", "page", "post", "story", "text"}
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
_BARRIER = {"table", "ul", "ol", "dl", "td", "th", "article", "section", "div", "body", "main", "blockquote", "nav", "aside", "header", "footer", "form", "select"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_TEXT = _HEADINGS | {"p", "span", "em", "strong", "b", "i", "a", "code", "pre"}
_RAW_END = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}


class _Node:
    __slots__ = ("tag", "up", "block", "out", "doubt", "good", "score", "chars", "linked", "links", "prose", "place")

    def __init__(self, tag: str, up: _Node | None, out: bool, doubt: int, good: int, place: int):
        self.tag, self.up, self.out, self.doubt, self.good, self.place = tag, up, out, doubt, good, place
        self.block = up.block if up and tag in INLINE else self
        self.score = 0.0
        self.chars = self.linked = self.links = self.prose = 0


#: What a name says of its element: nothing, perhaps outside, outside.
CLEAR, WEAK, STRONG = 0, 1, 2


def _named_outside(tag: str, value: str) -> int:
    """Does a class or id call its element something outside the article. Of a name of several words all count, save for
    headings and paragraphs, where the name itself must be one word; names that speak of
    other elements (has-sidebar, comments-open, overflow-hidden) do not. A name is weak where another of its words
    may be what the element is about (popular-science), or where the word is one that articles are about too."""
    found = CLEAR
    for token in value.split():
        names = [x.lower() for x in _NAME.findall(token)]
        if tag in _TEXT and len(names) > 1 or names and (names[0] in ("has", "no", "with", "without") or names[-1] in ("open", "closed", "enabled") or names[0] == "overflow"):
            continue
        called = OUTSIDE.intersection(names)
        if called and (tag != "article" or not {"comment", "comments", "ad", "ads", "advert", "promo", "related"}.isdisjoint(names)):
            other = [x for x in names if x not in OUTSIDE and x not in GENERIC and len(x) > 2]
            found = max(found, WEAK if other or called <= AMBIGUOUS else STRONG)
    return found


def _judge(tag: str, attrs: str, in_article: bool) -> tuple[bool, int, int]:
    """Is the element outside any article for sure; how surely by its name; does its name speak for it."""
    if tag in NEVER:
        return True, CLEAR, 0
    if tag == "header":
        return not in_article, CLEAR, 0
    good, doubt = 0, CLEAR
    if attrs:
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return True, CLEAR, 0
            if key == "role" and value.lower() in ROLES:
                return True, CLEAR, 0
            if key in ("class", "id") and tag not in ("html", "body", "main"):
                doubt = max(doubt, _named_outside(tag, value))
                good |= not INSIDE.isdisjoint(x.lower() for x in _NAME.findall(value))
            if key == "itemprop" and value.lower() == "articlebody":
                good = 1
    return False, doubt, good


class _Open:
    """The open elements, with counts of their tags: all, those since the last element that
    is not inline, and those since the last barrier, so that what is not open is not searched."""

    def __init__(self, root: _Node):
        self.stack, self.all = [root], Counter()
        self.inline, self.barriers = [Counter()], [(0, Counter())]

    def push(self, node: _Node) -> None:
        tag = node.tag
        self.stack.append(node)
        self.all[tag] += 1
        if tag in INLINE:
            self.inline[-1][tag] += 1
        else:
            self.inline.append(Counter())
        if tag in _BARRIER:
            self.barriers.append((len(self.stack) - 1, Counter()))
        else:
            self.barriers[-1][1][tag] += 1

    def pop(self) -> None:
        tag = self.stack.pop().tag
        self.all[tag] -= 1
        if tag in INLINE:
            self.inline[-1][tag] -= 1
        else:
            self.inline.pop()
        if tag in _BARRIER:
            self.barriers.pop()
        else:
            self.barriers[-1][1][tag] -= 1

    def can_close(self, tag: str) -> bool:
        """Would an end tag close an element: inline ones end within their block, paragraphs and
        list items within their barrier."""
        if tag in INLINE:
            return self.inline[-1][tag] > 0
        return self.barriers[-1][1][tag] > 0 if tag in ("p", "li") else self.all[tag] > 0

    def pop_until(self, tags) -> None:
        while self.stack[-1].tag not in tags:
            self.pop()
        self.pop()

    def make_room(self, tag: str) -> None:
        """Close what a start tag ends: an open paragraph, the item or cell before."""
        shut = _CLOSES.get(tag, set())
        while True:
            at, since = self.barriers[-1]
            here = [t for t in (*shut, "p") if since[t] > 0]
            if here:
                self.pop_until(here)
                if not shut:
                    return
            elif self.stack[at].tag in shut and at:
                while len(self.stack) > at:
                    self.pop()
            else:
                return


def _parse(page: str) -> tuple[list[_Node], list[tuple[_Node, str, int]]]:
    """All nodes, parents first, and the blocks of text: (innermost block element, text,
    characters in links)."""
    root = _Node("#", None, False, CLEAR, 0, 0)
    nodes, blocks, open_ = [root], [], _Open(root)
    stack = open_.stack
    buffer: list[str] = []
    linked: list[str] = []
    pos, size, lower = 0, len(page), None

    def flush() -> None:
        nonlocal buffer, linked
        if buffer:
            if text := " ".join(html.unescape("".join(buffer)).split()):
                blocks.append((stack[-1].block, text, len(" ".join(html.unescape("".join(linked)).split())) if linked else 0))
            buffer, linked = [], []

    def say(text: str) -> None:
        if text and not stack[-1].out:
            buffer.append(text)
            if open_.all["a"]:
                linked.append(text)

    while pos < size:
        m = _TAG.search(page, pos)
        if not m:
            say(page[pos:])
            break
        say(page[pos : m.start()])
        pos = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, attrs = tag.lower(), m[3] if m[2] else m[6]
        if m[1] or m[4]:
            if open_.can_close(tag):
                if tag not in INLINE:
                    flush()
                open_.pop_until((tag,))
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, pos)
            pos = size if not end else page.find(">", end.start()) + 1 or size
            continue
        if tag == "br" or tag == "hr" or tag in VOID:
            if tag in INLINE:
                say(" ")
            else:
                flush()
            continue
        if tag not in INLINE:
            flush()
            open_.make_room(tag)
        up = stack[-1]
        out, doubt, good = (True, CLEAR, 0) if up.out else _judge(tag, attrs, open_.all["article"] + open_.all["main"] > 0)
        if attrs.endswith("/") and tag in ("svg", "path"):
            continue
        node = _Node(tag, up, out, doubt, good, len(blocks))
        node.links = tag == "a"
        nodes.append(node)
        open_.push(node)
    flush()
    return nodes, blocks


#: A page whose elements not in doubt hold less prose than this, and hardly any beside the others, is gutted.
LEAST_PROSE = 140
#: A weak name counts for nothing where its element has that much prose and at most this share of its text in links.
MOST_LINKED = 0.3
#: A list mostly of links is a menu unless a link has so many characters on average: then it is one of references.
REFERENCE = 60


def _settle(nodes: list[_Node], blocks: list[tuple[_Node, str, int]]) -> None:
    """Sum text and links up the tree, and decide on the elements whose name puts them in
    doubt: they are outside with all they hold, unless they have hardly anything but them; then
    the one with most prose is kept, if that is most of the page's and no article is elsewhere."""
    sure, under, article = 0, set(), False
    for node, text, linked in blocks:
        node.chars += len(text)
        node.linked += linked
        node.prose += len(text) * (len(text) >= 25 and 2 * linked < len(text))
    for n in reversed(nodes):
        if n.up:
            n.up.chars += n.chars
            n.up.linked += n.linked
            n.up.links += n.links
            n.up.prose += n.prose
    for n in nodes:
        if n.doubt == WEAK and n.prose >= LEAST_PROSE and n.linked <= MOST_LINKED * n.chars:
            n.doubt = CLEAR
    for n in nodes:
        if n.doubt or n.up and id(n.up) in under:
            under.add(id(n))
            if not (n.up and id(n.up) in under):
                sure -= n.prose
        elif n.tag in ("article", "main") and n.chars:
            article = True
    total = nodes[0].prose
    sure += total
    gutted = not article and sure < LEAST_PROSE and 10 * sure < total
    best = max((n for n in nodes if n.doubt), key=lambda n: (n.prose, -n.place), default=None) if gutted else None
    kept = set()
    while best and 2 * best.prose > total:
        kept.add(id(best))
        best = best.up
    for n in nodes:
        n.out = n.out or bool(n.up and n.up.out) or n.doubt and id(n) not in kept


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by two line ends; "" if there are none."""
    nodes, blocks = _parse(page or "")
    _settle(nodes, blocks)
    for node, text, linked in blocks:
        if len(text) >= 25 and node.tag not in _HEADINGS:
            points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
            n, share = (node.up if node.tag in ("p", "pre", "li", "td") and node.up else node), 1.0
            for k in range(2, 7):
                if not n or n.tag in ("html", "#"):
                    break
                n.score += points * share
                n, share = n.up, 1 / k
    kept = [b for b in blocks if not b[0].out]
    if not kept:
        return ""

    def value(n: _Node) -> float:
        return (n.score + (5 if n.tag in ("article", "main") else 0) * bool(n.score) + 3 * n.good * bool(n.score)) * (1 - n.linked / max(1, n.chars))

    best = max((n for n in nodes if not n.out and n.score), key=lambda n: (value(n), -n.place), default=None)
    if best is None:
        # No running text of any length: the article or main element with most text, or all.
        best = max((n for n in nodes if n.tag in ("article", "main") and not n.out and n.chars), key=lambda n: n.chars - n.linked, default=nodes[0])
    top = best
    while top.up:
        top = top.up
        if top.tag in ("article", "main") and not top.out:
            best = top
            if top.tag == "article":
                break
    enough = max(10.0, 0.2 * value(best))
    also = {id(best)}
    for n in nodes:
        if n.up is best.up and n is not best and not n.out and n.tag not in INLINE and best.up is not None:
            density = n.linked / max(1, n.chars)
            prose = n.tag == "p" and (n.chars > 80 and density < 0.25)
            title = n.tag == "h1" and n.place <= best.place
            if n.chars and (value(n) >= enough or prose or title):
                also.add(id(n))
    verdict: dict[int, bool] = {}

    def inside(n: _Node) -> bool:
        trail, answer = [], False
        while n:
            if id(n) in verdict:
                answer = verdict[id(n)]
                break
            trail.append(id(n))
            if n.tag in ("ul", "ol") and n.links > 1 and n.linked > 0.6 * max(1, n.chars) and n.chars < REFERENCE * n.links:
                break  # a menu
            if id(n) in also:
                answer = True
                break
            n = n.up
        verdict.update(dict.fromkeys(trail, answer))
        return answer

    return "\n\n".join(text for node, text, _ in kept if inside(node))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id_col, url_col, text, n_chars (code points).

    Null and empty pages, and pages without text, give "". Unclosed or truncated markup is
    read as far as it goes. Rows that repeat are
    extracted each; null ids and urls are passed on; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(text, pa.string())], ["id", "url", "text"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
