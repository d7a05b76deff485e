"""Pages cut into text blocks with their place in the element tree, and the small labelled table of example pages.

``parse`` reads a page as a browser would where it matters for text: raw-text elements (script, style, title, textarea)
and comments hold no text, paragraphs, list items, table cells and headings end where the next one starts, an end tag
closes what is still open inside its element and is ignored without one. Formatting elements never break a block, so
unclosed ones do no harm; ``br`` is white space. Every element of block kind is a node of the tree.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Element names of HTML by what they do to text.
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"}
UNSEEN = {"template", "noscript", "svg", "object", "canvas", "audio", "video", "select", "button", "datalist"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCK = HEADING | {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "head", "header", "hgroup", "hr", "html", "legend", "li",
    "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th",
    "thead", "tr", "ul",
}
_CLOSES = {  # a start tag ends these open elements, up to the nearest of the bounds
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
_SCOPE = {"td", "th", "caption", "table", "button", "object", "template"}

# What an element says about its text, by its name, its role attribute and the words of its class and id.
ASIDE_TAGS = {"nav", "form", "dialog", "menu", "search"}
ASIDE_ROLES = {"navigation", "banner", "search", "form", "alert", "dialog", "alertdialog", "menu", "menubar", "toolbar"}
# Beside the text, articles (teasers) inside included.
SIDE_TAGS = {"aside", "footer"}
SIDE_ROLES = {"complementary", "contentinfo"}
SIDE_CLASSES = {"aside", "footer", "promo", "recommended", "related", "sidebar", "sponsored", "teaser", "teasers", "widget"}
COMMENT_WORDS = {"comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "discussion", "reactions"}
ASIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "consent",
    "cookie", "cookies", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notification", "pagination", "pager", "popup", "promo", "promoted", "promotion",
    "recommended", "related", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored",
    "subscribe", "subscription", "tags", "teaser", "toolbar", "topbar", "widget", "widgets",
}
MAIN_TAGS = {"article", "main"}
MAIN_WORDS = {"article", "body", "content", "entry", "main", "post", "story", "text"}
NEUTRAL_WORDS = {"with", "has", "no", "without", "open", "layout"}

# Zones of the tree; a block lies in that of its nearest telling element.
PLAIN, MAIN_TAG, MAIN_WORD, ASIDE_TAG, ASIDE_WORD, COMMENT, HEADER, SIDE = range(8)


@dataclass
class Block:
    text: str
    node: int
    tag: str
    zone: int
    link_share: float


@dataclass
class Page:
    """Blocks in page order; ``parent`` and ``depth`` of each node of the tree, node 0 being the root."""

    blocks: list[Block] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])


def _names(value: str) -> list[str]:
    return [w.lower() for w in _NAME.findall(value)]


def _zone(tag: str, attributes: str, outer: int) -> int:
    """The zone that an element opens inside ``outer``."""
    if outer in (COMMENT, ASIDE_TAG, SIDE) and tag not in MAIN_TAGS:
        return outer
    if tag in ("html", "body", "head"):
        return outer
    own = PLAIN
    classes, role = [], ""
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = "".join(values)
            name = name.lower()
            if name == "role":
                role = value.lower()
            elif name in ("class", "id"):
                classes += value.split()
            elif name == "hidden" or value.lower() == "true":
                own = ASIDE_WORD
    main = tag in MAIN_TAGS or role in MAIN_TAGS
    words = [{c.lower()} if main else set(_names(c)) for c in classes]
    words = [w - {"header"} if w & MAIN_WORDS else w for w in words]  # the heading part of an article
    if any(w & COMMENT_WORDS and not w & NEUTRAL_WORDS for w in words):
        return COMMENT
    if tag in SIDE_TAGS or role in SIDE_ROLES or any(c.lower() in SIDE_CLASSES for c in classes):
        return SIDE
    if tag in ASIDE_TAGS or role in ASIDE_ROLES:
        return ASIDE_TAG
    if any(w & ASIDE_WORDS and not w & NEUTRAL_WORDS for w in words):
        return ASIDE_WORD
    if own == ASIDE_WORD:
        return own
    if main:
        return outer if outer == COMMENT or outer == SIDE and tag == "article" else MAIN_TAG
    if tag == "header":
        return outer if outer in (MAIN_TAG, MAIN_WORD) else HEADER
    if outer in (PLAIN, HEADER) and any(w & MAIN_WORDS for w in words):
        return MAIN_WORD
    return outer


def parse(page: str) -> Page:
    """The page's non-empty blocks: character references decoded, white space made one space, trimmed."""
    out = Page()
    stack: list[tuple[str, int, int, bool]] = [("", 0, PLAIN, False)]  # tag, node, zone, unseen
    pieces: list[str] = []
    linked = 0
    link_depth = 0  # stack size at the open link, 0 for none
    lower = ""
    opened: dict[str, int] = {}  # open elements by name, so a search for none ends at once

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                tag, node, zone, _ = stack[-1]
                out.blocks.append(Block(text, node, tag, zone, min(1.0, linked / len(text))))
            pieces.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if not raw or stack[-1][3]:
            return
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if link_depth:
            linked += len(text.strip())

    def close(index: int) -> None:
        nonlocal link_depth
        flush()
        drop(index)
        if link_depth > len(stack):
            link_depth = 0

    def drop(index: int) -> None:
        for element in stack[index:]:
            opened[element[0]] -= 1
        del stack[index:]

    def push(tag: str, node: int, zone: int, unseen: bool) -> None:
        opened[tag] = opened.get(tag, 0) + 1
        stack.append((tag, node, zone, unseen))

    def find(tags: set[str], bounds: set[str]) -> int:
        if not any(opened.get(t) for t in tags):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in bounds:
                return 0
        return 0

    at, end = 0, len(page)
    while at < end:
        match = _TOKEN.search(page, at)
        if match is None:
            say(page[at:])
            break
        say(page[at : match.start()])
        at = match.end()
        name = match.group(2)
        if name is None:
            continue
        tag = name.lower()
        if match.group(1):
            if tag in HEADING:
                index = find(HEADING, _SCOPE)
            elif tag in ("body", "html", "br"):
                flush() if tag != "br" else say(" ")
                continue
            elif tag in BLOCK or tag in UNSEEN:
                index = find({tag}, {"table"} if tag not in ("table", "td", "th", "tr", "tbody", "thead", "tfoot", "caption") else set())
            else:
                if tag == "a":
                    link_depth = 0
                continue
            if index and tag in UNSEEN:  # no break: the text goes on behind it
                drop(index)
            elif index:
                close(index)
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            lower = lower or page.lower()
            if len(lower) != len(page):  # a letter whose lower case is longer: search in place
                found = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
                stop = found.start() if found else end
            else:
                stop = lower.find(f"</{tag}", at)
                stop = end if stop < 0 else stop
            shut = page.find(">", stop)
            at = end if shut < 0 else shut + 1
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in UNSEEN:
            top = stack[-1]
            push(tag, top[1], top[2], True)
            continue
        if tag not in BLOCK:
            if tag == "a":
                link_depth = len(stack)
            continue
        flush()
        if tag == "hr":
            continue
        if tag in _CLOSES:
            closed, bounds = _CLOSES[tag]
            index = find(closed, bounds)
            if index:
                close(index)
        elif tag in HEADING and stack[-1][0] in HEADING:
            close(len(stack) - 1)
        if tag not in ("td", "th", "tr", "tbody", "thead", "tfoot", "html", "body", "head"):
            index = find({"p"}, _SCOPE)
            if index:
                close(index)
        _, node, zone, unseen = stack[-1]
        out.parent.append(node)
        out.depth.append(out.depth[node] + 1)
        push(tag, len(out.parent) - 1, _zone(tag, match.group(3), zone), unseen)
    flush()
    return out


# The labelled table: example pages put together from these parts, invented for the purpose.
_CONTENT = (
    "<article>{}</article>",
    "<main>{}</main>",
    '<main><article class="post">{}</article></main>',
    '<div class="content">{}</div>',
    '<div id="articleBody">{}</div>',
    '<div class="entry-text"><div>{}</div></div>',
    "<div>{}</div>",
    "<section>{}</section>",
    "{}",
    "<table><tr><td>{}</td></tr></table>",
)
_BEFORE = (
    '<nav><ul>{links}</ul></nav>',
    '<div class="menu"><ul>{links}</ul></div>',
    '<div><ul>{links}</ul></div>',
    '<header><a href="/">{name}</a><p>{sentence}</p></header>',
    '<div id="header"><h2>{name}</h2>{sentence}</div>',
    '<div class="cookie-notice"><p>{sentence} {sentence}</p><button>OK</button></div>',
    '<div class="ad">{sentence}</div>',
    '<div role="banner">{name}</div>',
    '<form action="/q"><label>{name}</label><input name="q"><p>{sentence}</p></form>',
    '<p><a href="/">{name}</a> | <a href="/x">{name}</a> | <a href="/y">{name}</a></p>',
)
_AFTER = (
    "<footer>&copy; {name} &middot; {sentence}</footer>",
    '<div class="footer"><p>&copy; 2020 {name}. All rights reserved.</p></div>',
    "<p>&copy; 2021 {name}. All rights reserved.</p>",
    '<section id="comments"><h3>{name}</h3><div class="comment"><p>{sentence} {sentence}</p></div></section>',
    '<ol class="commentlist"><li><p>{sentence}</p></li><li><p>{sentence} {sentence}</p></li></ol>',
    "<aside><h3>{name}</h3><p>{sentence}</p><ul>{links}</ul></aside>",
    '<div class="sidebar"><h3>{name}</h3><p>{sentence} {sentence}</p></div>',
    '<div class="related"><ul>{links}</ul></div>',
    '<div class="newsletter-signup"><p>{sentence}</p></div>',
    '<div><a href="/a">{name}</a> <a href="/b">{name}</a> <a href="/c">{name}</a></div>',
)
_WORDS = "lamp river stone cloud seven harbour morning glass paper winter garden letter bridge market silver field".split()

EXAMPLE_PAGES = 200


def example_page(number: int) -> tuple[str, str]:
    """One page of the labelled table and its main text."""
    rng = random.Random(f"page {number}")

    def words(n: int) -> str:
        return " ".join(rng.choice(_WORDS) for _ in range(n))

    def sentence() -> str:
        return f"{words(rng.randint(3, 16)).capitalize()}."

    def fill(part: str) -> str:
        part = re.sub(r"\{links\}", lambda _: "".join(f'<li><a href="/{i}">{words(rng.randint(1, 4))}</a></li>' for i in range(rng.randint(2, 7))), part)
        part = re.sub(r"\{name\}", lambda _: words(rng.randint(1, 3)).title(), part)
        return re.sub(r"\{sentence\}", lambda _: sentence(), part)

    lines, inside = [], []
    for k in range(rng.randint(2, 9)):
        kind = rng.random()
        if k == 0 or kind < 0.12:
            lines.append(words(rng.randint(2, 8)).capitalize())
            inside.append(f"<h{1 if k == 0 else rng.randint(2, 4)}>{lines[-1]}</h{1 if k == 0 else 2}>")
        elif kind < 0.22:
            items = [sentence() for _ in range(rng.randint(2, 4))]
            lines += items
            inside.append("<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>")
        else:
            lines.append(" ".join(sentence() for _ in range(rng.choice((1, 1, 2, 4, 8)))))
            tag = rng.choice(("p", "p", "p", "p", "blockquote"))
            inside.append(f"<{tag}>{lines[-1]}</{tag}>")
    before = [fill(rng.choice(_BEFORE)) for _ in range(rng.randint(1, 3))]
    after = [fill(rng.choice(_AFTER)) for _ in range(rng.randint(1, 3))]
    body = "".join(before) + _CONTENT[number % len(_CONTENT)].format("".join(inside)) + "".join(after)
    return f"<html><head><title>{lines[0]}</title></head><body>{body}</body></html>", "\n".join(lines)


def labelled_pages(spark: SparkSession, count: int = EXAMPLE_PAGES) -> DataFrame:
    """(page_id, html, text): the labelled table that the block classifier learns from."""
    rows = [(i, *example_page(i)) for i in range(count)]
    return spark.createDataFrame(rows, "page_id long, html string, text string")
