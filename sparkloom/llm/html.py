"""Main text of web pages by tree scoring.

A forgiving parser builds the tree of block elements.  Subtrees that by element, role or class are
navigation, headers, footers, sidebars, notices, adverts, forms, reader comments, scripts or styles
are cut.  Every remaining paragraph gives points (one, one a comma, one a hundred characters up to
three) to its parent, half of them to the grandparent and less to further ancestors; a container's
points are discounted by the share of its text that is link text.  The best container stays, and so
do siblings with a good share of its points or with paragraphs of their own.  An ``article`` or
``main`` element around the best container counts as the container.  Nothing else is dropped.

Every step is linear in the page's length: open elements are looked up by name, end tags are matched in
one pass, sums go up the tree once, and points reach ``ANCESTORS`` levels.

Defined results: null and empty pages, and pages without text outside cut subtrees, give the empty
text; unclosed and misnested elements are closed where their parents end; a cut inline element that is
never closed isn't cut; of containers with equal points the innermost, then the last counts; pages of
any length are read whole; repeated rows and rows with null or repeated ids give one result each; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame

from sparkloom.llm import _blocks as B
from sparkloom.llm import _map

#: A tag (an end tag's slash, the name, the attributes), a comment or a declaration.  Where quotes don't
#: pair, a tag ends at the next ``>``.  No part goes back over what it has read.
_TAG = re.compile(
    r"""<(?:(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+(?=>)|[^<>]*+(?=>))>|!--(?:(?s:.*?)-->|(?s:.*+))|[!?][^>]*+(?:>|$))"""
)
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden|type)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?(?=[\s/>]|$)""", re.I)
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object", "select", "xmp"}
_RAW_TO_END = {"script", "style", "textarea", "title", "iframe"}
_CUT_TAGS = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "head", "fieldset"}
_VOID = {"br", "img", "hr", "meta", "link", "input", "wbr", "area", "base", "col", "embed", "param", "source", "track"}
_BLOCKS = {
    "html", "body", "p", "div", "article", "section", "main", "header", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li",
    "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "dl", "dt", "dd",
    "address", "details", "summary", "center", "hgroup", "search",
} | _CUT_TAGS
_WORDS = re.compile(r"[a-z]+")
_CUT_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sidebar", "menu", "nav", "navbar", "navigation",
    "footer", "comment", "comments", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "promo", "promotion",
    "share", "sharing", "social", "related", "recommended", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription",
    "breadcrumb", "breadcrumbs", "pagination", "pager", "sponsor", "sponsored", "disqus", "widget", "login", "signup", "search",
    "toolbar", "masthead", "respond", "replies", "skip", "outbrain", "taboola",
}
_OUTER_CUT_WORDS = {"header", "top", "topbar"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form"}
_CONTENT = {"article", "main"}
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_FENCE = {"ul", "ol", "table", "dl", "article", "section", "main", "body", "blockquote", "div"}


class _Tree:
    """Block elements by number: parent, element name, whether cut; and the text blocks."""

    def __init__(self) -> None:
        self.parent = [-1]
        self.name = ["html"]
        self.cut = [False]
        self.blocks: list[tuple[int, str, int]] = []  # (element, text, characters of links)


def _cut_by_attributes(name: str, attributes: str, in_content: bool) -> bool:
    for m in _ATTR.finditer(attributes):
        key = m.group(1).lower()
        value = (m.group(2) or m.group(3) or m.group(4) or "").lower()
        if key == "hidden" and "data-" not in attributes[max(0, m.start() - 5) : m.start()]:
            return True
        if key == "aria-hidden" and value == "true":
            return True
        if key == "style" and "display:none" in value.replace(" ", ""):
            return True
        if key == "role" and value in _ROLES:
            return True
        if key in ("class", "id") and name not in ("html", "body", "article", "main"):
            own = set(_WORDS.findall(value))
            if own & _CUT_WORDS or (not in_content and own & _OUTER_CUT_WORDS):
                return True
    return False


class _Open:
    """The open elements, and the depths at which names, containers and content elements are open."""

    def __init__(self) -> None:
        self.stack = [0]
        self.depths: dict[str, list[int]] = {}
        self.fences = [-1]
        self.contents = [-1]

    def push(self, element: int, name: str) -> None:
        depth = len(self.stack)
        self.stack.append(element)
        own = self.depths.get(name)
        if own is None:
            own = self.depths[name] = [-1]
        own.append(depth)
        if name in _FENCE:
            self.fences.append(depth)
        if name in _CONTENT:
            self.contents.append(depth)

    def pop(self, name: str) -> None:
        self.stack.pop()
        self.depths[name].pop()
        if name in _FENCE:
            self.fences.pop()
        if name in _CONTENT:
            self.contents.pop()

    def last(self, name: str) -> int:
        """Depth of the innermost open element of a name, -1 for none."""
        own = self.depths.get(name)
        return own[-1] if own else -1


def _ends(page: str) -> dict[int, int]:
    """Where each inline start tag's element ends: place behind the tag to place behind the end tag.

    Tags of one name pair up like brackets, in one pass over the page.
    """
    found: dict[int, int] = {}
    waiting: dict[str, list[int]] = {}
    for m in _TAG.finditer(page):
        name = m.group(2)
        if name is None:
            continue
        own = waiting.setdefault(name.lower(), [])
        if not m.group(1):
            own.append(m.end())
        elif own:
            found[own.pop()] = m.end()
    return found


def _parse(page: str, by_class: bool) -> _Tree:
    tree = _Tree()
    open_ = _Open()
    stack = open_.stack
    text: list[str] = []
    linked = 0
    link = 0
    at, size = 0, len(page)
    ends: dict[int, int] | None = None
    endless: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if text:
            block = "".join(text)
            if not block.isspace():
                tree.blocks.append((stack[-1], block, linked))
            text.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal link
        flush()
        while len(stack) > depth:
            open_.pop(tree.name[stack[-1]])
        link = 0

    while at < size:
        m = _TAG.search(page, at)
        stop = m.start() if m else size
        if stop > at and not tree.cut[stack[-1]]:
            piece = page[at:stop]
            if "&" in piece:
                piece = unescape(piece)
            text.append(piece)
            if link:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if name == "a":
                link = max(0, link - 1)
            elif name in _BLOCKS:
                depth = open_.last(name)
                # An end tag doesn't close an element around the content that it stands in.
                if depth > 0 and (name in _FENCE or depth >= open_.contents[-1]):
                    pop_to(depth)
            continue
        if name in _RAW:
            end = None
            if name not in endless:
                end = re.compile(rf"</{re.escape(name)}\b[^<>]*>?", re.I).search(page, at)
                if end is None:
                    endless.add(name)
            if end or name in _RAW_TO_END:
                at = end.end() if end else size
            continue
        if name in _VOID:
            if name == "hr":
                flush()
            else:
                text.append(" ")
            continue
        attributes = m.group(3)
        if name in _BLOCKS:
            # A paragraph, or an item of the same list or row, ends here unless a container began since.
            depth = open_.last("p")
            for other in _CLOSES.get(name, ()):
                depth = max(depth, open_.last(other))
            if depth > 0 and depth > open_.fences[-1]:
                pop_to(depth)
            flush()
            parent = stack[-1]
            content = open_.contents[-1] > 0
            cut = tree.cut[parent] or name in _CUT_TAGS or (name == "header" and not content)
            if not cut and by_class and attributes.strip():
                cut = _cut_by_attributes(name, attributes, content)
            tree.parent.append(parent)
            tree.name.append(name)
            tree.cut.append(cut)
            open_.push(len(tree.name) - 1, name)
        elif name == "a":
            link += 1
        elif by_class and attributes.strip() and not tree.cut[stack[-1]] and _cut_by_attributes(name, attributes, open_.contents[-1] > 0):
            # Text around a cut inline element stays one block: reading goes on behind its end tag.
            if ends is None:
                ends = _ends(page)
            at = ends.get(at, at)
    flush()
    return tree


#: Levels above a paragraph that get points from it.
ANCESTORS = 8


def _select(tree: _Tree) -> list[str]:
    """The kept blocks in page order."""
    blocks = [(e, " ".join(t.split()), k) for e, t, k in tree.blocks if not tree.cut[e]]
    blocks = [b for b in blocks if b[1]]
    if not blocks:
        return []
    n = len(tree.name)
    points, length, links = [0.0] * n, [0] * n, [0] * n
    for e, t, k in blocks:
        length[e] += len(t)
        links[e] += min(k, len(t))
        if len(t) < 25 or k > 0.5 * len(t):
            continue
        own = 1 + t.count(",") + t.count("、") + t.count("，") + min(len(t) // 100, 3)
        a, share = (tree.parent[e] if tree.name[e] in ("p", "h1", "h2", "h3", "li", "pre", "td") else e), 1.0
        for depth in range(1, ANCESTORS + 1):
            if a < 0:
                break
            points[a] += own * share
            share = 0.5 if depth == 1 else 0.5 / (1.5 * depth)
            a = tree.parent[a]
    for i in range(n - 1, 0, -1):  # parents come before their children
        length[tree.parent[i]] += length[i]
        links[tree.parent[i]] += links[i]
    score = [p * (1 - links[i] / length[i]) if length[i] else 0.0 for i, p in enumerate(points)]
    top = max(range(n), key=lambda i: (score[i], i))
    if score[top] <= 0:  # no paragraph is long enough to give points
        kept = {i for i in range(n) if tree.name[i] in _CONTENT and length[i]} or {0}
    else:
        a, content = top, -1
        while a >= 0:
            if tree.name[a] in _CONTENT:
                content = a
            a = tree.parent[a]
        if content >= 0:
            kept = {content}
            # Several articles side by side belong together.
            kept |= {i for i in range(n) if tree.parent[i] == tree.parent[content] and score[i] >= 0.2 * score[content] and score[i] > 0 and tree.name[i] in _CONTENT}
        else:
            limit = max(5.0, 0.2 * score[top])
            kept = {top}
            for i in range(1, n):
                if tree.parent[i] == tree.parent[top] and i != top and length[i]:
                    density = links[i] / length[i]
                    good = score[i] >= limit or (density < 0.25 and (length[i] >= 80 or tree.name[i] in ("h1", "h2", "h3", "p") and density == 0))
                    if good:
                        kept.add(i)
    inside = [False] * n
    for i in range(n):
        inside[i] = i in kept or (tree.parent[i] >= 0 and inside[tree.parent[i]])
    return [t for e, t, _ in blocks if inside[e]]


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    got = _select(_parse(page, True))
    if not got:
        got = _select(_parse(page, False))
    return " ".join(got)


def _extracted(block: B.Block) -> dict:
    texts = [main_text(block.text(i)) for i in range(block.n)]
    return {"text": texts, "n_chars": [len(t) for t in texts]}


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", also: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per page: the id, the columns in ``also``, the main text and its length in characters."""
    return _map.measured(pages, id_col, html_col, "text string, n_chars long", _extracted, also=also)
