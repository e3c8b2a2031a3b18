"""HTML extraction by tree scoring (operator 2).

The page becomes a tree of elements. Every paragraph gives points to its ancestors: one, one more for each comma,
and one for each 100 characters up to three; its parent gets them all, its grandparent half, three more levels a
sixth and less. A container's points are discounted by its link density. The best container (or the article, else
the main element, around it) is kept with its siblings: those of a fifth of its points, long link-poor paragraphs,
headings before it, and all link-poor blocks between the first and the last of these. Where the whole page is best,
only its lists of links are left out. Buttons, menus, drawings and ``noscript`` are content in an article or main element
or a paragraph, and nowhere else.

What is not content (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) is
left out by tag, role, and those words of class and id that say so and nothing else (``site-footer``, but not
``has-sidebar``). A class alone does not take away an element that holds an article or main element, nor does a form
that holds one; nor, on a page without such an element, a class such as ``overlay`` most of the page's text; nor such a
class, which may mean the subject, a paragraph.

Cases: null and empty html give an empty text, as does a page without content. Unclosed elements, cut-off
tags, stray quotes and stray end tags are read as browsers read them, but for a quote that never closes, which ends
with its tag. Time is in proportion to the page, however long or deeply nested. Of equally good containers the first in page order wins. Equal pages are extracted row by row; extra columns are
ignored, and a column with the result's name is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from strideframe.llm.common import table

_BLANK = r"[ \t\n\f\r]"
#: A name, then perhaps a value; a quote that never closes belongs to the name.
_ATTRIBUTE = rf"""(?:{_BLANK}|/)*+[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+(?:{_BLANK}*+={_BLANK}*+(?:"[^"]*+"|'[^']*+'|[^ \t\n\f\r"'>][^ \t\n\f\r>]*+|(?=>)))?+"""
TAG = re.compile(rf"<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)((?:{_ATTRIBUTE})*+)((?:{_BLANK}|/)*+)>")
ATTRIBUTE = re.compile(rf"""(?:{_BLANK}|/)*([^ \t\n\f\r/>][^ \t\n\f\r/>=]*)(?:{_BLANK}*={_BLANK}*("[^"]*"|'[^']*'|[^ \t\n\f\r"'>][^ \t\n\f\r>]*)?)?""")
#: Comments, declarations, instructions and what else a page doesn't show.
HIDDEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)", re.DOTALL)

RAW = {"script", "style", "textarea", "title", "template", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CUT = {"head", "nav", "header", "footer", "aside", "form", "select", "dialog", "video", "audio", "canvas"} | RAW
#: Content in the article alone.
SOFT = {"button", "menu", "svg", "noscript"}
BLOCKS = {
    "p", "div", "section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot",
    "tr", "td", "th", "blockquote", "pre", "address", "center", "body", "html", "fieldset", "details", "summary", "figure", "figcaption", "caption", "hr", "hgroup", "search",
    "header", "footer", "nav", "aside", "form", "menu", "dialog",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
PARAGRAPHS = {"p", "pre", "td", "blockquote", "li", "dd"}
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: Elements among which such a tag looks for what it closes.
FAMILIES = ({"li", "ul", "ol", "menu"}, {"dt", "dd", "dl"}, {"tr", "td", "th", "table"}, {"option", "select"})
FAMILY = {tag: i for i, family in enumerate(FAMILIES) for tag in family}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar", "toolbar"}
#: Words of classes and ids that name what is not content, and words that may stand beside them.
NOT_CONTENT = set(
    "comment comments commentlist disqus reply replies respond discussion ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion promotions banner banners cookie cookies consent gdpr notice notices"
    " popup popups modal overlay newsletter newsletters subscribe signup paywall nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager header footer masthead"
    " sidebar sidebars widget widgets related recommended share sharing social toolbar login search".split()
)
#: Of these, words that also name the wrapping of a whole page.
WRAPPERS = set("overlay modal widget widgets header social share sharing notice notices search".split())
BESIDE = set(
    "site page main global top bottom left right primary secondary mobile desktop side bar box block section area wrap wrapper container inner outer list item items thread form links link"
    " buttons button icons posts articles stories content panel slot unit space holder zone text bar row group tags tools law policy legal sticky floating google dfp the and for of my".split()
)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    __slots__ = ("tag", "parent", "children", "cut", "flag", "scope", "inline", "near", "score", "chars", "linked", "commas", "own")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False, flag: str = ""):
        self.tag, self.parent, self.cut, self.flag, self.children = tag, parent, cut, flag, []
        block = parent is None or tag in BLOCKS
        self.scope: Node = self if block else parent.scope  # the block that an inline end tag can't reach beyond
        self.inline: dict[str, int] | None = {} if block else None  # open inline elements of a block, by name
        self.near: tuple = parent.near if parent is not None else (None,) * len(FAMILIES)  # of each family the element, or the nearest around it
        if tag in FAMILY:
            self.near = (*self.near[: FAMILY[tag]], self, *self.near[FAMILY[tag] + 1 :])
        self.score, self.chars, self.linked, self.commas, self.own = 0.0, 0, 0, 0, 0


def named(value: str) -> str:
    """sure or maybe, if one of the class's tokens names such an element and says nothing else."""
    found = ""
    for token in value.split():
        words: list[str] = []
        for w in WORD.findall(token.lower() if token.isupper() else token):
            joined = words[-1] + w.lower() if words else ""
            words[-1:] = [joined] if joined in NOT_CONTENT else [*words[-1:], w.lower()]  # side-bar is sidebar
        if any(w in NOT_CONTENT for w in words) and all(w in NOT_CONTENT or w in BESIDE or w.isdigit() for w in words):
            if any(w in NOT_CONTENT and w not in WRAPPERS for w in words):
                return "sure"
            found = "maybe"
    return found


def judge_tag(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether the element is no content for sure, and what its class or id says of it."""
    if tag in CUT and tag != "form":
        return True, ""
    flag = "sure" if tag == "form" else "soft" if tag in SOFT else ""
    if not attributes or tag in ("html", "body"):
        return False, flag
    at: dict[str, str] = {}
    for k, v in ATTRIBUTE.findall(attributes):
        at.setdefault(k.lower(), v[1:-1] if v[:1] in "\"'" else v)
    if "hidden" in at or at.get("aria-hidden", "").lower() == "true" or at.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none", at.get("style", ""), re.IGNORECASE):
        return True, ""
    says = {named(at.get(k, "")) for k in ("class", "id")}
    return False, "sure" if "sure" in says else flag or ("maybe" if "maybe" in says else "")


def parse(html: str) -> Node:
    root = node = Node("#root", None)
    at = text_from = 0
    open_: dict[str, int] = {}  # blocks, by name

    def text(end: int) -> None:
        if end > text_from:
            node.children.append(unescape(html[text_from:end]))

    def close(upto: Node) -> Node:
        """Ends ``upto`` and all that is open in it."""
        x = node
        while True:
            if x.scope is not x:
                x.scope.inline[x.tag] -= 1
            else:
                open_[x.tag] -= 1
            if x is upto:
                return x.parent
            x = x.parent

    while True:
        at = html.find("<", at)
        if at < 0:
            break
        m = TAG.match(html, at)
        if m is None:
            hidden = HIDDEN.match(html, at)
            if hidden:
                text(at)
                at = text_from = hidden.end()
            elif re.compile("/?[a-zA-Z]").match(html, at + 1):  # a tag that the page's end cuts off
                text(at)
                return root
            else:
                at += 1
            continue
        text(at)
        at = text_from = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                node.children.append(" ")
            elif tag in BLOCKS:
                if open_.get(tag):
                    up = node
                    while up.tag != tag:
                        up = up.parent
                    node = close(up)
            elif node.scope.inline.get(tag):  # an inline end tag closes no block
                up = node
                while up.tag != tag:
                    up = up.parent
                node = close(up)
            continue
        if tag in VOID:
            if tag == "hr" and node.scope.tag == "p":
                node = close(node.scope)
            node.children.append(Node("hr", node) if tag == "hr" else " " if tag == "br" else "")
            continue
        if tag in BLOCKS and node.scope.tag == "p":  # a block ends an open paragraph, and the formatting inside it
            node = close(node.scope)
        if tag in CLOSES:
            closes, until = CLOSES[tag]
            up = node.near[FAMILY[tag]]
            if up is not None and up.tag in closes:
                node = close(up)
        child = Node(tag, node, *judge_tag(tag, m[3]))
        node.children.append(child)
        if tag in RAW:  # its text is no markup, up to its end tag
            end = re.compile(rf"</{re.escape(tag)}(?=[ \t\n\f\r/>])", re.IGNORECASE).search(html, at)
            stop = html.find(">", end.end()) if end else -1
            at = text_from = stop + 1 if stop >= 0 else len(html)
            continue
        if "/" not in m[4] or tag in BLOCKS or tag in ("a", "b", "i", "span", "em", "strong"):
            if child.scope is not child:
                child.scope.inline[tag] = child.scope.inline.get(tag, 0) + 1
            else:
                open_[tag] = open_.get(tag, 0) + 1
            node = child
    text(len(html))
    return root


def _walk(node: Node) -> Iterator[Node]:
    """Nodes that are not cut, in page order, without recursion."""
    stack = [node]
    while stack:
        x = stack.pop()
        if not x.cut:
            yield x
            stack += [c for c in reversed(x.children) if not isinstance(c, str)]


def _flat(text: str) -> str:
    return " ".join(text.split())


def _measure(root: Node) -> list[Node]:
    """Fills chars, commas and linked of every node that is not cut: of its own text and that below it."""
    nodes = list(_walk(root))
    for x in nodes:
        x.chars = x.linked = x.commas = 0
        for c in x.children:
            if isinstance(c, str):
                x.chars += len(_flat(c))
                x.commas += c.count(",")
        x.own = x.chars
    for x in reversed(nodes):
        if x.tag == "a":
            x.linked = x.chars
        if x.parent is not None:
            x.parent.chars += x.chars
            x.parent.linked += x.linked
            x.parent.commas += x.commas
    return nodes


def _settle(root: Node) -> list[Node]:
    """Cuts what its class says is no content, unless it holds the article; returns what remains, measured."""
    nodes = _measure(root)
    flagged = [x for x in nodes if x.flag]
    if not flagged:
        return nodes
    holds = {id(x) for x in nodes if x.tag in ("article", "main")}
    for x in reversed(nodes):
        if id(x) in holds and x.parent is not None and not (x.tag == "article" and x.flag):
            holds.add(id(x.parent))
    plain = root.chars - root.linked
    within = set()  # of the article or a paragraph
    for x in nodes if any(x.flag == "soft" for x in flagged) else ():
        if x.parent is not None and (id(x.parent) in within or x.parent.tag in ("article", "main") or x.parent.tag in PARAGRAPHS):
            within.add(id(x))
    for x in flagged:
        if x.flag == "soft" or x.flag == "maybe" and x.tag == "p":
            x.cut = x.flag == "soft" and id(x) not in within
            continue
        most = x.flag == "maybe" and not holds and 2 * (x.chars - x.linked) > plain
        inside = id(x) in holds and x.tag not in ("article", "main")
        x.cut = not (most or inside)
    return _measure(root)


def blocks(run: list) -> list[str]:
    """Texts of the blocks in a run of nodes and strings, in page order; a block ends where another begins or ends."""
    out, parts = [], []

    def flush():
        text = _flat("".join(parts))
        parts.clear()
        if text:
            out.append(text)

    stack: list = list(reversed(run))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            parts.append(x)
        elif x.cut:
            if x.tag in BLOCKS:
                flush()
        else:
            if x.tag in BLOCKS:
                flush()
                stack.append(None)
            stack += reversed(x.children)
    flush()
    return out


def _score(nodes: list[Node]) -> list[Node]:
    """Passes each paragraph's points on to its ancestors; returns those with points, in page order."""
    scored = set()
    for x in nodes:
        text = x.own if x.tag in ("div", "section", "article", "main", "center") else 0  # text without a paragraph around it
        if x.tag in PARAGRAPHS and x.chars:
            points, up = 1 + x.commas + min(x.chars / 100, 3), x.parent
        elif text >= 25:
            points, up = 1 + min(text / 100, 3), x
        else:
            continue
        for level in range(5):
            if up is None:
                break
            up.score += points / (level + 1 if level < 2 else 3 * level)
            scored.add(id(up))
            up = up.parent
    for x in nodes:
        x.score *= 1 - x.linked / max(x.chars, 1)
    return [x for x in nodes if id(x) in scored and x.score > 0]


def extract(html: str) -> str:
    root = parse(html)
    nodes = _settle(root)
    candidates = _score(nodes)
    if not candidates:
        return "\n".join(blocks([root]))
    best = max(candidates, key=lambda x: x.score)  # the first of equals, in page order
    for tag in ("article", "main"):  # the page itself says how far the content reaches
        up = best
        while up is not None and up.tag != tag:
            up = up.parent
        if up is not None:
            best = up
            break
    if best.tag in ("#root", "html", "body"):  # of a whole page, lists of links are menus
        inner = next((x for x in nodes if x.tag == "body"), best)
        best = inner if inner.chars == best.chars else best
        return "\n".join(blocks([x for x in best.children if isinstance(x, str) or x.tag in ("p", *HEADINGS) or x.linked < 0.75 * max(x.chars, 1)]))
    around = best.parent.children
    poor = lambda x: x.linked < 0.25 * max(x.chars, 1)
    kept = [i for i, x in enumerate(around) if not isinstance(x, str) and not x.cut and (x is best or (poor(x) and (x.score >= 0.2 * best.score or x.tag == "p" and x.chars > 80)))]
    first, last = kept[0], kept[-1]
    while first and (isinstance(around[first - 1], str) and not around[first - 1].strip() or not isinstance(around[first - 1], str) and around[first - 1].tag in HEADINGS):
        first -= 1
    run = [x for i, x in enumerate(around) if first <= i <= last and (isinstance(x, str) or i in kept or poor(x))]
    return "\n".join(blocks(run))


@pandas_udf(StringType())
def _extract(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield pd.Series([extract(h) if h else "" for h in batch], index=batch.index, dtype=object)


extract_text = _extract.asNondeterministic()


def extract_pages(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each as ``out_col``."""
    return pages.withColumn(out_col, extract_text(F.coalesce(F.col(html_col), F.lit(""))))


def query(spark, sf_dir: str) -> DataFrame:
    out = extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
