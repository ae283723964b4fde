"""HTML extraction by tag-path ratios.

A page is cut into blocks, each with its root-to-leaf path of block elements (element names with their first class). Plain
text, linked text, punctuation and blocks of a path are added up within each element that holds its blocks, and the fullest of these elements stands for the path: a
path that comes back in many sibling subtrees, as the comments of a thread do, weighs as one of them, however many there are. The text ratio (plain characters) and the punctuation ratio
of a path are smoothed with the mean over the paths in its container and fused to their geometric mean, times the share of the text that is not linked. Two
hints of the markup weigh on the fused value, and never decide alone: `article` and `main` raise it, a class or id that
names chrome or comments lowers it, unless the element, alike subtrees taken once, holds half of the page's text (of that in `article` or `main`, if there is any). Both are relative to the page's own best.
The threshold is the split of the page's own values (logarithms, Otsu's), but at most SHARE of the best.

Paths from the threshold on are strong and choose content subtrees: the article around a strong block, or else its container and
the elements around that of whose text strong blocks make up half. A weak block in a subtree is content if strong blocks stand beside it in its
container, or if it is a heading, list item, table cell, caption or the like; outside articles, links in lists of links or in the body are not, nor is what a lowered element holds.
Only elements that HTML itself sets apart (scripts, styles, forms, nav, footer, aside, page header, ARIA landmarks, hidden elements) are cut by name.

Elements are nodes with a pointer to their parent; paths are pairs of a path and a label. So a page takes time in proportion to its length
however deep its elements are nested.
"""

from __future__ import annotations

import html as entities
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element, role and class names of HTML.
BLOCKS = frozenset(("address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"))
SKIPPED = frozenset(("aside", "button", "canvas", "dialog", "footer", "form", "head", "iframe", "input", "label", "menu", "nav", "noscript", "object", "option", "select", "svg", "template", "textarea"))
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "noembed", "noframes", "xmp"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
SHORT = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dt", "dd", "caption", "figcaption", "summary", "blockquote", "pre", "address"))
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PLAIN = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "tr", "td", "th", "dt", "dd"))
NONE, PARAGRAPH = frozenset(), frozenset(("p",))
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar"))
HINTS = frozenset(("ad", "ads", "advert", "banner", "breadcrumbs", "comment", "commentlist", "comments", "consent", "cookie", "cookies", "discussion", "disqus", "menu", "nav", "newsletter", "notice", "pagination", "popup", "promo", "related", "replies", "reply", "respond", "responses", "share", "sidebar", "social", "sponsored", "subscribe", "tags", "thread", "usercomments"))
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"'=]++|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*)|[\"'])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、؛؟]")
#: Most that the threshold may be, as a share of the best path; weights of the hints.
SHARE, RAISED, LOWERED = 0.2, 4.0, 0.25


def attributes_of(text: str) -> dict[str, str]:
    """Names in lower case with their values; the first of a repeated name counts, as in browsers."""
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), double or single or bare)
    return found


def set_apart(tag: str, attributes: dict[str, str], in_main: bool) -> bool:
    """Whether HTML itself says that an element is not part of the main text."""
    if tag in SKIPPED or (tag == "header" and not in_main):
        return True
    return attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(UNSEEN.search(attributes.get("style", "")))


def hinted(tag: str, attributes: dict[str, str]) -> bool:
    words = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()
    return tag not in ("html", "body", "article", "main") and not HINTS.isdisjoint(re.split(r"[\s_-]+", words))


class Page:
    """The elements and text blocks of a page. Element 0 is what stands around all; a block is (path, element, text, linked characters)."""

    def __init__(self):
        self.parent, self.tag, self.path, self.named, self.raised, self.article = [-1], [""], [0], [False], [False], [-1]
        self.paths: dict[tuple[int, str], int] = {}
        self.above, self.label = [-1], [""]  # of paths
        self.found: list[tuple[int, int, str, int]] = []

    def element(self, parent: int, tag: str, label: str, named: bool) -> int:
        key = (self.path[parent], label)
        if key not in self.paths:
            self.paths[key] = len(self.above)
            self.above.append(key[0])
            self.label.append(label)
        self.parent.append(parent)
        self.tag.append(tag)
        self.path.append(self.paths[key])
        self.named.append(named)
        self.raised.append(self.raised[parent] or tag in ("article", "main"))
        self.article.append(self.article[parent] if self.article[parent] >= 0 else len(self.tag) - 1 if tag == "article" else -1)
        return len(self.tag) - 1

    def name(self, path: int) -> str:
        """A path as text."""
        labels = []
        while path > 0:
            labels.append(self.label[path])
            path = self.above[path]
        return "/".join(reversed(labels))

    def totals(self, values: list[float]) -> list[float]:
        """Values of elements summed up over their subtrees."""
        out = list(values)
        for k in range(len(out) - 1, 0, -1):  # parents come before their children
            out[self.parent[k]] += out[k]
        return out

    def lowered(self) -> list[bool]:
        """Elements in one that bears a chrome name and does not hold half of the text; of its alike children the fullest counts."""
        n = len(self.tag)
        own, whole = [0] * n, 0
        main = any(self.raised[k] for _, k, _, _ in self.found)
        for _, k, text, _ in self.found:
            if self.raised[k] or not main:
                own[k] += len(text)
                whole += len(text)
        best: list[dict[int, int]] = [{} for _ in range(n)]
        held = own
        for k in range(n - 1, 0, -1):
            held[k] += sum(best[k].values())
            up, path = self.parent[k], self.path[k]
            if self.tag[k] in PLAIN:  # paragraphs are no repeated subtrees
                best[up][path] = best[up].get(path, 0) + held[k]
            else:
                best[up][path] = max(best[up].get(path, 0), held[k])
        out = [False] * n
        for k in range(1, n):
            out[k] = out[self.parent[k]] or (self.named[k] and 2 * held[k] < whole)
        return out


def blocks(page: str) -> Page:
    """The page's text blocks outside what is set apart, in order, and the elements around them."""
    out = Page()
    # Open elements: tag, set apart, element (of one that is set apart: the one around it).
    stack: list[tuple[str, bool, int]] = []
    opened: dict[str, int] = {}  # of the stack, by tag
    tops: list[int] = []  # places of block elements in the stack
    parts, linked, at, anchors = [], 0, 0, 0

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        if tops and tops[-1] == len(stack):
            tops.pop()
        return tag

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text and not (stack and stack[-1][1]):
            k = stack[-1][2] if stack else 0
            out.found.append((out.path[k], k, text, min(linked, len(text))))
        parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        parts.append(text)
        linked += len(text) if anchors else 0

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            say(m[1])
        if not m[3]:
            continue
        tag, closing = m[3].lower(), bool(m[2])
        if tag == "br":
            parts.append("\n")
        if tag == "a":
            anchors = 0 if closing else 1
        if closing:
            if opened.get(tag):
                if tag in BLOCKS:
                    flush()
                while stack and (t := stack[-1][0]) != tag:
                    if t in BLOCKS and tag not in BLOCKS:
                        break
                    pop()
                if stack and stack[-1][0] == tag:
                    pop()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in BLOCKS or tag in SKIPPED:
            flush()
            ends = CLOSES.get(tag, NONE) | (PARAGRAPH if tag in BLOCKS else NONE)
            if tops and stack[tops[-1]][0] in ends:
                keep = tops[-1]
                while len(stack) > keep:
                    pop()
            elif stack and stack[-1][0] in ends:
                pop()
        if tag not in VOID and not m[4].rstrip().endswith("/"):
            attributes = attributes_of(m[4]) if m[4] else {}
            around = stack[-1][2] if stack else 0
            apart = bool(stack and stack[-1][1]) or set_apart(tag, attributes, out.raised[around])
            if apart or tag in BLOCKS:
                first = attributes.get("class", "").split()[:1]
                k = around if apart else out.element(around, tag, ".".join([tag, *first]), hinted(tag, attributes))
                if tag in BLOCKS:
                    tops.append(len(stack))
                stack.append((tag, apart, k))
                opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


def ratios(page: Page, hints: bool = True, lowered: list[bool] | None = None) -> dict[str, float]:
    """The fused value of every path, by its name."""
    return {page.name(p): v for p, v in fused(page, (page.lowered() if lowered is None else lowered) if hints else None).items()}


def fused(page: Page, lowered: list[bool] | None) -> dict[int, float]:
    """The fused value of every path. Sums are those of the element that holds most plain text in blocks of the path."""
    per: dict[tuple[int, int], list[float]] = {}
    weight: dict[int, float] = {}
    for path, k, text, linked in page.found:
        own = per.setdefault((path, page.parent[k]), [0.0, 0.0, 0.0])
        own[0] += len(text) - linked
        own[1] += len(PUNCTUATION.findall(text)) + 1
        own[2] += linked
        weight[path] = max(weight.get(path, 0.0), (RAISED if page.raised[k] else 1.0) * (LOWERED if lowered and lowered[k] else 1.0))
    paths: dict[int, list[float]] = {}
    for (path, _), own in per.items():
        if path not in paths or (own[0], own[1]) > (paths[path][0], paths[path][1]):
            paths[path] = own
    inside: dict[int, list[int]] = {}
    for path in paths:
        inside.setdefault(page.above[path], []).append(path)
    out = {}
    for members in inside.values():
        text = sum(paths[p][0] for p in members) / len(members)
        marks = sum(paths[p][1] for p in members) / len(members)
        for p in members:
            plain = paths[p][0] / max(1.0, paths[p][0] + paths[p][2])
            out[p] = weight[p] * plain * math.sqrt((paths[p][0] + text) / 2 * (paths[p][1] + marks) / 2)
    return out


def threshold(values: list[float]) -> float:
    """Otsu's split of the logarithms of a page's values, at most SHARE of the best."""
    logs = sorted(math.log1p(v) for v in values)
    best, cut, below = -1.0, logs[0], 0.0
    whole = sum(logs)
    for k in range(1, len(logs)):
        below += logs[k - 1]
        if logs[k] > logs[k - 1]:
            apart = k * (len(logs) - k) * (below / k - (whole - below) / (len(logs) - k)) ** 2
            if apart > best:
                best, cut = apart, logs[k]
    return min(math.expm1(cut), SHARE * max(values))


def subtrees(page: Page, strong: set[int]) -> set[int]:
    """Elements that are content as a whole, chosen by the blocks on strong paths."""
    n = len(page.tag)
    text, good = [0.0] * n, [0.0] * n
    for path, k, said, _ in page.found:
        text[k] += len(said)
        good[k] += len(said) if path in strong else 0
    text, good = page.totals(text), page.totals(good)
    chosen: set[int] = set()
    passed = [3] * n  # the fewest steps, up to 2, after which an element has been passed: from there nothing new is found
    for path, k, _, _ in page.found:
        if path not in strong:
            continue
        if page.article[k] >= 0:
            chosen.add(page.article[k])
            continue
        up = 0
        while k > 0 and passed[k] > up and not (up > 1 and 2 * good[k] < text[k]):
            passed[k] = up
            chosen.add(k)
            k, up = page.parent[k], min(up + 1, 2)
    return chosen


def main_blocks(source: str, hints: bool = True) -> list[tuple[str, bool]]:
    """Text of every block outside what is set apart, in page order, and whether it is content."""
    page = blocks(source)
    if not page.found:
        return []
    lowered = page.lowered() if hints else [False] * len(page.tag)
    values = fused(page, lowered)
    least = threshold(list(values.values()))
    strong = {p for p, v in values.items() if v >= least}
    beside = {page.above[p] for p in strong}
    chosen = subtrees(page, strong)
    n = len(page.tag)
    linked, text, held, article = [0.0] * n, [0.0] * n, [False] * n, [False] * n
    for _, k, said, links in page.found:
        text[k] += len(said)
        linked[k] += links
    text, linked = page.totals(text), page.totals(linked)
    for k in range(1, n):
        held[k] = held[page.parent[k]] or k in chosen
        article[k] = article[page.parent[k]] or (k in chosen and page.tag[k] == "article")

    def kept(path: int, k: int, said: str, links: int) -> bool:
        if path in strong and 2 * links < len(said):
            return True
        if not held[k] or (lowered[k] and path not in strong) or not (path in strong or page.above[path] in beside or page.tag[k] in SHORT or 2 * links >= len(said)):
            return False
        if article[k] or 2 * links < len(said):
            return True
        up = page.parent[k] if page.parent[k] > 0 else k
        return page.tag[up] != "body" and 2 * linked[up] < text[up]

    return [(said, kept(path, k, said, links)) for path, k, said, links in page.found]


def main_text(source: str, hints: bool = True) -> str:
    return "\n".join(text for text, kept in main_blocks(source, hints) if kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row. Null or empty html, or a page without content, gives an empty text;
    rows that repeat a page are extracted each, very long pages whole; an empty table gives an empty result. Other columns of the
    input, whatever their names, are not read."""
    @F.pandas_udf("string")
    def extract(html: pd.Series) -> pd.Series:
        return html.map(lambda page: main_text(page) if page else "")

    return pages.select("page_id", "url", extract(F.col("html").cast("string")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
