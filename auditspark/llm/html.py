"""Main text of web pages by scores on the element tree.

Blocks of text give points for their length and commas to their parent, half of
them to the grandparent and less to those above.  A container's points are
discounted by the share of its text that stands in links.  The container with
most points is the article; siblings that score well beside it, or that are
plain paragraphs, lists or headings without links, are kept with it.  Elements that never hold article text
(menus, footers, forms, scripts, adverts, comments, ...) are set aside by their
tag, role or class before scoring.

White space inside a block becomes one blank, blocks are joined by one blank in
page order.  Null and empty pages, and pages without text, give the empty text.
Broken markup is read as it comes: end tags without a start are skipped, a tag
cut off by the end of the page is dropped.  Pages with equal or no id are read
one by one; an empty table gives no row.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import empty_if_null

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes template xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ASIDE_TAGS = frozenset(
    "head nav footer aside form script style noscript template iframe svg canvas object embed button select textarea "
    "dialog menu title audio video map math datalist".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion sidebar comment comments disqus footer menu "
    "nav navbar navigation breadcrumb breadcrumbs cookie cookies consent share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup popup modal overlay paywall pagination pager login respond replies skip".split()
)
ASIDE_UNLESS_TEXT = frozenset("header banner notice notices alert warning disclaimer legal copyright widget toolbar search tools meta".split())
#: A class name with one of these parts tells a state of the page, not what the element is.
STATE_NAMES = frozenset("has have with without no not is open closed enabled disabled on off layout".split())
TEXT_NAMES = frozenset("article content main story entry post text".split())
ROOTS = frozenset(("html", "body", "main", "article"))
#: Blocks that are kept beside the best container, however short, if they hold no link.
PLAIN = frozenset("p ul ol dl blockquote pre h1 h2 h3 h4 h5 h6".split())
# A block start ends an open paragraph, an item ends the item before it.
ENDS_BEFORE = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
               "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
               "option": ("option", ("select",))}

# No quantifier gives back what it took, so a page is read in time proportional to its length.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"(?<![^\s=/\"'>])([^\s=/\"'>]++)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++)")
NAME = re.compile(r"[A-Za-z]+")


class Page:
    """The element tree of a page: parent, tag and set-aside mark of each node, and
    its stretches of text in order, each with its block and its enclosing link."""

    def __init__(self, source: str):
        self.parent, self.tag, self.aside, self.block, self.link, self.named = [-1], ["#"], [False], [0], [False], [False]
        self.in_text = [False]  # whether a node is or lies in an article or main
        self.open: Counter[str] = Counter()  # tags of the open elements
        self.pieces: list[tuple[int, int, str]] = []  # node, number of its block's turn, text
        self.turn = 0
        stack, at = [0], 0
        for m in TOKEN.finditer(source):
            if m.start() < at:
                continue
            self._text(stack[-1], source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                self._close(stack, name)
                continue
            self._open(stack, name, m[3] or m[6] or "")
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
                self._cut(stack, len(stack) - 1)
        rest = source[at:]
        self._text(stack[-1], rest)

    def _text(self, node: int, text: str) -> None:
        if text and not self.aside[node]:
            self.pieces.append((node, self.turn, text))

    def _cut(self, stack: list[int], k: int) -> None:
        self.open.subtract(self.tag[node] for node in stack[k:])
        del stack[k:]

    def _close(self, stack: list[int], name: str) -> None:
        for k in range(len(stack) - 1, 0, -1) if self.open[name] > 0 else ():
            if self.tag[stack[k]] == name:
                self._cut(stack, k)
                break
            if self.tag[stack[k]] in ("table", "article", "body") and name not in BLOCK:
                return
        if name in BLOCK:
            self.turn += 1

    def _open(self, stack: list[int], name: str, attributes: str) -> None:
        if name in BLOCK or name == "br":
            self.turn += 1
        if name in BLOCK and self.open["p"] > 0:
            for k in range(len(stack) - 1, 0, -1):
                open_tag = self.tag[stack[k]]
                if open_tag == "p":
                    self._cut(stack, k)
                    break
                if open_tag in BLOCK:
                    break
        if name in ENDS_BEFORE and any(self.open[t] > 0 for t in ENDS_BEFORE[name][0].split()):
            ended, within = ENDS_BEFORE[name]
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] in ended.split():
                    self._cut(stack, k)
                    break
                if self.tag[stack[k]] in within:
                    break
        up = stack[-1]
        node = len(self.parent)
        aside, named = self._set_aside(up, name, attributes)
        self.parent.append(up)
        self.tag.append(name)
        self.aside.append(self.aside[up] or aside)
        self.block.append(node if name in BLOCK else self.block[up])
        self.link.append(self.link[up] or name == "a")
        self.named.append(named)
        self.in_text.append(self.in_text[up] or name in ("article", "main"))
        if name not in VOID and (name in BLOCK or name in RAW or not attributes.rstrip().endswith("/")):
            stack.append(node)
            self.open[name] += 1

    def _set_aside(self, up: int, name: str, attributes: str) -> tuple[bool, bool]:
        """Whether an element is set aside, and whether it is named as text."""
        if name in ASIDE_TAGS:
            return True, False
        if name == "header" and not self.in_text[up]:
            return True, False
        if not attributes:
            return False, name in ("article", "main")
        found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
        own = found.get("class", "") + " " + found.get("id", "")
        aside_names, others, text_named = self._names(own.lower().split())
        style = found.get("style", "").replace(" ", "").lower()
        bare = {a.lower() for a in ATTRIBUTE.sub(" ", attributes).split()}
        hidden = "display:none" in style or "visibility:hidden" in style or "hidden" in bare or found.get("aria-hidden") == "true"
        texty = text_named or name in ("article", "main")
        if name in ("html", "body", "main"):
            return False, texty
        if name == "article":
            return hidden or bool({"comment", "comments"} & set(own.lower().split())), texty
        aside = (
            hidden or found.get("role", "").lower() in ASIDE_ROLES or (aside_names or others) and not texty
        )
        return aside, texty and not aside_names

    @staticmethod
    def _names(tokens: list[str]) -> tuple[bool, bool, bool]:
        """Whether whole class names or ids say that an element is to be set aside, that
        it is unless it is text, and that it is text.  Of names with several parts those
        that tell a state (``has-sidebar``, ``page-sidebar-left``) say nothing; the others say
        what any of their parts says (``footer-container``, ``sidebar-left``)."""
        aside = others = text = False
        for token in tokens:
            parts = {w for w in NAME.findall(token)}
            if len(parts) > 1 and (parts & STATE_NAMES or "page" in parts and parts & {"left", "right"}):
                continue
            if parts & ASIDE_NAMES:
                aside = True
            elif parts & TEXT_NAMES:
                text = True
            others |= bool(parts & ASIDE_UNLESS_TEXT)
        return aside, others, text

    def main_text(self) -> str:
        pieces = [(n, turn, html.unescape(t)) for n, turn, t in self.pieces]
        inside = self._marked(self._kept(pieces))
        out: list[str] = []
        last = None
        for node, turn, text in pieces:
            if not inside[node]:
                continue
            if turn != last:
                out.append(" ")
                last = turn
            out.append(text)
        return " ".join("".join(out).split())

    def _marked(self, kept: set[int] | None) -> list[bool]:
        """Whether each node is kept or lies in one that is."""
        inside = [kept is None] * len(self.parent)
        for node, up in enumerate(self.parent):  # a parent comes before its children
            inside[node] = inside[node] or node in (kept or ()) or (up >= 0 and inside[up])
        return inside

    def _kept(self, pieces: list[tuple[int, int, str]]) -> set[int] | None:
        """Nodes whose text is the article; None for the whole page."""
        size, linked = Counter(), Counter()
        own: dict[tuple[int, int], list[int]] = {}
        for node, turn, text in pieces:
            n = len(" ".join(text.split()))
            if not n:
                continue
            entry = own.setdefault((self.block[node], turn), [0, 0, 0])
            entry[0] += n
            entry[1] += text.count(",") + text.count("，") + text.count("、")
            entry[2] += n if self.link[node] else 0
            size[node] += n
            linked[node] += n if self.link[node] else 0
        for node in range(len(self.parent) - 1, 0, -1):  # children come after their parent
            size[self.parent[node]] += size[node]
            linked[self.parent[node]] += linked[node]
        points: dict[int, float] = {}
        for (block, _), (n, commas, links) in own.items():
            if n < 25:
                continue
            value = (1 + commas + min(n / 100, 3)) * (1 - links / n)
            up, share = self.parent[block] if block else 0, 1.0
            for level in range(5):
                if up < 0:
                    break
                points[up] = points.get(up, 0) + value * share
                up, share = self.parent[up], 0.5 if level == 0 else 1 / (3 * (level + 1))
        scored = {
            c: (p + (25 if self.named[c] else 0)) * (1 - linked.get(c, 0) / max(size.get(c, 1), 1)) for c, p in points.items()
        }
        for c in range(len(self.tag)):  # short articles give no points
            if c not in scored and self.tag[c] in ("article", "main") and size.get(c):
                scored[c] = 25 * (1 - linked.get(c, 0) / size[c])
        if not scored:
            return None
        best = max(scored, key=lambda c: (scored[c], -c))
        while self.tag[best] not in BLOCK and self.parent[best] > 0:
            best = self.parent[best]
        kept = {best}
        if self.tag[best] in ("html", "body", "#"):
            return kept
        for c in range(1, len(self.tag)):
            if c == best or self.parent[c] != self.parent[best] or self.aside[c] or not size.get(c):
                continue
            density = linked.get(c, 0) / size[c]
            if scored.get(c, 0) >= max(10, 0.2 * scored[best]):
                kept.add(c)
            elif self.tag[c] in PLAIN and not linked.get(c):
                kept.add(c)
            elif self.tag[c] == "p" and (size[c] > 80 and density < 0.25):
                kept.add(c)
        return kept


def main_text(source: str) -> str:
    return Page(source).main_text() if source else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col(id_col).cast("long").alias("p"), F.col(url_col).cast("string").alias("u"), empty_if_null(html_col).alias("h")
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
