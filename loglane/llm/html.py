"""Main text of web pages by composite text density.

Each page is read into a tree. Elements that are never article text (scripts, forms, menus, adverts and the like, by tag,
role or class) are set aside. Every other node gets its composite density: characters per tag, adjusted by how much
of it is links and by the page's own share of links. The subtree with the largest sum of its children's densities
is selected. The least density on its path from the body is the threshold: branches off that path with a node that
reaches it belong to the text as well. A selection inside an ``article`` or ``main`` element takes that element.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglane.llm.shared import TEXT_ROWS, arrow_rows, in_batches, slices, texts_of

TAG = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>?""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed values of HTML: elements without content, with raw content, that begin a block, and that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCKS - frozenset("body caption html legend tbody td tfoot th thead tr".split())
# Siblings that end each other without an end tag, and the elements that fence them in.
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("ul ol dl table tbody thead tfoot tr td th article section div main body html aside nav form blockquote".split())

# Fixed values of this extractor: elements, roles and class words that are not article text, and words that are.
ASIDE_TAGS = frozenset(
    "head title script style noscript template iframe svg annotation annotation-xml canvas object embed nav footer aside form button select textarea "
    "input option datalist dialog menu audio video noembed noframes".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo "
    "promoted recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar "
    "widget widgets".split()
)
TEXT_WORDS = frozenset("article articles body content entry main post story text".split())
HOMES = ("article", "main")


def _set_aside(name: str, attributes: str, in_home: bool) -> bool:
    if name in ASIDE_TAGS:
        return True
    if name == "header" and not in_home:
        return True
    if not attributes or name in ("html", "body", *HOMES):
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key == "role" and value.lower() in ASIDE_ROLES:
            return True
        if key in ("class", "id"):
            words = {w.lower() for w in PARTS.findall(value)}
            # Inside the article, "header" is its own heading.
            if words & (ASIDE_WORDS - {"header"} if in_home else ASIDE_WORDS) and not words & TEXT_WORDS:
                return True
    return False


class Page:
    """The tree of a page as lists by node: parents come before children."""

    def __init__(self, html: str):
        self.names, self.parents, self.aside, self.homes = ["#root"], [-1], [False], [False]
        # Pieces of text in page order with their node; None ends a block.
        self.pieces: list[tuple[int, str] | None] = []
        # How many elements of each name are open, so that no end is looked for in vain.
        self.open: defaultdict[str, int] = defaultdict(int)
        self._read(html)

    def _read(self, html: str) -> None:
        names, stack, at = self.names, [0], 0
        while at < len(html):
            m = TAG.search(html, at)
            begin = m.start() if m else len(html)
            if begin > at:
                self._text(stack[-1], html[at:begin])
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                self._close(stack, name)
                continue
            if name in ENDS_P:
                self._end(stack, {"p"}, FENCES)
            if name in ENDS_SAME:
                self._end(stack, ENDS_SAME[name], FENCES - ENDS_SAME[name])
            if name == "body" and "body" in names:
                continue
            node, parent = len(names), stack[-1]
            names.append(name)
            self.parents.append(parent)
            home = self.homes[parent] or name in HOMES
            self.homes.append(home)
            self.aside.append(self.aside[parent] or _set_aside(name, m[3], home))
            if name in BLOCKS:
                self.pieces.append(None)
            elif name == "br":
                self.pieces.append((parent, " "))
            if name in VOID or m[3].endswith("/") and name in ("svg", "path", "math"):
                continue
            if name in RAW:
                end = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            stack.append(node)
            self.open[name] += 1

    def _cut(self, stack: list[int], k: int) -> None:
        for i in stack[k:]:
            self.open[self.names[i]] -= 1
        del stack[k:]

    def _end(self, stack: list[int], names: set[str], fences: frozenset) -> None:
        """Close the nearest open element of these names, unless a fence is nearer."""
        if not any(map(self.open.get, names)):
            return
        for k in range(len(stack) - 1, 0, -1):
            name = self.names[stack[k]]
            if name in names:
                self._cut(stack, k)
                self.pieces.append(None)
                return
            if name in fences:
                return

    def _close(self, stack: list[int], name: str) -> None:
        if name in ("body", "html"):
            return  # what follows still belongs to the body
        if name == "br":
            self.pieces.append((stack[-1], " "))
            return
        if not self.open[name]:
            return
        for k in range(len(stack) - 1, 0, -1):
            if self.names[stack[k]] == name:
                self._cut(stack, k)
                if name in BLOCKS:
                    self.pieces.append(None)
                return
            # An inline end tag does not close blocks around it.
            if name not in BLOCKS and self.names[stack[k]] in BLOCKS:
                return

    def _text(self, node: int, raw: str) -> None:
        self.pieces.append((node, unescape(raw) if "&" in raw else raw))

    def selected(self) -> np.ndarray:
        """Which nodes belong to the text."""
        n = len(self.names)
        parents, aside = self.parents, self.aside
        chars, tags, link_chars, link_tags, in_link = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            in_link[i] = in_link[parents[i]] or self.names[i] == "a"
        for piece in self.pieces:
            if piece and not aside[piece[0]]:
                size = sum(map(len, piece[1].split()))
                chars[piece[0]] += size
                if in_link[piece[0]]:
                    link_chars[piece[0]] += size
        for i in range(n - 1, 0, -1):
            if not aside[i]:
                p = parents[i]
                chars[p] += chars[i]
                link_chars[p] += link_chars[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (self.names[i] == "a")
        body = self.names.index("body") if "body" in self.names else 0
        share = link_chars[body] / max(chars[body], 1)
        density, sums = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            if aside[i] or not chars[i]:
                continue
            c, t, lc, lt = chars[i], max(tags[i], 1), max(link_chars[i], 1), max(link_tags[i], 1)
            base = math.log(c / max(c - link_chars[i], 1) * link_chars[i] + share * c + math.e)
            ratio = max(c / lc * (t / lt), 1.0)
            density[i] = c / t * math.log(ratio) / base if ratio > 1 else 0.0
            if i:
                sums[parents[i]] += density[i]
        inside = [False] * n
        inside[body] = True
        for i in range(body + 1, n):
            inside[i] = inside[parents[i]]
        # The first of equal sums; a page with no element of text keeps its body.
        best = max((i for i in range(n) if inside[i] and not aside[i]), key=lambda i: (sums[i], -i), default=body)
        if sums[best] <= 0:
            best = body
        path = [best]
        while path[-1] != body and parents[path[-1]] >= 0:
            path.append(parents[path[-1]])
        home = next((i for i in reversed(path) if self.names[i] in HOMES), None)
        threshold = min(density[i] for i in path)
        keep = np.zeros(n, bool)
        if home is not None:
            keep[home] = True
        else:
            keep[best] = True
            # Branches off the path that hold a node of at least this density; also other sections right below the body.
            peak = list(density)
            for i in range(n - 1, 0, -1):
                peak[parents[i]] = max(peak[parents[i]], peak[i])
            on_path = set(path)
            for i in range(n):
                if i not in on_path and parents[i] in on_path and peak[i] >= threshold > 0:
                    keep[i] = True
        for i in range(1, n):
            keep[i] = (keep[i] or (parents[i] >= 0 and keep[parents[i]])) and not aside[i]
        return keep


def main_text(html: str) -> str:
    """Blocks of the selected text, white space inside each turned into one space, joined by empty lines."""
    page = Page(html)
    keep = page.selected()
    blocks, held = [], []
    for piece in [*page.pieces, None]:
        if piece is None:
            if held and (text := " ".join("".join(held).split())):
                blocks.append(text)
            held = []
        elif keep[piece[0]]:
            held.append(piece[1])
    return "\n\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """``row`` (all columns of ``pages`` but ``html``), ``text``, ``n_chars`` (its code points); one per row.

    A null or empty page, and one without text, gives an empty text. Pages of any length are read whole; broken markup
    is read as far as it goes. No rows give no rows.
    """

    def fn(batch: pa.RecordBatch) -> pa.Table:
        pages = texts_of(batch, "html")
        out = [main_text(h) if h else "" for at, to in slices(pages) for h in pages[at:to].to_pylist()]
        return pa.table({"row": batch.column(0), "text": pa.array(out, pa.string()), "n_chars": pa.array(map(len, out), pa.int64())})

    arrow_rows(pages, TEXT_ROWS)
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != "html"]).alias("row")
    df = pages.select(row, F.col("html").cast("string").alias("html"))
    schema = T.StructType([df.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return df.mapInArrow(in_batches(fn, ""), schema)
