"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into a flat row of text blocks at the tags that start a block. Each block is described by its word count
and link density, those of the blocks before and after it and the words of its siblings, and by the landmarks and class names around it. A decision tree
tells content from boilerplate; it is trained here, on the blocks of a small labelled table of page layouts (`LAYOUTS`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, read, slices

#: Elements whose content is no markup; title, code and hidden text among them.
RAW = frozenset("script style noscript template iframe title textarea select".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: Quotes count only after an equals sign.
REST = re.compile(r"(?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+>")
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|itemprop|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_TAGS = frozenset("nav footer aside form button dialog label legend menu fieldset search".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist status note".split())
#: An item ends where the next one of its list begins.
ITEMS, LISTS = ("li", "dt", "dd", "td", "th"), frozenset("ul ol menu dl table".split())
CONTENT_TAGS = frozenset("article main".split())
CHROME_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disqus dropdown foot footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup privacy promo promoted promotion recommended related reply replies respond responses search share sharing sidebar sidenav signin signup skip skiplink social sponsor sponsored subscribe subscription tags toc toolbar topbar widget widgets".split()
)
FEATURES = ["words", "links", "words before", "links before", "words after", "links after", "chrome", "container", "heading", "page has container", "most words of a sibling", "is paragraph"]


def tokens(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, tag, is end tag, attributes) of the tags, in one pass; comments, declarations and raw elements have the tag "".

    What is not closed ends with the page: comments and raw elements are left out, a tag without > is text. Once a quote is found to be unclosed, tags end at
    the first >.
    """
    at, last, quoted = 0, html.rfind(">"), True
    while True:
        at = html.find("<", at)
        if at < 0 or at > last and not html.startswith("<!--", at):
            return
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = len(html) if end < 0 else end + 3
            yield at, end, "", False, ""
            at = end
            continue
        ends = html.startswith("/", at + 1)
        name = NAME.match(html, at + 1 + ends)
        if not name:
            if html[at + 1 : at + 2] in ("!", "?", "/"):
                end = html.find(">", at) + 1
                yield at, end, "", False, ""
                at = end
            else:
                at += 1
            continue
        rest = REST.match(html, name.end()) if quoted else None
        if rest:
            end = rest.end()
        else:
            quoted = False
            end = html.find(">", name.end()) + 1
        tag = name[0].lower()
        if tag in RAW and not ends:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, end)
            end = close.end() if close else len(html)
            yield at, end, "", False, ""
        else:
            yield at, end, tag, ends, html[name.end() : end - 1]
        at = end


def _attributes(attrs: str, inside: bool) -> tuple[bool, bool, bool]:
    """(is chrome by role or visibility, is chrome by a class or id, is the content's container)."""
    chrome = named = content = False
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).strip()
        if name == "role":
            chrome |= value.lower() in CHROME_ROLES
            content |= value.lower() in ("main", "article")
        elif name == "itemprop":
            content |= value.lower() == "articlebody"
        elif name == "hidden":
            chrome = True
        elif name == "aria-hidden":
            chrome |= value.lower() == "true"
        elif name == "style":
            chrome |= re.search(r"display\s*:\s*none", value, re.I) is not None
        else:
            for one in value.split():
                parts = WORD.findall(one)
                for part in (parts[0].lower(), parts[-1].lower()) if parts else ():
                    # the header of an article is its title
                    named |= part in CHROME_WORDS and not (inside and part == "header")
    return chrome, named, content


class Block:
    """A flat text block: its text, words, words in links, and what is around it."""

    __slots__ = ("text", "words", "linked", "strong", "hint", "container", "heading", "parent", "paragraph", "chrome")

    def __init__(self, text: str, words: int, linked: int, strong: bool, hint: int, container: bool, heading: int, parent: int, paragraph: bool):
        self.text, self.words, self.linked, self.strong, self.hint, self.container, self.heading, self.parent, self.paragraph = text, words, linked, strong, hint, container, heading, parent, paragraph
        self.chrome = strong or hint >= 0


def _wide_hints(page: list[Block], above: list[int]) -> None:
    """A class name around most of a page, its title included, or around all that it has, says nothing about the blocks in it."""
    if not above:
        return
    words, title, n = [0] * len(above), [False] * len(above), len(above)
    total = free = 0
    for b in page:
        if b.strong:
            continue
        total += b.words
        if b.hint < 0:
            free += b.words
        else:
            words[b.hint] += b.words
            title[b.hint] |= b.heading == 1
    for k in range(n - 1, -1, -1):
        if above[k] >= 0:
            words[above[k]] += words[k]
            title[above[k]] |= title[k]
    says = []
    for k in range(n):
        wide = 2 * words[k] > total and (title[k] or not free)
        says.append(not wide or above[k] >= 0 and says[above[k]])
    for b in page:
        b.chrome = b.strong or b.hint >= 0 and says[b.hint]


def blocks(html: str) -> list[Block]:
    """A page's text blocks, in order."""
    out: list[Block] = []
    stack: list = []  # (tag, and what held before it: chrome, hint, container, link, parent)
    opened: dict[str, int] = {}
    above: list[int] = []  # of each element with a chrome name, the one around it
    items: list[int] = [-1]  # of each open list, the depth of its open item
    chrome = container = link = False
    hint = -1
    parent = parents = 0
    parts: list[str] = []
    linked = heading = 0
    paragraph = False
    state: tuple = (False, -1, False, 0)

    def close() -> None:
        nonlocal linked
        if parts:
            words = "".join(parts).split()
            if words:
                out.append(Block(" ".join(words), len(words), min(linked, len(words)), *state[:3], heading, state[3], paragraph))
            parts.clear()
        linked = 0

    def pop(tag: str) -> None:
        nonlocal chrome, hint, container, link, parent
        while stack:
            name, chrome, hint, container, link, parent = stack.pop()
            opened[name] -= 1
            if name in LISTS and len(items) > 1:
                items.pop()
            elif items[-1] == len(stack):
                items[-1] = -1
            if name == tag:
                return

    def text(piece: str) -> None:
        nonlocal linked, state
        if not piece:
            return
        if "&" in piece:
            piece = unescape(piece)
        if not parts:
            if piece.isspace():
                return
            state = (chrome, hint, container, parent)
        elif chrome and not state[0] or hint >= 0 and hint != state[1]:  # a notice within a line
            return
        parts.append(piece)
        if link:
            linked += len(piece.split())

    last = 0
    for at, end, tag, ends, attrs in tokens(html):
        if at > last:
            text(html[last:at])
        last = end
        if not tag:
            continue
        block = tag in BLOCKS
        if block:
            close()
            heading = int(tag[1]) if not ends and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else 0
            paragraph = not ends and tag == "p"
            if not ends and opened.get("p") and stack[-1][0] == "p":
                pop("p")
            if not ends and tag in ITEMS and items[-1] >= 0:
                while len(stack) > items[-1] >= 0:
                    pop(stack[-1][0])
        elif tag == "br":
            if parts:
                parts.append(" ")
            continue
        if ends:
            if opened.get(tag):
                pop(tag)
            continue
        if tag in VOID or tag == "svg" and attrs.endswith("/"):
            continue
        strong, named, body = _attributes(attrs, container) if "=" in attrs or "hidden" in attrs else (False, False, False)
        if tag in ("html", "body"):
            strong = named = False
        content = tag in CONTENT_TAGS or body
        if block and tag not in ("p", "tr", "option", *ITEMS) or strong or named or tag in ("a", "span", "svg") or tag in CHROME_TAGS:
            if tag == "a" and opened.get("a"):
                pop("a")
            if tag in ITEMS:
                items[-1] = len(stack)
            stack.append((tag, chrome, hint, container, link, parent))
            opened[tag] = opened.get(tag, 0) + 1
            if tag in LISTS:
                items.append(-1)
            if block:
                parents += 1
                parent = parents
            if content:
                container = True
                hint = -1
                chrome = chrome and any(opened.get(t) for t in CHROME_TAGS)
            elif strong or tag in CHROME_TAGS or tag == "svg" or tag == "header" and not container:
                chrome = True
            elif named:
                above.append(hint)
                hint = len(above) - 1
            link = link or tag == "a"
    if last < len(html):
        text(html[last:])
    close()
    _wide_hints(out, above)
    return out


def features(page: list[Block]) -> np.ndarray:
    n = len(page)
    x = np.zeros((n, len(FEATURES)))
    if n:
        words = np.array([b.words for b in page], float)
        share = np.array([b.linked for b in page], float) / words
        x[:, 0], x[:, 1] = words, share
        x[1:, 2], x[1:, 3] = words[:-1], share[:-1]
        x[:-1, 4], x[:-1, 5] = words[1:], share[1:]
        x[:, 6:9] = [[b.chrome, b.container, b.heading > 0] for b in page]
        x[:, 9] = x[:, 7].any()
        most: dict[int, int] = {}
        for b in page:
            if not b.chrome:
                most[b.parent] = max(most.get(b.parent, 0), b.words - b.linked)
        x[:, 10] = [most.get(b.parent, 0) for b in page]
        x[:, 11] = [b.paragraph for b in page]
    return x


class Tree:
    """A binary decision tree by Gini impurity; nodes are (feature, threshold, left, right, value) arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2):
        self.nodes: list[list[float]] = []
        self._grow(x, y, depth, least)
        self.table = np.array(self.nodes)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        me = len(self.nodes)
        self.nodes.append([-1, 0, 0, 0, float(y.mean())])
        if depth == 0 or y.min() == y.max():
            return me
        best = (2 * y.mean() * (1 - y.mean()) * len(y) - 1e-9, None, None)
        for f in range(x.shape[1]):
            cuts = np.unique(x[:, f])
            for cut in (cuts[1:] + cuts[:-1]) / 2:
                a = x[:, f] <= cut
                n = a.sum()
                if min(n, len(y) - n) < least:
                    continue
                p, q = y[a].mean(), y[~a].mean()
                cost = 2 * p * (1 - p) * n + 2 * q * (1 - q) * (len(y) - n)
                if cost < best[0] - 1e-12:
                    best = (cost, f, cut)
        if best[1] is None:
            return me
        a = x[:, best[1]] <= best[2]
        left, right = self._grow(x[a], y[a], depth - 1, least), self._grow(x[~a], y[~a], depth - 1, least)
        self.nodes[me][:4] = [best[1], best[2], left, right]
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        while True:
            f = self.table[at, 0].astype(int)
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return self.table[at, 4] >= 0.5
            row = self.table[at[inner]]
            at[inner] = np.where(x[inner, f[inner]] <= row[:, 1], row[:, 2], row[:, 3]).astype(int)


#: The labelled table: page layouts in which +n stands for n words of content and -n for n words of boilerplate.
LAYOUTS = [
    "<nav><ul><li><a>-1</a></li><li><a>-1</a></li><li><a>-2</a></li></ul></nav><div class=ad>-8</div><article><h1>+6</h1><p>+30</p><p>+1</p><p>+80</p><p>+3</p></article><footer>-7</footer>",
    "<nav><a>-1</a> <a>-1</a></nav><div class=advert>-14</div><article><h1>+4</h1><p>+5</p></article><footer>-12</footer>",
    "<header><div>-3</div><p>-9</p></header><main><h1>+7</h1><p>+60</p><h2>+3</h2><p>+45</p><ul><li>+4</li><li>+9</li><li>+2</li></ul></main><aside><h3>-2</h3><p>-25</p><ul><li><a>-6</a></li><li><a>-7</a></li></ul></aside><footer><a>-1</a> -5</footer>",
    "<div class=cookie-notice>-30<button>-1</button></div><header><a>-2</a></header><article><h1>+8</h1><p>+25</p><p>+2 <a>+3</a> +20</p><blockquote>+15</blockquote><p>+1</p></article><section id=comments><h2>-1</h2><p>-20</p><p>-35</p><p>-3</p></section><footer>-4</footer>",
    "<article><h1>+5</h1><p>+12</p><aside>-18</aside><p>+33</p><div class=share><a>-1</a><a>-1</a></div><p>+9</p><form>-5<label>-2</label></form><p>+2</p></article><div class=related><h3>-2</h3><ul><li><a>-8</a></li><li><a>-5</a></li></ul></div>",
    "<div id=menu><a>-1</a><a>-1</a><a>-1</a></div><div id=content><h1>+6</h1><p>+50</p><p>+41</p><p>+8</p><p>+60</p></div><div id=footer>-10</div>",
    "<div><a>-1</a> <a>-1</a> <a>-2</a></div><div><h1>+5</h1><p>+44</p><p>+28</p><p>+12</p><p>+39</p></div><div>-4</div>",
    "<ul><li><a>-2</a></li><li><a>-1</a></li><li><a>-3</a></li></ul><h2>+4</h2><p>+70</p><p>+22</p><p>+31</p><p>+18 <a>+2</a></p><ul><li><a>-4</a></li><li><a>-6</a></li></ul><p>-3</p>",
    "<table><tr><td><a>-1</a></td><td><a>-1</a></td></tr></table><h1>+3</h1><p>+90</p><p>+15</p><p>+27</p><table><tr><td>-2</td><td><a>-2</a></td></tr></table>",
    "<div class=sidebar><h4>-1</h4><p>-30</p><p>-22</p></div><div><h1>+9</h1><p>+35</p><p>+48</p></div><div class=newsletter><p>-16</p><form>-3</form></div>",
    "<p>+25</p><p>+60</p><p>+14</p>",
    "<main><article><h1>+3</h1><p>+8 <a>+2</a></p><p>+1</p><aside>-3</aside><ul><li>+1</li><li>+1</li></ul><div class=ad-slot>-2</div><form>-1</form><p>+14</p></article></main><section class=comments><p>-15</p><p>-4</p></section>",
    "<article><p>+9</p><nav><a>-1</a><a>-2</a></nav><p>+22</p><div class=promo><p>-12</p><p>-30</p></div><ol><li>+5</li><li class=ad>-1</li><li>+2</li></ol><aside><p>-40</p><p>-3</p></aside><p>+2</p><footer>-6</footer></article>",
    "<article><h1>+6</h1><div class=byline>-4</div><p>+35</p><figure><figcaption>+5</figcaption></figure><p>+1</p><div class=newsletter><h3>-3</h3><p>-9</p><form>-2<button>-1</button></form></div><p>+11</p><h2>+2</h2><p>+3</p></article><div id=comments><p>-50</p><p>-2</p><p>-18</p></div>",
    "<div role=main><h1>+4</h1><p>+2</p><aside role=complementary><p>-22</p></aside><p>+44</p><div hidden>-10</div><div>+7</div><div class=share>-2 <a>-1</a></div></div><div class=comments><p>-9</p><p>-31</p></div><footer><p>-20</p></footer>",
    "<main><div><p>+3</p></div><div><p>+1</p></div><div class=advert>-1</div><div><p>+2</p></div><ul><li>+1</li><li>+4</li></ul><div class=widget>-7</div></main>",
    "<article>+5<div class=ad>-6</div>+12<aside>-1</aside>+1</article>",
    "<article><header class=entry-header><h1>+3</h1><h2>+5</h2></header><p>+20</p><ul><li>+2<ul><li>+1</li><li>+2</li></ul></li></ul><table><tr><td>+1</td><td>+2</td></tr><tr><td>+1</td><td>+1</td></tr></table></article>",
    "<div class=cookie>-12</div><div><h1>+4</h1><p>+30</p><div class=ad>-9</div><p>+2</p><p>+24</p></div><div class=comments><p>-28</p><p>-33</p></div><div class=footer><p>-14</p></div>",
    "<div><a>-1</a> <a>-2</a></div><div><h1>+5</h1><p>+40</p><p>+2</p><p>+31</p><p>+1</p></div><div>-4</div>",
    "<ul><li><a>-1</a></li><li><a>-2</a></li></ul><div><h1>+3</h1><p>+2</p><p>+55</p><p>+1</p><p>+1</p></div><p>-3</p><p>-5 <a>-1</a></p>",
    "<div><span>-2</span></div><section><h2>+4</h2><p>+18</p><p>+3</p><p>+26</p><p>+2</p></section><section><h3>-2</h3><ul><li><a>-5</a></li><li><a>-6</a></li></ul></section><div>-9</div>",
    "<div>-2 <a>-1</a></div><div><h1>+7</h1><h2>+2</h2><p>+21</p><ul><li>+3</li><li>+1</li></ul><p>+64</p><p>+4</p></div><div><p><a>-2</a> <a>-1</a></p></div>",
    "<h1>+3</h1><p>+20</p><p>+4</p><p>+33</p>",
    "<div role=banner>-4</div><div role=main><h1>+2</h1><p>+6</p><p>+18</p></div><div role=contentinfo>-15</div>",
    "<div><a>-3</a></div><p>+16</p><div><a>-5</a></div><div><a>-2</a> -1</div>",
    "<main><p>+1</p><p>+1</p><p><a>+4</a></p><p>+2</p></main>",
    "<article><p><a>+1</a></p><p>+10</p><p><a>+3</a> <a>+2</a></p></article>",
    "<div>-1</div><div><a>-1</a></div><div>-2</div><div><p>+30</p><p>+24</p></div><div>-2</div><div><a>-1</a></div>",
]


def _spelled(layout: str) -> str:
    return re.sub(r"([+-])(\d+)", lambda m: ("content " if m[1] == "+" else "other ") * int(m[2]), layout)


@lru_cache(maxsize=1)
def tree() -> Tree:
    pages = [blocks(_spelled(x)) for x in LAYOUTS]
    x = np.concatenate([features(p) for p in pages])
    y = np.array([b.text.startswith("content") for p in pages for b in p], float)
    return Tree(x, y)


def main_text(pages: DataFrame, html_col: str = "html") -> tuple[DataFrame, str]:
    """`pages` with one more string column, whose name is returned."""
    from pyspark.sql import types as T

    name = "text"
    while name in pages.columns:
        name += "_"
    at, model = pages.columns.index(html_col), tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, at):
                cut = [blocks(t.decode()) if t else [] for t in as_bytes(b.column(at))]
                keep = iter(model.predict(np.concatenate([features(p) for p in cut])).tolist())
                text = ["\n\n".join(x.text for x in p if next(keep)) for p in cut]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*b.schema.names, name])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(name, T.StringType())])), name


def extracted(pages: DataFrame) -> DataFrame:
    """One row for each row of `pages`: page_id, url, text, n_chars.

    A null or empty html, and a page without content, give an empty text. Repeated rows and null ids keep their rows;
    other columns are ignored. Unclosed tags, comments and scripts end with the page. An empty table gives no rows.
    """
    out, name = main_text(pages.select("page_id", "url", F.col("html").cast("string").alias("html")))
    return out.select("page_id", "url", F.col(name).alias("text"), F.length(name).cast("long").alias("n_chars"))


def op9_maintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read(spark, sf_dir, "pages"))
