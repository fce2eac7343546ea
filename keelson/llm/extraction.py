"""Main text of HTML pages by minimum-cut labelling.

A page becomes its blocks of text (runs of inline content between block-level tags) with the elements around them. Each block gets an integer
cost: evidence from landmarks (semantic elements, roles, words of class and id), and, as far as landmarks are silent, the log odds of
a classifier over the block's shape. Costs are the terminal capacities of a graph; its smoothness edges join neighbouring blocks (stronger the closer
they are in the tree) and, through one node per container, the blocks of a container. The maximum flow (``mincut.label``) separates
content from boilerplate. A landmark outweighs all edges of a block together, so smoothness decides only where markup does not speak.

The classifier is a logistic regression trained in numpy on blocks whose landmarks speak, of at most ``sample_pages`` pages in the order of
the hash of their id and url, at most ``PAGE_BLOCKS`` blocks each spread over the page. Where that sample lacks one of the classes, ``PRIOR`` stands in.

Defined cases: a null html is empty; a page without landmarks of which the cut keeps nothing keeps all its blocks that are more than links; scripts, styles and other unrendered elements never count; ``<br>`` is white space; white space is Unicode's; a
page without markup is one block; unclosed and stray tags are allowed; an unterminated comment or tag runs to the end. Pages are independent rows, ids may repeat or be null,
and extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import scratch_table, string_array
from keelson.llm.mincut import label

# Fixed values of HTML: elements by role.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong "
                   "sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg canvas object textarea select button title noframes noembed datalist audio video".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
LISTS = frozenset("ul ol dl table menu".split())    # an implied end does not pass these
# Fixed words that pages use in class, id and role.
COMMENTS = frozenset("comment comments commentlist commentary disqus reply replies respond".split())
SIDE = frozenset("""
    nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar tabs skip
    sidebar aside rail widget widgets related recommended recommendations recommendation trending popular complementary
    footer contentinfo copyright colophon legal disclaimer masthead topbar banner
    ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion promoted taboola outbrain
    cookie cookies consent gdpr notice notices popup modal overlay alert toast dialog paywall
    form login signin signup register newsletter subscribe subscription search searchbox searchform captcha
    share sharing social follow""".split())
BODY = frozenset("article post entry story main".split())
BODY_PART = frozenset("content body text main article".split())

HARD, SOFT, SILENT, WEAK, BODYLIKE, MAIN, ARTICLE = range(7)
#: cost of a block by the innermost landmark around it; positive: content
EVIDENCE = {HARD: -60, SOFT: -40, SILENT: 3, WEAK: 12, BODYLIKE: 34, MAIN: 34, ARTICLE: 44}
OUTSIDE = -12                                       # silent blocks of a page that has an article or a main part
SHAPE_MOST = 15                                     # bound on the classifier's part
BESIDE, CONTAINER = 8, 3                            # capacities of the smoothness edges
SAMPLE_PAGES, PAGE_BLOCKS = 500, 200
FEATURES = 6
#: log odds where no labelled blocks exist: long texts with sentences are content, link lists are not
PRIOR = np.array([-1.5, 0.9, -4.0, 1.0, 2.0, -2.0])

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=(?:\s*+(?:"[^"]*+"|'[^']*+'))?+)*+)(?:>|\Z)""", re.S | re.X)
_ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HEADING = re.compile(r"h[1-6]\Z")


def _landmark(tag: str, attributes: str, around: int) -> int:
    """Evidence inside an element, from its own marks and those around it."""
    if around == HARD or tag in ("nav", "aside", "footer"):
        return HARD
    words, strong = set(), False
    if "=" in attributes and tag not in ("html", "body"):
        for name, *values in _ATTR.findall(attributes):
            value = values[0] or values[1] or values[2]
            found = {w.lower() for w in _WORDS.findall(value)}
            name = name.lower()
            if name == "role":
                found = {"nav"} if "navigation" in found else found
                strong |= bool(found & {"main", "article"})
            strong |= name == "itemprop" and value.lower() == "articlebody"
            strong |= name == "id" and value.lower() in ("content", "main", "article", "main-content", "maincontent")
            words |= found
    if words & COMMENTS:
        return HARD
    if words & SIDE or tag in ("form", "fieldset", "dialog", "menu"):
        return SOFT
    if (tag == "header" or "header" in words) and around < WEAK:
        return SOFT
    if tag == "article":
        return ARTICLE
    if tag == "main":
        return max(around, MAIN)
    if strong or words & BODY and words & BODY_PART:
        return max(around, BODYLIKE)
    if around == SILENT and words & (BODY | BODY_PART):
        return WEAK
    return around


class Block:
    """A run of inline content: its text, the element it lies in, the landmark around it, and the share of it inside links."""
    __slots__ = ("text", "element", "mark", "tag", "linked")

    def __init__(self, text, element, mark, tag, linked):
        self.text, self.element, self.mark, self.tag, self.linked = text, element, mark, tag, linked


def blocks_of(page: str) -> tuple[list[Block], list[int]]:
    """The blocks of a page in order, and each element's parent (element 0 is the root)."""
    parent, blocks = [-1], []
    stack: list[tuple[str, int, int]] = [("", 0, SILENT)]       # block-level elements that are open
    opened: dict[str, int] = {}
    parts: list[str] = []
    link_from: list[str] = []
    linked = in_link = at = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                tag, element, mark = stack[-1]
                solid = len(text) - text.count(" ")
                size = min(solid, len("".join(entities.unescape("".join(link_from)).split()))) if link_from else 0
                blocks.append(Block(text, element, mark, tag, size / solid))
            parts.clear()
        link_from.clear()

    def close(k):
        flush()
        while len(stack) > k:
            opened[stack.pop()[0]] -= 1

    while True:
        m = _TOKEN.search(page, at)
        text = page[at:m.start() if m else len(page)]
        if text:
            parts.append(text)
            if in_link:
                link_from.append(text)
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = 0
            elif tag not in INLINE and opened.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
            elif tag == "p":
                flush()
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
                close_at = page.find(">", end.end()) if end else -1
                at = close_at + 1 if close_at >= 0 else len(page)
            parts.append(" ")
            continue
        if tag in INLINE or tag in VOID and tag != "hr":
            if tag == "a":
                in_link = 1
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        if tag == "hr":
            continue
        if stack[-1][0] == "p":
            close(len(stack) - 1)
        ends = CLOSES.get(tag, ())
        if any(opened.get(e) for e in ends):
            k, cut = len(stack), 0
            while k > 1 and stack[k - 1][0] not in LISTS:
                k -= 1
                cut = k if stack[k][0] in ends else cut
            if cut:
                close(cut)
        parent.append(stack[-1][1])
        stack.append((tag, len(parent) - 1, _landmark(tag, m[3], stack[-1][2])))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return blocks, parent


def shape(b: Block) -> tuple[float, ...]:
    """Features of a block that say nothing about landmarks."""
    words = b.text.split(" ")
    n = len(b.text)
    return (1.0, min(np.log1p(len(words)), 6.0), b.linked, float(b.text[-1] in ".!?…。\"”»"),
            min(1.0, sum(w[-1] in ",.;:" for w in words) / len(words)) if len(words) > 4 else 0.0,
            sum(c.isdigit() for c in b.text) / n)


def costs(blocks: list[Block], weights: np.ndarray) -> list[int]:
    """Terminal capacities: signed costs, positive for content."""
    landmarks = any(b.mark >= BODYLIKE for b in blocks)
    odds = None
    out = []
    for b in blocks:
        cost = EVIDENCE[b.mark]
        if b.mark in (SILENT, WEAK):
            cost = OUTSIDE if landmarks and b.mark == SILENT else cost
            if not _HEADING.match(b.tag):           # a heading is as good as what it stands over
                odds = float(np.dot(weights, shape(b)))
                cost += int(round(max(-SHAPE_MOST, min(SHAPE_MOST, 5 * odds))))
        out.append(cost)
    return out


def _depths(parent: list[int]) -> list[int]:
    depth = [0] * len(parent)
    for e in range(1, len(parent)):
        depth[e] = depth[parent[e]] + 1
    return depth


def graph(blocks: list[Block], parent: list[int], unary: list[int]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """All nodes' costs (blocks, then containers at no cost) and the smoothness edges."""
    depth = _depths(parent)
    edges = []
    for k in range(len(blocks) - 1):
        a, b = blocks[k].element, blocks[k + 1].element
        apart = 0
        while a != b:
            if depth[a] < depth[b]:
                a, b = b, a
            a = parent[a]
            apart += 1
        edges.append((k, k + 1, max(1, BESIDE - 2 * max(0, apart - 2))))
    users: dict[int, int] = {}                      # how many branches with blocks an element has
    seen = set()
    for b in blocks:
        e = b.element
        users[e] = users.get(e, 0) + 1
        while e not in seen and e > 0:
            seen.add(e)
            e = parent[e]
            users[e] = users.get(e, 0) + 1
    node = {e: len(blocks) + k for k, e in enumerate(sorted(e for e, n in users.items() if n > 1))}

    def holder(e):
        while e >= 0 and e not in node:
            e = parent[e]
        return e
    for k, b in enumerate(blocks):
        e = holder(b.element)
        if e >= 0:
            edges.append((k, node[e], CONTAINER))
    for e in node:
        up = holder(parent[e]) if e else -1
        if up >= 0:
            edges.append((node[e], node[up], CONTAINER))
    return unary + [0] * len(node), edges


def main_blocks(page: str, weights: np.ndarray = PRIOR) -> list[str]:
    """The texts of a page's content blocks, in order."""
    blocks, parent = blocks_of(page)
    unary = costs(blocks, weights)
    most = 2 * BESIDE + CONTAINER
    if all(abs(c) > most for c in unary):           # no edge can turn a block
        keep = [c > 0 for c in unary]
    else:
        keep = label(*graph(blocks, parent, unary))
    if not any(keep) and all(b.mark == SILENT for b in blocks):     # nothing speaks against the page's text
        keep = [b.linked < 1 for b in blocks]
    return [b.text for b, k in zip(blocks, keep) if k]


# ------------------------------------------------------------------------------------------------ training

def _page_features(page: str) -> bytes:
    """Label and shape of a page's blocks with a clear landmark, at most ``PAGE_BLOCKS``, as float32 rows."""
    blocks = [b for b in blocks_of(page)[0] if b.mark not in (SILENT, WEAK) and not _HEADING.match(b.tag)]
    step = -(-len(blocks) // PAGE_BLOCKS)
    return np.array([(float(b.mark >= BODYLIKE), *shape(b)) for b in blocks[::step or 1]], np.float32).tobytes()


def train(rows: np.ndarray, steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Logistic regression by full gradient steps; both classes weigh the same. ``PRIOR`` without rows of both."""
    if not len(rows) or rows[:, 0].min() == rows[:, 0].max():
        return PRIOR
    y, x = rows[:, 0].astype(np.float64), rows[:, 1:].astype(np.float64)
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= rate * (x.T @ (share * (p - y)) + decay * w)
    return w


def fit(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights of the shape classifier, from a bounded sample of pages labelled by their own landmarks."""
    rows = pages.select(F.xxhash64(F.col(id_col), F.col(url_col)).alias("pick"), F.col(html_col).alias("html"))
    picks = rows.select("pick").distinct().orderBy("pick").limit(sample_pages)

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_page_features(t.as_py()) for t in string_array(b, "html")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["pick", "features"])

    # at most sample_pages hashes: a bounded broadcast, and one page for each of them comes back
    some = rows.join(F.broadcast(picks), "pick").mapInArrow(featurize, "pick long, features binary")
    some = scratch_table(some.groupBy("pick").agg(F.min("features").alias("features")), "page-features")
    blobs = [bytes(r["features"]) for r in some.orderBy("pick").collect()]
    return train(np.frombuffer(b"".join(blobs), np.float32).reshape(-1, 1 + FEATURES))


def extract(pages: DataFrame, weights: np.ndarray, html_col: str = "html") -> DataFrame:
    """``pages`` without its html, with ``text`` (the blocks joined by line ends) and ``n_chars``."""
    keep = [f for f in pages.schema.fields if f.name not in (html_col, "text", "n_chars")]
    names = [f.name for f in keep]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "text string, n_chars long"])
    given = np.asarray(weights, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["\n".join(main_blocks(t.as_py(), given)) for t in string_array(b, html_col)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(names))), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return pages.select(*names, html_col).mapInArrow(run, ddl)
