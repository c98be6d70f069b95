"""Main text of web pages by a tree-structured graphical model over the DOM.

Each element and text node is a binary variable, content or not.  Node potentials
come from a log-linear model on the node's own features, edge potentials from a
2 x 2 table for parent and child, one table for each kind of child.  Sum-product
messages go up from the leaves and down from the root; a block of text is kept if
its content marginal is at least one half.  Both sets of potentials are trained on
labelled pages.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Element names, fixed by HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no page text; the first four run to the end of a page that does not close them.
RAW = frozenset("script style textarea title template iframe svg select option head".split())
_TO_END = frozenset("script style textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
#: Opening one of the first ends an open element of the second, up to the scope.
_P_ENDS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
_LISTED = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: End tags that close table cells on their way.
_THROUGH_CELLS = frozenset("tr table tbody thead tfoot body html div article main section".split())
_SCOPE = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_TAG_HEAD = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile(r"[>\"']")
_ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACES = re.compile(r"[ \t\n\r\f\v   -     　\x85\x1c-\x1f]+")
_LONG_REFERENCE = re.compile(r"&#([0-9]{8,});?")
_NAMES = re.compile(r"[a-z]+")

#: Words in names that mark parts beside the article; plain text in natural order.
BESIDE = (
    "ad ads advert advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header footer "
    "sidebar side aside widget related recommend share social comment comments respond reply disqus cookie consent notice popup modal "
    "overlay newsletter subscribe signup login form search copyright legal toolbar tags pagination pager skip hidden "
    "teaser teasers recommended trending popular latest links commentlist alert topbar masthead"
).split()
#: Words in names that mark the article itself.
WITHIN = "article content main post entry story body text prose".split()

TAGS = (
    "article main section div span p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre code figure figcaption "
    "nav header footer aside form button label input a b i em strong body html small time address details summary #text other"
).split()
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_CLASS_AT = {w: i for i, w in enumerate(BESIDE + WITHIN)}
N_FEATURES = 1 + len(TAGS) + len(_CLASS_AT) + 14
#: Elements that hold running text or its parts, and elements that name their role.
_TEXTUAL = frozenset("p li h1 h2 h3 h4 h5 h6 dd dt dl td th tr table tbody thead ul ol blockquote pre figcaption figure".split())
_ROLES = frozenset("article main nav header footer aside form button".split())
_BESIDE, _WITHIN = frozenset(BESIDE), frozenset(WITHIN)


@cache
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\s*>", re.I)


@dataclass
class Page:
    """Nodes in page order; node 0 is the root.  ``text`` is None for elements."""

    parent: list[int]
    tag: list[str]
    names: list[tuple[str, ...]]
    text: list[str | None]
    depth: list[int]


class Tags:
    """Tags of a page in linear time.  A tag is tried by one expression; once that has
    failed, ends are looked up in the list of quotes and angle brackets, and what was
    learnt about an opening quote is not found out again."""

    def __init__(self, source: str):
        self.source, self.marks, self.after = source, None, {}

    def at(self, start: int) -> tuple[str, str, str, int] | None:
        """(slash, name, attributes, end) of the tag at ``start``, or None for text."""
        if self.marks is None:
            m = _TAG.match(self.source, start)
            if m:
                return m[1], m[2], m[3], m.end()
            self.marks = [m.start() for m in _SPECIAL.finditer(self.source)]
            last: dict[str, int] = {}
            self.closing = [0] * len(self.marks)  # place of the next mark of the same kind, or -1
            for k in range(len(self.marks) - 1, -1, -1):
                kind = self.source[self.marks[k]]
                self.closing[k] = last.get(kind, -1)
                last[kind] = k
        head = _TAG_HEAD.match(self.source, start)
        if not head:
            return None
        k, passed = bisect_left(self.marks, head.end()), []
        while True:
            if k >= len(self.marks) or k < 0:
                end = -1
                break
            if self.source[self.marks[k]] == ">":
                end = self.marks[k]
                break
            if k in self.after:
                end = self.after[k]
                break
            passed.append(k)
            k = self.closing[k] + 1 if self.closing[k] >= 0 else -1
        self.after.update(dict.fromkeys(passed, end))
        return None if end < 0 else (head[1], head[2], self.source[head.end() : end], end + 1)


def parse(source: str) -> Page:
    """The tree of a page, in time linear in its length whatever it holds."""
    page = Page([-1], ["html"], [()], [None], [0])
    stack = [0]
    opened: dict[str, list[int]] = {}  # places in the stack of the open elements of each name
    blocks: list[int] = []  # places in the stack of the open block elements
    never: set[str] = set()  # names of elements that nothing closes any more

    def add(tag: str, names: tuple[str, ...], text: str | None) -> int:
        page.parent.append(stack[-1])
        page.tag.append(tag)
        page.names.append(names)
        page.text.append(text)
        page.depth.append(len(stack))
        return len(page.tag) - 1

    def close(to: int) -> None:
        for v in stack[to:]:
            opened[page.tag[v]].pop()
        del stack[to:]
        while blocks and blocks[-1] >= to:
            blocks.pop()

    def nearest(names: tuple[str, ...]) -> int:
        return max((opened[n][-1] for n in names if opened.get(n)), default=0)

    at, text_from, size, tags = 0, 0, len(source), Tags(source)
    last_bracket = source.rfind(">")
    while at < size:
        start = source.find("<", at)
        if start < 0:
            break
        after = source[start + 1 : start + 2]
        slash = name = attributes = None
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            end = size if end < 0 else end + 3
        elif after in ("!", "?") and start < last_bracket:
            end = source.find(">", start) + 1
        else:
            found = tags.at(start) if after == "/" or after.isalpha() else None
            if not found:
                at = start + 1  # text
                continue
            slash, name, attributes, end = found
        if start > text_from:
            add("#text", (), source[text_from:start])
        at = text_from = end
        if name is None:
            continue
        name = name.lower()
        if slash:
            k = nearest((name,))
            if k and (k >= nearest(("td", "th")) or name in _THROUGH_CELLS):
                close(k)
            continue
        if name in ("html", "body"):
            continue
        if name in RAW:
            # up to its own end tag
            stop = None if name in never else _end_of(name).search(source, at)
            if stop:
                at = text_from = stop.end()
            elif name in _TO_END:
                at = text_from = size
            else:
                never.add(name)
            continue
        if name in _P_ENDS and blocks and page.tag[stack[blocks[-1]]] == "p":
            close(blocks[-1])
        if name in _LISTED:
            k = nearest(_LISTED[name])
            if k and k > nearest(_SCOPE[name]):
                close(k)
        names: tuple[str, ...] = ()
        if attributes:
            found = []
            for a in _ATTR.finditer(attributes):
                value = (a.group(2) or a.group(3) or a.group(4) or "").lower()
                kind = a.group(1).lower()
                if kind in ("hidden",) or (kind == "aria-hidden" and value == "true") or (kind == "style" and "display:none" in value.replace(" ", "")):
                    found.append("hidden")
                elif kind in ("class", "id", "role"):
                    found += _NAMES.findall(value)
            names = tuple(found)
        node = add(name, names, None)
        if name not in VOID and not attributes.endswith("/"):
            opened.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                blocks.append(len(stack))
            stack.append(node)
    if size > text_from:
        add("#text", (), source[text_from:size])
    return page


def _short(m: re.Match) -> str:
    digits = m[1].lstrip("0")
    return f"&#{digits or 0};" if len(digits) < 8 else "&#99999999;"


def clean(text: str) -> str:
    """Character references decoded, white space made single spaces."""
    return _SPACES.sub(" ", entities.unescape(_LONG_REFERENCE.sub(_short, text)))


def features(page: Page) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers in use at each node (padded with -1 removed): (node, feature, value)."""
    n = len(page.tag)
    text_len = np.array([len(t) if t is not None else 0 for t in page.text], float)
    parent = np.array(page.parent)
    in_link = np.zeros(n)
    total, linked = text_len.copy(), np.zeros(n)
    anchor = np.array([t == "a" for t in page.tag])
    for v in range(n - 1, 0, -1):
        if anchor[v]:
            linked[v] = total[v]
        total[parent[v]] += total[v]
        linked[parent[v]] += linked[v]
    density = linked / np.maximum(total, 1)
    whole = max(total[0], 1)
    node, feat, value = [], [], []

    def put(v: int, f: int, x: float = 1.0) -> None:
        node.append(v)
        feat.append(f)
        value.append(x)

    at = 1 + len(TAGS) + len(_CLASS_AT)
    other = _TAG_AT["other"]
    for v in range(n):
        put(v, 0)
        put(v, 1 + _TAG_AT.get(page.tag[v], other))
        for w in page.names[v]:
            k = _CLASS_AT.get(w)
            if k is not None:
                put(v, 1 + len(TAGS) + k)
    share = total / whole
    heads = [v for v in range(n) if page.tag[v] in ("h1", "h2")]
    order, depth = np.arange(n), np.array(page.depth)
    beside = np.array([not _BESIDE.isdisjoint(w) for w in page.names])
    within = np.array([not _WITHIN.isdisjoint(w) for w in page.names])
    top = depth == 1
    first = order < heads[0] if heads else np.zeros(n, bool)
    textual = np.array([t in _TEXTUAL for t in page.tag])
    columns = (density, density > 0.5, share, share > 0.4, np.log1p(total) / 10, total < 20, total > 200, in_link, beside, within & ~beside, top, top & textual & (density < 0.5), first, first & (density > 0.5))
    for k, column in enumerate(columns):
        on = np.flatnonzero(column)
        node += on.tolist()
        feat += [at + k] * len(on)
        value += np.asarray(column, float)[on].tolist()
    return np.array(node), np.array(feat), np.array(value)


def kinds(page: Page) -> np.ndarray:
    """Kind of each node, which says how closely it follows its parent: text, inline,
    running text, containers without a name, elements that say what they are, and
    those without a name that stand at the top of the page."""
    out = []
    for tag, names, text, depth in zip(page.tag, page.names, page.text, page.depth, strict=True):
        named = tag in _ROLES or not _BESIDE.isdisjoint(names) or not _WITHIN.isdisjoint(names)
        out.append(0 if text is not None else 4 if named else 5 if depth == 1 else 2 if tag in _TEXTUAL else 3 if tag in BLOCK else 1)
    return np.array(out)


@dataclass
class TreeModel:
    """unary: log odds weights of features; edges[k]: log potentials of (parent,
    child) states for children of kind k (the last table also serves all kinds beyond it)."""

    unary: np.ndarray
    edges: np.ndarray


def beliefs(page: Page, model: TreeModel, found=None) -> tuple[np.ndarray, np.ndarray]:
    """Content marginal of each node, and of (parent, child) state pairs: messages
    upward in reverse page order, then downward in page order."""
    node, feat, value = found or features(page)
    n = len(page.tag)
    score = np.bincount(node, model.unary[feat] * value, n)
    log = np.zeros((n, 2))
    log[:, 1] = score
    kind = np.minimum(kinds(page), len(model.edges) - 1)
    edge = np.exp(model.edges)
    up = np.ones((n, 2))
    own = np.exp(log - log.max(axis=1, keepdims=True)).tolist()
    gather = [row[:] for row in own]
    e = edge.tolist()
    to_parent = [[1.0, 1.0] for _ in range(n)]
    parent = page.parent
    for v in range(n - 1, 0, -1):
        g0, g1 = gather[v]
        t = e[kind[v]]
        m0, m1 = t[0][0] * g0 + t[0][1] * g1, t[1][0] * g0 + t[1][1] * g1
        s = m0 + m1
        to_parent[v] = [m0 / s, m1 / s]
        p = gather[parent[v]]
        a, b = p[0] * m0 / s, p[1] * m1 / s
        z = a + b
        p[0], p[1] = a / z, b / z
    belief = [[0.5, 0.5]] * n
    pairs = np.zeros((n, 2, 2))
    s = sum(gather[0])
    belief[0] = [gather[0][0] / s, gather[0][1] / s]
    for v in range(1, n):
        pb, mu, t, g = belief[parent[v]], to_parent[v], e[kind[v]], gather[v]
        d0, d1 = pb[0] / max(mu[0], 1e-300), pb[1] / max(mu[1], 1e-300)
        q00, q01, q10, q11 = d0 * t[0][0] * g[0], d0 * t[0][1] * g[1], d1 * t[1][0] * g[0], d1 * t[1][1] * g[1]
        s = q00 + q01 + q10 + q11
        belief[v] = [(q00 + q10) / s, (q01 + q11) / s]
        pairs[v] = [[q00 / s, q01 / s], [q10 / s, q11 / s]]
    return np.array(belief)[:, 1], pairs


class Forest:
    """Trees side by side, their nodes by depth: messages of all trees go up and down level by level."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.tag) for p in pages]
        first = np.cumsum([0, *sizes[:-1]])
        self.parent = np.concatenate([np.array(p.parent) + f for p, f in zip(pages, first, strict=True)])
        self.parent[first] = -1
        self.kind = np.concatenate([kinds(p) for p in pages])
        depth = np.concatenate([np.array(p.depth) for p in pages])
        order = np.argsort(depth, kind="stable")
        cut = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        self.levels = [order[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def beliefs(self, score: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Content marginals, and those of (parent, child) states, as :func:`beliefs` gives them."""
        n, join = len(score), np.logaddexp
        e = edges[np.minimum(self.kind, len(edges) - 1)]
        own, sent = score.copy(), np.zeros(n)
        for level in self.levels[:0:-1]:
            r, t = own[level], e[level]
            sent[level] = join(t[:, 1, 0], t[:, 1, 1] + r) - join(t[:, 0, 0], t[:, 0, 1] + r)
            np.add.at(own, self.parent[level], sent[level])
        odds, pairs = own.copy(), np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            above, r, t = odds[self.parent[level]] - sent[level], own[level], e[level]
            odds[level] = r + join(t[:, 0, 1], t[:, 1, 1] + above) - join(t[:, 0, 0], t[:, 1, 0] + above)
            both = t + np.stack([np.stack([np.zeros(len(r)), r], 1), np.stack([above, above + r], 1)], 1)
            both = np.exp(both - both.max((1, 2), keepdims=True))
            pairs[level] = both / both.sum((1, 2), keepdims=True)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500))), pairs


KINDS = 6


def train(pages: list[tuple[Page, np.ndarray, float]], rounds: int = 400, rate: float = 0.4, l2: float = 1e-5) -> TreeModel:
    """Maximum likelihood of labelled trees: observed minus expected feature and
    edge counts of pages that each have a weight, by AdaGrad over all of them in each round."""
    model = TreeModel(np.zeros(N_FEATURES), np.zeros((KINDS, 2, 2)))
    gu, ge = np.full(N_FEATURES, 1e-6), np.full((KINDS, 2, 2), 1e-6)
    forest, y = Forest([p for p, _, _ in pages]), np.concatenate([y for _, y, _ in pages]).astype(int)
    weight = np.concatenate([np.full(len(y), w / len(y)) for _, y, w in pages]) / sum(w for _, _, w in pages)
    found, base = [], 0
    for page, _, _ in pages:
        node, feat, value = features(page)
        found.append((node + base, feat, value))
        base += len(page.tag)
    node, feat, value = (np.concatenate(x) for x in zip(*found, strict=True))
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((KINDS, 2, 2))
    np.add.at(seen, (forest.kind[child], y[forest.parent[child]], y[child]), weight[child])
    for _ in range(rounds):
        p, pairs = forest.beliefs(np.bincount(node, model.unary[feat] * value, base), model.edges)
        du = l2 * model.unary + np.bincount(feat, ((p - y) * weight)[node] * value, N_FEATURES)
        expected = np.zeros((KINDS, 2, 2))
        np.add.at(expected, forest.kind[child], pairs[child] * weight[child, None, None])
        de = l2 * model.edges + expected - seen
        gu += du * du
        ge += de * de
        model = TreeModel(model.unary - rate * du / np.sqrt(gu), model.edges - rate * de / np.sqrt(ge))
    return model


#: Elements whose text is the article, and elements and names whose text is not: how pages are labelled.
_IN = frozenset(("article", "main"))
_OUT = frozenset("nav header footer aside form button label input select menu dialog".split())


def label(page: Page) -> np.ndarray | None:
    """Content labels of a page that marks its article with an element or role of
    its own, or None for a page that does not."""
    inside = np.zeros(len(page.tag))
    seen = False
    for v in range(1, len(page.tag)):
        p = page.parent[v]
        out = page.tag[v] in _OUT or any(w in BESIDE for w in page.names[v])
        comes_in = page.tag[v] in _IN or page.tag[v] == "article"
        seen |= comes_in
        inside[v] = 0 if out or inside[p] < 0 else 1 if comes_in or inside[p] > 0 else 0
        if out:
            inside[v] = -1
        elif inside[p] < 0:
            inside[v] = -1
    return np.maximum(inside, 0) if seen else None


def main_text(page: Page, content: np.ndarray) -> str:
    """Kept text, one line per block in page order."""
    blocks: list[str] = []
    parts: list[str] = []
    home = -1
    block = [0]  # the nearest block element at or above each node
    for v in range(1, len(page.tag)):
        block.append(v if page.text[v] is None and page.tag[v] in BLOCK else block[page.parent[v]])

    def flush() -> None:
        text = clean("".join(parts)).strip(" ")
        if text:
            blocks.append(text)
        parts.clear()

    for v in range(1, len(page.tag)):
        if page.text[v] is None:
            if page.tag[v] in BLOCK:
                flush()
            continue
        if block[v] != home:
            flush()
            home = block[v]
        if content[v] >= 0.5:
            parts.append(page.text[v])
    flush()
    return "\n".join(blocks)


#: Labelled pages that the model is trained on, at most, the first by a hash of page_id, and the characters of each, at most.
TRAIN_PAGES = 80
TRAIN_CHARS = 20_000


def fit(pages: DataFrame, most: int = TRAIN_PAGES, most_chars: int = TRAIN_CHARS, id_col: str = "page_id", html_col: str = "html") -> TreeModel:
    """Train on written pages of many shapes (:func:`written_pages`) and on at most ``most``
    pages of ``pages(page_id, html)`` that mark their article, which weigh as much
    as a quarter of the written ones together, as they may all look alike; half of them without the
    element that marks it.  The sample fits the driver: pages of more than
    ``most_chars`` characters are not trained on; all pages are extracted from,
    whatever their length.  Nulls and pages without a mark are not trained on, rows that
    repeat may both be; an empty table leaves the written pages."""
    rows = (
        pages.where(F.col(f"`{html_col}`").rlike("(?i)<(article|main)\\b") & (F.length(f"`{html_col}`") <= most_chars))
        .orderBy(F.xxhash64(f"`{id_col}`"), f"`{id_col}`", F.xxhash64(f"`{html_col}`")).limit(most).select(F.col(f"`{html_col}`").alias("html")).toArrow()["html"].to_pylist()
    )
    made = [(p, y) for p in map(parse, rows) if (y := label(p)) is not None]
    for page, _ in made[::2]:
        page.tag = ["div" if t in _IN else t for t in page.tag]
    written = written_pages()
    weight = len(written) / (4 * max(1, len(made)))
    return train([(p, y, weight) for p, y in made] + [(p, y, 1.0) for p, y in written])


def extract(pages: DataFrame, model: TreeModel, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``pages`` without the html column, with text and n_chars; a null or empty
    page has an empty text.  No exchange; other columns stay as they are, but for ones
    called text or n_chars, which the results replace.  Rows don't depend on each other: repeated rows get equal
    results, an empty table gives an empty one, a page is read whole whatever its length."""
    rest = [F.col(f"`{c}`") for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = pages.select(*rest, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    shared = pages.sparkSession.sparkContext.broadcast(model)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = []
            for source in batch.column(batch.num_columns - 1):
                page = parse(source.as_py() or "")
                out.append(main_text(page, beliefs(page, m)[0]) if len(page.tag) > 1 else "")
            text = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text, pc.utf8_length(text).cast(pa.int64())], [f"c{k}" for k in range(len(names))])

    # Arrow functions can't take names with dots
    plainly = pages.select(*[c.alias(f"c{k}") for k, c in enumerate(rest)], F.col(f"`{html_col}`").alias("_html"))
    return plainly.mapInArrow(run, StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(schema.fields)])).toDF(*names)


# -- written pages --------------------------------------------------------------------
# Shapes that the table's pages may lack, dealt from parts by a fixed random stream.  The
# names IN and OUT on an element are its label and no feature.

IN, OUT = "zzin", "zzout"
WRITTEN_PAGES = 500
_WORDS = "the a river stone of light and under old window they walked to market near some water house with green long winter said that it was there for many years before her brother came from town by road".split()


def _said(rng: np.random.Generator, words: int) -> str:
    text = " ".join(rng.choice(_WORDS, max(1, words)))
    return text[:1].upper() + text[1:] + "."


def _element(tag: str, names: str, inner: str, mark: str = "", by: str = "class") -> str:
    marked = f' class="{mark}"' if mark and by != "class" else ""
    named = f' {by}="{names} {mark}"' if names and by == "class" else f' {by}="{names}"' if names else f' class="{mark}"' if mark else ""
    return f"<{tag}{named}{marked if names else ''}>{inner}</{tag}>"


def _links(rng: np.random.Generator, n: int, listed: bool, words: int = 2) -> str:
    each = [f'<a href="/x{k}">{_said(rng, int(rng.integers(1, words + 1)))[:-1]}</a>' for k in range(n)]
    return "".join(f"<li>{x}</li>" for x in each) if listed else " ".join(each)


def _beside(rng: np.random.Generator) -> str:
    """One part beside the article: its element, names and content vary apart from each other."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    by = pick("class", "class", "id")
    kind = pick("menu", "menu", "head", "foot", "side", "notice", "ad", "form", "comments", "comments", "related", "share", "crumbs", "pager")
    prose = lambda n: "".join(f"<p>{_said(rng, int(rng.integers(3, 40)))}</p>" for _ in range(n))
    few = int(rng.integers(1, 7))
    if kind == "menu":
        inner = _links(rng, few, True)
        shape = pick(("nav", "", f"<ul>{inner}</ul>"), ("nav", "", _links(rng, few, False)), ("ul", pick("menu", "nav", "navigation", "links"), inner), ("div", pick("menu", "navbar", "nav", "navigation", "topbar"), _links(rng, few, False)), ("ul", "", inner), ("div", pick("nav", "menu"), f"<ul>{inner}</ul>"))
    elif kind == "head":
        shape = pick(("header", "", f"<h1>{_said(rng, 3)}</h1>" + _links(rng, few, False)), ("div", pick("header", "banner", "masthead", "site-header", "topbar"), f"<span>{_said(rng, 4)}</span>"), ("header", "", f"<p>{_said(rng, 6)}</p>"), ("div", "header", f"<h1>{_said(rng, 3)}</h1><p>{_said(rng, 8)}</p>"))
    elif kind == "foot":
        shape = (pick("footer", "div", "section"), pick("footer", "site-footer", "copyright", "legal"), pick(prose(1), _links(rng, few, False), f"&copy; {_said(rng, 6)}"))
        shape = pick(shape, ("footer", "", prose(1)), ("footer", "", _said(rng, 8)))
    elif kind == "side":
        shape = (pick("aside", "div", "section"), pick("sidebar", "widget", "side", "sidebar-left", "widget-area"), f"<h3>{_said(rng, 2)}</h3>" + pick(prose(2), f"<ul>{_links(rng, few, True, 8)}</ul>"))
        shape = pick(shape, ("aside", "", prose(1)))
    elif kind == "notice":
        shape = (pick("div", "section", "div"), pick("cookie", "consent", "notice", "popup", "modal", "overlay", "alert", "cookie-notice"), prose(1) + pick("<button>Accept</button>", ""))
    elif kind == "ad":
        shape = (pick("div", "div", "section", "aside"), pick("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"), pick(_said(rng, 8), prose(1), _links(rng, 1, False, 8)))
    elif kind == "form":
        shape = pick(("form", "", f"<label>{_said(rng, 2)}</label><input><button>Send</button>"), ("form", pick("newsletter", "search", "login"), prose(1) + "<input>"), ("div", pick("newsletter", "subscribe", "signup", "login"), prose(1) + "<form><input></form>"))
    elif kind == "comments":
        one = lambda: pick(f'<div class="comment"><p>{_said(rng, int(rng.integers(3, 40)))}</p></div>', f"<li><p>{_said(rng, int(rng.integers(3, 40)))}</p></li>", f"<p>{_said(rng, int(rng.integers(3, 40)))}</p>", f"<div>{_said(rng, int(rng.integers(3, 40)))}</div>")
        shape = (pick("section", "div", "ol", "div"), pick("comments", "comments", "comment", "commentlist", "respond", "comments-area", "disqus"), f"<h3>{_said(rng, 2)}</h3>" * int(rng.integers(2)) + pick("{}", "{}", "<ol>{}</ol>", "<ul>{}</ul>").format("".join(one() for _ in range(few))))
    elif kind == "related":
        tease = lambda: pick(f'<h3><a href="/r">{_said(rng, 5)}</a></h3><p>{_said(rng, int(rng.integers(5, 30)))}</p>', f'<a href="/r">{_said(rng, 7)}</a>')
        names = pick("related", "teaser", "recommended", "popular", "trending", "teaser related", "latest")
        shape = pick((pick("div", "section", "aside"), names, tease() + tease()), (pick("article", "div", "li"), names, tease()))
    else:
        shape = {"share": (pick("div", "ul"), pick("share", "social", "share-buttons"), _links(rng, few, True)), "crumbs": (pick("div", "ol", "p"), pick("breadcrumb", "breadcrumbs"), " / ".join(_links(rng, 1, False) for _ in range(3))), "pager": ("div", pick("pagination", "pager", "tags"), _links(rng, few, False))}[kind]
    return _element(shape[0], shape[1], shape[2], OUT, by)


def _block(rng: np.random.Generator) -> str:
    pick = lambda *x: x[int(rng.integers(len(x)))]
    words = int(pick(1, 3, 8, 20, 40, 70))
    p = f"<p>{_said(rng, words)}</p>"
    linked = f'<p>{_said(rng, 4)} <a href="/l">{_said(rng, 3)}</a></p>'
    whole = f'<p><a href="/w">{_said(rng, int(rng.integers(1, 12)))}</a></p>'
    table = "<table>" + "".join(f"<tr><td>{_said(rng, 2)}</td><td>{_said(rng, 1)}</td></tr>" for _ in range(2)) + "</table>"
    return pick(
        p, p, p, p, linked, whole, f"<h2>{_said(rng, 3)}</h2>{p}", f"<ul><li>{_said(rng, 4)}</li><li>{_said(rng, 2)} <a href='/x'>{_said(rng, 2)}</a></li></ul>", f"<ol><li>{_said(rng, 6)}</li></ol>", f"<ul>{_links(rng, 3, True, 4)}</ul>",
        f"<blockquote>{_said(rng, 12)}</blockquote>", f"<pre>{_said(rng, 5)}</pre>", table, f"<div>{_said(rng, words)}</div>", f"<figure><img src='i'><figcaption>{_said(rng, 5)}</figcaption></figure>", f"<p><b>{_said(rng, 4)}</b><br>{_said(rng, 9)}</p>", f"<section>{p}{p}</section>", f"<dl><dt>{_said(rng, 1)}</dt><dd>{_said(rng, 7)}</dd></dl>",
    )


def written_pages(n: int = WRITTEN_PAGES, seed: int = 11) -> list[tuple[Page, np.ndarray]]:
    """``n`` pages of parts in random layouts, with their labels: the article in any of many
    elements or in none, of one line or of many blocks, linked or not, with parts beside it, before, after and within."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    out = []
    for _ in range(n):
        inner = [f"<h1>{_said(rng, int(rng.integers(1, 7)))}</h1>"] if rng.random() < 0.65 else []
        inner += [_block(rng) for _ in range(int(pick(1, 1, 2, 3, 5, 8)))]
        if rng.random() < 0.35:
            inner.insert(int(rng.integers(1, len(inner) + 1)), _beside(rng))
        tag, by, names = pick(
            ("article", "class", ""), ("article", "class", pick("post", "entry", "story")), ("main", "class", ""), ("main", "id", "content"), ("div", "role", "main"), ("div", "id", pick("story", "content", "main", "article", "post")),
            ("div", "class", pick("content", "post-body", "entry-content", "article-text", "story", "prose")), ("section", "class", pick("content", "", "body")), ("div", "class", ""), ("td", "class", ""), ("td", "class", ""), ("", "", ""),
        )
        body = "".join(inner)
        if tag:
            core = _element(tag, names, body, IN, by)
            core = f"<table><tr><td class='{OUT}'>{_links(rng, 3, False)}</td>{core}</tr></table>" if tag == "td" else core
        else:
            core = re.sub(r"<(h1|h2|p|ul|ol|blockquote|pre|table|div|figure|section|dl)>", rf'<\1 class="{IN}">', body)
        if rng.random() < 0.3:
            core = _element("div", pick("", "wrapper", "page", "container"), core, IN)
        before, after = ("".join(_beside(rng) for _ in range(int(rng.integers(0, 4)))) for _ in range(2))
        whole = before + core + after
        page = parse(_element("div", pick("page", "wrapper", ""), whole) if tag and rng.random() < 0.3 else whole)
        y = np.zeros(len(page.tag))
        for v in range(1, len(page.tag)):
            y[v] = 1 if IN in page.names[v] else 0 if OUT in page.names[v] else y[page.parent[v]]
        out.append((page, y))
    return out
