"""HTML main text by minimum-cut labelling.

A page becomes its text blocks in page order. A classifier (logistic regression on features of a
block's text, links, tag and enclosing elements, trained on a bounded sample of pages that mark
their article) gives each block a cost for either label; these are the capacities to the two
terminals. Neighbouring blocks, and blocks under one parent, are joined by smoothness edges that
weaken with their distance in the element tree. The minimum cut is the labelling of least cost.
Elements that are never content (navigation, forms, scripts, comment sections and so on) are left out
before.

Most nodes are settled by persistency: a node whose terminal capacity exceeds all its edges takes
its own side, and its edges become capacity of its neighbours. The maximum flow runs on the rest.

A null or empty page gives the empty text. Unclosed and stray tags are tolerated, references
decoded, white space (also inside blocks) reduced to one space. Repeated rows get equal texts.
Other columns pass through; an output name that is taken is replaced.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pages in the training sample, in expectation.
SAMPLE_PAGES = 1000
#: The classifier's greatest say on a block, and that of the page's own mark of its article; text and
#: neighbours together outvote the mark.
REACH, MARK = 4.0, 2.5
#: Smoothness between neighbours under one parent; halved by each tree step between parents.
SMOOTH = 1.0

# Element names by their role in a page.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav"
    " noframes ol option optgroup p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW_TAGS = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "title", "xmp")
NEVER_TAGS = frozenset("nav header footer aside form menu dialog select button noframes head fieldset search".split())
NEVER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie"
    " cookies disclaimer discussion footer header masthead menu nav navbar navigation newsletter notice notices"
    " popup promo promotion related reply replies responses share sharing sidebar signup social sponsor sponsored"
    " subscribe toolbar widget disqus respond modal overlay toc".split()
)
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
ARTICLE_TAGS = frozenset(("article", "main"))
CLOSES_P = BLOCK_TAGS - {"br", "option", "optgroup", "caption", "button", "legend"}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({'|'.join(RAW_TAGS)})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>"  # with a quote that is never closed
    r"|<[!?][^>]*>"
    r"|</?[a-zA-Z][^<>]*\Z",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")


@dataclass
class Block:
    path: tuple[int, ...]  # numbers of the enclosing elements
    tag: str
    names: frozenset
    inside: frozenset
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _never(tag: str, attributes: str) -> tuple[bool, frozenset]:
    """Whether an element is never content, and the words of its class and id."""
    if not attributes:
        return tag in NEVER_TAGS, frozenset()
    words: set[str] = set()
    never = tag in NEVER_TAGS
    for name, *values in _NAMES.findall(attributes):
        value = next((v for v in values if v), "").lower()
        if name.lower() == "role":
            never |= value in NEVER_ROLES
        else:
            # Names of the page's frame and article speak of the element only as whole words.
            words |= set(value.split() if tag in ("html", "body", *ARTICLE_TAGS) else _WORDS.findall(value))
    return never or (bool(words & NEVER_WORDS) and tag not in ("html", "body")), frozenset(words)


def blocks(page: str, all_of_them: bool = False) -> list[Block]:
    """The text blocks in page order; those of elements that are never content only on demand."""
    stack: list[tuple[str, int, bool, frozenset]] = []
    found: list[Block] = []
    current: Block | None = None
    number, skipped, links, at = 0, 0, 0, 0

    def text(piece: str) -> None:
        nonlocal current
        if not piece or (skipped and not all_of_them):
            return
        if current is None:
            if piece.isspace():
                return
            owner = next((s for s in reversed(stack) if s[0] in BLOCK_TAGS), ("", 0, False, frozenset()))
            path = tuple(s[1] for s in stack if s[0] in BLOCK_TAGS)
            inside = frozenset(s[0] for s in stack) | (frozenset(("never",)) if skipped else frozenset())
            current = Block(path, owner[0], owner[3], inside)
            found.append(current)
        current.parts.append(piece)
        if links:
            current.linked += len(piece)

    def close(depth: int) -> None:
        nonlocal skipped, links, current
        for name, _, never, _ in stack[depth:]:
            skipped -= never
            links -= name == "a"
            if name in BLOCK_TAGS:
                current = None
        del stack[depth:]

    for m in _TAG.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        tag = (tag or "").lower()
        if not tag:
            continue
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if depth >= 0 and not (tag not in BLOCK_TAGS and any(s[0] in BLOCK_TAGS for s in stack[depth + 1 :])):
                close(depth)
            elif depth >= 0:
                # An inline end tag across blocks ends only its own element.
                links -= tag == "a"
                skipped -= stack[depth][2]
                del stack[depth]
            continue
        if tag in VOID_TAGS:
            if tag in ("br", "hr"):
                if tag == "hr":
                    current = None
                text(" ")
            continue
        if tag in CLOSES_P:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCK_TAGS), -1)
            if depth >= 0 and stack[depth][0] == "p":
                close(depth)
        if tag == "li" or tag in ("dt", "dd", "tr", "td", "th", "option"):
            pairs = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}[tag]
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCK_TAGS), -1)
            if depth >= 0 and stack[depth][0] in pairs:
                close(depth)
        number += 1
        never, names = _never(tag, attributes)
        stack.append((tag, number, never, names))
        skipped += never
        links += tag == "a"
        if tag in BLOCK_TAGS:
            current = None
    text(page[at:])
    for block in found:
        block.text = " ".join(html.unescape("".join(block.parts)).split())
    return [b for b in found if b.text]


FEATURES = 11


def features(found: list[Block]) -> np.ndarray:
    """One row per block: text form, links, own tag and place in the page."""
    rows = np.zeros((len(found), FEATURES))
    for i, b in enumerate(found):
        n = len(b.text)
        rows[i] = (
            np.log1p(n),
            min(1.0, b.linked / n),
            sum(b.text.count(c) for c in ".!?") / (1 + b.text.count(" ")),
            b.text[-1] in ".!?",
            b.tag == "p",
            b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"),
            b.tag == "li",
            b.tag in ("div", "td", "section", "body", ""),
            bool(b.names & NEVER_WORDS) or "never" in b.inside,
            "©" in b.text or "|" in b.text,
            1.0,
        )
    return rows


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and labels of the blocks of pages that mark their article."""
    for batch in batches:
        x, y = [], []
        for page in batch.column(0).to_pylist():
            found = blocks(page or "", all_of_them=True)
            inside = [bool(b.inside & ARTICLE_TAGS) and "never" not in b.inside for b in found]
            if any(inside):
                x.append(features(found))
                y += inside
        if x:
            values = pa.array(np.concatenate(x).ravel())
            ends = pa.array(np.arange(0, len(values) + 1, FEATURES), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, values), pa.array(np.array(y, float))], ["x", "y"])


def train(pages: DataFrame, column: str = "html", sample: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps on the sample's summed moments.

    Without any page that marks its article, text length and links decide by fixed weights.
    """
    texts = pages.select(F.col(column).alias("html")).where(F.length("html") > 0)
    classes = max(1, texts.count() // sample)
    chosen = texts.where(F.pmod(F.xxhash64("html"), F.lit(classes)) == 0).distinct()
    rows = chosen.mapInArrow(_labelled, "x array<double>, y double").toArrow()
    weights = np.array([0.5, -4.0, 0, 1, 1, 1, -1, -0.5, -4, -1, -1.5])
    if not rows.num_rows:
        return weights
    x = np.array(rows.column("x").to_pylist())
    y = rows.column("y").to_numpy()
    weights = np.zeros(FEATURES)
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (y - p) - 0.5 * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(FEATURES)
        weights = weights + np.linalg.solve(curve, gradient)
    return weights


def _edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Neighbours, and each block with the one before it under the same parent."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1].path
            shared = next((k for k, (u, v) in enumerate(zip(a, b.path, strict=False)) if u != v), min(len(a), len(b.path)))
            steps = max(0, len(a) - shared - 1) + max(0, len(b.path) - shared - 1)
            edges[i - 1, i] = SMOOTH * 0.5**steps
        parent = b.path[-2] if len(b.path) > 1 else 0
        j = last.get(parent)
        if j is not None:
            edges[j, i] = edges.get((j, i), 0.0) + SMOOTH / 2
        last[parent] = i
    return [(i, j, w) for (i, j), w in edges.items()]


def minimum_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the content side. ``unary`` is the gain of the content label."""
    n = len(unary)
    gain = list(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(gain[i]) >= sum(near[i].values()):
            label[i] = gain[i] > 0
            for j, w in near[i].items():
                gain[j] += w if label[i] else -w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        side = _flow({i: gain[i] for i in rest}, {i: dict(near[i]) for i in rest})
        for i in rest:
            label[i] = i in side
    return [bool(x) for x in label]


def _flow(gain: dict[int, float], near: dict[int, dict[int, float]]) -> set[int]:
    """Maximum flow by shortest augmenting paths; the nodes still reached from the source."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(w) for i, w in near.items()} | {source: {}, sink: {}}
    for i, g in gain.items():
        if g > 0:
            room[source][i], room[i][source] = g, 0.0
        else:
            room[i][sink], room[sink][i] = -g, 0.0
    while True:
        before = {source: source}
        queue = deque([source])
        while queue and sink not in before:
            i = queue.popleft()
            for j, r in room[i].items():
                if r > 1e-9 and j not in before:
                    before[j] = i
                    queue.append(j)
        if sink not in before:
            return set(before) - {source}
        path, j = [], sink
        while j != source:
            path.append((before[j], j))
            j = before[j]
        push = min(room[i][j] for i, j in path)
        for i, j in path:
            room[i][j] -= push
            room[j][i] += push


def main_text(page: str | None, weights: np.ndarray) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    marked = [bool(b.inside & ARTICLE_TAGS) for b in found]
    gain = np.clip(features(found) @ weights, -REACH, REACH)
    if any(marked):  # the page's own mark of its article is a cost like others
        gain = gain + np.where(marked, MARK, -MARK)
    return " ".join(b.text for b, keep in zip(found, minimum_cut(gain.tolist(), _edges(found)), strict=True) if keep)


def extract(pages: DataFrame, weights: np.ndarray, column: str = "html", out: str = "text") -> DataFrame:
    """Add each page's main text."""

    @F.arrow_udf("string")
    def texts(batch: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py(), weights) for p in batch], pa.string())

    return pages.withColumn(out, texts(F.col(column)))
