"""Main text of web pages by minimum-cut labelling.

Each text block of a page is a node. A logistic classifier over a block's own properties (zone of the element tree, share
of linked text, length, sentence end, kind of element, legal marks), trained by ridge Newton steps on a small labelled
table, gives its log-odds of being content; their positive part is the capacity from the source, their negative part
that to the sink. Smoothness edges join consecutive blocks, the weaker the further apart they lie in the element tree,
and join each block with its element and each element with its parent, so the tree spreads a label over what lies close
in it at a number of edges in proportion to the page. The maximum flow leaves the cheapest cut: blocks on the source
side are the main text, in page order.

One Arrow map over pages: no shuffle, pages are cut one at a time, batches by bytes. A null or empty page, or one without
content blocks, gives an empty text; a null id or url stays null; repeated rows each get their result; extra columns of
the input are left out unless asked for with ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.llm.common import byte_slices, text_or_empty, texts
from carepath.llm.html_blocks import HEADING, PLAIN, Block, Page, labelled_pages, parse

ZONES = 8
RIDGE = 0.05
NEWTON_STEPS = 30
MAX_LABELLED = 1_000_000  # bytes of labelled pages the classifier is fitted on; more raises

UNIT = 100  # capacities are whole numbers of this many to one unit of log-odds
CLIP = 6.0  # no block is surer than this
ADJACENT = 2.0  # capacity between consecutive blocks, divided by the steps between their elements
INSIDE = 0.5  # capacity between a block and its element
NESTED = 0.25  # capacity between an element and its parent

_LEGAL = ("©", "(c) ", "copyright", "all rights reserved")


def features(blocks: Sequence[Block]) -> np.ndarray:
    """One row a block; the first column is the constant."""
    out = np.zeros((len(blocks), ZONES + 9))
    for row, b in zip(out, blocks):
        words = b.text.count(" ") + 1
        start = b.text[:200].lower()
        row[0] = 1.0
        row[1 + b.zone] = 1.0
        plain = 1.0 if b.zone == PLAIN else 0.0  # without a telling element the text itself must tell
        rest = row[1 + ZONES :]
        rest[0] = b.link_share
        rest[1] = np.log(words) / 3
        rest[2] = plain * b.link_share
        rest[3] = plain * np.log(words) / 3
        rest[4] = 1.0 if b.text[-1] in ".!?…:;\"”»。！？" else 0.0
        rest[5] = 1.0 if b.tag in HEADING else 0.0
        rest[6] = 1.0 if b.tag in ("p", "blockquote", "pre") else 0.0
        rest[7] = plain if any(m in start for m in _LEGAL) else 0.0
    return out


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(-(x @ w)))
        gradient = x.T @ (p - y) + RIDGE * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(pages: DataFrame) -> np.ndarray:
    """Weights of the block classifier from labelled pages (html, text): a block is content if it is a line of the text.
    The table must be small (``MAX_LABELLED`` bytes of html)."""
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    if size > MAX_LABELLED:
        raise ValueError(f"{size} bytes of labelled pages; the classifier is fitted on up to {MAX_LABELLED}")
    x, y = [], []
    for row in pages.select("html", "text").orderBy("html").collect():
        blocks, lines = parse(row.html or "").blocks, set((row.text or "").split("\n"))
        x.append(features(blocks))
        y += [b.text in lines for b in blocks]
    return fit_weights(np.concatenate(x), np.array(y, float))


def default_weights(spark: SparkSession) -> np.ndarray:
    return fit(labelled_pages(spark))


class Network:
    """Maximum flow by blocking flows over shortest paths. Terminal capacities are kept per node (positive: from the
    source, negative: to the sink), other edges are undirected."""

    def __init__(self, terminal: Sequence[int]):
        self.rest = list(terminal)
        self.edges: list[list[int]] = [[] for _ in terminal]
        self.to: list[int] = []
        self.capacity: list[int] = []

    def join(self, a: int, b: int, capacity: int) -> None:
        if capacity > 0 and a != b:
            self.edges[a].append(len(self.to))
            self.edges[b].append(len(self.to) + 1)
            self.to += (b, a)
            self.capacity += (capacity, capacity)

    def _levels(self) -> tuple[list[int], bool]:
        """Distance of each node from the source in the residual network, and whether the sink is reached."""
        rest, to, capacity = self.rest, self.to, self.capacity
        level = [0 if r > 0 else -1 for r in rest]
        queue = [i for i, r in enumerate(rest) if r > 0]
        reached = False
        for u in queue:
            if rest[u] < 0:
                reached = True
                continue
            for e in self.edges[u]:
                v = to[e]
                if capacity[e] > 0 and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        return level, reached

    def source_side(self) -> list[bool]:
        """Push the maximum flow; the nodes that the source still reaches lie before the minimum cut."""
        rest, to, capacity, edges = self.rest, self.to, self.capacity, self.edges
        while True:
            level, reached = self._levels()
            if not reached:
                return [d >= 0 for d in level]
            arc = [0] * len(rest)
            for start in range(len(rest)):
                path: list[int] = []
                u = start
                while rest[start] > 0 and level[start] == 0:
                    if rest[u] < 0:
                        amount = min(rest[start], -rest[u], *(capacity[e] for e in path))
                        rest[start] -= amount
                        rest[u] += amount
                        for e in path:
                            capacity[e] -= amount
                            capacity[e ^ 1] += amount
                        path, u = [], start
                        continue
                    own = edges[u]
                    while arc[u] < len(own):
                        e = own[arc[u]]
                        if capacity[e] > 0 and level[to[e]] == level[u] + 1:
                            break
                        arc[u] += 1
                    if arc[u] < len(own):
                        path.append(own[arc[u]])
                        u = to[path[-1]]
                    elif path:
                        u = to[path.pop() ^ 1]
                        arc[u] += 1
                    else:
                        break


def _steps(page: Page, a: int, b: int, far: int) -> int:
    """Edges between two nodes of the element tree; ``far`` if there are as many or more."""
    steps = 0
    while a != b and steps < far:
        if page.depth[a] >= page.depth[b]:
            a = page.parent[a]
        else:
            b = page.parent[b]
        steps += 1
    return steps


def label(page: Page, weights: np.ndarray) -> list[bool]:
    """Whether each block is content, by the minimum cut."""
    blocks = page.blocks
    if not blocks:
        return []
    odds = np.clip(features(blocks) @ weights, -CLIP, CLIP)
    elements: dict[int, int] = {}  # nodes of the tree above a block, numbered behind the blocks
    links = []
    for i, b in enumerate(blocks):
        node, below, weight = b.node, i, INSIDE
        while True:
            known = elements.get(node)
            if known is None:
                known = elements[node] = len(blocks) + len(elements)
                links.append((below, known, weight))
            else:
                links.append((below, known, weight))
                break
            if node == 0:
                break
            node, below, weight = page.parent[node], known, NESTED
    net = Network([*np.rint(odds * UNIT).astype(int).tolist(), *[0] * len(elements)])
    for a, b, weight in links:
        net.join(a, b, round(weight * UNIT))
    far = round(2 * ADJACENT * UNIT)  # from here on the capacity rounds to nothing
    for i in range(len(blocks) - 1):
        steps = _steps(page, blocks[i].node, blocks[i + 1].node, far)
        net.join(i, i + 1, round(ADJACENT * UNIT / (1 + steps)))
    return net.source_side()[: len(blocks)]


def main_text(html: str, weights: np.ndarray) -> str:
    page = parse(html)
    return "\n".join(b.text for b, content in zip(page.blocks, label(page, weights)) if content)


def extract(
    pages: DataFrame, weights: np.ndarray, keep: Sequence[str | Column] = ("page_id", "url"), html: str | Column = "html"
) -> DataFrame:
    """The columns of ``keep`` plus text string (never null) and n_chars long, its code points."""
    rows = pages.select(*keep, text_or_empty(html).alias("_page_html"))
    kept = rows.columns[:-1]
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "_page_html"):
            found = [main_text(t, weights) for t in texts(batch, "_page_html")]
            columns = [batch.column(i) for i in range(len(kept))]
            columns += [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "text", "n_chars"])

    return rows.mapInArrow(cut, ", ".join([*types, "text string", "n_chars bigint"]))
