"""Main text of pages by a tree-structured graphical model.

Every block-level DOM node has a label, content or not, and so has an inline
element with a class, id or role, such as an advert inside a paragraph; an
inline node's edge to its parent is of a kind of its own.  A node's potential is
linear in features of its tag, class, id and text; parent and child share a
potential for each pair of labels.  On the page's tree sum-product message
passing is exact: messages go up from the leaves and down from the root, and
their product at a node is its marginal.  Training climbs the likelihood of
labelled pages, whose gradient needs the same marginals.

Blocks whose node is content with a marginal over one half are the text: white
space inside a block becomes one space, blocks are joined by an empty line.

Local to a row.  Defined cases: null, empty and blank pages have no text;
broken markup is read as far as it goes; a page without content gives an empty
text, a very long or deep one takes time in proportion to its length.
"""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import dom, labelled_pages

Weights = dict[str, float]

_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")
_NAMED = ("class", "id", "role")
#: Elements that begin a part of their own, as any element with a name does;
#: others mostly share their parent's label.
_PARTS = frozenset("html head body nav header footer aside article main section form dialog".split())


def _bucket(n: float, *bounds: float) -> int:
    return sum(n >= b for b in bounds)


def features(node: dom.Node, parent: str = "") -> tuple[list[str], str]:
    """Features of a node below an element ``parent``, and the kind of the edge
    to it."""
    out = [f"inline={node.tag}"] if node.inline else ["bias", f"tag={node.tag}", f"tag={parent}>{node.tag}"]
    part = node.tag in _PARTS
    if node.attrs:
        values = node.attributes()
        tokens = {t.lower() for a in _NAMED for t in _TOKEN.findall(values.get(a, ""))}
        out += [f"name={t}" for t in sorted(tokens) if len(t) > 1]
        part = part or bool(tokens)
    if node.inline:  # its text is a part of the parent's
        return out, "inline"
    size = _bucket(node.chars, 1, 40, 120, 300)
    out += [f"chars={size}", f"chars={node.tag}:{size}"]
    if node.chars:
        out.append(f"links={_bucket(node.link_chars / node.chars, 0.01, 0.5)}")
    return out, "part" if part else "flow"


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    m = max(a, b)
    return m + math.log(math.exp(a - m) + math.exp(b - m))


def all_features(page: dom.Page) -> list[tuple[list[str], str]]:
    return [features(n, page.nodes[n.parent].tag if n.parent >= 0 else "") for n in page.nodes]


def marginals(page: dom.Page, w: Weights, told: list[tuple[list[str], str]] | None = None
              ) -> tuple[list[float], list[tuple[float, ...]]]:
    """P(content) of every node, and the four joint probabilities of parent
    and child for every edge (by child)."""
    nodes = page.nodes
    told = told or all_features(page)
    up = [[0.0, sum(w.get(f, 0.0) for f in fs)] for fs, _ in told]  # evidence at and below a node
    pair = {k: [[w.get(f"edge={k}{a}{b}", 0.0) for b in (0, 1)] for a in (0, 1)] for k in ("part", "flow", "inline")}
    sent = [(0.0, 0.0)] * len(nodes)
    for c in range(len(nodes) - 1, 0, -1):  # children come after their parents
        e, (u0, u1) = pair[told[c][1]], up[c]
        sent[c] = (_add(u0 + e[0][0], u1 + e[0][1]), _add(u0 + e[1][0], u1 + e[1][1]))
        above = up[nodes[c].parent]
        above[0] += sent[c][0]
        above[1] += sent[c][1]
    down = [(0.0, 0.0)] * len(nodes)
    one = [0.0] * len(nodes)
    joint: list[tuple[float, ...]] = [()] * len(nodes)
    for c, node in enumerate(nodes):
        if c:
            p = node.parent
            # the parent's belief without what this child told it
            b0, b1 = (up[p][y] + down[p][y] - sent[c][y] for y in (0, 1))
            e = pair[told[c][1]]
            down[c] = (_add(b0 + e[0][0], b1 + e[1][0]), _add(b0 + e[0][1], b1 + e[1][1]))
            logs = [b + e[y][x] + up[c][x] for y, b in ((0, b0), (1, b1)) for x in (0, 1)]
            z = _add(_add(logs[0], logs[1]), _add(logs[2], logs[3]))
            joint[c] = tuple(math.exp(v - z) for v in logs)
        t0, t1 = up[c][0] + down[c][0], up[c][1] + down[c][1]
        one[c] = math.exp(t1 - _add(t0, t1))
    return one, joint


def truth(page: dom.Page) -> list[int]:
    """Labels of a labelled page: ``data-y``, inherited, 0 at the root."""
    out = [0] * len(page.nodes)
    for k, node in enumerate(page.nodes[1:], 1):
        y = node.attributes().get("data-y")
        out[k] = out[node.parent] if y is None else int(y)
    return out


def train(sources: list[str], rounds: int = 80, rate: float = 0.3, decay: float = 0.001) -> Weights:
    """Weights that climb the pages' likelihood (full gradients, AdaGrad)."""
    pages = [dom.parse(s) for s in sources]
    labels = [truth(p) for p in pages]
    told = [all_features(p) for p in pages]
    w: Weights = defaultdict(float)
    seen: Weights = defaultdict(float)
    for _ in range(rounds):
        grad: Weights = defaultdict(float)
        for page, y, known in zip(pages, labels, told):
            one, joint = marginals(page, w, known)
            for k, node in enumerate(page.nodes):
                fs, kind = known[k]
                for f in fs:
                    grad[f] += y[k] - one[k]
                if k:
                    for i, p in enumerate(joint[k]):
                        a, b = divmod(i, 2)
                        grad[f"edge={kind}{a}{b}"] += (y[node.parent] == a and y[k] == b) - p
        for f in grad:
            g = grad[f] - decay * len(pages) * w[f]
            seen[f] += g * g
            w[f] += rate * g / math.sqrt(seen[f] + 1e-9)
    return dict(w)


def main_text(source: str | None, w: Weights) -> str:
    page = dom.parse(source)
    if not page.blocks:
        return ""
    one, _ = marginals(page, w)
    texts = (" ".join("".join(text for node, text in block if one[node] > 0.5).split()) for block in page.blocks)
    return "\n\n".join(filter(None, texts))


@functools.cache
def default_weights() -> Weights:
    """Weights of the labelled pages, fitted once in a process."""
    return train(labelled_pages.pages())


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    w = default_weights() if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py(), w) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
