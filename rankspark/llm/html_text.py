"""Main text of web pages by a graphical model on the tree of their blocks.

Each node of a page's tree (:mod:`html_tree`) is article text or not. A page's labelling has a
potential for every node (a weighted sum of binary features: tag, what class and id say of the node
and of those around it, length, links, place) and one for every parent and child (by both labels and
the child's kind). The tree has no cycles, so sum-product messages, upward from the leaves and then
downward from the root, give the exact probability of each node; the leaves that are more likely
text than not are the text, in page order.

The weights maximise the likelihood of labelled pages; the gradient comes from the same messages.
Labelled are pages of the table that mark their article themselves (one ``article`` or ``main``),
at most ``TRAIN_PAGES`` of at most ``TRAIN_CHARS`` characters, the same text in ``LAYOUTS`` other
layouts each, and ``INVENTED`` invented pages, so that a table without marks has a model too. A page
is never judged by its mark alone: the layouts put articles into plain elements as well, and menus,
adverts, notices, forms and comments inside articles.

Defined cases: a null or empty page has an empty text, as has one without any text that is likelier
article; null and repeated ids are rows like any other; line breaks and all other white space in a
block become one space; an empty table gives an empty result; other columns are kept by ``extract``
unless they bear the names of its results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rankspark import session
from rankspark.llm import html_layouts, html_tree
from rankspark.llm.registry import query
from rankspark.llm.texts import row_slices, table

#: Bounds of the training sample: pages of the table, their characters, layouts of each, invented pages, nodes of a page.
TRAIN_PAGES, TRAIN_CHARS, LAYOUTS, INVENTED, TRAIN_NODES = 150, 32_768, 3, 250, 2_000
KINDS = 4
STEPS, RATE, RIDGE = 250, 0.08, 2e-4


# ---------------------------------------------------------------- messages


def _sent(unary: float, potential: tuple[float, float, float, float]) -> float:
    """Log ratio (parent is text : is not) that a child with log odds ``unary`` sends. Potentials: 00, 01, 10, 11 (parent, child)."""
    a, b, c, d = potential
    if unary > 0:
        e = math.exp(-unary)
        return math.log(c * e + d) - math.log(a * e + b)
    e = math.exp(unary)
    return math.log(c + d * e) - math.log(a + b * e)


def marginals(unary: list[float], parents: list[int], kinds: list[int], potentials: list[tuple[float, float, float, float]]) -> list[float]:
    """Log odds of each node being text. Parents come before their children; the first node is the root."""
    n = len(unary)
    upward, messages = list(unary), [0.0] * n
    for i in range(n - 1, 0, -1):
        messages[i] = _sent(upward[i], potentials[kinds[i]])
        upward[parents[i]] += messages[i]
    belief = list(upward)
    turned = [(a, c, b, d) for a, b, c, d in potentials]
    for i in range(1, n):
        # What the parent knows without this child, seen through the edge from the other side.
        belief[i] = upward[i] + _sent(belief[parents[i]] - messages[i], turned[kinds[i]])
    return belief


class Model:
    """Weights of the features (log odds of text) and log potentials (kind, parent's label, child's label)."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.weights = weights.tolist()
        self.potentials = [tuple(np.exp(p.reshape(-1) - p.max()).tolist()) for p in pairs]

    def log_odds(self, nodes: list[html_tree.Node]) -> list[float]:
        own = self.weights
        unary = [sum([own[f] for f in fs]) for fs in html_tree.features(nodes)]
        return marginals(unary, [n.parent for n in nodes], html_tree.edge_kinds(nodes), self.potentials)

    def text(self, page: str) -> str:
        """The article's blocks, joined by an empty line."""
        nodes = html_tree.read(page)
        if len(nodes) == 1:
            return ""
        return "\n\n".join([n.text for n, odds in zip(nodes, self.log_odds(nodes), strict=True) if n.leaf and n.chars and odds >= 0])


# ---------------------------------------------------------------- training pages


def labels_of(nodes: list[html_tree.Node]) -> list[int] | None:
    """Labels of a training page's nodes: by its marks, or by its only article; None if it has neither."""
    marked = any(n.label is not None for n in nodes)
    roots = [i for i, n in enumerate(nodes) if not n.leaf and n.tag in ("article", "main")]
    if not marked and len(roots) != 1:
        return None
    own, text = [0] * len(nodes), [0] * len(nodes)
    for i, n in enumerate(nodes):
        above = own[n.parent] if n.parent >= 0 else 0
        if marked:
            own[i] = above if n.label is None else int(n.label == "1")
        elif i == roots[0]:
            own[i] = 1
        else:
            own[i] = int(above and n.tag not in html_tree.LANDMARKS) if not n.leaf else above
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i].leaf:
            text[i] = own[i] * nodes[i].chars
        if i:
            text[nodes[i].parent] += text[i]
    # An element is text if more than half of what it holds is.
    return [own[i] if n.leaf else int(2 * text[i] > n.chars) for i, n in enumerate(nodes)]


def _example(page: str) -> tuple[list[list[int]], list[int], list[int], list[int]] | None:
    """(features, parents, kinds, labels) of a training page."""
    nodes = html_tree.read(page)
    labels = labels_of(nodes) if 1 < len(nodes) <= TRAIN_NODES else None
    return labels and (html_tree.features(nodes), [n.parent for n in nodes], html_tree.edge_kinds(nodes), labels)


def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the training pages of each sampled page: itself and its text in other layouts."""
    for batch in row_slices(batches, 16):
        out: dict[str, list] = {c: [] for c in ("sizes", "features", "parents", "kinds", "labels")}
        for seed, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            pages = [page]
            if page:
                nodes = html_tree.read(page)
                labels = labels_of(nodes)
                if labels and any(labels):
                    kept = [n for n, y in zip(nodes, labels, strict=True) if n.leaf and y and n.chars]
                    words = [w for n, y in zip(nodes, labels, strict=True) if n.leaf and not y for w in n.text.split()]
                    words += [w for n in kept[:3] for w in n.text.split()[:40]]
                    pages += html_layouts.layouts(seed, [("h1" if n.tag == "h1" else "p", n.text) for n in kept], words, LAYOUTS)
            else:
                pages = html_layouts.layouts(seed, [], [], 1)
            for found in filter(None, map(_example, pages)):
                for name, value in zip(("features", "parents", "kinds", "labels"), found, strict=True):
                    if name == "features":
                        out["sizes"].append([len(f) for f in value])
                        value = [x for f in value for x in f]
                    out[name].append(value)
        yield pa.record_batch({k: pa.array(v, pa.list_(pa.int32())) for k, v in out.items()})


def training_pages(pages: DataFrame) -> DataFrame:
    """(seed, html): a bounded sample, chosen by ids first, and a null for each invented page."""
    spark = pages.sparkSession
    fit = pages.where(F.length("html").between(1, TRAIN_CHARS)).select(F.col("page_id").cast("string").alias("seed"), "html")
    order = F.xxhash64("seed", F.lit(13))
    # Only ids and hashes are sorted; a repeated id brings its rows along, up to the bound.
    chosen = fit.where(F.col("html").rlike("(?i)<(article|main)[\\s>]")).select("seed").where("seed is not null").orderBy(order, "seed").limit(TRAIN_PAGES)
    some = fit.join(F.broadcast(chosen.distinct()), "seed", "left_semi").limit(TRAIN_PAGES)
    invented = spark.range(INVENTED).select(F.concat(F.lit("invented "), F.col("id")).alias("seed"), F.lit(None).cast("string").alias("html"))
    return some.unionByName(invented)


# ---------------------------------------------------------------- fit


class _Trees:
    """All training pages as one forest, by depth."""

    def __init__(self, rows: list[dict]):
        at, parents = 0, []
        for r in rows:
            own = np.array(r["parents"])
            parents.append(np.where(own < 0, -1, own + at))
            at += len(own)
        join = lambda c: np.concatenate([np.array(r[c], np.int64) for r in rows])
        self.parents, self.kinds, self.labels = np.concatenate(parents), join("kinds"), join("labels")
        self.sizes, self.features = join("sizes"), join("features")
        # Every node has features, so each has a place of its own in the list.
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]]
        depth = np.zeros(at, np.int64)
        for i, p in enumerate(self.parents.tolist()):
            depth[i] = depth[p] + 1 if p >= 0 else 0
        self.levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max()) + 1)]
        self.pages = len(rows)
        child = np.flatnonzero(self.parents >= 0)
        self.seen = self.edge_sums(child, self.labels[self.parents[child]] * 2 + self.labels[child])

    def edge_sums(self, child: np.ndarray, cell: np.ndarray, share: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.kinds[child] * 4 + cell, share, KINDS * 4).reshape(KINDS, 2, 2)

    def expected(self, weights: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of text of each node, expected counts of the edges' labels) by messages up and down, as log odds."""
        upward = np.add.reduceat(weights[self.features], self.starts)
        sent = np.zeros_like(upward)
        for level in reversed(self.levels):
            own, (a, b, c, d) = upward[level], pairs.reshape(KINDS, 4)[self.kinds[level]].T
            sent[level] = np.logaddexp(c, d + own) - np.logaddexp(a, b + own)
            upward += np.bincount(self.parents[level], sent[level], len(upward))
        belief = upward.copy()
        counts = np.zeros((KINDS, 2, 2))
        for level in self.levels:
            own, (a, b, c, d) = upward[level], pairs.reshape(KINDS, 4)[self.kinds[level]].T
            without = belief[self.parents[level]] - sent[level]
            none, some = np.logaddexp(a, c + without), np.logaddexp(b, d + without)
            belief[level] = own + some - none
            total = np.logaddexp(none, some + own)
            for cell, term in enumerate((a, b + own, c + without, d + without + own)):
                counts += self.edge_sums(level, np.full(len(level), cell), np.exp(term - total))
        return 1 / (1 + np.exp(np.clip(-belief, -500, 500))), counts

    def ascent(self, weights: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Gradient of the mean log likelihood of a page."""
        p, counts = self.expected(weights, pairs)
        own = np.bincount(self.features, np.repeat(self.labels - p, self.sizes), len(weights))
        return np.concatenate([own, (self.seen - counts).reshape(-1)]) / self.pages


def fitted(rows: list[dict], steps: int = STEPS) -> Model:
    """Maximum likelihood weights by gradient steps of adaptive size (first and second moments), with a ridge."""
    trees = _Trees(rows)
    n_weights = len(html_tree.NAMES)
    theta = np.zeros(n_weights + KINDS * 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        ascent = trees.ascent(theta[:n_weights], theta[n_weights:].reshape(KINDS, 2, 2)) - RIDGE * theta
        first, second = 0.9 * first + 0.1 * ascent, 0.99 * second + 0.01 * ascent**2
        theta += RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return Model(theta[:n_weights], theta[n_weights:].reshape(KINDS, 2, 2))


def fit(pages: DataFrame) -> Model:
    """The model of a table's own labelled pages (page_id, html) and their layouts; bounded, so fitted on the driver."""
    schema = ", ".join(f"{c} array<int>" for c in ("sizes", "features", "parents", "kinds", "labels"))
    rows = training_pages(pages).mapInArrow(examples, schema).collect()
    # Sums of floats depend on the order of the pages.
    return fitted(sorted((r.asDict() for r in rows), key=lambda r: (r["parents"], r["features"])))


# ---------------------------------------------------------------- extraction


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """The rows without their html, with ``text`` and ``n_chars``."""
    others = [c for c in pages.columns if c.lower() not in ("html", "text", "n_chars")]
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in row_slices(batches, 64):
            found = [own.text(page) if page else "" for page in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                [*batch.schema.names[:-1], "text", "n_chars"])

    rows = pages.select(*[pages[c] for c in others], "html")
    return rows.mapInArrow(texts, StructType([*rows.drop("html").schema, StructField("text", StringType()), StructField("n_chars", LongType())]))


@query("op13_html_text")
def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages)).select("page_id", "url", "text", "n_chars")
