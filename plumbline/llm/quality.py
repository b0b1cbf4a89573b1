"""Quality classifier: histogram gradient-boosted trees over statistics of the text.

The trees are fitted on a bounded sample of labelled documents: their statistics are at most SAMPLE rows of some thirty
numbers. All documents are scored where they lie, by trees flattened into arrays that numpy walks level by level.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import third
from plumbline.llm.rowwise import with_scores

SAMPLE = 20_000  # labelled documents learnt from: those with the smallest hashes of their ids
TREES, DEPTH, RATE, BINS = 120, 4, 0.1, 64
LEAST_LEAF, L2 = 10, 1.0

GROUPS = {"stop": ".!?", "comma": ",;:", "bar": "|", "loud": "!", "symbol": "*#$%&@", "code": "{}[]<>=\\_/+", "bracket": "()", "quote": "'\"", "hyphen": "-", "line": "\n"}
DIGITS, CAPITALS = re.compile(r"\d"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NAMES = ["chars", "words", "distinct_share", "word_length", "longest_word", "lines", "line_words", "distinct_lines", "commonest_word", "digits", "capitals", "not_ascii", *GROUPS, "ends_with_stop", "title_words", "distinct_pairs"]


def statistics(text: str | None) -> list[float]:
    """NAMES of a whole text; all 0 for a null or empty one."""
    if not text:
        return [0.0] * len(NAMES)
    n = len(text)
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    counted: dict[str, int] = {}
    for w in words:
        counted[w] = counted.get(w, 0) + 1
    m, k = len(words) or 1, len(lines) or 1
    pairs = set(zip(words, words[1:], strict=False))
    raw = text.encode("utf-8", "surrogatepass")
    capitals = sum(map(text.count, CAPITALS)) if text.isascii() else sum(map(str.isupper, text))
    return [
        np.log1p(n), np.log1p(len(words)), len(counted) / m, (n - text.count(" ")) / m, float(max(map(len, words), default=0)), np.log1p(len(lines)), len(words) / k, len(set(lines)) / k,
        max(counted.values(), default=0) / m, len(DIGITS.findall(text)) / n, capitals / n, (len(raw) - n) / n,
        *[sum(map(text.count, marks)) / n for marks in GROUPS.values()], float(text.rstrip()[-1:] in ".!?"), sum(w[0].isupper() for w in words) / m, len(pairs) / m,
    ]


@dataclass
class Trees:
    """Trees of equal depth as arrays: node i of a level has children 2i and 2i + 1 in the next; a leaf passes all to the left."""

    base: float
    feature: np.ndarray  # (trees, 2 ** depth - 1)
    bound: np.ndarray  # values above it go right
    leaf: np.ndarray  # (trees, 2 ** depth)


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(column)
    if len(values) <= bins:
        return (values[:-1] + values[1:]) / 2
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Boosting on logistic loss. Each level sums gradients and curvatures of every feature's bins and takes the best cut of each node."""
    rows, features = x.shape
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6) if rows else 0.5
    model = Trees(float(np.log(share / (1 - share))), np.zeros((trees, 2**depth - 1), np.int32), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)))
    if not rows or y.min() == y.max():
        return model
    edges = [_edges(x[:, f], bins) for f in range(features)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    score = np.full(rows, model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, curve = y - p, p * (1 - p)
        node = np.zeros(rows, np.int64)
        for level in range(depth):
            at, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-9)
            cut = np.full(nodes, -1)
            which = np.zeros(nodes, np.int64)
            for f in range(features):
                place = node * bins + binned[:, f]
                g, h, n = (np.bincount(place, w, nodes * bins).reshape(nodes, bins).cumsum(1) for w in (grad, curve, None))
                gain = g**2 / (h + L2) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + L2) - g[:, -1:] ** 2 / (h[:, -1:] + L2)
                gain[(n < LEAST_LEAF) | (n[:, -1:] - n < LEAST_LEAF)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(nodes), top] > best
                best[better], cut[better], which[better] = gain[np.arange(nodes), top][better], top[better], f
            for i in np.flatnonzero(cut >= 0):
                model.feature[t, at + i], model.bound[t, at + i] = which[i], edges[which[i]][cut[i]]
            right = (cut[node] >= 0) & (binned[np.arange(rows), which[node]] > cut[node])
            node = 2 * node + right
        g, h = np.bincount(node, grad, 2**depth), np.bincount(node, curve, 2**depth)
        model.leaf[t] = rate * g / (h + L2)
        score += model.leaf[t][node]
    return model


def score_rows(model: Trees, x: np.ndarray) -> np.ndarray:
    """Share for label 1, all rows and trees at once, a level at a time."""
    rows, (trees, inner) = np.arange(len(x))[:, None], model.feature.shape
    node, tree = np.zeros((len(x), trees), np.int64), np.arange(trees)
    at = 0
    while at < inner:
        spot = at + node
        node = 2 * node + (x[rows, model.feature[tree, spot]] > model.bound[tree, spot])
        at = 2 * at + 1
    return 1 / (1 + np.exp(-(model.base + model.leaf[tree, node].sum(1))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Learns labels.quality from the text of documents whose id's remainder is not 1; at most ``sample`` of them.

    An id labelled more than once counts once, with label 1 if at least half of its labels are. Null labels and ids are
    left out. Without labels every score is a half; with labels of one kind, near that label.
    """
    once = labels.where((third() != 1) & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    chosen = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded by the parameter
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    got = with_scores(known.select("doc_id", "label", "text"), [T.StructField("x", T.ArrayType(T.DoubleType()))], lambda texts: [pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))])
    seen = got.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample).select("label", "x").toPandas()
    return fit_trees(np.array(seen["x"].tolist()).reshape(-1, len(NAMES)), seen["label"].to_numpy(float))


def predict(docs: DataFrame, model: Trees) -> DataFrame:
    """``docs`` with score (0 to 1, higher: label 1 likelier) and predicted (1 from 0.5 on) of every whole text."""

    def score(texts: list) -> list[pa.Array]:
        made = np.concatenate([np.zeros(0), *[score_rows(model, np.array([statistics(t) for t in texts[lo : lo + 1000]])) for lo in range(0, len(texts), 1000)]])
        return [pa.array(made, pa.float64()), pa.array((made >= 0.5).astype(np.int32))]

    return with_scores(docs, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], score)
