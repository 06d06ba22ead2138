"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows, then flattened into arrays of a complete binary tree, so that a batch of
documents walks all trees at once in numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm.base import crc_of_id, python_ready, query, table

MAX_LABELLED = 20_000  # the classifier is fitted on at most so many labelled rows
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, LEAST = 60, 4, 64, 0.15, 10

FEATURES = ["chars", "words", "word_length", "distinct_words", "top_word", "repeated_next", "lines", "distinct_lines", "line_length",
            "lower", "upper", "digit", "blank", "sentence_sign", "other_sign", "exclamation", "pipe", "beyond_ascii", "control"]

_CLASS = np.zeros(256, np.int64)  # of a UTF-8 byte
_CLASS[:32] = 6
_CLASS[127] = 6
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 0
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_CLASS[list(b"0123456789")] = 2
_CLASS[list(b" \t\n\r")] = 3
_CLASS[list(b".,;:?'\"-()")] = 4
_CLASS[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = 5
_CLASS[128:192] = 8
_CLASS[192:] = 7


def features(text: str | None) -> list[float]:
    """Statistics of one whole text; null as empty, for which all shares are 0."""
    text = text or ""
    n = max(1, len(text))
    kinds = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=9) / n
    words, lines = text.split(), text.split("\n")
    count = Counter(words)
    m = max(1, len(words))
    same = sum(map(str.__eq__, words, words[1:]))
    return [np.log1p(len(text)), np.log1p(len(words)), len(text) / m, len(count) / m, max(count.values(), default=0) / m, same / m,
            np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)),
            *kinds[:6], text.count("!") / n, text.count("|") / n, kinds[7], kinds[6]]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Forest:
    """Trees as arrays [tree, node]; the children of node i are 2i+1 (at most the threshold) and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray  # [tree, leaf]
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        trees, depth = np.arange(len(self.feature)), self.value.shape[1].bit_length() - 1
        node = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        total = self.base + self.value[trees, node - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Boost on logistic loss. Each node takes the best split of the gradient histograms; one without a gain stays a leaf.

    With no rows, or labels of one kind, the score is that kind's rate, kept off 0 and 1 by one row of each.
    """
    width, nodes = x.shape[1], 2 ** depth - 1
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(1) for f in range(width)]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, width), np.int64)
    limit = np.full((width, BINS), np.inf)
    for f, e in enumerate(edges):
        limit[f, :len(e)] = e
    rate_1 = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate_1 / (1 - rate_1)))
    out = Forest(np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes + 1)), base)
    if not len(x) or y.min() == y.max():
        return out
    raw = np.full(len(x), base)
    column = codes + np.arange(width) * BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, here = 2 ** level - 1, 2 ** level
            place = ((node - first)[:, None] * (width * BINS) + column).ravel()
            size = here * width * BINS

            def spread(weights, place=place, size=size, here=here):
                return np.bincount(place, weights=np.repeat(weights, width), minlength=size).reshape(here, width, BINS).cumsum(axis=2)

            g, h, n = spread(grad), spread(hess), spread(np.ones(len(x)))
            g_all, h_all, n_all = g[:, :1, -1:], h[:, :1, -1:], n[:, :1, -1:]
            gain = g ** 2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all ** 2 / (h_all + 1)
            gain[(n < LEAST) | (n_all - n < LEAST)] = -1
            best = gain.reshape(here, -1).argmax(axis=1)
            good = gain.reshape(here, -1)[np.arange(here), best] > 1e-6
            f, b = best // BINS, best % BINS
            out.feature[t, first:first + here] = np.where(good, f, 0)
            out.threshold[t, first:first + here] = np.where(good, limit[f, b], np.inf)
            node = 2 * node + 1 + (x[np.arange(len(x)), out.feature[t, node]] > out.threshold[t, node])
        leaf = node - nodes
        g, h = (np.bincount(leaf, weights=w, minlength=nodes + 1) for w in (grad, hess))
        out.value[t] = rate * g / (h + 1)
        raw += out.value[t, leaf]
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
                max_labelled: int = MAX_LABELLED) -> Forest:
    """Fit on labelled documents of the learning folds (CRC-32 of the key mod 5 is not 0).

    A bounded sample is drawn by a hash of the key, at a rate set by the number of labelled keys, so it falls evenly
    on all documents. Null keys and labels are left out; of several labels of one key the smallest holds, and a key
    with several documents gives each of them.
    """
    python_ready(docs.sparkSession)
    marked = (labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & (crc_of_id(key) % 5 != 0))
              .groupBy(F.col(key).alias("key")).agg(F.min(label).alias("label")))
    total = marked.count()
    rate = min(1.0, 0.95 * max_labelled / max(1, total))
    drawn = F.pmod(F.xxhash64(F.lit(7), F.col("key").cast("string")), F.lit(1_000_000)) < int(rate * 1_000_000)
    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("key").isNotNull() & (crc_of_id("key") % 5 != 0) & drawn)

    @F.arrow_udf("array<double>")
    def stats(texts: pa.Array) -> pa.Array:
        return pa.array([features(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    rows = (chosen.join(marked.filter(drawn), "key").select("label", stats("text").alias("x"), F.xxhash64("key", "text").alias("h"))
            .limit(2 * max_labelled).collect())
    rows.sort(key=lambda r: r.h)
    rows = rows[:max_labelled]
    return fit_forest(np.array([r.x for r in rows], np.float64).reshape(len(rows), len(FEATURES)), np.array([float(r.label > 0) for r in rows]))


def score_quality(docs: DataFrame, forest: Forest, text: str = "text", name: str = "score") -> DataFrame:
    """docs with one more column, the probability of good quality of each whole text; null as empty.

    Equal texts get equal scores. An existing column of that name is replaced.
    """
    python_ready(docs.sparkSession)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [forest.score(matrix(batch.slice(at, 500).to_pylist())) for at in range(0, len(batch), 500)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return docs.withColumn(name, score(F.col(text)))


def keep_good(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns only."""
    scored = score_quality(docs, forest, name="_quality_score")
    return scored.filter(F.col("_quality_score") >= threshold).drop("_quality_score")


@query("op7_quality_classifier")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    forest = fit_quality(docs, table(spark, folder, "labels"))
    scored = score_quality(docs, forest)
    return scored.select("doc_id", (crc_of_id("doc_id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
