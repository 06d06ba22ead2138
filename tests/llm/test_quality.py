import os
import zlib

import numpy as np
import pytest

from twinframe.llm import quality

FOLDER = "/root/testdata/sf0.1"


def walk(forest, row):
    """One row through one tree after another, by plain steps."""
    total = forest.base
    for t in range(len(forest.feature)):
        node = 0
        while node < forest.feature.shape[1]:
            node = 2 * node + 1 + int(row[forest.feature[t, node]] > forest.threshold[t, node])
        total += forest.value[t, node - forest.feature.shape[1]]
    return 1 / (1 + np.exp(-total))


def test_arrays_equal_plain_walk_and_learn():
    rng = np.random.default_rng(1)
    x = rng.random((800, len(quality.FEATURES)))
    y = ((x[:, 2] > 0.6) & (x[:, 5] < 0.5) | (x[:, 7] > 0.9)).astype(float)
    forest = quality.fit_forest(x[:600], y[:600])
    scores = forest.score(x[600:])
    assert np.allclose(scores, [walk(forest, r) for r in x[600:]])
    assert ((scores > 0.5) == y[600:]).mean() > 0.93


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 20, (300, len(quality.FEATURES))).astype(float)
    y = (x[:, 3] + rng.normal(0, 3, 300) > 11).astype(float)
    forest = quality.fit_forest(x, y, trees=1, depth=1)
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = y - p, np.full(300, p * (1 - p))

    def gain(f, cut):
        left = x[:, f] <= cut
        if min(left.sum(), (~left).sum()) < quality.LEAST:
            return -1
        return sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left))
    best = max((gain(f, c), f, c) for f in range(x.shape[1]) for c in range(20))
    assert np.isclose(best[0], gain(forest.feature[0, 0], forest.threshold[0, 0]))


@pytest.mark.parametrize("y", [np.zeros(0), np.zeros(5), np.ones(5)])
def test_no_rows_or_one_label(y):
    forest = quality.fit_forest(np.zeros((len(y), len(quality.FEATURES))), y)
    score = forest.score(np.zeros((1, len(quality.FEATURES))))[0]
    assert 0 < score < 1 and np.isclose(score, (y.sum() + 1) / (len(y) + 2))


def test_operator_on_odd_rows(spark, odd_documents):
    labels = spark.createDataFrame([(1, 0), (2, 1), (5, 1), (5, 0), (None, 1), (6, None), (99, 1)], "doc_id long, quality int")
    forest = quality.fit_quality(odd_documents, labels)
    rows = quality.score_quality(odd_documents, forest, name="n_tokens").collect()
    assert len(rows) == 9 and all(0 <= r.n_tokens <= 1 for r in rows)
    assert quality.keep_good(odd_documents, forest, 0.0).columns == odd_documents.columns
    empty = odd_documents.limit(0)
    assert quality.score_quality(empty, quality.fit_quality(empty, labels.limit(0))).count() == 0


def test_held_out_accuracy_and_no_leak(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables are not here")
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality.fit_quality(docs, labels)
    held = quality.score_quality(docs.join(labels, "doc_id"), forest).filter("crc32(cast(doc_id as string)) % 5 = 0").select("doc_id", "quality", "score").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    right = [(r.score >= quality.THRESHOLD) == (r.quality == 1) for r in held]
    assert len(held) > 500 and np.mean(right) > 0.97
    flipped = labels.withColumn("quality", (labels.doc_id % 2).cast("int")).filter("crc32(cast(doc_id as string)) % 5 = 0").unionByName(labels.filter("crc32(cast(doc_id as string)) % 5 <> 0"))
    again = quality.fit_quality(docs, flipped)
    assert np.array_equal(again.value, forest.value) and np.array_equal(again.feature, forest.feature)
