import os

import numpy as np
import pytest

from twinframe.llm import language

FOLDER = "/root/testdata/sf0.01"


def slow_mixture(counts, chances, allowed, rounds):
    share = [a / sum(allowed) for a in allowed]
    for _ in range(rounds):
        new = [0.0] * len(share)
        for g, c in enumerate(counts):
            total = sum(s * p[g] for s, p in zip(share, chances))
            for k in range(len(share)):
                new[k] += c * share[k] * chances[k][g] / total
        share = [x / sum(counts) for x in new]
    return share


def test_mixture_equals_plain_steps():
    rng = np.random.default_rng(1)
    chances = rng.dirichlet(np.ones(20), 3)
    counts = rng.integers(0, 9, (5, 20))
    allowed = np.array([[1, 1, 1], [1, 0, 1], [1, 1, 1], [0, 1, 0], [1, 1, 0]], float)
    share, fit = language.mixture(counts, chances, allowed, 7)
    for i in range(5):
        assert np.allclose(share[i], slow_mixture(counts[i].tolist(), chances.tolist(), allowed[i].tolist(), 7))
        assert np.isclose(fit[i], (counts[i] * np.log(share[i] @ chances)).sum())


def test_proportions_and_set_of_a_mixed_text():
    rng = np.random.default_rng(2)
    model = language.Languages(["a", "b", "c", "d"], rng.dirichlet(np.full(language.BUCKETS, 0.05), 4) + 1e-9)
    model.chances /= model.chances.sum(axis=1, keepdims=True)
    true = np.array([[1, 0, 0, 0], [0.7, 0.3, 0, 0], [0.5, 0, 0.3, 0.2]])
    counts = np.array([rng.multinomial(3000, (t @ model.chances) / (t @ model.chances).sum()) for t in true])
    found = language.infer(counts, model)
    assert np.abs(found - true).max() < 0.05 and np.array_equal(found > 0, true > 0)


def test_held_out_accuracy(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables are not here")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = language.identify(docs, language.fit_languages(docs)).filter("crc32(cast(doc_id as string)) % 4 = 2").collect()
    assert len(rows) > 150 and np.mean([r.language.lang == r.lang for r in rows]) > 0.98
    assert all(0 <= r.language.share <= 1 for r in rows)


def test_held_out_labels_are_not_read(spark):
    rows = [(i, "some words here", "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    changed = docs.withColumn("lang", language.F.when(language.crc_of_id("doc_id") % 4 == 2, "xx").otherwise(docs.lang))
    assert language.fit_languages(changed).names == ["en"]


def test_odd_rows(spark, odd_documents):
    docs = odd_documents.withColumn("lang", language.F.when(odd_documents.doc_id == 5, "en").when(odd_documents.doc_id == 6, "xx"))
    model = language.fit_languages(docs)
    rows = language.identify(docs, model, name="n_tokens").collect()
    assert len(rows) == 9 and all(r.n_tokens.lang == "und" for r in rows if r.doc_id in (1, 2, 3, 8))
    nothing = language.fit_languages(docs.limit(0))
    assert nothing.names == [] and {r.language.lang for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_many_languages_and_no_influence_of_neighbours():
    """A document in nine languages keeps them all, and what a document gets does not hang on the others of its batch."""
    rng = np.random.default_rng(9)
    chances = np.full((10, 200), 1e-4)
    for i in range(10):
        chances[i, 20 * i:20 * i + 20] = 1
    chances /= chances.sum(axis=1, keepdims=True)
    model = language.Languages([f"l{i}" for i in range(10)], chances)
    counts = np.array([rng.multinomial(4000, share @ chances) for share in ([1 / 9] * 9 + [0], [1] + [0] * 9, [0.5, 0.5] + [0] * 8)], float)
    together = language.infer(counts, model)
    assert [(row > 0).sum() for row in together] == [9, 1, 2]
    for row, alone in zip(together, counts):
        assert np.allclose(language.infer(alone[None], model)[0], row, atol=1e-5)
