import os

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from twinframe.llm import packing, pii, quality, simhash

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def leaked(text, items):
    """A plain search: half of an item's words in a row."""
    words = " ".join(("".join(c if c.isalnum() else " " for c in (text or "").lower())).split())
    for item in items:
        w = "".join(c if c.isalnum() else " " for c in item.lower()).split()
        half = len(w) // 2
        if any(f" {' '.join(w[i:i + half])} " in f" {words} " for i in range(len(w) - half + 1)):
            return True
    return False


@pytest.fixture(scope="module")
def expected(spark):
    """Each stage again, one document after another."""
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables are not here")
    docs = duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall()
    items = [r[0] for r in duckdb.sql(f"select text from '{FOLDER}/benchmark.parquet'").fetchall()]
    forest = quality.fit_quality(*(spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels")))
    good = [(i, t) for i, t in docs if forest.score(quality.matrix([t]))[0] >= 0.3]
    prints = [simhash.fingerprint(t) for _, t in good]
    label = list(range(len(good)))
    for _ in good:
        for i, p in enumerate(prints):
            label[i] = min(label[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 3)
    ids = [i for i, _ in good]
    least = {}
    for i, group in zip(ids, label):
        least[group] = min(i, least.get(group, i))
    single = [(i, t) for i, t in good if i in set(least.values())]
    clean = [(i, t) for i, t in single if not leaked(t, items)]
    return docs, good, single, clean, [(i, pii.mask(t, pii.personal_spans(t)[1])) for i, t in clean]


def test_stages_one_by_one(spark, expected):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES[:4], expected[1:]):
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == COLUMNS, name
        assert sorted(map(tuple, docs.select("doc_id", "text").collect())) == sorted(want), name


def test_run(spark, expected):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    tokens = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(tokens.many([t])[0]) // 4 + 1 for i, t in expected[4]}
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist() and sum(n for _, n in parts) <= 2048


def test_odd_and_empty(spark):
    rows = [(i, t, None, "s", None) for i, t in enumerate([None, "", "a", "a", "word " * 30_000, "bob@x.io and some more words here"])] + [(None, "x", "en", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        at = table
        for name, stage in corpus_pipeline.STAGES:
            if name == "quality classifier" and not os.path.isdir(FOLDER):
                continue
            at = stage(spark, at, FOLDER).cache()
            assert at.columns == COLUMNS or name == "best-fit packing"
        assert (at.count() == 0) == (table.count() == 0)
