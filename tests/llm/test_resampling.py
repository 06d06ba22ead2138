import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinframe.llm import resampling

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(st.sampled_from("abABzZ09é日𝐣 \n\x00,_ "), max_size=60)), max_size=12)


def grams(text, longest):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def bucket(gram, buckets):
    return zlib.crc32(gram.encode()) % buckets


def brute(docs, target, longest=1, buckets=10_000, least=20, percent=10):
    """{key: (features, weight, score, rank)} by plain Python."""
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for g in grams(text, longest):
                counts[bucket(g, buckets)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s.tolist(), t.tolist())]
    rows = []
    for key, text in docs:
        h = int(hashlib.sha256(f"2024:{key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g, buckets)] for g in grams(text, longest))
        rows.append((key, len(grams(text, longest)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), len(grams(text, 1)) >= least))
    may = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0]))
    rank = {r[0]: i + 1 for i, r in enumerate(may[:len(may) * percent // 100])}
    return {r[0]: (*r[1:4], rank.get(r[0])) for r in rows}


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 3), st.booleans())
def test_tables_count_as_python(texts, longest, cut):
    before = resampling.BLOCK_BYTES
    resampling.BLOCK_BYTES = 16 if cut else before
    try:
        counts, per_text = np.zeros(97, int), np.zeros(len(texts), int)
        for made, doc, sign, _ in resampling.tables(pa.array(texts, pa.string()), longest, 97):
            np.add.at(counts, made.bucket, sign * made.count)
            np.add.at(per_text, doc, sign)
    finally:
        resampling.BLOCK_BYTES = before
    wanted = np.zeros(97, int)
    for text in texts:
        for g in grams(text, longest):
            wanted[bucket(g, 97)] += 1
    assert counts.tolist() == wanted.tolist() and per_text.tolist() == [len(grams(t, longest)) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcdefgh0é"), min_size=1, max_size=60), min_size=1))
def test_hash_is_xxhash64(words):
    raw = " ".join(words).encode()
    text = resampling.Text(np.frombuffer(raw, np.uint8), np.array([len(raw)]))
    start, size, _ = text.grams(2)
    assert text.xxhash64(start, size).tolist() == [xxhash.xxh64_intdigest(text.of(a, n)) for a, n in zip(start, size)]


def test_equal_hashes_are_told_apart(monkeypatch):
    """With one hash for all n-grams only their bytes differ, and the table still holds each of them once."""
    monkeypatch.setattr(resampling.Text, "xxhash64", lambda self, start, size: np.zeros(len(start), np.uint64))
    words = [f"w{i % 40}" + "x" * (i % 3 * 70) for i in range(400)]
    held = next(resampling.tables(pa.array([" ".join(words)]), 1, 1000))[0]
    assert sorted(held.count[held.count > 0].tolist()) == sorted(words.count(w) for w in set(words))


def test_against_brute_force(spark):
    vocabulary = [f"word{i}" for i in range(300)]
    docs = [(i, " ".join(vocabulary[(i * 7 + j * (i % 11 + 1)) % (300 if i % 3 else 40)] for j in range(i % 60))) for i in range(500)]
    target = [" ".join(vocabulary[:40]), None, "word1 word2"]
    for longest in (1, 2):
        found = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame([(t,) for t in target], "text string"),
                                    longest=longest).collect()
        assert {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in found} == brute(docs, target, longest)


def test_odd_tables(spark, odd_documents):
    target = spark.createDataFrame([("word", 1), (None, 2)], "text string, score int")
    docs = odd_documents.withColumns({"score": F.lit("mine"), "tie": F.lit("kept"), "part": F.lit(3)})
    rows = resampling.resample(docs, target, least_words=2, percent=100).collect()
    assert len(rows) == 9 and {r.tie for r in rows} == {"kept"} and {r.part for r in rows} == {3}
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 1 + sum(r.n_words >= 2 for r in rows)))
    assert [r.n_features for r in rows if r.doc_id in (1, 2, 8)] == [0, 0, 0] and [r.weight for r in rows if r.doc_id in (1, 2, 8)] == [0, 0, 0]
    assert next(r.n_features for r in rows if r.doc_id == 6) == 60_000
    assert resampling.resample(docs.limit(0), target).count() == 0
    assert len(resampling.resample(docs, target.limit(0)).collect()) == 9


def test_ranks_of_repeated_rows(spark):
    """A third of all rows tie in score and key: every rank is given once."""
    docs = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("some words " * 15).alias("text"))
    rows = resampling.resample(docs, docs.select("text"), percent=60).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 541))
