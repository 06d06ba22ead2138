import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinframe.llm import induced, suffixes


def plain(texts, size):
    """What is removed of each text, from all its windows."""
    seen = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - size + 1):
            seen.setdefault(t[i:i + size], []).append((d, i))
    out = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                out[d][i:i + size] = True
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(2, 257), max_size=80), st.integers(0, 3))
def test_suffix_order(symbols, fold):
    text = np.array([2 + (s - 2) % (2, 3, 7, 256)[fold] for s in symbols] + [0], np.uint16)
    plainly = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert induced.sort_suffixes(text, 10_000).tolist() == plainly
    assert induced.sort_suffixes(text, 10_000, memory=40).tolist() == plainly  # queues and arrays on disk


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), max_size=6), st.integers(1, 12))
def test_repeated_windows(strings, size):
    covered = plain(strings, size)
    found = induced.repeated_windows(strings, size, memory=64)
    for s, starts, want in zip(strings, found, covered):
        got = np.zeros(len(s), bool)
        for i in starts:
            got[i:i + size] = True
        assert np.array_equal(got, want)


def test_equal_windows_choose_alike():
    rng = random.Random(2)
    shared = bytes(rng.choice(b"abc ") for _ in range(700))
    texts = [bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 400))) + shared + bytes(rng.choice(b"abc ") for _ in range(50)) for _ in range(6)]
    chosen = []
    for t in texts:
        gram, at, n, gap = suffixes.contexts(np.frombuffer(t, np.uint8), np.zeros(len(t), np.int32))
        assert all(a + k - 1 <= a + d <= a + 200 - suffixes.GRAM for a, k, d in zip(at, n, gap))  # each window holds its gram
        by = {int(a) + i: (int(g)) for g, a, k in zip(gram, at, n) for i in range(int(k))}
        assert sorted(by) == list(range(len(t) - 199))  # each window once
        begin = t.index(shared)
        chosen.append([by[begin + i] for i in range(501)])
    assert all(c == chosen[0] for c in chosen)


def test_contexts_left_out_share_no_window():
    rng = random.Random(6)
    size, texts = 200, []
    core = bytes(rng.choice(b"abcdefgh ") for _ in range(260))
    for _ in range(60):
        lo, hi = sorted((rng.randint(0, 120), rng.randint(140, 260)))
        texts.append(bytes(rng.choice(b"xyz ") for _ in range(rng.randint(0, 150))) + core[lo:hi] + bytes(rng.choice(b"xyz ") for _ in range(rng.randint(0, 150))))
    grams, bodies, gaps = [], [], []
    for t in texts:
        for g, a, k, d in zip(*suffixes.contexts(np.frombuffer(t, np.uint8), np.zeros(len(t), np.int32), size)):
            grams.append(int(g))
            bodies.append(t[a:a + k + size - 1])
            gaps.append(int(d))
    kept = suffixes.alike(grams, bodies, gaps, size)
    repeated = [i for i, gone in enumerate(plain(bodies, size)) if gone.any()]
    assert set(repeated) <= set(kept) and 0 < len(repeated) and len(kept) < len(bodies)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(400)] + ["é", "日本"]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(rng.randint(0, 250)) for _ in range(60)]
    shared = [prose(70) for _ in range(4)]
    for i in range(40):
        texts.append(prose(rng.randint(0, 60)) + " " + shared[i % 4][rng.randint(0, 40):] + " " + prose(rng.randint(0, 60)))
    texts += [texts[3], texts[3], texts[5] + "x", "y" + texts[5], "z" * 1000, "abcdefg " * 200, "z" * 199, "z" * 400, None, "", "short"]
    copy = texts[7].split()
    copy[len(copy) // 2:len(copy) // 2 + 1] = ["CHANGED"]
    return [*texts, " ".join(copy), prose(3000) + shared[0] + prose(20)]


@pytest.mark.parametrize("piece", [suffixes.PIECE, 700])
def test_operator(spark, corpus, piece, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", piece)
    monkeypatch.setattr(suffixes, "SHARD", 20_000)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(corpus)], "doc_id long, text string, text_key int").repartition(4)
    rows = {r.doc_id: r for r in suffixes.dedup_substrings(docs).collect()}
    raw = [(t or "").encode() for t in corpus]
    for i, (t, gone) in enumerate(zip(raw, plain(raw, 200))):
        r = rows[i]
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()), i
    assert sum(r.n_removed for r in rows.values()) > 10_000


def test_odd_rows(spark, odd_documents):
    rows = suffixes.dedup_substrings(odd_documents).collect()
    assert len(rows) == 9 and sum(r.doc_id is None for r in rows) == 1
    long = next(r for r in rows if r.doc_id == 6)
    assert long.n_removed == long.n_bytes == 340_000 and all(r.n_removed == 0 for r in rows if r.doc_id != 6)
    assert suffixes.dedup_substrings(odd_documents.limit(0)).count() == 0


def test_contexts_of_one_gram_are_dealt_by_their_halves(spark):
    """A gram with very many surroundings is spread over the shards; contexts that share a half meet, the others are left out."""
    rng = np.random.default_rng(4)
    half, gram = (suffixes.SIZE - suffixes.GRAM + 1) // 2, bytes(suffixes.GRAM)
    sides = [rng.bytes(half) for _ in range(300)]
    bodies = [sides[i // 2] + gram + rng.bytes(half) for i in range(200)] + [rng.bytes(half) + gram + rng.bytes(half) for _ in range(200)]
    rows = [(7, i, b, half, *suffixes.half_hashes(b, half, suffixes.SIZE)) for i, b in enumerate(bodies)]
    parts = spark.createDataFrame(rows, "gram long, context long, body binary, gap int, before long, behind long")
    dealt = [(r.context, r.shard) for r in suffixes.deal(parts, 16).collect()]
    assert sorted(c for c, _ in dealt) == list(range(200))
    shard = dict(dealt)
    assert all(shard[i] == shard[i + 1] for i in range(0, 200, 2)) and len(set(shard.values())) > 8
    assert suffixes.half_hashes(gram, 0, suffixes.SIZE) == (None, None)
