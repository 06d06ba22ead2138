import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinframe.llm import decontaminate as dc


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=20), st.lists(st.integers(0, 4), max_size=20))
def test_common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    assert dc.common_subsequence(a, b) == row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB 1.-é\n 日"))), max_size=6))
def test_words(texts):
    """Equal words get equal numbers, whatever stands around them."""
    import re
    split = [re.findall("[0-9a-z\u0080-\U0010ffff]+", (t or "").lower()) for t in texts]
    codes = dc.word_codes(texts)
    assert [len(c) for c in codes] == [len(s) for s in split]
    known = {}
    for words, numbers in zip(split, codes):
        for w, n in zip(words, numbers.tolist()):
            assert known.setdefault(w, n) == n


def test_right_vectors_are_those_of_the_svd():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((300, 8)) @ np.diag([50, 40, 30, 20, 1e-3, 1e-3, 1e-3, 1e-3]) @ rng.standard_normal((8, 60))
    random = rng.standard_normal((60, 12))
    found, values = dc.right_vectors(a.T @ (a @ random), random, 4)
    _, true, rows = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(values, true[:4], rtol=1e-3) and np.allclose(np.abs(np.sum(found * rows[:4].T, axis=0)), 1, atol=1e-3)


def test_sketch_equals_the_matrix_product(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50, int(rng.integers(0, 90)))) for _ in range(40)] + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    codes = dc.encode(docs, "text")
    found, passages = dc.passage_counts(codes)
    rows = []
    for c in dc.word_codes(texts):
        for at in range(0, len(c), dc.PASSAGE):
            row = np.zeros(dc.BUCKETS)
            row[c[at:at + dc.PASSAGE] & (dc.BUCKETS - 1)] = 1
            rows.append(row)
    matrix = np.array(rows)
    assert passages == len(rows) and np.array_equal(found, matrix.sum(axis=0))
    idf = dc.weights(found, passages)
    matrix = matrix * idf
    matrix /= np.sqrt((matrix ** 2).sum(axis=1, keepdims=True))
    random = rng.standard_normal((dc.BUCKETS, 5))
    assert np.allclose(dc.sketch(codes, idf, random), np.c_[matrix.T @ (matrix @ random), matrix.sum(axis=0)], atol=1e-3)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijk"), 7)) for _ in range(4000)]

    def prose(n):
        return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else str(rng.choice(words)) for _ in range(n))
    items = [prose(int(n)) for n in rng.integers(12, 60, 30)]
    docs, truth = [], set()
    for d in range(300):
        text = prose(int(rng.integers(0, 400)))
        if d % 6 == 0:
            k = d // 6 % len(items)
            leak = items[k]
            if d % 12 == 0:  # a paraphrase: a fifth of the words before the answer are others
                w = leak.split()
                w = [str(rng.choice(words)) if i < 0.7 * len(w) and rng.random() < 0.2 else x for i, x in enumerate(w)]
                leak = ", ".join(w).upper()
            cut = int(rng.integers(0, len(text) + 1))
            cut = text.rfind(" ", 0, cut) + 1
            text = f"{text[:cut]}{leak} {text[cut:]}"
            truth.add((d, k))
        docs.append((d, text))
    return docs, [(k, t) for k, t in enumerate(items)], truth


def test_finds_all_leaks_and_nothing_else(spark, corpus):
    docs, items, truth = corpus
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    space = dc.fit_space(docs)
    rows = dc.find_leaks(docs, items, space).selectExpr("doc_id", "explode(leaks) leak").collect()
    assert {(r.doc_id, r.leak.item) for r in rows} == truth
    kept = dc.drop_leaked(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(300)) - {d for d, _ in truth}


def test_benchmark_in_several_lists(spark, corpus, monkeypatch):
    docs, items, truth = corpus
    monkeypatch.setattr(dc, "ITEMS", 7)
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    rows = dc.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"), dc.fit_space(docs)).selectExpr("doc_id", "explode(leaks) leak").collect()
    assert {(r.doc_id, r.leak.item) for r in rows} == truth


def test_odd_rows(spark, odd_documents):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "null id"), (3, "null id"), (None, "same text here")], "item_id long, text string")
    rows = dc.find_leaks(odd_documents, items, dc.fit_space(odd_documents), name="n_tokens").collect()
    assert len(rows) == 9 and all(r.n_tokens == [] for r in rows if not r.text or not r.text.strip())
    empty = odd_documents.limit(0)
    assert dc.find_leaks(empty, items, dc.fit_space(empty)).count() == 0
    assert dc.drop_leaked(odd_documents, items.limit(0)).count() == 9


def test_answers_of_common_words_and_answers_of_their_own(spark):
    """A paraphrase with half to four fifths of the item leaks if the whole answer is there, whatever its words."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijk"), 7)) for _ in range(4000)]

    def prose(n):
        return [str(rng.choice(["the", "of", "and"])) if rng.random() < 0.3 else str(rng.choice(words)) for _ in range(n)]
    docs = [(d, " ".join(prose(200))) for d in range(200)]
    short, asked = prose(18) + ["the", "of", str(words[1]), "and", "the", "of"], prose(24)
    own = ["the", "of", str(words[2]), "and"]

    def paraphrase(question, upto, share):
        """The question with so many of its uncommon words before upto replaced that share of all of them stays."""
        rare = [i for i, w in enumerate(question) if len(w) == 7]
        gone = [i for i in rare if i < upto][::2]
        while len(rare) - len(gone) < share * len(rare):
            gone.pop()
        return [f"zzz{i}" if i in gone else w for i, w in enumerate(question)]
    docs += [(1000, docs[0][1] + " " + " ".join(paraphrase(short, 18, 0.6))), (1001, docs[1][1] + " " + " ".join(paraphrase(asked, 24, 0.6) + own)),
             (1002, docs[2][1] + " " + " ".join(paraphrase(asked, 24, 0.6)))]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(short), " ".join(short[-6:])), (2, " ".join(asked), " ".join(own))], "item_id long, text string, answer string")
    space = dc.fit_space(docs)
    rows = dc.find_leaks(docs, items, space, answer="answer").selectExpr("doc_id", "explode(leaks) leak").collect()
    found = {(r.doc_id, r.leak.item): r.leak for r in rows}
    assert set(found) == {(1000, 1), (1001, 2)}
    assert all(0.5 <= leak.item_share < 0.8 and leak.answer_share == 1 for leak in found.values())


def test_recall_of_short_paraphrases_against_brute_force():
    """Of all texts whose words the verification accepts, at least nine in ten of each band are found."""
    rng = np.random.default_rng(11)
    tongues = [np.array([f"{tongue}{i}" for i in range(3000)]) for tongue in "abcd"]
    often = 1 / np.arange(1, 3001)
    often /= often.sum()

    def prose(n, words):
        return rng.choice(words, n, p=often).tolist()
    items = [(prose(int(n), tongues[t]), tongues[t]) for t in range(4) for n in rng.integers(15, 24, 30)]
    texts = []
    for k in np.repeat(np.arange(len(items)), 8):
        (item, words), rate = items[k], rng.choice([0.2, 0.4, 0.6])
        around = prose(int(rng.integers(40, 200)), words)
        leak = [words[rng.integers(len(words))] if i < 0.75 * len(item) and rng.random() < rate else w for i, w in enumerate(item)]
        cut = int(rng.integers(0, len(around) + 1))
        texts.append((int(k), " ".join(around[:cut] + leak + around[cut:])))
    codes = dc.word_codes([t for _, t in texts] + [" ".join(prose(200, tongues[d % 4])) for d in range(1000)])
    batch = pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in codes], pa.binary())], ["codes"])
    parts = list(dc.passages_of(iter([batch])))
    found, passages = sum(np.bincount(b, minlength=dc.BUCKETS) for b, _ in parts), sum(len(s) for _, s in parts)
    random = rng.standard_normal((dc.BUCKETS, dc.RANK + dc.EXTRA))
    sums = dc.Sketch(dc.weights(found, passages), random)
    for buckets, starts in parts:
        sums.add(buckets, starts)
    space = dc.make_space(sums.out.astype(np.float64), found, random, passages, dc.RANK)
    searcher = dc.Searcher(space, [(k, c, c[len(c) - -(-len(c) // 4):]) for k, c in enumerate(dc.word_codes([" ".join(i) for i, _ in items]))])
    bands = {}
    for (k, _), text, hits in zip(texts, codes, searcher.many(codes[:len(texts)])):
        share = dc.common_subsequence(searcher.telling[k], text.tolist()) / len(searcher.telling[k])
        told = dc.common_subsequence(searcher.answers[k], text.tolist()) / len(searcher.answers[k])
        if share >= dc.VERBATIM or share >= dc.LOOSE and told >= dc.ANSWER:
            bands.setdefault(min(int(share * 10), 8), []).append(k in {h[0] for h in hits})
    assert set(bands) == {5, 6, 7, 8} and all(np.mean(f) >= 0.9 for f in bands.values()), {b: (np.mean(f), len(f)) for b, f in bands.items()}


def test_codes_in_place_of_texts(spark, corpus):
    """Words that were hashed once give the same hits as the texts, also for null and empty ones."""
    docs, items, _ = corpus
    docs = spark.createDataFrame([*docs, (1000, None), (1001, "")], "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    space = dc.fit_space(docs)
    plain = dc.find_leaks(docs, items, space).select("doc_id", "leaks").collect()
    coded = dc.find_leaks(dc.encode(docs, "text", "doc_id"), items, space, codes="codes").select("doc_id", "leaks").collect()
    assert sorted(plain) == sorted(coded) and sum(len(r.leaks) for r in coded) > 0


def test_op2_reads_texts_once(spark, tmp_path, corpus):
    """The search goes over the hashed words, not over the texts again."""
    docs, items, truth = corpus
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = dc.op2(spark, str(tmp_path))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == truth
    assert not [f for f in found.inputFiles() if "documents.parquet" in f]
