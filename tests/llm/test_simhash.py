import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from twinframe.llm import simhash
from twinframe.llm.components import components

SPACE = set(" \t\n\x0b\x0c\r")


def plain(text):
    """The fingerprint by the letter of its definition."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(" " if c in SPACE else c for c in lower).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text(st.sampled_from("aAbÉé \t\n\x0b\x1c\x85 İ.")), st.text()))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def test_long_text_in_blocks():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert simhash.fingerprint(text) == plain(text)


def test_golay_table():
    weights = np.array([[int(e).bit_count() if e >= 0 else -1 for e in row] for row in simhash.ERRORS])
    assert (weights[:, 0] <= 3).all() and (weights[:, 0] >= 0).all()
    assert all((sum(w == 4 for w in row) == 5) == (row[0] == 3) for row in weights.tolist())


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=3))
def test_near_fingerprints_share_a_key(print_, flips):
    other = print_
    for f in flips:
        other ^= 1 << f
    mine = set(simhash.pair_keys(np.array([print_], np.uint64), True)[1].tolist())
    theirs = simhash.pair_keys(np.array([other], np.uint64), False)[1].tolist()
    assert mine & set(theirs)


def brute(prints):
    """Smallest key reachable over links, by union-find."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(prints))]


def test_groups_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    texts = []
    for g in range(60):
        words = list(rng.choice(base, int(rng.integers(0, 120))))
        for _ in range(int(rng.integers(1, 8))):
            copy = list(words)
            for _ in range(int(rng.integers(0, 3))):
                if copy:
                    copy[int(rng.integers(0, len(copy)))] = str(rng.choice(base))
            texts.append(" ".join(copy))
    texts += [None, "", " \n"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, component string")
    rows = sorted(simhash.simhash_groups(docs).collect())
    prints = [simhash.fingerprint(t) for t in texts]
    assert [r.print & (2**64 - 1) for r in rows] == prints
    expect = brute(prints)
    assert [r.component for r in rows] == expect
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(expect))


def test_odd_rows(spark, odd_documents):
    rows = simhash.simhash_groups(odd_documents).collect()
    assert len(rows) == 9 and {r.component for r in rows if r.key in (1, 2, 3, 8)} == {1}
    kept = simhash.drop_near_copies(odd_documents)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "5", "6", "7", "None"]
    assert simhash.simhash_groups(odd_documents.limit(0)).count() == 0 and simhash.drop_near_copies(odd_documents.limit(0)).count() == 0


def test_unlike_rows_under_one_key_stay(spark):
    one, two = "the first text is about ships and the sea in winter", "nothing of the kind stands in the second text at all"
    rows = [(5, one, "a", 1), (5, two, "b", 2), (5, two, "b", 2), (5, two, "c", 3), (9, one, "d", 4), (3, "quite another matter of some length", "e", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _body string, _id int").repartition(4)
    kept = simhash.drop_near_copies(docs)
    found = sorted((r.doc_id, r.text) for r in kept.collect())
    assert kept.columns == docs.columns and found == sorted([(5, one), (5, two), (3, rows[5][1])])
    # two near copies under the smallest key of their group: one of them stays
    near = [(1, one), (1, one.upper()), (2, one)]
    assert simhash.drop_near_copies(spark.createDataFrame(near, "doc_id long, text string")).count() == 1


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(-50, 100)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.label for r in rows} == {**{i: -50 for i in range(-50, 101)}, 500: 500, 501: 500}
