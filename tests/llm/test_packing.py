import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from twinframe.llm import packing
from twinframe.llm.tokens import tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS, LIBRARY = packing.WordIds(PATH), tokenizer(PATH)


def ids(text):
    return np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x260, exclude_categories=["Cs"]), st.sampled_from(" \n'<|>日sİſ"))))
def test_ids_of_any_text(text):
    assert WORDS.many([text])[0] == ids(text)


def test_long_way():
    text = "Some words, it's 12 numbers!\n" * 500
    assert WORDS.long(text) == ids(text)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 99), min_size=1, max_size=60), st.integers(0, 9))
def test_evolution_packs_every_piece(sizes, seed):
    sizes = np.array(sizes)
    found = packing.evolve(sizes, [], 15, 100, seed)
    fills = np.bincount(found[0], weights=sizes)
    assert fills.max() <= 100 and fills[fills > 0].sum() == sizes.sum()
    best_fit = np.zeros(len(sizes), np.int64)
    packing.best_fit(np.argsort(-sizes, kind="stable").tolist(), sizes.tolist(), best_fit, [], 0, 100)
    assert packing.fitness(found[0], sizes, 100) <= packing.fitness(best_fit, sizes, 100)


def test_crossover_beats_best_fit():
    """Sizes cut from full bins, so that a perfect packing exists and best fit alone rarely finds it."""
    rng = np.random.default_rng(3)
    wins = 0
    for _ in range(10):
        cuts = np.sort(rng.integers(15, 85, (30, 2)), axis=1) + np.array([0, 1])
        sizes = np.concatenate([cuts[:, 0], cuts[:, 1] - cuts[:, 0], 100 - cuts[:, 1]])
        start = packing.fitness(packing.evolve(sizes, [], 0, 100, 1)[0], sizes, 100)
        end = packing.fitness(packing.evolve(sizes, [], 300, 100, 1)[0], sizes, 100)
        assert end <= start
        wins += end < start
    assert wins >= 5


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for parts in by.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by)


def test_operator(spark, odd_documents):
    pieces = packing.token_pieces(odd_documents, PATH, with_ids=True).cache()
    rows = packing.pack(pieces).collect()
    assert len(rows) == pieces.count() and sum(r.key == 5 for r in rows) == 2 and sum(r.key is None for r in rows) == 1
    check(rows, 2048)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.start == 2048 * r.piece for r in rows)
    long = b"".join(r.ids for r in sorted((r for r in rows if r.key == 6), key=lambda r: r.piece))
    assert long == ids("word and another " * 20_000) + b"\0\0\0\0"
    assert [r.length for r in rows if r.key in (1, 2, 3, 8)] == [1] * 4
    assert packing.pack(pieces.limit(0)).count() == 0


def test_blocks_and_second_deal(spark):
    sizes = np.random.default_rng(5).integers(1, 1200, 3000)
    pieces = spark.createDataFrame([(int(i), int(s), "x") for i, s in enumerate(sizes)], "key long, length long, offset string")
    rows = packing.pack(pieces, block=256).collect()
    assert sorted(r.key for r in rows) == list(range(3000))
    assert check(rows, 2048) <= 1.01 * np.ceil(sizes.sum() / 2048)
