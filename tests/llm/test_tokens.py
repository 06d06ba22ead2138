import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinframe.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = tokens.whole_tokens(PATH)
COUNTER, LIBRARY = tokens.Counter(PATH, WHOLE), tokens.tokenizer(PATH)


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x260, exclude_categories=["Cs"]), st.sampled_from(" \n'<|>日s"))))
def test_any_text(text):
    assert COUNTER.many([text]) == [library(text)]


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "a<|endoftext|>  b", "it's  \n\n x", "   ", "x" * 5000])
def test_special(text):
    assert COUNTER.many([text]) == [library(text)] and COUNTER.long(text) == COUNTER.long(text)


def test_long_way_equals_short():
    text = "Some words, 12 numbers!\n" * 1000
    assert COUNTER.long(text) == library(text)


def test_whole_tokens_are_single():
    assert len(WHOLE) > 40_000 and all(len(e.ids) == 1 for e in LIBRARY.encode_batch(WHOLE, add_special_tokens=False))


def test_operator(spark, odd_documents):
    rows = tokens.count_tokens(odd_documents, PATH).collect()
    assert len(rows) == 9 and all(r.n_tokens == library(r.text) for r in rows)
    assert tokens.count_tokens(odd_documents.limit(0), PATH).count() == 0
