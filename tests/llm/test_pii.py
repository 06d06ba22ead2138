import pytest
import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from twinframe.llm import pii

PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
}


def plain(text):
    found = [(*m.span(), kind) for kind, (pattern, good) in PATTERNS.items() for m in re.finditer(pattern, text) if good(m)]
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from("a1@.-+ 0(é")), st.lists(st.sampled_from(["4111 1111 1111 1111", "@a.b@c.d", "1.2.3.4.5", "+1 (555) 555-2222", "bob@x.io", "255.1.1.256", " ", "."])))
def test_plain_patterns(text, parts):
    assert pii.identifiers(text) == plain(text)
    joined = "".join(parts) + text
    assert pii.identifiers(joined) == plain(joined)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def found(text):
    return [(text[a:b], kind) for a, b, kind in pii.personal_spans(text)[1]]


def test_disguises_map_back_to_the_source():
    for text, kind in [("bob [at] example [dot] com", "email"), ("bob at example dot com", "email"), ("ｂｏｂ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email"),
                       ("bоb@exаmple.com", "email"), ("192 dot 168 dot 1 dot 2", "ip"), ("bob(at)example.com", "email"),
                       ("four " + "one " * 14 + "one", "card"), ("plus one two three four five six seven eight nine zero one", "phone")]:
        for lead, tail in (("", ""), ("é日 see ", " now."), ("write to: ", "\nend")):
            assert found(lead + text + tail) == [(text, kind)]


def test_disguised_card_with_spelled_digits():
    digits = "4111111111111111"
    names = {v: k for k, v in pii.SPELLED.items()}
    text = "card " + " ".join(names[d] for d in digits) + " ok"
    assert found(text) == [(text[5:-3], "card")]


def test_clean_text_is_left_alone():
    for text in ("We met at noon. One or two of three point five.", "the dot at the end", "v1.2.3", "one two three"):
        assert found(text) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["one ", "two ", "plus ", " at ", " dot ", "[at]", "(dot)", "а", "é", "＠", "bob", "x.io", "​", "4", ". "])).map("".join))
def test_spans_stay_in_the_text_and_base_stays(text):
    base, every = pii.personal_spans(text)
    assert base == plain(text) and set(base) <= set(every)
    assert all(0 <= a < b <= len(text) for a, b, _ in every)


def test_mask():
    text = "a bob@x.io b 10.0.0.1"
    assert pii.mask(text, pii.personal_spans(text)[1]) == "a [EMAIL] b [IP]"


def test_long_runs_are_linear():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "+1" + " " * 300_000, "1." * 150_000, "one " * 60_000, "a@" * 100_000):
        pii.personal_spans(text)


def test_operator(spark, odd_documents):
    rows = pii.digests(odd_documents).select("doc_id", "_found.*").collect()
    assert len(rows) == 9 and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() and r.spans == "" for r in rows)
    one = spark.createDataFrame([(1, "ñ mail bob@x.io or bob at x dot io"), (2, None)], "doc_id long, text string")
    row = pii.digests(one).select("_found.*").first()
    assert row.n_email == 1 and row.spans == "email:7:15,email:19:34" and row.base_sha256 == hashlib.sha256(b"email:7:15").hexdigest()
    spans = pii.find_personal(one).orderBy("doc_id").collect()
    assert [tuple(s) for s in spans[0].personal.spans] == [(7, 15, "email"), (19, 34, "email")] and spans[1].personal.spans == []
    assert [r.text for r in pii.mask_personal(one).orderBy("doc_id").collect()] == ["ñ mail [EMAIL] or [EMAIL]", None]
    assert pii.digests(odd_documents.limit(0)).count() == 0


def test_disguised_parts_beside_a_plain_match():
    """A plain pattern that takes a part of a disguised identifier keeps its span, and the whole identifier is found and masked too."""
    for text, part, kind in [("j\u043ehn@example.com", "hn@example.com", "email"), ("bob@example.c\u043em", "bob@example.c", "email"),
                             ("john@mail.example[dot]com", "john@mail.example", "email"), ("10.0.0.1\uff12", "10.0.0.1", "ip"),
                             ("+1 555 555 222\uff12", "+1 555 555 222", "phone")]:
        for lead, tail in (("", ""), ("see ", " now")):
            whole = lead + text + tail
            base, every = pii.personal_spans(whole)
            assert [(whole[a:b], k) for a, b, k in base] == [(part, kind)]
            assert {(whole[a:b], k) for a, b, k in every} == {(part, kind), (text, kind)}
            assert pii.mask(whole, every) == lead + pii.SHORT[kind] + tail
    assert found("\u043e x@y.io 10.0.0.1") == [("x@y.io", "email"), ("10.0.0.1", "ip")]


CLEAN = [" now", " now, an anecdote", ". The point is made (at last)", ", punto final", " and a dotted line, look at the page", "\nthree words, point", " [at] the end"]
DISGUISED = ["mail jane at example dot com", "mail jane (at) example [dot] com", "jane arroba ejemplo punto es", "jane (chez) exemple [point] fr",
             "plus four nine, null eins sieben drei vier fünf sechs sieben", "𝐣𝐨𝐡𝐧@example.com", "jane at mail.example dot com",
             "mail john at example.com", "plain a@b.cd and 10.0.0.1", "jane at example[dot]com"]


@pytest.mark.parametrize("text", DISGUISED)
@pytest.mark.parametrize("tail", CLEAN)
def test_spans_do_not_depend_on_what_follows(text, tail):
    """Whether a stretch is an identifier depends on the stretch alone."""
    plain, every = pii.personal_spans(text)
    assert pii.personal_spans(text + tail) == (plain, every)
    assert pii.personal_spans(tail.strip() + "\n" + text)[1] == [(a + len(tail.strip()) + 1, b + len(tail.strip()) + 1, k) for a, b, k in every]


@pytest.mark.parametrize("text,kind", [(DISGUISED[0], "email"), (DISGUISED[1], "email"), (DISGUISED[2], "email"), (DISGUISED[3], "email"), (DISGUISED[4], "phone"),
                                       (DISGUISED[5], "email"), (DISGUISED[6], "email"), (DISGUISED[9], "email")])
def test_disguises_of_four_languages(text, kind):
    assert kind in {k for _, _, k in pii.personal_spans(text)[1]}


def test_a_look_at_a_host_is_no_address():
    assert pii.personal_spans("look at example.com, a point of interest")[1] == []
