"""Personal data: identifiers found as they stand and behind disguises, with spans in the source text.

A transducer rewrites homoglyphs, spelled digits and at/dot disguises into plain signs and keeps, for each piece it rewrote, where it came
from. The same patterns run over the plain and the rewritten text; a span of the rewritten one is mapped back to source characters.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm.base import python_ready, query, table

KINDS = ("email", "ip", "card", "phone")
SHORT = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

Span = tuple[int, int, str]

# ---- patterns. Look-behinds and possessive parts only spare retries that cannot succeed, so that long runs stay linear.

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, looked for from the @."""
    free = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = m.end()


def identifiers(text: str) -> list[Span]:
    """(start, end, kind) of the plain patterns, by start and then by the order of KINDS."""
    found = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            digits = digits_of(m[0]) if m.end() - m.start() <= 64 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
        if "+" in text:
            found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# ---- the transducer

#: Signs that look like a Latin letter, digit or sign; fixed values.
HOMOGLYPHS = dict(zip("авеіјкмнорсѕтухАВЕЅІЈКМНОРСТУХαορνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abeijkmhopcstyxABESIJKMHOPCTYXaopvABEZHIKMNOPTYX"))
HOMOGLYPHS |= {chr(0x660 + i): str(i) for i in range(10)} | {chr(0x6F0 + i): str(i) for i in range(10)}  # Arabic digits
HOMOGLYPHS |= {"。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-"}
HOMOGLYPHS |= dict.fromkeys("​‌‍⁠﻿­", "")  # signs of no width
# Every other sign above Latin-1 whose compatibility form is one printable ASCII sign: full width, bold, italic, circled, spaces, ...
HOMOGLYPHS = {c: n for c in map(chr, [*range(0x100, 0xD800), *range(0xE000, 0x20000)])
              if len(n := unicodedata.normalize("NFKC", c)) == 1 and " " <= n <= "~"} | HOMOGLYPHS
#: Digits as words, in English, German, French and Spanish; fixed values.
SPELLED = {word: str(i) for words in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun",
                                      "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve")
           for i, word in enumerate(words.split())}
#: Words for the two signs of an address, in the same languages; fixed values. The second list stands for the sign in brackets only.
AT, AT_BRACKETED = "at arroba arobase", "at arroba arobase chez klammeraffe"
DOT = "dot punkt point punto"


def _any(words: str) -> str:
    """Any of some words, told apart by their first letters first."""
    by = {}
    for word in sorted(words.split(), key=len, reverse=True):
        by.setdefault(word[0], []).append(word[1:])
    return "(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by.items()) + ")"


_BEYOND = re.compile("[^\x00-\xac\xae-\xff]")  # a table of this many signs is looked up, not compiled
_WORD, _GAP = _any(" ".join(SPELLED)), "(?:[ -]|, )"
_THREE = re.compile(f"{_WORD}{_GAP}{_WORD}{_GAP}{_WORD}")  # in lower case
_SPELLED = re.compile(rf"(?<![^\W_])(?:plus[ -])?{_WORD}(?:{_GAP}{_WORD})*+(?![^\W\d_])", re.I)
_RUN = re.compile(_WORD, re.I)
_OPEN, _CLOSE = r"[(\[{<] ?", r" ?[)\]}>]"
_BRACKETED = re.compile(rf" ?{_OPEN}(?:({_any(AT_BRACKETED)})|{_any(DOT)}){_CLOSE} ?", re.I)
# A word for the at sign between blanks counts where the host behind it has a dot in disguise too: "look at example.com" is no address.
_AT_DOT = re.compile(rf" (?:(?<=[A-Za-z0-9] )({_any(AT)}) (?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*+(?: {_any(DOT)} | ?{_OPEN}{_any(DOT)}{_CLOSE} ?)[A-Za-z0-9])"
                     rf"|{_any(DOT)} (?=[A-Za-z0-9-]))", re.I)
_SIGN = re.compile(rf"{_OPEN}{_any(AT_BRACKETED)}{_CLOSE}", re.I)


def _hinted(text: str) -> bool:
    """Whether a text has a word for a dot or a bracketed at: each disguise of an address has one inside its own stretch."""
    lower = text.lower()
    return any(word in lower for word in DOT.split()) or _SIGN.search(text) is not None


class Rewritten:
    """A text and, for each stretch of it, the source stretch it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.out, self.src, self.cut = [0], [0], [len(text)]  # starts in the text and the source, ends in the source
        self.literal = [True]  # copied one to one, or rewritten as a whole

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Replace stretches (start, end, with) of this text, in order and apart; offsets stay those of the source."""
        if not edits:
            return self
        new = Rewritten("")
        new.out, new.src, new.cut, new.literal = [], [], [], []
        pieces, length = [], 0

        def put(part: str, lo: int, hi: int, literal: bool) -> None:
            nonlocal length
            new.out.append(length)
            new.src.append(lo)
            new.cut.append(hi)
            new.literal.append(literal)
            pieces.append(part)
            length += len(part)

        def copy(lo: int, hi: int) -> None:
            while lo < hi:
                k = bisect_right(self.out, lo) - 1
                end = min(hi, self.out[k + 1] if k + 1 < len(self.out) else len(self.text))
                if self.literal[k]:
                    base = self.src[k] - self.out[k]
                    put(self.text[lo:end], lo + base, end + base, True)
                else:
                    put(self.text[lo:end], self.src[k], self.cut[k], False)
                lo = end

        at = 0
        for lo, hi, part in edits:
            copy(at, lo)
            start, end = self.source(lo, hi)
            if part:
                put(part, start, end, False)
            at = hi
        copy(at, len(self.text))
        new.text = "".join(pieces)
        return new

    def source(self, lo: int, hi: int) -> tuple[int, int]:
        """The source span of [lo, hi) of this text; a stretch rewritten as a whole counts whole."""
        first, last = bisect_right(self.out, lo) - 1, bisect_right(self.out, hi - 1) - 1
        start = self.src[first] + (lo - self.out[first] if self.literal[first] else 0)
        end = self.src[last] + (hi - self.out[last]) if self.literal[last] else self.cut[last]
        return start, end


def rewritten(text: str) -> Rewritten | None:
    """The text with disguises undone, or None where it has none."""
    at = Rewritten(text)
    if not text.isascii():
        at = at.rewrite([(m.start(), m.end(), HOMOGLYPHS[m[0]]) for m in _BEYOND.finditer(at.text) if m[0] in HOMOGLYPHS])
    edits = []
    for m in _SPELLED.finditer(at.text) if _THREE.search(at.text.lower()) else ():
        words = _RUN.findall(m[0])
        if len(words) >= 3:  # one or two are words like any other
            edits.append((m.start(), m.end(), ("+" if m[0][:4].lower() == "plus" else "") + "".join(SPELLED[w.lower()] for w in words)))
    at = at.rewrite(edits)
    if _hinted(at.text):
        for disguise in (_AT_DOT, _BRACKETED):
            at = at.rewrite([(m.start(), m.end(), "@" if m[1] else ".") for m in disguise.finditer(at.text)])
    return None if at.text is text else at


def personal_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """(spans of the plain patterns, those spans and the ones behind disguises), both by start and kind.

    A span from the rewritten text is added where some of it was rewritten, unless a plain span of its kind covers it entirely.
    """
    text = text or ""
    plain = identifiers(text)
    other = rewritten(text)
    if other is None:
        return plain, plain
    starts, ends = {}, {}  # of the plain spans of each kind; a span's end is the furthest up to it
    for a, b, kind in plain:
        starts.setdefault(kind, []).append(a)
        so_far = ends.setdefault(kind, [])
        so_far.append(max([b, *so_far[-1:]]))
    found = []
    for lo, hi, kind in identifiers(other.text):
        a, b = other.source(lo, hi)
        k = bisect_right(starts.get(kind, []), a) - 1
        if text[a:b] != other.text[lo:hi] and (k < 0 or ends[kind][k] < b):
            found.append((a, b, kind))
    return plain, sorted({*plain, *found}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def mask(text: str | None, spans: list[Span]) -> str | None:
    """The text with each stretch covered by spans, which may overlap, replaced by the name of the kind that starts it."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], SHORT[kind]]
        at = max(at, b)
    return "".join([*out, text[at:]])


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


# ---- the operator

def find_personal(docs: DataFrame, text: str = "text", name: str = "personal") -> DataFrame:
    """docs with a struct column: plain and all spans (arrays of start, end, kind; code points, end exclusive).

    A null text counts as empty and has no spans; repeated rows get theirs each. An existing column of that name is replaced.
    """
    python_ready(docs.sparkSession)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
    kind = pa.struct([("plain", pa.list_(span)), ("spans", pa.list_(span))])

    def rows(spans: list[Span]) -> list[dict]:
        return [{"start": a, "end": b, "kind": k} for a, b, k in spans]

    @F.arrow_udf("struct<plain: array<struct<start: bigint, end: bigint, kind: string>>, spans: array<struct<start: bigint, end: bigint, kind: string>>>")
    def spans_of(texts: pa.Array) -> pa.Array:
        found = map(personal_spans, texts.to_pylist())
        return pa.array([{"plain": rows(p), "spans": rows(s)} for p, s in found], kind)

    return docs.withColumn(name, spans_of(F.col(text)))


def mask_personal(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in the text replaced by the name of its kind. A null text stays null; no row goes."""
    python_ready(docs.sparkSession)

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        return pa.array([mask(t, personal_spans(t)[1]) for t in texts.to_pylist()], pa.string())

    return docs.withColumn(text, masked(F.col(text)))


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with counts of the plain spans by kind, the digest of the plain spans, and all spans as text."""
    python_ready(docs.sparkSession)
    fields = [*((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())]

    @F.arrow_udf("struct<" + ", ".join(f"{n}: {'bigint' if n[:2] == 'n_' else 'string'}" for n, _ in fields) + ">")
    def digest(texts: pa.Array) -> pa.Array:
        out = []
        for plain, spans in map(personal_spans, texts.to_pylist()):
            kinds = [s[2] for s in plain]
            out.append({**{f"n_{k}": kinds.count(k) for k in KINDS}, "spans": written(spans),
                        "base_sha256": hashlib.sha256(written(plain).encode()).hexdigest()})
        return pa.array(out, pa.struct(fields))

    return docs.withColumn("_found", digest(F.col(text)))


@query("op3_personal_data")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "_found.*")
