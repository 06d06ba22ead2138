import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinframe.llm import middle


def brute(key, text):
    """(n, form, prefix, middle, output) by plain Python."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, body string")
    made = middle.fill_in_middle(docs)
    return made.withColumn("back", middle.restore(F.col("output"), F.col("form"))).collect()


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 10 ** 12), st.text(st.sampled_from("<PSM>ab\r\n\u0085é日𝐣\U0001F469‍$\\{}\x00 "), max_size=400)), min_size=1, max_size=60))
def test_any_text(spark, rows):
    out = run(spark, [(k, t, "x", "y") for k, t in rows])
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output) for r in out), key=str) == sorted(((k, *brute(k, t)) for k, t in rows), key=str)
    assert all(r.back == r.text and r.body == "y" for r in out)


@pytest.mark.parametrize("size", [255, 256, 257, 2048, 700_000])
def test_lengths(spark, size):
    out = run(spark, [(k, "é\n𝐣" * size, None, None) for k in range(6)])
    assert all((r.n, r.form, r.prefix_units, r.middle_units, r.output) == brute(r.doc_id, r.text) and r.back == r.text for r in out)
    assert {r.form for r in out} != {"plain"}


def test_odd_tables(spark, odd_documents):
    docs = odd_documents.withColumnRenamed("n_tokens", "output")
    rows = middle.fill_in_middle(docs).collect()
    assert len(rows) == 9 and all((r.n, r.form, r.prefix_units, r.middle_units, r.output) == brute(r.doc_id, r.text) for r in rows)
    assert middle.fill_in_middle(docs.limit(0)).count() == 0


def test_words_as_units(spark):
    """Units of a word and what follows it; what no unit covers belongs to the suffix."""
    docs = spark.createDataFrame([(i, "one two  three four\nfive " * 80) for i in range(40)] + [(99, "  leading blanks")], "doc_id long, text string")
    out = middle.fill_in_middle(docs, unit=r"[^\s]+\s*").withColumn("back", middle.restore(F.col("output"), F.col("form"))).collect()
    assert all(r.back == r.text for r in out) and {r.n for r in out} == {400, 0}
    for r in out:
        if r.form == "psm" and r.n:
            assert len(r.output.split("<S>")[0].removeprefix("<P>").split()) == r.prefix_units


def test_marks_with_signs(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "doc_id long, text string")
    marks = ("$1", "\\s", "{m}")
    out = middle.fill_in_middle(docs, marks=marks).withColumn("back", middle.restore(F.col("output"), F.col("form"), marks)).collect()
    assert all(r.back == r.text for r in out) and any(r.output.startswith("$1") for r in out)
