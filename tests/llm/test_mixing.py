import re

import pytest
from pyspark.sql import functions as F

from twinframe.llm import mixing


def brute_targets(sizes):
    """sizes by source, in order: shares by weight, the excess shared again until none is above three times its size."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    budget, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = budget - sum(3 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        above = {s for s in rest if share[s] > 3 * sizes[s]}
        if not above:
            return {**{s: 3.0 * sizes[s] for s in full}, **share}
        full |= above


def mixed(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, target string, tie string")
    sized = docs.withColumns({"size": mixing.word_count(F.col("text")), "weight": mixing.quality_weight(F.col("text")), "digest": F.md5("text")})
    return mixing.mix(sized, ["doc_id", "digest"], **more)


def check(rows):
    """Sums near the targets, complete epochs before the fraction, one document of a source cut at most."""
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    wanted = brute_targets({s: sum(r.size for r in group) for s, group in by.items()})
    for s, group in by.items():
        total = sum(r.size for r in group)
        assert all(r.source_size == total and r.target == pytest.approx(wanted[s], rel=1e-9) for r in group)
        assert abs(sum(r.taken for r in group) - wanted[s]) <= 0.5
        whole = int(group[0].target + 0.5) // total if total else 0
        assert all(r.epochs == whole and whole * r.size <= r.taken <= min(whole + 1, 3) * r.size for r in group)
        assert sum(r.taken not in (whole * r.size, (whole + 1) * r.size) for r in group) <= 1


def test_targets_and_budgets(spark):
    words = lambda i: " ".join(["word"] * (i * 37 % 50 + 1))
    rows = [(i, ["b", "a", None, "tiny", "B"][min(i % 7, 4)] if i > 3 else "tiny", words(i), "x", "y") for i in range(600)]
    out = mixed(spark, rows).collect()
    check(out)
    again = mixed(spark, list(reversed(rows))).repartition(5).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)
    assert "tie" in out[0] and out[0]["tie"] == "y"


def test_excess_is_shared_again(spark):
    rows = [(i, "c", "one two three", None, None) for i in range(3)] + [(10 + i, "b", "a " * 100, None, None) for i in range(5)]
    rows += [(30 + i, "a", "a " * 40, None, None) for i in range(20)]
    out = mixed(spark, rows).collect()
    check(out)
    assert {r.target for r in out if r.source == "c"} == {27.0} and all(r.taken == 9 for r in out if r.source == "c")


def test_repeated_rows_and_one_hot_source(spark):
    rows = [(None, "hot", "the same row", None, None)] * 900 + [(i, "z", "other words here and there", None, None) for i in range(300)]
    check(mixed(spark, rows).collect())


def test_odd_tables(spark, odd_documents):
    docs = odd_documents.withColumns({"source": F.when(F.col("doc_id") > 4, "s"), "size": mixing.word_count(F.col("text")),
                                      "weight": F.when(F.col("doc_id") != 3, mixing.quality_weight(F.col("text")))})
    out = mixing.mix(docs, ["doc_id"])
    rows = out.collect()
    check(rows)
    assert {r.size for r in rows if r.text is None or not r.text.strip()} == {0} and out.columns[:3] == odd_documents.columns
    assert mixing.mix(docs.limit(0), ["doc_id"]).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(docs.withColumn("size", F.lit(0)), ["doc_id"]).collect())


def test_weights_lead(spark):
    """A document of nine times the weight comes first nine times in ten."""
    pairs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.floor(F.col("id") / 2).cast("string")).alias("source"),
                                     F.lit(100).alias("size"), F.when(F.col("id") % 2 == 0, 9.0).otherwise(1.0).alias("weight"))
    out = mixing.mix(pairs, ["doc_id"])
    first = out.filter("round(target) % 200 = 100 and taken > epochs * size").groupBy("weight").count().collect()
    count = {r["weight"]: r["count"] for r in first}
    assert sum(count.values()) > 1000 and 0.87 < count[9.0] / sum(count.values()) < 0.93


def test_word_and_weight(spark):
    texts = ["", "a b c\x0bd", "1234 !!", "Straße 日本", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mixing.word_count(F.col("t")).alias("n"), mixing.quality_weight(F.col("t")).alias("w")).collect()
    for r in rows:
        assert r.n == len(re.findall(mixing.WORD, r.t or ""))
        share = len([c for c in r.t if c.isascii() and c.isalpha() or ord(c) > 127]) / len(r.t) if r.t else 0
        assert r.w == pytest.approx(0.1 + 0.9 * share)


def test_fast_counts_equal_the_plain_patterns(spark):
    """Words and letters are counted without a list of matches and without the negated class, with the same results."""
    texts = [None, "", " ", "\t\n\x0b\f\r ", " a", "a ", "a\u00a0b c", "\x1c\x1da b\x85c", "x\x00y\x7f z{|}~[`@", "\U00010330\U0010ffff 1\U0001f600 \u0080\u007f",
             "Zz.Aa" * 50 + "  \r\n" * 40 + "9", "\u3000 \u2028\n\n."]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    text = F.coalesce("t", F.lit(""))
    plain = F.lit(1.0) - F.length(F.regexp_replace(text, mixing.LETTERS, "")) / F.greatest(F.length(text), F.lit(1))
    plain = F.lit(0.1) + F.lit(0.9) * F.when(F.length(text) > 0, plain).otherwise(F.lit(0.0))
    made = rows.select(mixing.word_count(F.col("t")).alias("n"), mixing.quality_weight(F.col("t")).alias("w"))
    known = rows.select(F.coalesce(F.regexp_count("t", F.lit(mixing.WORD)), F.lit(0)).cast("bigint").alias("n"), plain.alias("w"))
    assert made.collect() == known.collect()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "[^" not in plan
