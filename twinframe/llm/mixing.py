"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame expressions.

Each source has a target of words. It is met by complete epochs over the source, then by a sample without replacement: every document draws
an exponential key divided by its quality weight, documents stand in the order of their keys within their source, and the words before a
document tell what it still gives to the budget. So a document of twice the weight is twice as likely to come first, and the last
document of a sample is cut where the budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.functions.rng import uniform
from twinframe.llm.base import fresh, keep, query, running, table

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"  # the characters between words
GAP = r"[\x20\x09-\x0D]+"
LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"  # of any script; ASCII signs and digits are none
LETTER_RUN = r"[a-zA-Z\x{80}-\x{10FFFF}]+"  # the same characters listed, the commonest first, as Spark's matcher tries the parts of a class in turn
LEAST_WEIGHT = 0.1  # of a document without letters
EPOCHS = 3  # a document is taken at most so often
TURN = 3  # sources weigh 1 to TURN, repeating
SEED = 20


def quality_weight(text: Column) -> Column:
    """From LEAST_WEIGHT to 1: how much of a text is letters and not signs, digits or blanks; a text without any is the least."""
    text = F.coalesce(text, F.lit(""))
    rest = F.length(F.regexp_replace(text, LETTER_RUN, ""))
    share = F.when(F.length(text) > 0, F.lit(1.0) - rest / F.length(text)).otherwise(F.lit(0.0))
    return F.lit(LEAST_WEIGHT) + F.lit(1.0 - LEAST_WEIGHT) * share


def word_count(text: Column) -> Column:
    """The matches of WORD, as the pieces between blanks: splitting takes a third of the time that matching does."""
    inner = F.trim(text, F.lit(BLANKS))
    return F.when(F.length(inner) > 0, F.size(F.split(inner, GAP))).otherwise(F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, source: str, size: str, epochs: int = EPOCHS, turn: int = TURN) -> DataFrame:
    """(source, size) with the weight, the target and start, the words of all sources before: one row for each source.

    Sources weigh 1 to turn in the order of their code points, null last. Together they share all words; none gets more than epochs times its
    own size, and what is above is shared again by weight. That ends at one rate of words for each unit of weight that all sources below their
    limit share, which is found directly: in the order of limit over weight, sources are full up to the first at which the rate would do.
    """
    ordered = running(sizes, [F.col(source).asc_nulls_last()], {"number": F.lit(1), "start": F.col(size)})
    weighted = ordered.withColumns({"source_weight": (F.pmod(F.col("number") - 1, F.lit(turn)) + 1).cast("bigint"), "start": F.col("start") - F.col(size)})
    limit = F.col(size) * epochs
    by_limit = keep(running(weighted, [(limit / F.col("source_weight")).asc(), F.col("number")], {"full": limit, "used": F.col("source_weight")}))
    every = by_limit.agg(F.sum(size).alias("words"), F.sum("source_weight").alias("weights")).first()  # one row
    if every["words"] is None:
        return by_limit.withColumn("target", F.lit(0.0)).drop("full", "used")
    open_weight = F.lit(every["weights"]) - F.col("used")
    enough = F.col("full") + limit / F.col("source_weight") * open_weight >= F.lit(every["words"])
    rate = (F.lit(every["words"]) - (F.col("full") - limit)) / (open_weight + F.col("source_weight"))
    found = by_limit.filter(enough).agg(F.min_by(rate, "used").alias("rate")).first()["rate"]
    return by_limit.withColumn("target", F.least(limit.cast("double"), F.col("source_weight") * F.lit(float(found)))).drop("full", "used")


def mix(docs: DataFrame, key: list[str], source: str = "source", size: str = "size", weight: str = "weight", epochs: int = EPOCHS, turn: int = TURN,
        seed: int = SEED) -> DataFrame:
    """docs with source_size, target, epochs (complete ones) and taken, the words of a document that the mix takes, repeats counted.

    key columns name a document: rows that agree in them and in their weight draw the same key and stand in any order. A null source is a source of
    its own, the last one; sizes are whole numbers, a null or negative one counts as none, and a null weight or one that is not above zero as the
    least above zero. Of the words taken, the first epochs * size are whole copies and the rest is a beginning. An empty table gives none. Existing
    columns of these names are replaced, all others are kept.
    """
    made = ["source_size", "target", "epochs", "taken"]
    docs = docs.select(*[c for c in docs.columns if c not in made])
    name, words, rank, before, start, whole, target = fresh(docs, "name", "words", "rank", "before", "start", "whole", "target")
    uneven = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(5e-300))
    drawn = keep(docs.withColumns({words: F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)),
                                   rank: -F.ln(F.lit(1.0) - uniform(seed, "mix", *key)) / uneven}))
    sizes = drawn.groupBy(F.col(source).alias(name)).agg(F.sum(words).alias("size"))
    plan = keep(targets(sizes, name, "size", epochs, turn).select(name, F.col("start").alias(start), F.col("size").alias(whole), F.col("target").alias(target)))
    placed = running(drawn, [F.col(source).asc_nulls_last(), F.col(rank), *[F.col(k).asc_nulls_last() for k in key]], {before: F.col(words)})
    met = placed.join(plan, F.col(source).eqNullSafe(F.col(name)), "left")
    budget = F.floor(F.col(target) + 0.5).cast("bigint")
    rest = F.when(F.col(whole) > 0, budget % F.col(whole)).otherwise(F.lit(0))
    full = F.when(F.col(whole) > 0, ((budget - rest) / F.col(whole))).otherwise(F.lit(0)).cast("bigint")
    part = F.greatest(F.lit(0), F.least(F.col(words), rest - (F.col(before) - F.col(start) - F.col(words))))
    return met.select(*docs.columns, F.col(whole).alias("source_size"), F.col(target).alias("target"), full.alias("epochs"),
                      (full * F.col(words) + part).cast("bigint").alias("taken"))


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size,
         {LEAST_WEIGHT} + {1.0 - LEAST_WEIGHT} * CASE WHEN length(text) > 0
             THEN 1.0::DOUBLE - length(regexp_replace(text, '{LETTERS}', '', 'g'))::DOUBLE / length(text)::DOUBLE ELSE 0.0 END AS weight
  FROM documents),
drawn AS (
  SELECT *, -ln(1.0::DOUBLE - ('0x' || substr(md5(concat_ws('|', '{SEED}', 'mix', doc_id::VARCHAR, digest)), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)
            / weight::DOUBLE AS rank FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS size, (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % {TURN} + 1 AS w FROM drawn GROUP BY source),
filled AS (
  SELECT *, {EPOCHS} * size AS most, sum({EPOCHS} * size) OVER o AS filled_to, sum(w) OVER o AS used, sum(size) OVER () AS words, sum(w) OVER () AS weights
  FROM sources WINDOW o AS (ORDER BY ({EPOCHS} * size)::DOUBLE / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
rates AS (
  SELECT min_by((words - (filled_to - most))::DOUBLE / (weights - used + w)::DOUBLE, used) AS rate FROM filled
  WHERE filled_to + most::DOUBLE / w * (weights - used) >= words),
plan AS (
  SELECT source, size AS source_size, least(most::DOUBLE, w * rate) AS target FROM filled, rates),
met AS (
  SELECT d.*, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN floor(p.target + 0.5)::BIGINT // p.source_size ELSE 0 END AS epochs,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.rank, d.doc_id NULLS LAST, d.digest ROWS UNBOUNDED PRECEDING)::BIGINT - d.size AS before
  FROM drawn d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, epochs,
       (epochs * size + greatest(0, least(size, floor(target + 0.5)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM met"""


@query("op11_source_mixing", SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), quality_weight(F.col("text")).alias("weight"),
                        F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    return mix(sized, ["doc_id", "digest"]).select("doc_id", "size", "source_size", "target", "epochs", "taken")
