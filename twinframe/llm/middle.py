"""Fill-in-middle transformation by one counted regex for each row, in DataFrame expressions.

A text is a row of units (code points unless asked otherwise). Its number of units, counted by the unit's regex, and a hash of its key give two
cuts a <= b; the pattern unit{a} unit{b-a} rest, with possessive counts, so that no match ever steps back, captures the three pieces at once, and
the replacement writes them in the order of the form.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm.base import fresh, query, table

UNIT = "(?s:.)"  # a code point
MARKS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
RATE = 90  # of 100 texts are cut
SUFFIX_FIRST = 20  # of 100 cut texts
BLOCK = 256  # units counted at once


def count_units(text: Column, unit: str = UNIT) -> Column:
    """How many units a text begins with, one behind the other. Whole blocks are counted first, so that no list holds more than a row's text."""
    blocks = F.regexp_extract(text, rf"\A(?:(?:{unit}){{{BLOCK}}}+)*+", 0)
    rest = F.regexp_extract(F.substring(text, F.length(blocks) + 1, F.length(text)), rf"\A(?:{unit})*+", 0)
    return (F.regexp_count(blocks, F.lit(rf"(?:{unit}){{{BLOCK}}}+")) * BLOCK + F.regexp_count(rest, F.lit(unit))).cast("bigint")


def draw(digest: Column, place: int) -> Column:
    """The place-th group of eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * place + 1, 8), 16, 10).cast("bigint")


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = UNIT, marks: tuple[str, str, str] = MARKS, rate: int = RATE,
                   suffix_first: int = SUFFIX_FIRST, name: str = "output") -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_units, middle_units and the output.

    Plain stay empty texts, texts that contain a mark, and those that are not drawn. What a text holds behind its last unit in a row belongs to the
    suffix. Null texts count as empty, a null key as an empty one; rows of the same key and number of units are cut alike. An empty table
    gives none. Existing columns of these names are replaced, all others are kept.
    """
    made = ["n", "form", "prefix_units", "middle_units", name]
    docs = docs.select(*[c for c in docs.columns if c == text or c not in made])
    body, digest, count, low, high, form = fresh(docs, "body", "digest", "count", "low", "high", "form")
    cut = docs.withColumns({body: F.coalesce(F.col(text), F.lit("")), digest: F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)})
    cut = cut.withColumn(count, count_units(F.col(body), unit))
    cuts = [F.pmod(draw(F.col(digest), i), F.col(count) + 1) for i in (0, 1)]
    marked = [F.contains(body, F.lit(m)) for m in marks]
    plain = (F.col(body) == "") | marked[0] | marked[1] | marked[2] | (draw(F.col(digest), 2) % 100 >= rate)
    cut = cut.withColumns({low: F.least(*cuts), high: F.greatest(*cuts),
                           form: F.when(plain, "plain").when(draw(F.col(digest), 3) % 100 < suffix_first, "spm").otherwise("psm")})
    pattern = F.concat(F.lit(rf"\A((?:{unit}){{"), F.col(low), F.lit(rf"}}+)((?:{unit}){{"), F.col(high) - F.col(low), F.lit(r"}+)((?s:.)*+)\z"))
    p, s, m = (_literal(mark) for mark in marks)
    order = F.when(F.col(form) == "spm", F.lit(f"{s}$3{p}$1{m}$2")).otherwise(F.lit(f"{p}$1{s}$3{m}$2"))
    cutting = F.col(form) != "plain"
    return cut.select(*[c for c in docs.columns if c not in made], F.col(count).alias("n"), F.col(form).alias("form"),
                      F.when(cutting, F.col(low)).alias("prefix_units"), F.when(cutting, F.col(high) - F.col(low)).alias("middle_units"),
                      F.when(cutting, F.regexp_replace(F.col(body), pattern, order)).otherwise(F.col(body)).alias(name))


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of: its pieces stand between the first marks of each kind."""
    p, s, m = (re.escape(mark) for mark in marks)
    piece = r"((?s:.)*?)"
    psm = F.regexp_replace(output, F.lit(rf"\A{p}{piece}{s}{piece}{m}((?s:.)*+)\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(rf"\A{s}{piece}{p}{piece}{m}((?s:.)*+)\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def _literal(mark: str) -> str:
    """A mark as the replacement of a regex writes it."""
    return mark.replace("\\", "\\\\").replace("$", "\\$")


SQL = f"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS body, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
drawn AS (SELECT *, ('0x' || substr(d, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(d, 9, 8))::BIGINT % (n + 1) AS y,
                 ('0x' || substr(d, 17, 8))::BIGINT % 100 AS u, ('0x' || substr(d, 25, 8))::BIGINT % 100 AS v FROM hashed),
formed AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b,
                  CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR u >= {RATE} THEN 'plain'
                       WHEN v < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
pieces AS (SELECT *, substring(body, 1, a) AS p, substring(body, a + 1, b - a) AS m, substring(body, b + 1) AS s FROM formed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM pieces"""


@query("op13_fill_in_middle", SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
                       F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
