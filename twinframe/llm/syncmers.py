"""Document fingerprints of closed syncmers, in DataFrame expressions.

A text is a sequence of words. A run of K words is an anchor if the smallest hash of its inner runs of S words is that of the first or the last
one. Whether a run is an anchor depends on nothing outside it, so an edit changes only the anchors that touch it, and any two texts that share
K + (K - S) words in a row share an anchor.

Where a stretch without white space is too long for a word, each of its letters counts as a word, so an edit inside it stays local too. Two texts
are matched by the places of their shared anchors: a match is an anchor that lies as far from its neighbour among the shared ones in both texts.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinframe.llm.base import fresh, query, table, width

K = 8  # words of an anchor
S = 2  # words of an inner run
LETTERS = 24  # a longer stretch without white space is read letter by letter
WORD = rf"(?<!\S)\S{{1,{LETTERS}}}(?!\S)|\S"
RANGES = 4  # of keys, for each shuffle partition


def anchors(docs: DataFrame, text: str, name: str, places: str | None = None, k: int = K, s: int = S) -> DataFrame:
    """docs with the array of anchor hashes of a text in order, and on request the numbers of the words they start at.

    A text of fewer than k words has one anchor, the hash of all its words, at place 0, and one without words none; null counts as
    empty. Columns called name or places are replaced, all others stay.
    """
    words_, runs_, at_ = fresh(docs, "_words", "_runs", "_at")
    inner = k - s + 1
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))
    made = docs.withColumn(words_, F.transform(words, lambda w: F.xxhash64(w)))
    run = F.col(words_)
    for i in range(1, s):
        run = F.zip_with(run, F.slice(words_, i + 1, F.greatest(F.size(words_) - i, F.lit(0))), lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.xxhash64(a, b)))
    made = made.withColumn(runs_, run)
    first = F.filter(F.sequence(F.lit(1), F.size(words_) - k + 1), lambda i: F.array_min(F.slice(runs_, i, inner)) == F.least(
        F.element_at(runs_, i), F.element_at(runs_, i + (inner - 1))))
    short = F.when(F.size(words_) > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    made = made.withColumn(at_, F.when(F.size(words_) >= k, first).otherwise(short))
    found = F.when(F.size(words_) >= k, F.transform(at_, lambda i: F.xxhash64(F.slice(words_, i, k)))).otherwise(
        F.when(F.size(words_) > 0, F.array(F.xxhash64(words_))).otherwise(F.array().cast("array<bigint>")))
    made = made.withColumn(name, found)
    if places:
        made = made.withColumn(places, F.transform(at_, lambda i: i - 1))
    return made.drop(words_, runs_, at_)


def written(found: Column) -> Column:
    """Anchors as text: eight hexadecimal digits each, in order."""
    return F.concat_ws("", F.transform(found, lambda a: F.lpad(F.hex(a.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))), 8, "0")))


def firsts(found: Column, places: Column, side: int) -> Column:
    """The distinct anchors of a text with the place of the first of each, by anchor: array of (anchor, side, place)."""
    listed = F.array_sort(F.zip_with(found, places, lambda a, p: F.struct(a.alias("anchor"), F.lit(side).alias("side"), p.alias("place"))))
    before = lambda x, i: F.when(i > 0, F.get(x, i - 1)["anchor"])
    return _with(listed, lambda x: F.filter(x, lambda e, i: (i == 0) | (e["anchor"] != before(x, i))))


def _with(value: Column, then) -> Column:
    """then(value), with value computed once a row."""
    return F.transform(F.array(value), then)[0]


def likeness(a: Column, a_places: Column, b: Column, b_places: Column) -> Column:
    """Matched anchors over all distinct anchors of two texts; 1 for two without any.

    The first places of a shared anchor in both texts make a pair. In the order of the first text, a pair is a match if it lies as far
    from the pair before or from the pair behind in one text as in the other; a single pair is one. So shared anchors in another order count
    for nothing, and an insertion costs the anchors that touch it alone.
    """
    both = F.array_sort(F.concat(firsts(a, a_places, 0), firsts(b, b_places, 1)))

    def score(x: Column) -> Column:
        pairs = F.filter(F.transform(x, lambda e, i: F.when(F.get(x, i + 1)["anchor"] == e["anchor"], F.struct(
            e["place"].alias("a"), F.get(x, i + 1)["place"].alias("b")))), lambda p: p.isNotNull())
        gap = lambda p, q: F.coalesce(q["a"] - p["a"] == q["b"] - p["b"], F.lit(False))
        before = lambda y, i: F.when(i > 0, F.get(y, i - 1))
        matched = _with(F.array_sort(pairs), lambda y: F.struct(F.size(y).alias("shared"), F.when(F.size(y) == 1, F.lit(1)).otherwise(F.size(F.filter(
            y, lambda p, i: gap(before(y, i), p) | gap(p, F.get(y, i + 1))))).alias("matched")))
        return _with(matched, lambda m: m["matched"] / (F.size(x) - m["shared"]))

    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(_with(both, score))


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs (key, text) with anchors, and text and anchors of the next row in descending order of the key; after the last comes the first.

    Keys are cut into ranges at quantiles, so no task sees them all. The largest key of each range also goes, as a guest, to the range
    above, whose last row it follows; that of the top range goes to the bottom. Null keys come last, rows that tie go by a hash of the text.
    """
    spark = docs.sparkSession
    ranges = RANGES * width(spark)
    order = F.coalesce(F.col(key).cast("double"), F.lit(float("-inf")))
    cuts = sorted(set(docs.select(F.col(key).cast("double").alias("x")).approxQuantile("x", [i / ranges for i in range(1, ranges)], 0.2 / ranges)))
    split = Bucketizer(splits=[float("-inf"), *(c for c in cuts), float("inf")], inputCol="_order", outputCol="_range") if cuts else None

    def ranged(df: DataFrame) -> DataFrame:
        df = df.withColumn("_order", order)
        return (split.transform(df) if split else df.withColumn("_range", F.lit(0))).drop("_order").withColumn("_range", F.col("_range").cast("int"))

    down = W.orderBy(F.desc("_range"))  # over one row a range
    heads = ranged(docs.select(key)).groupBy("_range").agg(F.max(key).alias("_head"))
    above = F.coalesce(F.lag("_range").over(down), F.min("_range").over(down.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    guest = F.broadcast(heads.select("_head", above.alias("_to")))
    dealt = (ranged(docs).join(guest, F.col(key).eqNullSafe(F.col("_head")), "left")
             .withColumn("_place", F.explode(F.filter(F.array(F.struct(F.col("_range").alias("range"), F.lit(0).alias("guest")),
                                                              F.struct(F.col("_to").alias("range"), F.lit(1).alias("guest"))), lambda p: p["range"].isNotNull())))
             .select(key, text, "_place.*").repartition(width(spark), "range"))
    made = anchors(dealt, text, "anchors", "places").withColumn("tie", F.xxhash64(text))
    after = W.partitionBy("range").orderBy("guest", F.desc_nulls_last(key), "tie")
    return (made.withColumns({"next_text": F.lead(text).over(after), "next_anchors": F.lead("anchors").over(after),
                              "next_places": F.lead("places").over(after)})
            .filter("guest = 0").drop("range", "guest", "tie"))


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited, anchors, edited_anchors, next_anchors, and places for each): each text, its edit and the next one.

    The edit replaces the last third of the characters by the first as many of the next text, or all it has. Null counts
    as empty. A table of one row follows itself.
    """
    body = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    third = F.floor(F.length("body") / 3).cast("int")
    pairs = with_next(body, "key", "body").withColumn("edited", F.concat(F.substring("body", F.lit(1), F.length("body") - third), F.substring("next_text", F.lit(1), third)))
    return anchors(pairs, "edited", "edited_anchors", "edited_places").select(
        F.col("key").alias(key), F.length("body").cast("bigint").alias("n_chars"), "edited", "anchors", "places", "edited_anchors", "edited_places",
        "next_anchors", "next_places")


@query("op5_document_fingerprints")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    pairs = edited_pairs(table(spark, folder, "documents").select("doc_id", "text"))
    return pairs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("anchors")).alias("fingerprint"),
                        written(F.col("edited_anchors")).alias("edited_fingerprint"), 
                        likeness(*map(F.col, ("anchors", "places", "edited_anchors", "edited_places"))).alias("near_edited"),
                        likeness(*map(F.col, ("anchors", "places", "next_anchors", "next_places"))).alias("near_next"))
