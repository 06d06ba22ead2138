"""Importance resampling towards a target corpus by hashed n-grams.

Every n-gram of words falls in a bucket. How much commoner a bucket is in the target than in the documents is its gain; the gains of a document's
n-grams add up to its weight, and the highest weights with Gumbel noise are drawn, which is sampling without replacement by importance.

Words are hashed in an open-addressed table of NumPy arrays, one for each block of texts: the slot of an n-gram starts from its xxhash64, holds
one of its occurrences, whose bytes are compared with those of any other that comes to the slot, its bucket and its count. The bytes of an n-gram
are hashed into a bucket once a block. The gains of a document are gathered by the slots of its occurrences.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm.base import fresh, keep, python_ready, query, running, table

LONGEST = 1  # words of an n-gram
BUCKETS = 10_000
LEAST_WORDS = 20  # of a document that may be drawn
PERCENT = 10  # of those are drawn
SCALE = 1000  # of whole-number gains
SEED = "2024"
BLOCK_BYTES = 1 << 20  # of text in one table
LANES = 16  # n-grams up to so many times eight bytes are compared in arrays, longer ones one by one

# XXH64, as published
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

_small = np.zeros(256, np.uint8)  # the lower-cased byte of a word, 0 for all others
for _c in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _small[_c] = _c
_small[65:91] = _small[97:123]


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


class Text:
    """The words of some texts in one run of bytes: lower case, one blank behind each word."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray):
        """raw holds the UTF-8 bytes of the texts, ends where each one ends."""
        mapped = _small[raw]
        inside = mapped != 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = ends[(ends > 0) & (ends < len(raw))]  # a word never goes on in the next text
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        starts = np.flatnonzero(first)
        sizes = np.flatnonzero(last) + 1 - starts
        self.doc = np.searchsorted(ends, starts, side="right")
        self.start = np.cumsum(sizes + 1) - (sizes + 1)
        self.end = self.start + sizes
        places = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)
        self.bytes = np.zeros(len(places) + len(sizes) + 8, np.uint8)
        self.bytes[places] = mapped[inside]
        self.bytes[self.end] = 32
        self.lanes = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, 0, (1,))  # eight bytes from any place
        self.fours = np.ndarray((len(self.bytes) - 3,), "<u4", self.bytes, 0, (1,))

    def grams(self, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, text number) of all runs of 1 to longest words of one text."""
        parts = []
        for n in range(1, longest + 1):
            ahead = max(len(self.doc) - n + 1, 0)
            one = np.flatnonzero(self.doc[:ahead] == self.doc[n - 1:]) if ahead else np.zeros(0, np.int64)
            parts.append((self.start[one], self.end[one + n - 1] - self.start[one], self.doc[one]))
        return tuple(np.concatenate(p) for p in zip(*parts))

    def xxhash64(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """XXH64 of seed 0 of each stretch; those of 32 bytes and more by the library."""
        h = P5 + size.astype(np.uint64)
        short = size < 32
        for lane in range(3):
            at = np.flatnonzero(short & (size >= 8 * lane + 8))
            x = _turn(self.lanes[start[at] + 8 * lane] * P2, 31) * P1
            h[at] = _turn(h[at] ^ x, 27) * P1 + P4
        at = np.flatnonzero(short & (size & 4 > 0))
        h[at] = _turn(h[at] ^ self.fours[start[at] + (size[at] & ~7)].astype(np.uint64) * P1, 23) * P2 + P3
        for i in range(3):
            at = np.flatnonzero(short & (size & 3 > i))
            h[at] = _turn(h[at] ^ self.bytes[start[at] + (size[at] & ~3) + i].astype(np.uint64) * P5, 11) * P1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
        for i in np.flatnonzero(~short):
            h[i] = xxhash.xxh64_intdigest(self.of(start[i], size[i]))
        return h

    def of(self, start: int, size: int) -> bytes:
        return self.bytes[start:start + size].tobytes()

    def same(self, start: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether stretches of equal sizes hold the same bytes."""
        equal = np.ones(len(start), bool)
        at = np.flatnonzero(size <= 8 * LANES)
        for lane in range(LANES):
            at = at[size[at] > 8 * lane]
            if not len(at):
                break
            spare = (8 * np.maximum(8 - (size[at] - 8 * lane), 0)).astype(np.uint64)  # bits behind the end
            equal[at] &= (self.lanes[start[at] + 8 * lane] ^ self.lanes[other[at] + 8 * lane]) << spare == 0
        for i in np.flatnonzero(size > 8 * LANES):
            equal[i] = self.of(start[i], size[i]) == self.of(other[i], size[i])
        return equal


class Table:
    """An open-addressed table of the n-grams of some texts. slot tells where each occurrence is held."""

    def __init__(self, text: Text, longest: int, buckets: int):
        start, size, self.doc = text.grams(longest)
        hashes = text.xxhash64(start, size)
        mask = (1 << max(2 * len(start) - 1, 1).bit_length()) - 1
        held = np.full(mask + 1, -1, np.int64)  # an occurrence
        self.slot = np.zeros(len(start), np.int64)
        left, spot = np.arange(len(start)), (hashes & np.uint64(mask)).astype(np.int64)
        while len(left):
            free = held[spot] < 0
            held[spot[free]] = left[free]  # of several that come to a free slot one stays
            by = held[spot]
            meets = (hashes[by] == hashes[left]) & (size[by] == size[left])
            one = np.flatnonzero(meets)
            meets[one] = text.same(start[left[one]], size[left[one]], start[by[one]])
            self.slot[left[meets]] = spot[meets]
            left, spot = left[~meets], (spot[~meets] + 1) & mask
        used = np.flatnonzero(held >= 0)
        self.count = np.bincount(self.slot, minlength=mask + 1)
        self.bucket = np.zeros(mask + 1, np.int64)
        whole = text.bytes.tobytes()
        self.bucket[used] = [zlib.crc32(whole[a:a + n]) % buckets for a, n in zip(start[held[used]].tolist(), size[held[used]].tolist())]


def blocks(texts: pa.Array, longest: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, one behind the last, bytes, ends): some texts after another, or one stretch of a long text.

    A long text is cut behind words. An n-gram across a cut is in no stretch: cut_grams() gives those.
    """
    texts = pc.fill_null(texts, "")
    buffers = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(buffers[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(int(np.searchsorted(ends, ends[at] + BLOCK_BYTES, side="right")) - 1, at + 1)
        to = min(to, len(texts))
        yield at, to, raw[ends[at]:ends[to]], ends[at + 1:to + 1] - ends[at]
        at = to


def stretches(raw: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, bool]]:
    """(bytes, carried): a long text in stretches that end behind a word.

    In front of each but the first come the last longest - 1 words of the one before, as a stretch of their own with carried set: what
    that alone counts was counted before.
    """
    at, before = 0, np.zeros(0, np.uint8)
    while at < len(raw):
        to = min(at + BLOCK_BYTES, len(raw))
        while to < len(raw) and _small[raw[to]]:  # on to the end of the word
            more = np.flatnonzero(_small[raw[to:to + 4096]] == 0)
            to = min(to + (int(more[0]) if len(more) else 4096), len(raw))
        part = np.concatenate([before, raw[at:to]]) if len(before) else raw[at:to]
        yield part, False
        before = np.zeros(0, np.uint8)
        if longest > 1 and to < len(raw):
            text = Text(part, np.array([len(part)]))
            tail = text.bytes[text.start[max(len(text.start) - longest + 1, 0)]:len(text.bytes) - 8] if len(text.start) else before
            before = tail.copy()
            if len(before):
                yield before, True
        at = to


def tables(texts: pa.Array, longest: int, buckets: int) -> Iterator[tuple[Table, np.ndarray, int, int]]:
    """(table, number of each occurrence's text among all, sign, words) for each block; a sign of -1 takes back what stretches count twice."""
    for first, to, raw, ends in blocks(texts, longest):
        if to - first == 1 and len(raw) > BLOCK_BYTES:
            for part, carried in stretches(raw, longest):
                text = Text(part, np.array([len(part)]))
                made = Table(text, longest, buckets)
                yield made, made.doc + first, -1 if carried else 1, text.doc + first
        else:
            text = Text(raw, ends)
            made = Table(text, longest, buckets)
            yield made, made.doc + first, 1, text.doc + first


def bucket_counts(docs: DataFrame, text: str, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many n-grams of all texts fall in each bucket; buckets without any are left out."""
    python_ready(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for made, _, sign, _ in tables(batch.column(0), longest, buckets):
                np.add.at(total, made.bucket, sign * made.count)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())})

    return docs.select(text).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(counts: DataFrame, wanted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain, the floor of SCALE times the smoothed log ratio of its shares; one number a bucket comes to the driver."""
    held, sums = np.zeros((2, buckets), np.int64), []
    for row, side in zip(held, (counts, wanted)):
        for r in side.collect():  # at most one row a bucket
            row[r["bucket"]] = r["n"]
        sums.append(int(row.sum()))
    s, t = held.tolist()
    return np.array([math.floor(SCALE * math.log((float(b + 1) * float(sums[0] + buckets)) / (float(a + 1) * float(sums[1] + buckets)))) for a, b in zip(s, t)],
                    np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", longest: int = LONGEST) -> DataFrame:
    """docs with n_words, n_features and weight, the sum of the gains of a text's n-grams; null counts as empty, which has none.

    Existing columns of these names are replaced, all others are kept.
    """
    python_ready(docs.sparkSession)
    buckets = len(gain)

    @F.arrow_udf("n_words bigint, n_features bigint, weight bigint")
    def added(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = np.zeros((3, len(batch)), np.int64)
            for made, doc, sign, words in tables(batch, longest, buckets):
                slot_gain = gain[made.bucket]
                np.add.at(out[0], words, sign)
                np.add.at(out[1], doc, sign)
                np.add.at(out[2], doc, sign * slot_gain[made.slot])
            yield pa.StructArray.from_arrays([pa.array(row) for row in out], ["n_words", "n_features", "weight"])

    names = ["n_words", "n_features", "weight"]
    found, = fresh(docs, "found")
    return docs.withColumn(found, added(F.col(text))).select(*[c for c in docs.columns if c not in names], *[F.col(f"{found}.{n}").alias(n) for n in names])


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = LONGEST,
             buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """docs without the text, with n_words, n_features, weight, score and rank: 1, 2, 3... for those drawn, null for the others.

    Of the documents of least_words words or more, percent of a hundred are drawn: those with the highest score, ties to the smaller key, null
    keys behind all others. The noise belongs to the key, a null key draws as an empty one; which of some rows that agree in key and score comes
    first is open. Empty tables on either side have counts of zero. Existing columns of these names are replaced, all others are kept.
    """
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    docs = docs.select(*[c for c in docs.columns if c not in ("score", "rank")])
    scored = keep(weigh(docs, gain, text, longest).drop(text).withColumn("score", (F.col("weight") + noise).cast("bigint")))
    may = F.col("n_words") >= least_words
    drawn = scored.filter(may).count() * percent // 100
    ordered = running(scored, [may.desc(), F.desc("score"), F.asc_nulls_last(key)], {"rank": F.lit(1)})
    return ordered.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))


# CRC-32 of each different word, a byte a step, from the table that the polynomial gives
SQL = f"""
WITH RECURSIVE table0 AS (SELECT unnest(range(256)) AS i, unnest(range(256)) AS c, 0 AS k),
rounds AS (SELECT * FROM table0 UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM rounds WHERE k < 8),
crc AS (SELECT i, c FROM rounds WHERE k = 8),
words AS (
  SELECT true AS mine, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT false, NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark),
counted AS (SELECT mine, doc_id, w, count(*) AS n FROM words GROUP BY ALL),
steps AS (
  SELECT w, hex(encode(w)) AS x, 4294967295 AS c, 0 AS k FROM (SELECT DISTINCT w FROM counted)
  UNION ALL
  SELECT w, x, xor(s.c >> 8, crc.c), k + 1 FROM steps s JOIN crc ON crc.i = xor(s.c & 255, ('0x' || substr(x, 2 * k + 1, 2))::BIGINT) WHERE 2 * k < length(x)),
buckets AS (SELECT w, xor(c, 4294967295) % {BUCKETS} AS bucket FROM steps WHERE 2 * k = length(x)),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE mine), 0) AS s, coalesce(sum(n) FILTER (WHERE NOT mine), 0) AS t FROM counted JOIN buckets USING (w) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM sums),
gain AS (
  SELECT bucket, floor({SCALE}.0::DOUBLE * ln(((t + 1)::DOUBLE * (s_all + {BUCKETS})::DOUBLE) / ((s + 1)::DOUBLE * (t_all + {BUCKETS})::DOUBLE)))::BIGINT AS g
  FROM sums, totals),
weights AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM counted JOIN buckets USING (w) JOIN gain USING (bucket) WHERE mine GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id::VARCHAR), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0)))::BIGINT AS score
  FROM documents d LEFT JOIN weights USING (doc_id)),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () * {PERCENT} // 100 AS drawn FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT s.doc_id, s.n_features::BIGINT AS n_features, s.weight, s.score, CASE WHEN rank <= drawn THEN rank END::BIGINT AS rank
FROM scored s LEFT JOIN placed USING (doc_id)"""


@query("op12_importance_resampling", SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return resample(docs, table(spark, folder, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")
