"""SimHash near-duplicates joined by Golay-code fuzzy keys.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each a word of the binary Golay code of length 23 after padding. The code
is perfect: every word lies within distance 3 of exactly one codeword. Two words that differ in at most one bit share a key:

* a word at distance 2 or less from its codeword c has the one key c, since its neighbours are within 3 of c and decode to it too;
* a word at distance 3 has besides c the five codewords at distance 4, and so the codeword of any neighbour that decodes elsewhere.

So it is enough that one side of a join lists all keys (at most 6) and the other its own codeword. Three or fewer errors over three segments
leave two segments with at most one error each (1+1+1, 2+1+0 and 3+0+0 all do), hence some pair of segments has both keys in common.
Candidates that share such a pair of keys (24 bits and the pair's number) are verified on the whole fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm.base import fresh, keep, python_ready, query, table
from twinframe.llm.components import components

SHINGLE = 3
MAX_BITS = 3  # what two errors over two segments of three can hold; see above
SEED = 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, bits)
GENERATOR = 0b110001110101  # of the (23, 12) Golay code


# ---- fingerprints

def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text; 0 if it is null or has no word."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, SEED) for p in parts), np.uint64, n).astype(">u8")
    for at in range(0, n, 65_536):
        block = hashes[at:at + 65_536]
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


# ---- the code

def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator; 0 for codewords."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - 11))
    return rest


def error_table() -> np.ndarray:
    """[syndrome, 6]: the error pattern of weight 3 or less, then, where that weighs 3, the five of weight 4; -1 where there is none."""
    table = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    light = np.zeros(2048, np.int64)
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], np.int64)
        for pattern, s in zip(patterns, syndrome(patterns)):
            if weight == 4 and light[s] != 3:
                continue
            table[s, used[s]] = pattern
            used[s] += 1
            light[s] = max(light[s], min(weight, 3))
    return table


ERRORS = error_table()


def segment_keys(prints: np.ndarray) -> list[np.ndarray]:
    """For each segment [n, 6] of 12-bit codeword numbers, nearest first, -1 where there is none."""
    out = []
    for shift, bits in SEGMENTS:
        words = ((prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        errors = ERRORS[syndrome(words)]
        out.append(np.where(errors >= 0, (words[:, None] ^ errors) >> 11, -1))
    return out


def pair_keys(prints: np.ndarray, all_keys: bool) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key) for each pair of segments and each choice of their keys, or of their first keys only."""
    segments = segment_keys(prints)
    where, keys = [], []
    for number, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        a, b = (segments[x] if all_keys else segments[x][:, :1] for x in (i, j))
        key = np.where((a[:, :, None] >= 0) & (b[:, None, :] >= 0), number << 24 | a[:, :, None] << 12 | b[:, None, :], -1).reshape(len(prints), -1)
        at, column = np.nonzero(key >= 0)
        where.append(at)
        keys.append(key[at, column])
    return np.concatenate(where), np.concatenate(keys)


# ---- the operator

def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """docs with one more column, the SimHash as a signed 64-bit number; null and wordless texts give 0."""
    python_ready(docs.sparkSession)

    @F.arrow_udf("bigint")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, shingle) for t in texts.to_pylist()], np.uint64).view(np.int64))

    return docs.withColumn(name, simhash(F.col(text)))


def keyed(prints: DataFrame, all_keys: bool) -> DataFrame:
    """(print, key) rows of distinct fingerprints."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 2000):
                part = values[at:at + 2000]
                where, keys = pair_keys(part.view(np.uint64), all_keys)
                yield pa.RecordBatch.from_arrays([pa.array(part[where]), pa.array(keys.astype(np.int32))], ["print", "key"])
    return prints.select("print").mapInArrow(run, "print bigint, key int")


def near_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) with a < b: all pairs of the distinct fingerprints in column print that differ in at most max_bits bits (at most 3)."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"The keys find at most {MAX_BITS} differing bits.")
    probe = keyed(prints, True).withColumnRenamed("print", "p")
    index = keyed(prints, False).withColumnRenamed("print", "q")
    near = F.bit_count(F.col("p").bitwiseXOR(F.col("q")))
    met = probe.join(index.hint("shuffle_hash"), "key").filter((F.col("p") != F.col("q")) & (near <= max_bits))
    return met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, *,
                   body: bool = False) -> DataFrame:
    """(key, print, component): each row's fingerprint, and the smallest key it reaches over links of at most max_bits bits.

    Equal fingerprints are always linked, those of wordless texts too. Copies are joined as one node, so a large group of
    copies costs one row. Repeated rows stay. The component is null where no row of the group has a key. On request with
    body, a hash of the text and a label of the component, since one key may stand in several.
    """
    mine = ["key", "body"] if body else ["key"]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *([F.xxhash64(text).alias("body")] if body else []))
    made = keep(fingerprints(rows, "text", "print", shingle).select(*mine, "print"))
    nodes = keep(made.groupBy("print").agg(F.min("key").alias("least")))
    grouped = components(near_links(nodes, max_bits))
    labelled = nodes.join(grouped.withColumnRenamed("node", "print"), "print", "left").withColumn("label", F.coalesce("label", "print"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component"))
    named = labelled.select("print", "label").join(least, "label").select("print", "component", *(["label"] if body else []))
    return made.join(named, "print").select(*mine, "print", "component", *(["label"] if body else []))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group of near copies, that with the smallest key, with all its own columns.

    A row is known by its key and a hash of its text, so unlike texts under one key are judged each by itself. Of near copies that share
    the smallest key the one of the smallest hash stays, and of rows with one key and one text the one whose columns hash lowest.
    Rows without a key cannot be told apart by it, and all stay. The rows that go are joined against the documents, which Spark
    broadcasts only while their table is small.
    """
    id_, body = fresh(docs, "_id", "_body")
    groups = keep(simhash_groups(docs.filter(F.col(key).isNotNull()), key, text, shingle, max_bits, body=True))
    heads = groups.filter(F.col("key") == F.col("component")).groupBy("label", "component", "body").agg(F.count("*").alias("rows"))
    first = heads.groupBy("label").agg(F.min("body").alias("first"), F.sum("rows").alias("rows"))
    crowded = keep(first.filter("rows > 1"))  # groups whose smallest key stands in several rows
    gone = groups.filter(F.col("key") != F.col("component")).select(F.col("key").alias(id_), F.col("body").alias(body))
    same = lambda side: (F.col(key) == side[id_]) & (F.xxhash64(text) == side[body])
    if crowded.isEmpty():
        return docs.join(gone, same(gone), "left_anti")
    more = heads.join(crowded.drop("rows"), "label")
    gone = gone.unionByName(more.filter("body <> first").select(F.col("component").alias(id_), F.col("body").alias(body)))
    left = docs.join(gone, same(gone), "left_anti")
    twice = more.filter("body = first and rows > 1").select(F.col("component").alias(id_), F.col("body").alias(body))
    hashed = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    one = left.join(twice, same(twice), "left_semi").groupBy(F.col(key).alias(id_), F.xxhash64(text).alias(body)).agg(
        F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.xxhash64(*hashed)).alias("row"))
    return left.join(twice, same(twice), "left_anti").unionByName(one.select("row.*"))


@query("op10_simhash_near_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash_groups(table(spark, folder, "documents").select("doc_id", "text"))
    return groups.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
