"""Benchmark decontamination by latent semantic retrieval.

Texts become hashed words; passages are blocks of 32 of them. One pass counts in how many passages each hash occurs, a second multiplies the
TF-IDF matrix A of all passages with random vectors, giving B = A'AR, from which a Nystroem step reads the leading right singular vectors and
values. A window of a text and a benchmark item are compared by the cosine of their whitened latent vectors. Candidates are verified by the
longest common subsequence of words and, for looser matches, by the item's answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from twinframe.llm.base import by_size, keep, python_ready, query, table, width

BUCKETS = 1 << 15
RANK = 24
EXTRA = 8  # random vectors beyond the rank
PASSAGE = 32  # words
STRIDE = 8  # words between the starts of windows
COSINE = 0.35  # candidates only; low enough that what the verification accepts is rarely lost before it
COMMON = 0.01  # share of passages above which a word says nothing by itself
FEWEST = 5  # an item with fewer other words is compared by all its words
VERBATIM = 0.8  # share of an item's telling words in common order that alone is a leak
LOOSE = 0.5  # share that is a leak if the answer is there too
ANSWER = 0.8  # share of the answer's words in common order
ITEMS = 4096  # benchmark items of one pass over the documents
CHUNK = 1024  # buckets of one shuffled part of a sketch
BLOCK = 1 << 14  # words handled at once
SIGNS = 4  # 64-bit numbers of a set's signature

_WORD = np.zeros(256, bool)  # bytes of a word: ASCII letters and digits, and all bytes of other characters
_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_WORD[128:] = True
_POWERS = np.cumprod(np.full(256, 0x9E3779B1, np.uint32), dtype=np.uint32)


# ---- words

def word_codes(texts: list[str | None]) -> list[np.ndarray]:
    """For each whole text a 31-bit number for each of its lower-cased words, made for all texts at once."""
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    flat = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = _WORD[flat]
    starts = np.flatnonzero(inside[1:] > inside[:-1]) + 1
    starts = np.append(0, starts) if inside[0] else starts
    if not len(starts):
        return [np.zeros(0, np.int32) for _ in texts]
    flat, inside = flat[starts[0]:], inside[starts[0]:]
    cuts = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw])[:-1])
    starts -= starts[0]
    offset = np.arange(len(flat)).astype(np.uint8) - np.repeat(starts.astype(np.uint8), np.diff(np.append(starts, len(flat))))
    hashes = np.add.reduceat(_POWERS[offset] * (flat * inside), starts, dtype=np.uint32)
    hashes ^= hashes >> np.uint32(15)
    hashes *= np.uint32(0x2C1B3C6D)
    return np.split((hashes >> np.uint32(1)).astype(np.int32), cuts)


def text_codes(texts: pa.Array) -> Iterator[np.ndarray]:
    for block in by_size((t or "" for t in texts.to_pylist()), 1 << 17):
        yield from word_codes(block)


def encode(docs: DataFrame, text: str, *beside: str) -> DataFrame:
    """(codes) behind the columns beside: the word numbers of each text as little-endian 32-bit numbers."""
    @F.arrow_udf("binary")
    def codes(texts: pa.Array) -> pa.Array:
        return pa.array([c.tobytes() for c in text_codes(texts)], pa.binary())
    return docs.select(*beside, codes(F.col(text)).alias("codes"))


# ---- the latent space

def passages_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, starts) for about BLOCK words at a time: the distinct buckets of each passage; a passage ends with its text."""
    def distinct(held: list[np.ndarray], starts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        first = np.concatenate(starts)
        buckets = np.concatenate(held) & (BUCKETS - 1)
        owner = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(buckets))))
        pairs = np.sort(owner * np.int64(BUCKETS) + buckets)
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
        return pairs & (BUCKETS - 1), np.searchsorted(pairs, np.arange(len(first), dtype=np.int64) * BUCKETS)

    held, starts, size = [], [], 0
    for batch in batches:
        for code in batch.column(0).to_pylist():
            words = np.frombuffer(code, np.int32)
            for at in range(0, len(words), BLOCK):
                part = words[at:at + BLOCK]
                held.append(part)
                starts.append(size + np.arange(0, len(part), PASSAGE))
                size += len(part)
                if size >= BLOCK:
                    yield distinct(held, starts)
                    held, starts, size = [], [], 0
    if size:
        yield distinct(held, starts)


def passage_counts(codes: DataFrame) -> tuple[np.ndarray, int]:
    """In how many passages each bucket occurs, and the number of passages; the driver gets one number a bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, passages = np.zeros(BUCKETS, np.int64), 0
        for buckets, starts in passages_of(batches):
            found += np.bincount(buckets, minlength=BUCKETS)
            passages += len(starts)
        there = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1)), pa.array(np.append(found[there], passages))], ["bucket", "n"])
    rows = codes.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(BUCKETS, np.int64), 0
    for r in rows:
        if r.bucket < 0:
            total = r.n
        else:
            out[r.bucket] = r.n
    return out, total


class Sketch:
    """Sums A'(A @ random) and the rows of A, for rows of passages scaled to length 1."""

    def __init__(self, idf: np.ndarray, random: np.ndarray):
        self.idf = idf.astype(np.float32)
        self.rows = np.concatenate([random * idf[:, None], (idf * idf)[:, None]], axis=1).astype(np.float32)
        self.out = np.zeros(self.rows.shape, np.float32)

    def add(self, buckets: np.ndarray, starts: np.ndarray) -> None:
        product = np.add.reduceat(self.rows[buckets], starts, axis=0)
        square = np.maximum(product[:, -1:], 1e-12)
        product = product / square  # scaled once for the row itself, once for A' below
        product[:, -1:] = 1 / np.sqrt(square)
        owner = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, len(buckets))))
        order = np.argsort(buckets.astype(np.uint16), kind="stable")
        ordered = buckets[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        self.out[ordered[first]] += np.add.reduceat(product[owner[order]], first, axis=0) * self.idf[ordered[first], None]


def sketch(codes: DataFrame, idf: np.ndarray, random: np.ndarray) -> np.ndarray:
    """[A'A @ random, column sums of A] over all passages, summed in parts of CHUNK buckets; its size is the same for any corpus."""
    spark = codes.sparkSession
    sent = spark.sparkContext.broadcast((idf, random.astype(np.float32)))
    columns = random.shape[1] + 1
    schema = pa.schema([("chunk", pa.int32()), ("part", pa.binary())])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for buckets, starts in passages_of(batches):
            held = held or Sketch(*sent.value)
            held.add(buckets, starts)
        for at in range(0, BUCKETS if held else 0, CHUNK):
            yield pa.RecordBatch.from_pydict({"chunk": [at // CHUNK], "part": [held.out[at:at + CHUNK].tobytes()]}, schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[chunk] = held.get(chunk, 0) + np.frombuffer(part, np.float32).astype(np.float64)
        for chunk, total in held.items():
            yield pa.RecordBatch.from_pydict({"chunk": [chunk], "part": [total.astype(np.float32).tobytes()]}, schema=schema)

    parts = codes.mapInArrow(multiply, "chunk int, part binary").repartition(min(width(spark), BUCKETS // CHUNK), "chunk").mapInArrow(add, "chunk int, part binary")
    out = np.zeros((BUCKETS, columns))
    for r in parts.collect():
        out[r.chunk * CHUNK:(r.chunk + 1) * CHUNK] = np.frombuffer(r.part, np.float32).reshape(CHUNK, columns)
    return out


def right_vectors(product: np.ndarray, random: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors and values of A from B = A'A @ random: A'A is close to B (random' B)^-1 B'."""
    core = random.T @ product
    level, turn = np.linalg.eigh((core + core.T) / 2)
    good = level > max(level.max(), 0) * 1e-9
    if not good.any():
        return np.zeros((len(product), 0)), np.zeros(0)
    half = product @ (turn[:, good] / np.sqrt(level[good]))
    left, values, _ = np.linalg.svd(half, full_matrices=False)
    many = min(rank, int((values > values[0] * 1e-6).sum()))
    return left[:, :many], values[:many]


@dataclass
class Space:
    """Whitened latent vectors: that of some words is the sum of their rows over the root of their last column's sum, less the centre."""

    vectors: np.ndarray  # [bucket, rank + 1], float32; the last column is the squared weight
    centre: np.ndarray
    common: np.ndarray  # buckets in more than COMMON of the passages


def make_space(total: np.ndarray, found: np.ndarray, random: np.ndarray, passages: int, rank: int) -> Space:
    """From the sums of a sketch: singular vectors of the centred passages, scaled to equal spread."""
    idf, mean = weights(found, passages), total[:, -1] / max(1, passages)
    vectors, values = right_vectors(total[:, :-1] - passages * np.outer(mean, mean @ random), random, rank)
    turned = vectors * (np.sqrt(max(1, passages)) / values) if len(values) else np.zeros((BUCKETS, 1))
    return Space(np.concatenate([turned * idf[:, None], (idf * idf)[:, None]], axis=1).astype(np.float32), (mean @ turned).astype(np.float32),
                 found > COMMON * max(1, passages))


def weights(found: np.ndarray, passages: int) -> np.ndarray:
    return np.where(found > 0, np.log((1 + passages) / (1 + found)), 0.0)


def fit_space(docs: DataFrame, text: str = "text", rank: int = RANK, seed: int = 2) -> Space:
    """Randomised SVD of the TF-IDF passages of all texts; empty and null texts have none."""
    python_ready(docs.sparkSession)
    return space_of(keep(encode(docs, text)), rank, seed)


def space_of(codes: DataFrame, rank: int = RANK, seed: int = 2) -> Space:
    """As fit_space, from a written table (codes)."""
    found, passages = passage_counts(codes)
    idf = weights(found, passages)
    random = np.random.default_rng(seed).standard_normal((BUCKETS, rank + EXTRA))
    return make_space(sketch(codes, idf, random), found, random, passages, rank)


# ---- search

def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a row of the table held in the bits of one number."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def scale(words: int) -> int:
    """Strides of the window for an item: near its length, in steps that widen with it."""
    m = max(1, round(words / STRIDE))
    while m > 16 and m & (m - 1) and m % 4:
        m += 1
    return m


def signature(codes: np.ndarray) -> np.ndarray:
    """[word, SIGNS]: one of 256 bits for each word; none for padding."""
    bits = (codes >> 15) & (64 * SIGNS - 1)
    out = np.zeros((len(codes), SIGNS), np.uint64)
    there = np.flatnonzero(codes >= 0)
    out[there, bits[there] >> 6] = np.uint64(1) << (bits[there] & 63).astype(np.uint64)
    return out


class Searcher:
    """Finds some benchmark items in texts, many texts at a time."""

    def __init__(self, space: Space, items: list[tuple], cosine: float = COSINE):
        """items: (id, word codes, codes of the answer)."""
        self.space, self.cosine, self.items = space, cosine, [i for i in items if len(i[1])]
        self.telling = [self.told(i[1]) for i in self.items]
        self.answers = [self.told(i[2]) for i in self.items]
        self.answer_sets = [frozenset(a) for a in self.answers]
        self.reach = [0 if set(i[2].tolist()) <= set(i[1].tolist()) else len(i[2]) for i in self.items]  # an answer of its own may stand beside the item
        self.rows = np.concatenate([space.vectors, np.zeros((1, space.vectors.shape[1]), np.float32)])  # the last one is padding
        self.sets = [frozenset(t) for t in self.telling]
        signs = [signature(np.array(t, np.int32)) for t in self.telling]
        self.signs = np.array([np.bitwise_or.reduce(s, axis=0) for s in signs]).reshape(-1, SIGNS)
        self.need = np.array([self.least(s) for s in signs], np.int64)
        self.margins = np.array([-(-max(STRIDE, len(i[1]) // 4) // STRIDE) for i in self.items], np.int64)
        by: dict[int, list[int]] = {}
        for k, (_, codes, _) in enumerate(self.items):
            by.setdefault(scale(len(codes)), []).append(k)
        self.scales = [(m, np.array(ks), self.unit(np.stack([space.vectors[self.items[k][1] & (BUCKETS - 1)].sum(axis=0) for k in ks]))) for m, ks in sorted(by.items())]

    @staticmethod
    def least(signs: np.ndarray) -> int:
        """The fewest bits that the words of a common subsequence long enough to count can have."""
        counts = -np.sort(-np.unique(signs, axis=0, return_counts=True)[1])
        return int(np.searchsorted(np.cumsum(counts), LOOSE * len(signs)) + 1)

    def told(self, codes: np.ndarray) -> list[int]:
        """The words that are not common; all of them where those are too few."""
        rare = codes[~self.space.common[codes & (BUCKETS - 1)]]
        return (rare if len(rare) >= min(FEWEST, len(codes)) else codes).tolist()

    def unit(self, sums: np.ndarray) -> np.ndarray:
        """Latent directions from sums of rows of the space."""
        x = sums[:, :-1] / np.sqrt(np.maximum(sums[:, -1:], 1e-12)) - self.space.centre
        return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-12)

    def candidates(self, words: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(item, start and end of the region in words, cosine) of windows near an item that have enough of its words.

        words: texts padded to whole strides; first, last: the strides at which the text of each stride begins and ends.
        """
        index = np.where(words >= 0, words & (BUCKETS - 1), BUCKETS)
        sums = np.concatenate([np.einsum("ijk->ik", self.rows[index[at:at + BLOCK]].reshape(-1, STRIDE, self.rows.shape[1])) for at in range(0, len(words), BLOCK)])
        total = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0, dtype=np.float64)])
        signs = [np.bitwise_or.reduce(signature(words).reshape(-1, STRIDE, SIGNS), axis=1)]  # of 1, 2, 4, ... strides from each
        strides = np.arange(len(sums))

        def held(start: np.ndarray, end: np.ndarray) -> np.ndarray:
            """Signatures of the strides from start to end."""
            level = np.frexp(end - start)[1] - 1
            while len(signs) <= level.max():
                step = 1 << (len(signs) - 1)
                signs.append(signs[-1] | np.concatenate([signs[-1][step:], np.zeros((min(step, len(sums)), SIGNS), np.uint64)])[:len(sums)])
            out = np.zeros((len(start), SIGNS), np.uint64)
            for x in np.flatnonzero(np.bincount(level)):
                of = np.flatnonzero(level == x)
                out[of] = signs[x][start[of]] | signs[x][end[of] - (1 << int(x))]
            return out

        def enough(found: np.ndarray, k: np.ndarray) -> np.ndarray:
            bits = np.bitwise_count(found & self.signs[k])
            return sum(bits[:, i].astype(np.int64) for i in range(SIGNS)) >= self.need[k]

        for m, ks, units in self.scales:
            begin, reach = strides[(strides + m <= last) | (strides == first)], self.margins[ks].max()
            for at in range(0, len(begin), 4096):
                lo = begin[at:at + 4096]
                hi = np.minimum(lo + m, last[lo])
                near = self.unit((total[hi] - total[lo]).astype(np.float32)) @ units.T
                w, j = np.divmod(np.flatnonzero(near >= self.cosine), len(ks))
                if not len(w):
                    continue
                some = enough(held(np.maximum(lo - reach, first[lo]), np.minimum(hi + reach, last[lo]))[w], ks[j])  # once a window, in the widest region
                w, j = w[some], j[some]
                if not len(w):
                    continue
                k = ks[j]
                start = np.maximum(lo[w] - self.margins[k], first[lo[w]])
                end = np.minimum(hi[w] + self.margins[k], last[lo[w]])
                for i in np.flatnonzero(enough(held(start, end), k)):
                    yield int(k[i]), int(start[i]) * STRIDE, int(end[i]) * STRIDE, float(near[w[i], j[i]])

    def many(self, texts: list[np.ndarray]) -> list[list[tuple]]:
        """For each text (item id, cosine, share of the item, share of its answer) of each item that leaked, by its best region."""
        out: list[list[tuple]] = [[] for _ in texts]
        there = [i for i, t in enumerate(texts) if len(t)]
        if not there or not self.items:
            return out
        sizes = np.array([-(-len(texts[i]) // STRIDE) for i in there])
        words = np.full(int(sizes.sum()) * STRIDE, -1, np.int32)
        ends = np.cumsum(sizes)
        for i, end, size in zip(there, ends, sizes):
            words[(end - size) * STRIDE:(end - size) * STRIDE + len(texts[i])] = texts[i]
        begins = ends - sizes
        owner = np.repeat(np.arange(len(there)), sizes)
        best: dict[tuple[int, int], tuple] = {}
        for k, lo, hi, near in self.candidates(words, begins[owner], ends[owner]):
            codes, answer, held = self.telling[k], self.answers[k], self.sets[k]
            region = [c for c in words[lo:hi].tolist() if c in held]
            if len(region) < LOOSE * len(codes):  # no common subsequence can be longer
                continue
            share = common_subsequence(codes, region) / len(codes)
            if share < LOOSE:
                continue
            at = (int(owner[lo // STRIDE]), k)
            beside = words[max(int(begins[at[0]]) * STRIDE, lo - self.reach[k]):min(int(ends[at[0]]) * STRIDE, hi + self.reach[k])]
            told = common_subsequence(answer, [c for c in beside.tolist() if c in self.answer_sets[k]]) / max(1, len(answer))
            if (share >= VERBATIM or share >= LOOSE and told >= ANSWER) and (share, told, near) > best.get(at, (0, 0, 0)):
                best[at] = (share, told, near)
        for (at, k), (share, told, near) in sorted(best.items()):
            out[there[at]].append((self.items[k][0], near, share, told))
        return out

    def all(self, texts: Iterator[np.ndarray]) -> Iterator[list[tuple]]:
        held, size = [], 0
        for codes in texts:
            held.append(codes)
            size += len(codes)
            if size >= BLOCK:
                yield from self.many(held)
                held, size = [], 0
        yield from self.many(held)


def item_codes(items: DataFrame, item: str, text: str, answer: str | None) -> Iterator[list[tuple]]:
    """The benchmark in lists of at most ITEMS: (id, codes, codes of the answer). Without an answer column, an item's last quarter."""
    block = []
    rows = items.select(F.col(item).alias("i"), F.col(text).alias("t"), (F.col(answer) if answer else F.lit(None)).cast("string").alias("a"))
    for r in rows.toLocalIterator():
        codes, told = word_codes([r.t, r.a])
        block.append((r.i, codes, told if len(told) else codes[len(codes) - -(-len(codes) // 4):]))
        if len(block) == ITEMS:
            yield block
            block = []
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, space: Space, text: str = "text", item: str = "item_id", item_text: str = "text",
               answer: str | None = None, name: str = "leaks", cosine: float = COSINE, codes: str | None = None) -> DataFrame:
    """docs with a column of the benchmark items found in each whole text: (item, cosine, item_share, answer_share).

    The benchmark is the query set: it is read in lists of a bounded size, each sent to the workers and compared with all
    documents. Items and texts that are null or have no words match nothing. Repeated items are each found, under their id.
    An existing column of that name is replaced. Where docs hold the word numbers of their whole texts already, codes names that
    column, and it is read in place of the text.
    """
    spark = docs.sparkSession
    python_ready(spark)
    kind = items.schema[item].dataType.simpleString()
    sent_type = pa.list_(pa.struct([("item", to_arrow_type(items.schema[item].dataType)), ("cosine", pa.float64()),
                                    ("item_share", pa.float64()), ("answer_share", pa.float64())]))
    latent = spark.sparkContext.broadcast(space)
    names, shape = ("item", "cosine", "item_share", "answer_share"), f"array<struct<item: {kind}, cosine: double, item_share: double, answer_share: double>>"

    def searching(sent):
        @F.arrow_udf(shape)
        def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            searcher = Searcher(latent.value, sent.value, cosine)
            for batch in batches:
                texts = text_codes(batch) if codes is None else (np.frombuffer(c, np.int32) for c in batch.to_pylist())
                yield pa.array([[dict(zip(names, hit)) for hit in hits] for hits in searcher.all(texts)], sent_type)
        return search

    lists = [searching(spark.sparkContext.broadcast(block))(F.col(codes or text)) for block in item_codes(items, item, item_text, answer)]
    return docs.withColumn(name, F.concat(*lists) if lists else F.array().cast(shape))


def drop_leaked(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents in which no benchmark item is found, with their own columns."""
    return find_leaks(docs, items, fit_space(docs, text), text, name="_leaks").filter(F.size("_leaks") == 0).drop("_leaks")


@query("op2_decontamination")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    python_ready(spark)
    docs = keep(encode(table(spark, folder, "documents"), "text", "doc_id"))  # words are hashed once, for the space and the search
    found = find_leaks(docs, table(spark, folder, "benchmark"), space_of(docs.select("codes")), codes="codes")
    return found.select("doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id", F.col("leak.item").alias("item_id"), *(F.col(f"leak.{c}").alias(c) for c in ("cosine", "item_share", "answer_share")))
