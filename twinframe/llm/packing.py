"""Best-fit packing by a grouping genetic algorithm on islands.

Texts become token pieces of at most `capacity`. Pieces below that are dealt by a hash of their row into blocks of a bounded size; several
islands evolve solutions of the same block, and between epochs each island receives the best solution of its neighbour. Only the bins that
the blocks leave badly filled meet again in a second deal. Solutions are arrays of bin numbers, so what moves is a few bytes a piece.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinframe.llm.base import by_size, keep, python_ready, query, table, width
from twinframe.llm.tokens import byte_letters, tokenizer

CAPACITY = 2048
BLOCK = 4096  # pieces of a block, on average
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 12
POPULATION = 6
FULL = 0.985  # a bin filled to this share is not dealt again
CACHE = 800_000  # words, and parts of words, a worker remembers before it forgets them all

# Characters whose case, class and normal form every Unicode table agrees on; other texts go to the library whole.
ODD = re.compile("[^\\t-\\r\x20-\x7e\xa0-įı-ɏ]")
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
END = b"\0\0\0\0"  # id 0 after each document


# ---- tokens

class WordIds(dict):
    """Token ids as little-endian 32-bit words; what stands between white space is encoded when first met and remembered."""

    ready: dict[str, WordIds] = {}

    def __init__(self, path: str):
        super().__init__()
        self.tok, self.letters = tokenizer(path), {b: c for c, b in byte_letters().items()}
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.codes = [n.to_bytes(4, "little") for n in range(self.tok.get_vocab_size())]
        self.parts: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in cls.ready:
            cls.ready[path] = cls(path)
        return cls.ready[path]

    def __missing__(self, word: str) -> bytes:
        get = self.parts.get
        if word.isalpha():
            code = get(word) or self.merged(word)
        else:
            code = b"".join([get(part) or self.merged(part) for part in SPLIT.findall(word)])
        self[word] = code
        return code

    def merged(self, part: str) -> bytes:
        """Ids of one pre-token. Those of plain words are remembered, since they come back with other signs around them."""
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        code = b"".join([self.codes[t.id] for t in self.tok.model.tokenize(letters)])
        self.parts[part] = code
        return code

    def forget(self) -> None:
        if len(self) > CACHE:
            self.clear()
        if len(self.parts) > CACHE:
            self.parts.clear()

    def many(self, texts: list[str]) -> list[bytes]:
        out, get = [], self.__getitem__
        self.forget()
        for text in texts:
            if ODD.search(text) or any(s in text for s in self.special):
                out.append(np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            elif len(text) > 4_000_000:
                out.append(self.long(text))
            else:
                out.append(b"".join(map(get, text.lower().split())))
        return out

    def long(self, text: str) -> bytes:
        found, out = (m[0] for m in re.finditer(r"\S+", text.lower())), []
        while words := list(islice(found, 200_000)):
            self.forget()
            out.append(b"".join(map(self.__getitem__, words)))
        return b"".join(out)


def token_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                 with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]): each text's ids and a closing id 0, cut into pieces of capacity.

    A null or empty text is the one piece [0]. Repeated rows, and rows whose key is null, give pieces each.
    """
    python_ready(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, step = WordIds.of(path), 4 * capacity
        for batch in batches:
            owner, piece, start, length, crc, ids = [], [], [], [], [], []
            at = 0
            for block in by_size(t or "" for t in batch.column(1).to_pylist()):
                for code in words.many(block):
                    code += END
                    for k, lo in enumerate(range(0, len(code), step)):
                        part = code[lo:lo + step]
                        owner.append(at)
                        piece.append(k)
                        start.append(lo // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part)
                    at += 1
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()),
                       *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["key", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(key), F.col(text)).mapInArrow(cut, schema)


# ---- one island

def best_fit(order: list[int], sizes: list[int], bins: np.ndarray, room: list[tuple[int, int]] | list[int], next_bin: int,
             capacity: int) -> int:
    """Put each piece of order into the fullest bin that has room for it, or a new one; returns the next free bin number.

    room holds (left space << 24 | bin) of the open bins, sorted.
    """
    for item in order:
        size = sizes[item]
        at = bisect_left(room, size << 24)
        if at < len(room):
            key = room.pop(at)
            number, left = key & 0xFFFFFF, (key >> 24) - size
        else:
            number, left = next_bin, capacity - size
            next_bin += 1
        bins[item] = number
        if left > 0:
            insort(room, left << 24 | number)
    return next_bin


def fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first; then the sum of squared fills, which rewards full bins beside empty ones. Smaller is better."""
    fill = np.bincount(bins, weights=sizes)
    fill = fill[fill > 0]
    return len(fill), -float(((fill / capacity) ** 2).sum())


def cross(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, listed: list[int], capacity: int, rng) -> np.ndarray:
    """A child of a with some well-filled bins of b injected whole.

    Bins of a that hold a copy of an injected piece go, as do its emptiest few; their other pieces are displaced and
    best-fitted, largest first, into what is left.
    """
    fill_a, fill_b = np.bincount(a, weights=sizes), np.bincount(b, weights=sizes)
    there = np.flatnonzero(fill_b)
    ranked = there[np.argsort(-fill_b[there], kind="stable")]
    well = ranked[:max(1, len(ranked) // 2)]
    chosen = np.zeros(len(fill_b), bool)
    chosen[rng.choice(well, max(1, len(well) // int(rng.integers(4, 12))), replace=False)] = True
    inject = chosen[b]
    gone = np.zeros(len(fill_a), bool)
    gone[a[inject]] = True
    open_a = np.flatnonzero((fill_a > 0) & ~gone)
    if len(open_a):
        gone[open_a[np.argsort(fill_a[open_a], kind="stable")[:max(2, len(open_a) // 50)]]] = True
    displaced = np.flatnonzero(gone[a] & ~inject)
    child = a.copy()
    child[inject] = b[inject] + len(fill_a)
    held = np.bincount(child[~(gone[a] & ~inject)], weights=sizes[~(gone[a] & ~inject)], minlength=1).astype(np.int64)
    open_bins = np.flatnonzero((held > 0) & (held < capacity))
    room = sorted(((capacity - held[open_bins]) << 24 | open_bins).tolist())
    noise = rng.random(len(displaced)) * (0.1 if rng.random() < 0.5 else 0.0)
    order = displaced[np.argsort(-(sizes[displaced] * (1 + noise)), kind="stable")].tolist()
    best_fit(order, listed, child, room, len(held), capacity)
    return np.unique(child, return_inverse=True)[1]


def evolve(sizes: np.ndarray, population: list[np.ndarray], generations: int, capacity: int, seed: int) -> list[np.ndarray]:
    """The population after some generations, best first; an empty one is seeded by best fit in disturbed orders."""
    rng, listed = np.random.default_rng(seed), sizes.tolist()
    population = list(population)
    while len(population) < POPULATION:
        noise = rng.random(len(sizes)) * 0.15 * min(len(population), 3)
        bins = np.zeros(len(sizes), np.int64)
        best_fit(np.argsort(-(sizes * (1 + noise)), kind="stable").tolist(), listed, bins, [], 0, capacity)
        population.append(bins)
    scored = sorted(((fitness(p, sizes, capacity), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])[:POPULATION]
    least, tag = -(-int(sizes.sum()) // capacity), len(population)
    for _ in range(generations):
        if scored[0][0][0] <= least:
            break
        first, second = rng.choice(len(scored), 2, replace=False)
        child = cross(scored[min(first, second)][2], scored[max(first, second)][2], sizes, listed, capacity, rng)
        tag += 1
        scored = sorted([*scored, (fitness(child, sizes, capacity), tag, child)], key=lambda x: x[:2])[:POPULATION]
    return [p for _, _, p in scored]


# ---- islands

def deal(pieces: DataFrame, total: int, seed: int, block: int) -> DataFrame:
    """(block, items) with about `block` pieces each, sorted by length and row; total is the number of pieces."""
    groups = max(1, round(total / block))
    return pieces.groupBy(F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(groups)).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("length").cast("int").alias("length"), "row"))).alias("items"))


def solve(blocks: DataFrame, capacity: int, islands: int, epochs: int, generations: int, seed: int) -> DataFrame:
    """(row, block, bin): the best solution of any island of each block."""
    python_ready(blocks.sparkSession)
    tasks = width(blocks.sparkSession)  # named, or tasks would be merged by their few bytes and not by the work they hold
    state = "block bigint, island int, sizes array<int>, population array<array<int>>, n_bins int, fill double"

    def step(epoch: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    sizes = np.array(row["sizes"], np.int64)
                    members = [np.array(p, np.int64) for p in row["population"]]
                    mix = np.random.SeedSequence([seed, epoch, int(row["block"]), row["island"]]).generate_state(1)[0]
                    members = evolve(sizes, members, generations, capacity, int(mix))
                    count, fill = fitness(members[0], sizes, capacity)
                    yield pa.RecordBatch.from_pylist(
                        [{"block": row["block"], "island": row["island"], "sizes": row["sizes"],
                          "population": [m.tolist() for m in members], "n_bins": count, "fill": fill}],
                        schema=pa.schema([("block", pa.int64()), ("island", pa.int32()), ("sizes", pa.list_(pa.int32())),
                                          ("population", pa.list_(pa.list_(pa.int32()))), ("n_bins", pa.int32()), ("fill", pa.float64())]))
        return run

    at = (blocks.select("block", F.col("items.length").alias("sizes"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
          .repartition(tasks, "block", "island")
          .select("block", "island", "sizes", F.array().cast("array<array<int>>").alias("population")))
    at = at.mapInArrow(step(0), state)
    for epoch in range(1, epochs):
        elites = F.collect_list(F.struct("island", F.col("population")[0].alias("best"))).over(W.partitionBy("block"))
        guest = F.filter(F.col("elites"), lambda x: x["island"] == F.pmod(F.col("island") + islands - 1, F.lit(islands)))[0]["best"]
        at = (at.repartition(tasks, "block").withColumn("elites", elites)
              .select("block", "island", "sizes", F.concat("population", F.array(guest)).alias("population"))
              .mapInArrow(step(epoch), state))
    best = at.groupBy("block").agg(F.min_by(F.col("population")[0], F.struct("n_bins", "fill", "island")).alias("bins"))
    return (blocks.join(best, "block").select("block", F.posexplode(F.arrays_zip(F.col("items.row").alias("row"), F.col("bins").alias("bin"))))
            .select(F.col("col.row").alias("row"), "block", F.col("col.bin").alias("bin")))


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS,
         generations: int = GENERATIONS, seed: int = 6) -> DataFrame:
    """pieces with sequence_id and offset: sequences of at most capacity tokens, each gapless from 0.

    Every row is packed once, repeated rows too. A piece as long as the capacity is a sequence of its own. Longer
    ones, and those of null or no length, are refused with an error. Columns called row, sequence_id or offset are
    replaced.
    """
    numbered = keep(pieces.drop("row", "sequence_id", "offset").withColumn("row", F.monotonically_increasing_id()))
    seen = numbered.agg(F.count(F.when(F.col("length") < capacity, 1)).alias("open"),
                        F.count(F.when(F.col("length").isNull() | (F.col("length") < 1) | (F.col("length") > capacity), 1)).alias("bad")).first()
    if seen.bad:
        raise ValueError(f"{seen.bad} pieces are empty or longer than {capacity}")
    part = numbered.filter(F.col("length") < capacity).select("row", "length")
    first = keep(solve(keep(deal(part, seen.open, seed, block)), capacity, islands, epochs, generations, seed)
                 .join(part, "row").withColumn("held", F.sum("length").over(W.partitionBy("block", "bin"))))
    done = first.filter(F.col("held") >= FULL * capacity).select("row", F.struct(F.lit(1), "block", "bin").alias("place"))
    poor = first.filter(F.col("held") < FULL * capacity).select("row", "length")
    again = solve(keep(deal(poor, poor.count(), seed + 1, 2 * block)), capacity, islands, epochs, generations, seed + 1)
    again = again.select("row", F.struct(F.lit(2), "block", "bin").alias("place"))
    whole = numbered.filter(F.col("length") == capacity).select("row", F.struct(F.lit(0), F.col("row").alias("block"), F.lit(0).alias("bin")).alias("place"))
    places = done.unionByName(again).unionByName(whole)
    order = W.partitionBy("place").orderBy("row")
    placed = places.join(numbered, "row")
    return (placed.withColumn("offset", F.sum("length").over(order.rowsBetween(W.unboundedPreceding, -1)))
            .withColumn("offset", F.coalesce("offset", F.lit(0)).cast("bigint"))
            .withColumn("sequence_id", F.min("row").over(W.partitionBy("place"))).drop("place", "row"))


@query("op6_best_fit_packing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, folder, "documents").select("doc_id", "text")
    packed = pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
    return packed.select(F.col("key").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
