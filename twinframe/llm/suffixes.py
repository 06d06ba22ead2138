"""Exact substring deduplication with suffix arrays of shards.

Every byte covered by a SIZE-byte string that also starts anywhere else is removed. Strings that can repeat are brought together first: the window
of SIZE bytes at each place chooses its smallest GRAM-byte hash (the leftmost if equal), so equal windows choose the same gram at the same distance.
Consecutive windows with one choice form a context: their gram's hash, the first start and their number. Only contexts whose gram occurs again can
hold a repeated window. Equal contexts are counted, not compared. Where one gram has several different contexts, one copy of each goes to a shard.
Two equal windows agree on half of what they hold beyond the gram, before or behind it; contexts that agree with no other on either half are left
out. Shards are dealt by gram and half, so a frequent gram is spread over them and a context may be in two. The suffixes of a shard are sorted by
external induction (`induced.py`). Each window belongs to one context, so nothing is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm.base import by_size, keep, python_ready, query, table
from twinframe.llm.induced import repeated_windows

SIZE = 200
GRAM = 64
PIECE = 1 << 18  # bytes looked at together
SHARD = 2 << 20  # bytes of contexts of one shard, on average

_PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(flat: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place, built by doubling."""
    h = flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    span = 1
    while span < GRAM:
        factor = np.uint64(pow(0xBF58476D1CE4E5B9, span, 1 << 64))
        h = h[:-span] * factor + (h[span:] ^ (h[span:] >> np.uint64(31)))
        span *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def contexts(flat: np.ndarray, owner: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first start, number of starts, place of the gram after the first start) for the windows of some texts laid end to end; owner numbers the text of each byte."""
    none = np.zeros(0, np.int64)
    if len(flat) < size:
        return none.astype(np.uint64), none, none, none
    h, span = gram_hashes(flat), size - GRAM + 1
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    padded = np.append(key, np.full(-len(key) % span, np.uint64(0xFFFFFFFFFFFFFFFF))).reshape(-1, span)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(flat) - size + 1
    choice = np.minimum(behind[:windows], ahead[span - 1:span - 1 + windows]) & _PLACE
    start = np.flatnonzero(owner[:windows] == owner[size - 1:])
    if not len(start):
        return none.astype(np.uint64), none, none, none
    chosen = choice[start]
    first = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (np.diff(start) != 1)))
    place = chosen[first].astype(np.int64)
    return h[place], start[first], np.diff(np.append(first, len(start))), place - start[first]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def text_key(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def find_contexts(docs: DataFrame, size: int) -> DataFrame:
    """(gram, context, text_key, at, n, gap) of all windows of the column text; context is a hash of the bytes they cover, gap that before the gram."""
    python_ready(docs.sparkSession)
    names = ["gram", "context", "text_key", "at", "n", "gap"]

    def emit(raw: list[bytes], shifts: list[int], keys: list[bytes]) -> pa.RecordBatch:
        flat = np.frombuffer(b"".join(raw), np.uint8)
        lengths = np.array([len(r) for r in raw])
        begin = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(raw), dtype=np.int32), lengths)
        gram, at, n, gap = contexts(flat, owner, size)
        whose = owner[at] if len(at) else np.zeros(0, np.int32)
        view, digest = memoryview(flat), xxhash.xxh3_64_intdigest
        context = np.fromiter((digest(view[a:b]) for a, b in zip(at.tolist(), (at + n + size - 1).tolist())), np.uint64, len(at))
        place = at - begin[whose] + np.array(shifts)[whose] if len(at) else at
        return pa.RecordBatch.from_arrays([signed(gram), signed(context), pa.array(keys, pa.binary()).take(pa.array(whose)), pa.array(place.astype(np.int64)),
                                           pa.array(n.astype(np.int32)), pa.array(gap.astype(np.int32))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in by_size((t or "" for t in batch.column(0).to_pylist()), PIECE):
                raw, shifts, keys, held = [], [], [], 0
                for data in (t.encode("utf-8", "replace") for t in block):
                    if len(data) < size:
                        continue
                    key = text_key(data)
                    for lo in range(0, len(data) - size + 1, PIECE):  # a very long text in pieces that share no window
                        part = data[lo:lo + PIECE + size - 1]
                        raw.append(part)
                        shifts.append(lo)
                        keys.append(key)
                        held += len(part)
                        if held >= 4 * PIECE:
                            yield emit(raw, shifts, keys)
                            raw, shifts, keys, held = [], [], [], 0
                if raw:
                    yield emit(raw, shifts, keys)

    return docs.select("text").mapInArrow(run, "gram bigint, context bigint, text_key binary, at bigint, n int, gap int")


def with_key(docs: DataFrame, text: str) -> DataFrame:
    """docs with text_key, a 128-bit hash of the text's bytes."""
    python_ready(docs.sparkSession)

    @F.arrow_udf("binary")
    def keys(texts: pa.Array) -> pa.Array:
        return pa.array([text_key((t or "").encode("utf-8", "replace")) for t in texts.to_pylist()], pa.binary())

    return docs.withColumn("text_key", keys(F.col(text)))


def alike(grams: list[int], bodies: list[bytes], gaps: list[int], size: int) -> list[int]:
    """Places of the contexts that may share a window with another one of the same gram: they agree on the half before the gram or behind it.

    A window holds size - GRAM bytes beyond the gram, so at least half of them lie on one side; a context too short for a half
    on one side has no window with that half.
    """
    half = (size - GRAM + 1) // 2
    seen: dict[tuple, list[int]] = {}
    for i, (gram, body, gap) in enumerate(zip(grams, bodies, gaps)):
        if gap >= half:
            seen.setdefault((gram, 0, body[gap - half:gap]), []).append(i)
        if gap + GRAM + half <= len(body):
            seen.setdefault((gram, 1, body[gap + GRAM:gap + GRAM + half]), []).append(i)
    return sorted({i for met in seen.values() if len(met) > 1 for i in met})


def half_hashes(body: bytes, gap: int, size: int) -> tuple[int | None, int | None]:
    """Hashes of the half before the gram and of that behind it; None where a context is too short for a half on that side."""
    half, behind = (size - GRAM + 1) // 2, gap + GRAM
    digest = xxhash.xxh3_64_intdigest
    found = (body[gap - half:gap] if gap >= half else None, body[behind:behind + half] if behind + half <= len(body) else None)
    return tuple(None if f is None else digest(f) - (1 << 63) for f in found)


def deal(parts: DataFrame, shards: int) -> DataFrame:
    """The contexts that agree with another of their gram on a half, each in the shards of its halves that are met again.

    parts: gram, context, body, gap and the hashes before and behind; (gram, context) is a key of it and of each shard.
    """
    halves = parts.select("gram", "context", F.posexplode(F.array("before", "behind")).alias("side", "half")).filter("half is not null")
    again = keep(halves.groupBy("gram", "side", "half").agg(F.count("*").alias("uses")).filter("uses > 1").drop("uses"))
    shard = F.pmod(F.xxhash64("gram", "side", "half"), F.lit(shards))
    dealt = keep(halves.join(again, ["gram", "side", "half"], "left_semi").select("gram", "context", shard.alias("shard"))
                 .groupBy("gram", "context").agg(F.collect_set("shard").alias("of")))
    return parts.join(dealt, ["gram", "context"]).select("gram", "context", "body", "gap", F.explode("of").alias("shard"))


def shard_spans(parts: DataFrame, size: int) -> DataFrame:
    """(gram, context, lo, hi): the runs of starts in each context that are repeated windows of one of its shards."""
    schema = "gram bigint, context bigint, lo int, hi int"

    def run(part: pa.Table) -> pa.Table:
        gram, context, body, gap = (part.column(c).to_pylist() for c in ("gram", "context", "body", "gap"))
        kept, out = alike(gram, body, gap, size), []
        for i, starts in zip(kept, repeated_windows([body[i] for i in kept], size)):
            g, c = gram[i], context[i]
            if len(starts):
                cut = np.flatnonzero(np.diff(starts) != 1) + 1
                out += [(g, c, int(x[0]), int(x[-1]) + 1) for x in np.split(starts, cut)]
        columns = list(zip(*out)) or [(), (), (), ()]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())],
                        names=["gram", "context", "lo", "hi"])

    return parts.groupBy("shard").applyInArrow(run, schema)


def removed_spans(docs: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """((text_key, spans), (text_key, text) of the distinct texts that have a gram met twice): what to remove of the column text."""
    found = keep(find_contexts(docs, size))
    # Written before they are joined: a join whose sides both come through exchanges of their own can be split where one gram is frequent.
    again = keep(found.groupBy("gram").agg(F.count("*").alias("uses")).filter("uses > 1").select("gram"))
    near = keep(found.join(again, "gram"))  # not grouped in the same stage, which would keep a frequent gram's rows together
    met = keep(near.groupBy("gram", "context", "text_key", "at", "n", "gap").agg(F.count("*").alias("rows")))
    kinds = keep(met.groupBy("gram", "context").agg(F.sum("rows").alias("uses"), F.max("n").alias("n"), F.max("gap").alias("gap"), F.min(F.struct("text_key", "at")).alias("first")))
    mixed = keep(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("gram"))
    unlike = keep(kinds.join(mixed, "gram").select("gram", "context", "uses", "n", "gap", "first.*"))
    whole = kinds.filter("uses > 1").select("gram", "context").withColumns({"lo": F.lit(0), "hi": F.lit(None).cast("int")})

    wanted = met.select("text_key").distinct().withColumnRenamed("text_key", "_key")
    keyed = with_key(docs.select("text").filter(F.octet_length("text") >= size), "text")
    texts = keep(keyed.join(wanted, F.col("text_key") == F.col("_key"), "left_semi").groupBy("text_key").agg(F.first("text").alias("text")))

    volume = unlike.agg(F.sum(F.col("n") + size)).first()[0] or 0
    shards = max(1, -(-volume // SHARD))
    places = unlike.groupBy("text_key").agg(F.collect_list(F.struct("gram", "context", "at", "n", "gap")).alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode("utf-8", "replace")
                for lo in range(0, len(of), 10_000):
                    some = of[lo:lo + 10_000]
                    bodies = [data[p["at"]:p["at"] + p["n"] + size - 1] for p in some]
                    before, behind = zip(*(half_hashes(b, p["gap"], size) for b, p in zip(bodies, some)))
                    yield pa.RecordBatch.from_arrays([pa.array([p["gram"] for p in some], pa.int64()), pa.array([p["context"] for p in some], pa.int64()),
                                                      pa.array(bodies, pa.binary()), pa.array([p["gap"] for p in some], pa.int32()),
                                                      pa.array(before, pa.int64()), pa.array(behind, pa.int64())],
                                                     ["gram", "context", "body", "gap", "before", "behind"])

    parts = keep(texts.join(places, "text_key").select("text", "places").mapInArrow(cut, "gram bigint, context bigint, body binary, gap int, before bigint, behind bigint"))
    runs = shard_spans(deal(parts, shards), size)
    single = runs.join(kinds.filter("uses = 1").select("gram", "context"), ["gram", "context"])
    starts = met.join(keep(whole.unionByName(single)), ["gram", "context"]).select(
        "text_key", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.coalesce("hi", "n") + F.lit(size - 1)).alias("hi"))
    return starts.groupBy("text_key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), texts


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by spans."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans): each whole text as bytes and what is removed of it.

    A null text counts as empty. Rows with equal texts are repeats of each other, so all their windows go. Keys may be null or
    repeat: every row gives a row. spans are (lo, hi) of the removed runs; what is left need not be valid UTF-8.
    """
    if size < GRAM:
        raise ValueError(f"size must be at least {GRAM}")
    body = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans, texts = removed_spans(body.select("text"), size)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data, found in zip(*(c.to_pylist() for c in batch.columns)):
                data, at, kept = data.encode("utf-8", "replace"), 0, hashlib.sha256()
                runs = merged([(s["lo"], s["hi"]) for s in found])
                for lo, hi in runs:
                    kept.update(data[at:lo])
                    at = hi
                kept.update(data[at:])
                rows.append((name, sum(b - a for a, b in runs), kept.hexdigest(), [{"lo": a, "hi": b} for a, b in runs]))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()),
                                              pa.array(columns[3], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))], ["text_key", "n_removed", "kept", "spans"])

    shape = "array<struct<lo: bigint, hi: bigint>>"
    done = texts.join(spans, "text_key").select("text_key", "text", "spans").mapInArrow(apply, f"text_key binary, n_removed bigint, kept string, spans {shape}")
    rows = with_key(body, "text").select("key", "text_key", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    return (rows.join(done, "text_key", "left")
            .select(F.col("key").alias(key), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
                    F.coalesce(F.size("spans"), F.lit(0)).cast("bigint").alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"),
                    F.coalesce("spans", F.array().cast(shape)).alias("spans")))


@query("op9_suffix_array_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_substrings(table(spark, folder, "documents").select("doc_id", "text")).drop("spans")
