"""Language identification as inference of a mixture.

Each language has a distribution of letter trigrams, hashed to a fixed number of buckets. The n-grams of a document come from a mixture of
languages; expectation-maximisation estimates the proportions. For each number of languages the likeliest ones of the full mixture are fitted
again alone, and the set with the best likelihood less a penalty for its size is chosen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm.base import by_size, crc_of_id, python_ready, query, table

BUCKETS = 1 << 12
SMOOTH = 0.5  # added to each count
ROUNDS = 12  # of expectation-maximisation
DOCS = 64  # documents inferred at once
NONE = "und"

_FOLD = np.arange(0x250, dtype=np.uint32)
_FOLD[:128] = 32  # ASCII but letters is a gap
_FOLD[97:123] = np.arange(97, 123)


def gram_counts(texts: list[str | None]) -> np.ndarray:
    """[text, bucket]: trigrams of the lower-cased letters of each whole text; other ASCII signs are gaps, gaps in a row count once."""
    out = np.zeros((len(texts), BUCKETS), np.int64)
    owners, grams = [], []
    for i, text in enumerate(texts):
        signs = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), np.uint32)
        low = signs < 0x250
        signs = np.where(low, _FOLD[np.where(low, signs, 0)], signs)
        signs = signs[np.append(True, (signs[1:] != 32) | (signs[:-1] != 32))].astype(np.uint64)
        if len(signs) < 3:
            continue
        mixed = (signs[:-2] * np.uint64(0x9E3779B1) + signs[1:-1]) * np.uint64(0x85EBCA77) + signs[2:]
        grams.append(((mixed * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(52)).astype(np.int32))
        owners.append(np.full(len(mixed), i, np.int32))
    if grams:
        out += np.bincount(np.concatenate(owners) * np.int64(BUCKETS) + np.concatenate(grams), minlength=out.size).reshape(out.shape)
    return out


@dataclass
class Languages:
    names: list[str]
    chances: np.ndarray  # [language, bucket], rows sum to 1


def fit_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Languages:
    """Trigram counts of each language over all documents of the learning folds (CRC-32 of the key mod 4 is not 2) with a language.

    What is shuffled is a row of counts for each language and task, what the driver gets one for each language.
    """
    python_ready(docs.sparkSession)
    names = [r[0] for r in docs.filter(_learnt(key) & F.col(lang).isNotNull()).groupBy(F.col(lang)).count().orderBy(lang).collect()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(names), BUCKETS), np.int64)
        place = {n: i for i, n in enumerate(names)}
        for batch in batches:
            texts, langs, at = batch.column(0).to_pylist(), [place[x] for x in batch.column(1).to_pylist()], 0
            for block in by_size((t or "" for t in texts), 1 << 18, 1 << 10):
                counts = gram_counts(block)
                for n in set(langs[at:at + len(block)]):
                    found[n] += counts[[x == n for x in langs[at:at + len(block)]]].sum(axis=0)
                at += len(block)
        n, b = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(found[n, b])], ["n", "b", "c"])

    rows = (docs.filter(_learnt(key) & F.col(lang).isNotNull()).select(F.col(text), F.col(lang)).mapInArrow(count, "n int, b int, c bigint")
            .groupBy("n", "b").agg(F.sum("c").alias("c")).toPandas())
    counts = np.zeros((len(names), BUCKETS))
    counts[rows.n, rows.b] = rows.c
    counts += SMOOTH
    return Languages(names, counts / counts.sum(axis=1, keepdims=True) if names else counts)


def _learnt(key: str):
    """Not held out; a document without a key is in no fold and not learnt from."""
    return crc_of_id(key) % 4 != 2


def mixture(counts: np.ndarray, chances: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(proportions [doc, language], log-likelihood [doc]) by expectation-maximisation, with weight only on allowed languages."""
    share = allowed / np.maximum(1, allowed.sum(axis=1, keepdims=True))
    size = np.maximum(1, counts.sum(axis=1, keepdims=True))
    for _ in range(rounds):
        total = share @ chances
        share = share * ((counts / np.maximum(total, 1e-30)) @ chances.T) / size
    total = share @ chances
    return share, (counts * np.log(np.maximum(total, 1e-30))).sum(axis=1)


def infer(counts: np.ndarray, model: Languages) -> np.ndarray:
    """[doc, language]: proportions under the language set of the best penalised likelihood (half a log of the n-grams for each language)."""
    chances = model.chances.astype(np.float32)
    counts = counts.astype(np.float32)
    every = np.ones((len(counts), len(chances)), np.float32)
    share, _ = mixture(counts, chances, every)
    order = np.argsort(-share, axis=1, kind="stable")
    best, score = np.zeros_like(share), np.full(len(counts), -np.inf)
    penalty = 0.5 * np.log(np.maximum(2, counts.sum(axis=1)))
    left = np.arange(len(counts))  # documents whose last larger set was better; the others are done, whatever their neighbours do
    for many in range(1, len(chances) + 1):
        allowed = np.zeros((len(left), len(chances)), np.float32)
        np.put_along_axis(allowed, order[left, :many], 1, axis=1)
        share, fit = mixture(counts[left], chances, allowed, 0 if many == 1 else ROUNDS)
        value = fit - many * penalty[left]
        better = value > score[left]
        left = left[better]
        best[left], score[left] = share[better], value[better]
        if not len(left):
            break
    return best


def identify(docs: DataFrame, model: Languages, text: str = "text", name: str = "language") -> DataFrame:
    """docs with a struct column: the main language, its share, and all (language, share) of the chosen set, largest first.

    A text that is null or has no letter, and any text where nothing was learnt, is `und` with share 0 and no languages.
    Shares that tie go in the order of the names. An existing column of that name is replaced.
    """
    python_ready(docs.sparkSession)
    part = pa.struct([("lang", pa.string()), ("share", pa.float64())])
    kind = pa.struct([("lang", pa.string()), ("share", pa.float64()), ("languages", pa.list_(part))])

    @F.arrow_udf("struct<lang: string, share: double, languages: array<struct<lang: string, share: double>>>")
    def found(texts: pa.Array) -> pa.Array:
        out, texts = [], texts.to_pylist()
        for at in range(0, len(texts), DOCS):
            block = texts[at:at + DOCS]
            shares = infer(gram_counts(block), model) if model.names else np.zeros((len(block), 0))
            for text, row in zip(block, shares.tolist()):
                languages = sorted(((-s, n) for s, n in zip(row, model.names) if s > 0)) if any(map(str.isalpha, text or "")) else []
                languages = [{"lang": n, "share": min(1.0, -s)} for s, n in languages]
                out.append({**(languages[0] if languages else {"lang": NONE, "share": 0.0}), "languages": languages})
        return pa.array(out, kind)

    return docs.withColumn(name, found(F.col(text)))


@query("op4_language_mixture")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_of_id("doc_id") % 4 == 2).alias("held_out"), F.col("language.lang").alias("lang_pred"),
                        F.col("language.share").alias("score"), F.size("language.languages").cast("bigint").alias("n_languages"))
