"""Token counts by the whole-token shortcut: most pre-tokens are one token, and only the rest is merged."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm.base import by_size, python_ready, query, table

CACHE = 1_000_000  # merged pre-tokens a worker remembers before it forgets them all
# Characters for which Unicode tables of any age agree on letter, number and space; other texts go to the library whole.
ODD = re.compile("[^\\t-\\r\x20-\x7e\xa0-ɏ]")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(path: str) -> list[str]:
    """The vocabulary strings that are one pre-token and that the merges, run on that string alone, make into one token.

    A vocabulary entry need not be reachable from its own letters: an earlier merge can block it. So each is
    proved by encoding it.
    """
    letters, tok, split = byte_letters(), tokenizer(path), regex.compile(PATTERN)
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    strings = {}
    for entry, number in vocabulary.items():
        try:
            text = bytes(letters[c] for c in entry).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if split.fullmatch(text) and split.findall(text) == [text]:
            strings[text] = number
    found = tok.encode_batch(list(strings), add_special_tokens=False)
    return [text for (text, number), e in zip(strings.items(), found) if e.ids == [number]]


class Counter:
    """Counts the tokens of texts; one for each worker process and vocabulary."""

    ready: dict[str, Counter] = {}

    def __init__(self, path: str, whole: list[str]):
        self.tok, self.split, self.whole = tokenizer(path), regex.compile(PATTERN), whole
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.letters = {b: c for c, b in byte_letters().items()}
        self.known = dict.fromkeys(whole, 1)

    @classmethod
    def of(cls, path: str, whole: list[str]) -> Counter:
        if path not in cls.ready:
            cls.ready[path] = cls(path, whole)
        return cls.ready[path]

    def learn(self, pieces: set[str]) -> None:
        fresh = list(pieces - self.known.keys())
        if len(self.known) + len(fresh) > CACHE + len(self.whole):
            self.known = dict.fromkeys(self.whole, 1)
            fresh = list(pieces - self.known.keys())
        merge = self.tok.model.tokenize
        for piece in fresh:
            self.known[piece] = len(merge(piece.encode().decode("latin-1").translate(self.letters)))

    def many(self, texts: list[str]) -> list[int]:
        """Tokens of some texts; pre-tokens are looked up for all of them at once."""
        out, lists = [0] * len(texts), []
        for i, text in enumerate(texts):
            if ODD.search(text) or any(s in text for s in self.special):
                out[i] = len(self.tok.encode(text, add_special_tokens=False).ids)
            elif len(text) > 4_000_000:
                out[i] = self.long(text)
            else:
                lists.append((i, self.split.findall(text)))
        self.learn(set().union(*(pieces for _, pieces in lists)))
        for i, pieces in lists:
            out[i] = sum(map(self.known.__getitem__, pieces))
        return out

    def long(self, text: str) -> int:
        found, total = (m[0] for m in self.split.finditer(text)), 0
        while pieces := list(islice(found, 200_000)):
            self.learn(set(pieces))
            total += sum(map(self.known.__getitem__, pieces))
        return total


def count_tokens(docs: DataFrame, path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """docs with one more column: the tokens of each whole text as the tokenizers library gives them.

    A null text counts as empty, which has 0 tokens. Repeated rows are counted each. An existing column of that
    name is replaced, all others are kept as they are. The strings proved to be whole go to the workers as a
    broadcast, whose size is that of the vocabulary.
    """
    spark = docs.sparkSession
    python_ready(spark)
    whole = spark.sparkContext.broadcast(whole_tokens(path))

    @F.arrow_udf("bigint")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter.of(path, whole.value)
        for batch in batches:
            texts = (t or "" for t in batch.to_pylist())
            yield pa.array([n for block in by_size(texts) for n in counter.many(block)], pa.int64())

    return docs.withColumn(name, tokens(F.col(text)))


@query("op8_token_counts")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "n_tokens",
                          (F.col("n_tokens") > 512).alias("over_limit"))
