"""Secret scans over a trigram inverted index.

Each rule's regex yields a Boolean query of trigrams that any match must contain. The index lists, for each trigram that some rule asks for, the
hashes of the texts that contain it, in blocks; posting lists are intersected block by block, and only the surviving texts are scanned with the
rule. A rule without a mandatory trigram scans every text. All work is DataFrame expressions.

A text stands in the index by its 64-bit hash, so copies are indexed once and the index does not depend on how the table is laid out. Should two
texts share a hash, both are scanned for what either asks for.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm.base import fresh, keep, query, table, width

BLOCKS = 8  # of the index, for each shuffle partition
MOST = 64  # alternatives followed before a query is made coarser


@dataclass(frozen=True)
class Rule:
    """A regex in the form that Java and Python read alike; least counts characters of a group."""

    kind: str
    pattern: str
    least: int
    group: int = 0


# A match of one class takes its whole run, so its least length may stand in the pattern; and none is tried again inside a run.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    Rule("hosted", r"gh[opsu]_[A-Za-z0-9]{36,}", 40),
    Rule("signed", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", 0),
)
BASE = 3  # so many first rules are the plain scan; the others add to it

Query = list[frozenset[str]]  # any of these sets of trigrams, all lower case; [empty set] is true of every text


# ---- trigram queries

def _absorb(query: Query) -> Query:
    """Without the alternatives that ask for more than another one does."""
    sets = sorted(set(query), key=len)
    out: Query = []
    for s in sets:
        if not any(o <= s for o in out):
            out.append(s)
    return out


def _both(a: Query, b: Query) -> Query:
    found = _absorb([x | y for x in a for y in b])
    return found if len(found) <= MOST else a


def _grams(strings: set[str]) -> Query:
    return _absorb([frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings])


def _strings(item) -> set[str] | None:
    """The few strings that one part of a parsed regex can match, or None where they are many."""
    kind, value = item
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN:
        found = set()
        for k, v in value:
            if k is not op.LITERAL:
                return None
            found.add(chr(v).lower())
        return found if len(found) <= 4 else None
    if kind is op.SUBPATTERN:
        return _sequence(value[3])[0]
    if kind is op.BRANCH:
        parts = [_sequence(p)[0] for p in value[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] == 0 and value[1] == 1:
        inner = _sequence(value[2])[0]
        return None if inner is None else inner | {""}
    return None


def _mandatory(item) -> Query:
    """The query of a part whose strings are many."""
    kind, value = item
    if kind is op.SUBPATTERN:
        return _sequence(value[3])[1]
    if kind is op.BRANCH:
        return _absorb([s for p in value[1] for s in _sequence(p)[1]])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] >= 1:
        return _sequence(value[2])[1]
    return [frozenset()]


def _sequence(items) -> tuple[set[str] | None, Query]:
    """(all strings it can match if they are few, its trigram query)."""
    query: Query = [frozenset()]
    run, whole = {""}, True
    for item in items:
        found = _strings(item)
        if found is not None and len(run) * len(found) <= MOST:
            run = {a + b for a in run for b in found}
            continue
        whole = False
        query = _both(_both(query, _grams(run)), _grams(found) if found is not None else _mandatory(item))
        run = {""}
    query = _both(query, _grams(run))
    return (run if whole else None), query


def trigram_query(pattern: str) -> Query:
    """Sets of trigrams, at least one of which is wholly in the lower-cased text of any match."""
    return _sequence(parser.parse(pattern))[1]


# ---- the index

def postings(docs: DataFrame, text: str, grams: list[str], blocks: int) -> DataFrame:
    """(block, gram, texts): the inverted index of some trigrams, as sets of text hashes."""
    held = F.filter(F.array(*[F.when(F.contains("lower", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]), lambda x: x.isNotNull())
    return (docs.select(F.xxhash64(text).alias("hash"), F.lower(F.col(text)).alias("lower")).select("hash", F.explode(held).alias("gram"))
            .groupBy(F.pmod("hash", F.lit(blocks)).alias("block"), "gram").agg(F.collect_set("hash").alias("texts")))


def candidates(index: DataFrame, grams: list[str], queries: dict[str, Query]) -> DataFrame:
    """(hash, kinds): the texts whose postings satisfy the query of some kinds. A list not in the index is empty."""
    place = {g: i for i, g in enumerate(grams)}
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "texts"))).alias("of"))
    none = F.array().cast("array<bigint>")

    def met(wanted: Query) -> Column:
        any_of = none
        for grams_of in wanted:
            all_of = None
            for g in sorted(grams_of):
                held = F.coalesce(F.col("of")[F.lit(place[g])], none)
                all_of = held if all_of is None else F.array_intersect(all_of, held)
            any_of = F.array_union(any_of, all_of)
        return any_of

    found = [F.struct(F.lit(kind).alias("kind"), met(q).alias("texts")) for kind, q in queries.items()]
    return (lists.select(F.explode(F.array(*found)).alias("x")).select("x.kind", F.explode("x.texts").alias("hash"))
            .groupBy("hash").agg(F.collect_set("kind").alias("kinds")))


# ---- verification

def matches(text: Column, rule: Rule) -> Column:
    """Array of (start, end, rank) of a rule's leftmost non-overlapping matches that are long enough; code points.

    What stands between matches gives the places: a split keeps every stretch, also empty ones.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.pattern, -1)
    sized = F.zip_with(F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))), part,
                       lambda x, p: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), F.length(p).alias("least")))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("out"))

    def step(state, x):
        start = state["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        put = F.when(x["least"] >= rule.least, F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start: int, end: int>>"))
        return F.struct(end.alias("at"), F.concat(state["out"], put).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(sized, nothing, step, lambda s: s["out"])).otherwise(F.array().cast("array<struct<start: int, end: int>>"))


def find_secrets(docs: DataFrame, text: str = "text", name: str = "secrets", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with an array column of (start, rank, kind, end), sorted: every rule's matches; rank is the rule's place.

    Matches of one rule do not overlap, those of different rules may. A null text counts as empty and has none. Repeated rows
    are scanned each. An existing column of that name is replaced.
    """
    columns = [c for c in docs.columns if c.lower() != name.lower()]
    hash_, kinds_ = fresh(docs, "_hash", "_kinds")
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if all(q)}
    grams = sorted({g for q in indexed.values() for s in q for g in s})
    body = F.coalesce(F.col(text), F.lit(""))
    hashed = docs.select(*columns, F.xxhash64(text).alias(hash_))
    if indexed:
        index = postings(docs.select(text), text, grams, BLOCKS * width(docs.sparkSession))
        # Written first: a join that reads both sides through exchanges of its own can be split where one text has many copies.
        kinds = keep(candidates(index, grams, indexed).withColumnsRenamed({"hash": hash_, "kinds": kinds_}))
        hashed = hashed.join(kinds.hint("shuffle_hash"), hash_, "left")
    else:
        hashed = hashed.withColumn(kinds_, F.array().cast("array<string>"))

    def spans(rule: Rule, rank: int) -> Column:
        wanted = F.coalesce(F.array_contains(kinds_, rule.kind), F.lit(False)) if rule.kind in indexed else F.rlike(body, F.lit(rule.pattern))
        made = F.transform(matches(body, rule), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"),
                                                                   s["end"].alias("end")))
        return F.when(wanted, made).otherwise(F.array().cast("array<struct<start: int, rank: int, kind: string, end: int>>"))

    return hashed.select(*columns, F.array_sort(F.concat(*[spans(rule, rank) for rank, rule in enumerate(rules)])).alias(name))


def written(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _is(kind: str):
    return lambda x: x == kind


@query("op1_secret_scans")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    kinds = F.transform("secrets", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, _is(rule.kind))).cast("bigint").alias(f"n_{rule.kind}") for rule in RULES[:BASE]]
    return found.select("doc_id", *counts, F.sha2(written(F.filter("secrets", lambda s: s["rank"] < BASE)), 256).alias("base_sha256"),
                        written(F.col("secrets")).alias("spans"))
