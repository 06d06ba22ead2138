"""Sparse latent entries: a struct of slot numbers and values, for one-hot blocks too wide to be written out.

A fitted row has one entry of value 1 in each wide block; a moved row has those of the three rows it came from.  Numbers of slots run
through all wide blocks, (first slot, count) is a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinframe.functions.scalars import bind

NAME = "_slots"  # the column of a latent row that holds its sparse entries
Block = tuple[int, int]


def of(numbers: Sequence[Column]) -> Column:
    """Entries of value 1; a null number is left out."""
    return bind(F.array_compact(F.array(*[n.cast("int") for n in numbers])), lambda found: F.struct(
        found.alias("indices"), F.transform(found, lambda i: F.lit(1.0)).alias("values")))


def _value(s: Column, number: Column) -> Column:
    """The value at a slot, 0 where there is no entry."""
    place = F.array_position(s["indices"], number)
    return F.when(place > 0, F.get(s["values"], (place - 1).cast("int"))).otherwise(F.lit(0.0))


def moved(a: Column, b: Column, c: Column, factor: Column) -> Column:
    """a + factor (c - b); slots where that is zero are left out."""
    every = F.array_sort(F.array_distinct(F.concat(a["indices"], b["indices"], c["indices"])))
    entries = F.transform(every, lambda i: F.struct(i.alias("i"), (_value(a, i) + factor * (_value(c, i) - _value(b, i))).alias("v")))
    return bind(F.filter(entries, lambda e: e["v"] != 0), lambda e: F.struct(e["i"].alias("indices"), e["v"].alias("values")))


def _entries(s: Column) -> Column:
    return F.zip_with(s["indices"], s["values"], lambda i, v: F.struct(i.alias("i"), v.alias("v")))


def _among(number: Column, block: Block) -> Column:
    return (number >= F.lit(block[0])) & (number < F.lit(block[0] + block[1]))


def without(s: Column, block: Block) -> Column:
    """All entries but those of one block."""
    return bind(F.filter(_entries(s), lambda e: ~_among(e["i"], block)), lambda e: F.struct(e["i"].alias("indices"), e["v"].alias("values")))


def strongest(s: Column, block: Block) -> Column:
    """The block's key of the largest value, the smaller on a tie; null when there is no entry."""
    inside = F.filter(_entries(s), lambda e: _among(e["i"], block))
    return F.array_min(F.transform(inside, lambda e: F.struct((-e["v"]).alias("v"), e["i"].alias("i"))))["i"] - F.lit(block[0])


def depth(count: int, most: int) -> tuple[int, int]:
    """(levels, base): the fewest levels of at most ``most`` branches that tell count keys apart, and the smallest base that does."""
    levels = 1
    while most ** levels < count:
        levels += 1
    base = max(1, round(count ** (1.0 / levels)))
    while base ** levels < count:
        base += 1
    while base > 1 and (base - 1) ** levels >= count:
        base -= 1
    return levels, base


def digits(number: Column, levels: int, base: int) -> list[Column]:
    """The digits of a key's number, the highest first."""
    return [F.pmod(F.floor(number / F.lit(base ** (levels - 1 - i))), F.lit(base)).cast("int") for i in range(levels)]


def features(s: Column, blocks: Sequence[Block], most: int) -> list[Column]:
    """For trees, which would write out every slot: the digits of each block's strongest key, -1 when there is none."""
    out = []
    for block in blocks:
        key = strongest(s, block)
        out += [F.coalesce(d, F.lit(-1)).cast("double") for d in digits(key, *depth(block[1], most))]
    return out
