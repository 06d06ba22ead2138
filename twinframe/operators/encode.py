"""Mixed-type rows to latent vectors and back."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.functions import slots
from twinframe.functions.ordered import prefix_sums, quantiles
from twinframe.functions.scalars import category_key
from twinframe.operators.profile import (BOOL_IS_NUMERIC, as_double, numeric_names, split_column_kinds, tagged_union,
                                         value_counts)
from twinframe.operators.neighbours import coded
from twinframe.session import checkpoint

NUMERIC_BLOCK = "__numeric__"
NARROW = 64  # keys: a one-hot block of at most so many is written out, a wider one has a dictionary table and sparse entries


@dataclass
class Encoding:
    """Fitted statistics of a table, bounded by the number of columns, and a dictionary table of the wide columns' keys.

    ``categories`` lists the keys of narrow columns; ``sizes`` counts those of wide ones, whose keys are in ``dictionary``
    (column, key, idx, n) in ascending order, like the list.
    """

    columns: list[str]
    types: dict[str, str]
    numeric: list[str]
    categorical: list[str]
    median: dict[str, float] = field(default_factory=dict)
    mean: dict[str, float] = field(default_factory=dict)
    std: dict[str, float] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)
    mode: dict[str, str] = field(default_factory=dict)
    rows: int = 0
    sizes: dict[str, int] = field(default_factory=dict)
    dictionary: DataFrame | None = field(default=None, repr=False, compare=False)

    @property
    def wide(self) -> list[str]:
        return [c for c in self.categorical if c in self.sizes]

    def cardinality(self, column: str) -> int:
        return self.sizes[column] if column in self.sizes else len(self.categories[column])

    def blocks(self) -> dict[str, tuple[int, int]]:
        """Block name to (start, width) in the written-out vector: numbers first, then one-hot blocks in column order; wide ones take no place."""
        out, at = {}, 0
        if self.numeric:
            out[NUMERIC_BLOCK] = (0, len(self.numeric))
            at = len(self.numeric)
        for c in self.categorical:
            width = 0 if c in self.sizes else len(self.categories[c])
            out[c] = (at, width)
            at += width
        return out

    def slots(self) -> dict[str, slots.Block]:
        """Wide column to (first slot, count) of its sparse entries."""
        out, at = {}, 0
        for c in self.wide:
            out[c] = (at, self.sizes[c])
            at += self.sizes[c]
        return out

    @property
    def width(self) -> int:
        return sum(w for _, w in self.blocks().values())

    def keys(self, column: str) -> DataFrame:
        """(key, idx) of a wide column."""
        return self.dictionary.filter(F.col("column") == column).select("key", "idx")

    def to_json(self) -> str:
        """All but the dictionary table."""
        state = {f: getattr(self, f) for f in self.__dataclass_fields__ if f != "dictionary"}
        return json.dumps(state)

    @classmethod
    def from_json(cls, text: str, dictionary: DataFrame | None = None) -> "Encoding":
        return cls(**json.loads(text), dictionary=dictionary)


def _long_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(c).alias("column"), as_double(df, c).alias("value")) for c in columns])
    return df.select(F.explode(entries).alias("e")).select("e.column", "e.value")


def fit_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians by column; a column without a number gets 0."""
    found = {r["column"]: r["quantile"] for r in quantiles(_long_numbers(df, columns), ["column"], "value", [0.5]).collect()}
    return {c: float(found.get(c, 0.0)) for c in columns}


def impute_median(df: DataFrame, columns: Sequence[str], medians: dict[str, float] | None = None) -> DataFrame:
    medians = medians or fit_medians(df, columns)
    return df.withColumns({c: F.coalesce(as_double(df, c), F.lit(medians[c])) for c in columns})


def most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mode): the most frequent non-null text, the smallest on a tie."""
    counts = value_counts(df, columns).filter(F.col("value").isNotNull())
    return counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    modes = {r["column"]: r["mode"] for r in most_frequent(df, columns).collect()}
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(modes.get(c))) for c in columns})


def fit_scale(df: DataFrame, columns: Sequence[str], medians: dict[str, float]) -> tuple[dict, dict, int]:
    """Mean and population std after median fill, and the row count, in one aggregate."""
    filled = {c: F.coalesce(as_double(df, c), F.lit(medians[c])) for c in columns}
    row = df.agg(F.count(F.lit(1)).alias("rows"),
                 *[f(filled[c]).alias(f"{tag}{i}") for i, c in enumerate(columns)
                   for tag, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    # Twelve digits: the order in which partial sums meet must not reach the fitted model.
    mean = {c: float(f"{row[f'm{i}'] or 0.0:.12g}") for i, c in enumerate(columns)}
    std = {c: float(f"{row[f's{i}'] or 0.0:.12g}") or 1.0 for i, c in enumerate(columns)}
    return mean, std, int(row["rows"])


def category_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Dimension (column, key, idx, n): text keys in ascending order, null under the missing key."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), category_key(F.col(c)).alias("key")) for c in columns])
    counts = (df.select(F.explode(entries).alias("e")).select("e.column", "e.key")
              .groupBy("column", "key").agg(F.count(F.lit(1)).alias("n")))
    numbered = prefix_sums(counts.withColumn("_one", F.lit(1)), ["column"], "key", ["_one"])
    return numbered.select("column", "key", "n", (F.col("cum__one") - 1).cast("bigint").alias("idx"))


def category_value_map(df: DataFrame, columns: Sequence[str], row_id: str) -> DataFrame:
    """(column, key, value): the first original value, by row id, behind each text key."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), category_key(F.col(c)).alias("key"),
                                 F.col(c).cast("string").alias("value")) for c in columns])
    return (df.select(F.col(row_id).alias("_id"), F.explode(entries).alias("e")).groupBy("e.column", "e.key")
            .agg(F.min_by("e.value", "_id").alias("value")))


def fit_encoding(df: DataFrame, columns: Sequence[str] | None = None, *,
                 kinds: tuple[Sequence[str], Sequence[str]] | None = None, narrow: int = NARROW) -> Encoding:
    """Column kinds, medians, scale and keys of a table; columns of more than ``narrow`` keys are wide."""
    columns = list(columns or df.columns)
    table = df.select(*columns)
    numeric, categorical = kinds if kinds is not None else split_column_kinds(table)
    numeric, categorical = list(numeric), list(categorical)
    enc = Encoding(columns, {c: table.schema[c].dataType.simpleString() for c in columns}, numeric, categorical)
    enc.median = fit_medians(table, numeric) if numeric else {}
    enc.mean, enc.std, enc.rows = fit_scale(table, numeric, enc.median)
    if enc.rows == 0:
        raise ValueError("The table must contain at least one row.")
    if categorical:
        keys = checkpoint(category_table(table, categorical))
        count = {r["column"]: r["n"] for r in keys.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        enc.sizes = {c: count[c] for c in categorical if count[c] > narrow}
        listed = keys.filter(~F.col("column").isin(enc.wide)).collect()  # at most NARROW a column
        enc.categories = {c: sorted(r["key"] for r in listed if r["column"] == c) for c in categorical if c not in enc.sizes}
        enc.dictionary = keys.filter(F.col("column").isin(enc.wide)) if enc.sizes else None
    return enc


def standardised(df: DataFrame, enc: Encoding, c: str) -> Column:
    return (F.coalesce(as_double(df, c), F.lit(enc.median[c])) - F.lit(enc.mean[c])) / F.lit(enc.std[c])


def one_hot(df: DataFrame, enc: Encoding, c: str) -> Column:
    """0/1 array over the keys of a narrow column; an unknown key gives zeros."""
    key = category_key(F.col(c))
    return F.array(*[(key == F.lit(k)).cast("double") for k in enc.categories[c]])


def with_codes(df: DataFrame, enc: Encoding, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Add the number of each wide column's key by a join with the dictionary; null when unknown."""
    for c, name in zip(columns, names):
        known = enc.keys(c).select(F.col("key").alias(f"_key_{name}"), F.col("idx").cast("int").alias(name))
        df = df.join(known, category_key(F.col(c)) == F.col(f"_key_{name}"), "left").drop(f"_key_{name}")
    return df


def encode(df: DataFrame, enc: Encoding, *, name: str = "z", sparse: str = slots.NAME) -> DataFrame:
    """Add the latent vector: standardised numbers, then narrow one-hot blocks; with wide columns also their sparse entries.

    Row-wise but for the dictionary joins, valid on any table with the columns.
    """
    missing = [c for c in enc.columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns for the fitted encoding: {missing}")
    parts = []
    if enc.numeric:
        parts.append(F.array(*[standardised(df, enc, c) for c in enc.numeric]))
    parts += [one_hot(df, enc, c) for c in enc.categorical if c not in enc.sizes]
    empty = F.array().cast("array<double>")
    out = df.withColumn(name, F.concat(*parts) if len(parts) > 1 else parts[0] if parts else empty)
    if not enc.wide:
        return out
    codes = [f"_code_{i}" for i in range(len(enc.wide))]
    numbers = [F.col(code) + F.lit(enc.slots()[c][0]) for c, code in zip(enc.wide, codes)]
    return with_codes(out, enc, enc.wide, codes).withColumn(sparse, slots.of(numbers)).drop(*codes)


def search_vector(blocks: Sequence[slots.Block], z: str = "z", sparse: str = slots.NAME) -> Column:
    """Numbers followed by one code a wide block, -1 for none: the form in which neighbours are looked for."""
    if not blocks:
        return F.col(z)
    return F.concat(F.col(z), F.array(*[F.coalesce(slots.strongest(F.col(sparse), b), F.lit(-1)).cast("double") for b in blocks]))


def tree_features(df: DataFrame, enc: Encoding, name: str = "z", sparse: str = slots.NAME) -> DataFrame:
    """df, encoded, with its vector in the form that trees take: wide blocks as the digits of their keys."""
    if not enc.wide:
        return df
    return df.withColumn(name, F.concat(F.col(name), F.array(*slots.features(F.col(sparse), list(enc.slots().values()), NARROW)))).drop(sparse)


def without_block(z: Column, block: tuple[int, int], width: int) -> Column:
    """All latent coordinates but one block."""
    start, size = block
    return F.concat(F.slice(z, 1, start), F.slice(z, start + size + 1, max(width - start - size, 0)))


def decode_numeric(z: Column, enc: Encoding) -> dict[str, Column]:
    """Back to data units, cast to the fitted types (whole numbers by truncation)."""
    return {c: restore_type(z[i] * F.lit(enc.std[c]) + F.lit(enc.mean[c]), enc.types[c])
            for i, c in enumerate(enc.numeric)}


def restore_type(value: Column, kind: str) -> Column:
    """Whole numbers by truncation, after rounding away the noise of scaling there and back."""
    return (F.round(value, 9) if kind in ("tinyint", "smallint", "int", "bigint") else value).cast(kind)


def restore_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast columns back to fitted types and order; nulls stay."""
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in types.items() if c in df.columns])


def _joint(real: DataFrame, synthetic: DataFrame, target: str | None, real_id: str, synthetic_id: str) -> tuple[DataFrame, Encoding]:
    """(side, id, z, perhaps its sparse entries) of both tables, bool as a number, missing categories as the most frequent value."""
    skip = {target, real_id, synthetic_id}
    shared = [c for c in real.columns if c in synthetic.columns and c not in skip]
    both = tagged_union(real.select(F.col(real_id).cast("string").alias("id"), *shared),
                        synthetic.select(F.col(synthetic_id).cast("string").alias("id"), *shared))
    numeric = [c for c in numeric_names(both.select(*shared), BOOL_IS_NUMERIC)]
    categorical = [c for c in shared if c not in numeric]
    filled = impute_mode(both, categorical) if categorical else both
    enc = fit_encoding(filled, shared, kinds=(numeric, categorical))
    return encode(filled, enc).select("side", "id", "z", *([slots.NAME] if enc.wide else [])), enc


def joint_features(real: DataFrame, synthetic: DataFrame, *, target: str | None = None,
                   real_id: str, synthetic_id: str) -> DataFrame:
    """(side, id, z): both tables under one median, scale, mode and one-hot fitted on their union; with wide columns also their sparse entries.

    Bool counts as a number here.  Missing categories take the most frequent value.
    """
    return _joint(real, synthetic, target, real_id, synthetic_id)[0]


def joint_vectors(real: DataFrame, synthetic: DataFrame, *, target: str | None = None,
                  real_id: str, synthetic_id: str) -> tuple[DataFrame, str]:
    """((side, id, z), metric): the same rows in the form in which neighbours are looked for."""
    rows, enc = _joint(real, synthetic, target, real_id, synthetic_id)
    blocks = list(enc.slots().values())
    return rows.select("side", "id", search_vector(blocks).alias("z")), coded(enc.width) if blocks else "euclidean"
