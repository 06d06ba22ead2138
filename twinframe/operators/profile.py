"""Profiling: column kinds, counts, summaries, encoding plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.functions.ordered import quantiles

# A categorical column is wide when distinct > max(50, 0.3 * rows).
HIGH_CARDINALITY_DISTINCT = 50
HIGH_CARDINALITY_SHARE = 0.3

# Three readings of a bool column: the measures take it as a number, the generator and the class
# rebalancing as a category, the copula and the quick report as no number.
BOOL_IS_NUMERIC = "bool_is_numeric"
BOOL_IS_CATEGORY = "bool_is_category"


def is_numeric(field: T.StructField, rule: str = BOOL_IS_CATEGORY) -> bool:
    if isinstance(field.dataType, T.BooleanType):
        return rule == BOOL_IS_NUMERIC
    return isinstance(field.dataType, T.NumericType)


def numeric_names(df: DataFrame, rule: str = BOOL_IS_CATEGORY, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f, rule) and f.name not in exclude]


def common_names(left: DataFrame, right: DataFrame, rule: str = BOOL_IS_NUMERIC, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical): the columns both tables have, in the order of the left one; a number in both counts as numeric."""
    shared = [c for c in left.columns if c in right.columns and c not in exclude]
    numeric = set(numeric_names(left, rule)) & set(numeric_names(right, rule))
    return [c for c in shared if c in numeric], [c for c in shared if c not in numeric]


def as_double(df: DataFrame, name: str) -> Column:
    """Number of a column, bool as 0/1, text by lenient cast."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return F.col(name).cast("int").cast("double")
    if isinstance(kind, T.StringType):
        return F.col(name).try_cast("double")
    return F.col(name).cast("double")


def split_column_kinds(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, categorical): numeric means a number type, not bool, with more than two distinct values.

    Two aggregate passes and no shuffle of values: smallest and largest first, then whether any value
    differs from both.
    """
    if not df.columns:
        raise ValueError("At least one column is required.")
    candidates = numeric_names(df)
    numeric: set[str] = set()
    if candidates:
        ends = df.agg(*[f(c).alias(f"{tag}{i}") for i, c in enumerate(candidates)
                        for tag, f in (("lo", F.min), ("hi", F.max))]).first()
        third = df.agg(*[F.max((F.col(c) != F.lit(ends[f"lo{i}"])) & (F.col(c) != F.lit(ends[f"hi{i}"]))).alias(f"t{i}")
                         for i, c in enumerate(candidates) if ends[f"lo{i}"] is not None] or [F.lit(None).alias("none")]
                       ).first().asDict()
        numeric = {c for i, c in enumerate(candidates) if third.get(f"t{i}")}
    return [c for c in df.columns if c in numeric], [c for c in df.columns if c not in numeric]


def column_kinds(df: DataFrame) -> DataFrame:
    """The split as a table (column, kind)."""
    numeric, categorical = split_column_kinds(df)
    return df.sparkSession.createDataFrame(
        [(c, "numeric" if c in set(numeric) else "categorical") for c in df.columns], "column string, kind string")


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long table (by..., column, value as text, n); null values keep a row.  One shuffle, combined before it."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return (df.select(*by, F.explode(entries).alias("e")).select(*by, "e.column", "e.value")
            .groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n")))


def _types(df: DataFrame, columns: Sequence[str]) -> Column:
    pairs = [F.lit(x) for c in columns for x in (c, df.schema[c].dataType.simpleString())]
    return F.create_map(*pairs)


def table_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: type, missing count, distinct count."""
    columns = list(columns or df.columns)
    return (value_counts(df, columns).groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.count("value").alias("distinct"), F.sum("n").alias("rows"))
        .withColumn("dtype", F.element_at(_types(df, columns), F.col("column"))))


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column: missing rate, distinct, mean, sample std, min, median, max."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), as_double(df, c).alias("value")) for c in columns])
    long = df.select(F.explode(entries).alias("e")).select("e.column", "e.value")
    moments = long.groupBy("column").agg(
        F.avg(F.col("value").isNull().cast("double")).alias("missing_rate"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    median = quantiles(long, ["column"], "value", [0.5]).select("column", F.col("quantile").alias("median"))
    distinct = long.groupBy("column", "value").agg(F.lit(1).alias("one")).groupBy("column").agg(
        F.count("value").alias("distinct"))
    return moments.join(distinct, "column").join(median, "column", "left")


def top_values(df: DataFrame, columns: Sequence[str], k: int = 8) -> DataFrame:
    """The k most frequent non-null values of each column, their rank and share of non-null rows."""
    counts = value_counts(df, columns).filter(F.col("value").isNotNull())
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    best = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(totals, "column").select("column", "rank", "value", "n", (F.col("n") / F.col("total")).alias("share"))


def categorical_summary(df: DataFrame, columns: Sequence[str], k: int = 8) -> DataFrame:
    """Per categorical column: missing rate, distinct, and the top values written as one text."""
    base = table_profile(df, columns).select(
        "column", "distinct", (F.col("missing") / F.col("rows")).alias("missing_rate"))
    text = top_values(df, columns, k).withColumn(
        "text", F.format_string("%s: %.1f%%", "value", F.col("share") * 100)).groupBy("column").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]), ", ")
        .alias("top_values"))
    return base.join(text, "column", "left")


def column_summary(df: DataFrame, k: int = 8) -> DataFrame:
    """Both summaries under one schema, with the column type."""
    numeric = numeric_names(df)
    other = [c for c in df.columns if c not in numeric]
    parts = []
    if numeric:
        parts.append(numeric_summary(df, numeric))
    if other:
        parts.append(categorical_summary(df, other, k))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.withColumn("dtype", F.element_at(_types(df, df.columns), F.col("column")))


def dataset_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per table: rows, numeric columns, categorical columns, missing cells."""
    parts = []
    for name, df in tables.items():
        numeric = len(numeric_names(df))
        missing = sum((F.count(F.when(F.col(c).isNull(), 1)) for c in df.columns), F.lit(0))
        parts.append(df.agg(F.count(F.lit(1)).alias("rows"), missing.cast("bigint").alias("missing")).select(
            F.lit(name).alias("dataset"), "rows", F.lit(numeric).cast("bigint").alias("numeric_columns"),
            F.lit(len(df.columns) - numeric).cast("bigint").alias("categorical_columns"), "missing"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def is_high_cardinality(distinct: Column, rows: Column) -> Column:
    return distinct > F.greatest(F.lit(HIGH_CARDINALITY_DISTINCT).cast("bigint"),
                                 F.floor(rows * F.lit(HIGH_CARDINALITY_SHARE)).cast("bigint"))


def encoding_plan(df: DataFrame, n_components: int | Mapping[str, int] = 2,
                  rationale: Mapping[str, str] | None = None) -> DataFrame:
    """Per column: distinct, missing, distinct share, strategy, latent width, wide-category flag, rationale."""
    numeric, _ = split_column_kinds(df)
    width = F.create_map(*[F.lit(x) for c in df.columns for x in (
        c, int(n_components.get(c, 2)) if isinstance(n_components, Mapping) else int(n_components))])
    is_number = F.col("column").isin(*numeric) if numeric else F.lit(False)
    wide = is_high_cardinality(F.col("distinct"), F.col("rows"))
    reasons = dict(rationale or {})
    special = (F.try_element_at(F.create_map(*[F.lit(x) for pair in reasons.items() for x in pair]), F.col("column"))
               if reasons else F.lit(None).cast("string"))
    decision = F.when(is_number, "median-imputed and standardised into the latent vector").when(
        wide, "one-hot context and a supervised projection block; wide column, warned about and used").otherwise(
        "one-hot context and a supervised projection block")
    return table_profile(df).select(
        "column", "dtype", "distinct", "missing",
        (F.col("distinct") / F.col("rows")).alias("distinct_share"),
        F.when(is_number, "standardised_numeric").otherwise("categorical_projection").alias("strategy"),
        F.when(is_number, F.lit(1)).otherwise(F.element_at(width, F.col("column"))).cast("bigint").alias("latent_width"),
        (wide & ~is_number).alias("wide_category"), F.coalesce(special, decision).alias("rationale"))


def drop_plan(df: DataFrame, drops: Sequence[str]) -> DataFrame:
    """The configured drops that exist in the table, as rows."""
    present = [(c, "drop", "redundant alias or duplicate of the target") for c in drops if c in df.columns]
    return df.sparkSession.createDataFrame(present, "column string, action string, reason string")


def high_cardinality_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct keys (null is a key) of each categorical column against the limit."""
    return table_profile(df, columns).select(
        "column", (F.col("distinct") + (F.col("missing") > 0).cast("bigint")).alias("distinct"), "rows").withColumn(
        "wide", is_high_cardinality(F.col("distinct"), F.col("rows")))


def quick_similarity(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Per column of the real table: means and missing rates, or distinct counts and coverage, on both sides."""
    numeric = numeric_names(real)
    other = [c for c in real.columns if c not in numeric]
    both = tagged_union(real, synthetic)
    is_real, is_synthetic = F.col("side") == "real", F.col("side") == "synthetic"
    parts = []
    if numeric:
        entries = F.array(*[F.struct(F.lit(c).alias("column"), as_double(both, c).alias("value")) for c in numeric])
        long = both.select("side", F.explode(entries).alias("e")).select("side", "e.column", "e.value")
        gone = F.col("value").isNull().cast("double")
        parts.append(long.groupBy("column").agg(
            F.avg(F.when(is_real, F.col("value"))).alias("real_mean"),
            F.avg(F.when(is_synthetic, F.col("value"))).alias("synthetic_mean"),
            F.avg(F.when(is_real, gone)).alias("real_missing"),
            F.avg(F.when(is_synthetic, gone)).alias("synthetic_missing"))
            .withColumn("abs_mean_delta", F.abs(F.col("real_mean") - F.col("synthetic_mean")))
            .withColumn("kind", F.lit("numeric")))
    if other:
        sides = side_counts(both, other)
        known = F.col("value").isNotNull()
        seen_real, seen_synthetic = F.col("n_real") > 0, F.col("n_synthetic") > 0
        parts.append(sides.groupBy("column").agg(
            F.count(F.when(known & seen_real, 1)).alias("real_unique"),
            F.count(F.when(known & seen_synthetic, 1)).alias("synthetic_unique"),
            (F.count(F.when(known & seen_real & seen_synthetic, 1))
             / F.greatest(F.count(F.when(known & seen_real, 1)), F.lit(1))).alias("category_coverage"),
            missing_rate("n_real").alias("real_missing"), missing_rate("n_synthetic").alias("synthetic_missing"))
            .withColumn("kind", F.lit("categorical")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def tagged_union(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Both tables under the real table's shared columns, with a ``side`` column."""
    shared = [c for c in real.columns if c in synthetic.columns]
    return real.select(*shared, F.lit("real").alias("side")).unionByName(
        synthetic.select(*shared, F.lit("synthetic").alias("side")))


def side_counts(both: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n_real, n_synthetic) over a tagged union; null values keep a row."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return both.select("side", F.explode(entries).alias("e")).select("side", "e.column", "e.value").groupBy(
        "column", "value").agg(F.count(F.when(F.col("side") == "real", 1)).alias("n_real"),
                               F.count(F.when(F.col("side") == "synthetic", 1)).alias("n_synthetic"))


def missing_rate(count: str) -> Column:
    """Share of the null row inside a group of (value, count) rows."""
    return F.try_divide(F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col(count))), F.lit(0)).cast("double"),
                        F.sum(count).cast("double"))
