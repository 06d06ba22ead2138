"""Cleaning steps over whole tables; column-level pieces are in ``functions.scalars``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.functions import scalars
from twinframe.operators.encode import fit_medians
from twinframe.operators.profile import as_double

CLASS_RANGES = 256


def drop_redundant_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*[n for n in names if n in df.columns])


def clean_text(df: DataFrame, columns: Sequence[str], sentinels: Sequence[str] = ("?", ""), strip: str | None = ".") -> DataFrame:
    return df.withColumns({c: scalars.null_sentinels(F.col(c), sentinels, strip) for c in columns})


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def union_splits(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def align_features(real: DataFrame, synthetic: DataFrame, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Shared columns but the target, in the real table's order."""
    shared = [c for c in real.columns if c in synthetic.columns and c != target]
    return real.select(*shared), synthetic.select(*shared)


def align_schema_with_nulls(df: DataFrame, like: DataFrame) -> DataFrame:
    """Columns of ``like`` in its order; absent ones are null."""
    return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
                       for f in like.schema.fields])


def augment_union(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Real rows and synthetic rows under the real schema, duplicates kept."""
    return real.unionByName(align_schema_with_nulls(synthetic, real))


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.na.drop(subset=[target])


def nearest_class(values: DataFrame, classes: DataFrame) -> DataFrame:
    """(v, nearest): for distinct numbers v the nearest of the distinct numbers c, the smaller on a tie.

    Both are cut into ranges at quantiles of the classes; a value looks up and down inside its range, and beyond it at the
    nearest filled ranges, of which there are at most CLASS_RANGES.
    """
    cuts = classes.select(F.percentile_approx("c", [i / CLASS_RANGES for i in range(1, CLASS_RANGES)])).first()[0] or []
    bounds = F.array(*[F.lit(float(x)) for x in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    met = classes.select(F.col("c").alias("x"), F.lit(1).alias("kind")).unionByName(values.select(F.col("v").alias("x"), F.lit(0).alias("kind")))
    met = met.withColumn("_range", F.size(F.filter(bounds, lambda b: b < F.col("x")))).withColumn("c", F.when(F.col("kind") == 1, F.col("x")))
    ends = met.filter("kind = 1").groupBy("_range").agg(F.min("c").alias("least"), F.max("c").alias("most"))
    every = values.sparkSession.range(len(set(cuts)) + 1).select(F.col("id").cast("int").alias("_range"))
    across = Window.orderBy("_range")
    around = every.join(ends, "_range", "left").select("_range", F.last("most", True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
                                                       F.first("least", True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    inside = Window.partitionBy("_range").orderBy("x", F.desc("kind"))
    up = Window.partitionBy("_range").orderBy(F.desc("x"), F.desc("kind"))
    whole = (Window.unboundedPreceding, Window.currentRow)
    found = met.withColumn("low", F.last("c", True).over(inside.rowsBetween(*whole))).withColumn("high", F.last("c", True).over(up.rowsBetween(*whole)))
    found = found.filter("kind = 0").join(around, "_range").withColumn("low", F.coalesce("low", "before")).withColumn("high", F.coalesce("high", "after"))
    near = F.when(F.col("high").isNull() | (F.col("x") - F.col("low") <= F.col("high") - F.col("x")), F.col("low")).otherwise(F.col("high"))
    return found.select(F.col("x").alias("v"), near.alias("nearest"))


def snap_target_to_class(synthetic: DataFrame, real: DataFrame, target: str) -> DataFrame:
    """Numeric label to the nearest real class (the smaller class on a tie); unknown text label to null.

    Labels are snapped once per distinct value and joined back, so a row never meets every class.
    """
    classes = real.select(F.col(target).alias("_class")).filter(F.col("_class").isNotNull()).distinct()
    if isinstance(real.schema[target].dataType, T.StringType):
        known = classes.withColumn("_known", F.lit(True))
        return synthetic.join(known, F.col(target) == F.col("_class"), "left").withColumn(
            target, F.when(F.col("_known"), F.col(target))).drop("_class", "_known")
    value = as_double(synthetic, target)
    values = synthetic.select(value.alias("v")).filter(F.col("v").isNotNull()).distinct()
    snapped = nearest_class(values, classes.select(F.col("_class").cast("double").alias("c")))
    return synthetic.withColumn("_v", value).join(snapped, F.col("_v") == F.col("v"), "left").withColumn(target, F.col("nearest")).drop("_v", "v", "nearest")


def rescale_marker(df: DataFrame, column: str, name: str = "size") -> DataFrame:
    """Median fill, then 10 + 34 (x - min) / (max - min); a constant column gives 18, an empty one 12."""
    span = df.agg(F.min(as_double(df, column)).alias("lo"), F.max(as_double(df, column)).alias("hi")).first()
    if span["lo"] is None:
        return df.withColumn(name, F.lit(12.0))
    if span["lo"] == span["hi"]:
        return df.withColumn(name, F.lit(18.0))
    middle = fit_medians(df, [column])[column]
    value = F.coalesce(as_double(df, column), F.lit(middle))
    return df.withColumn(name, F.lit(10.0) + F.lit(34.0) * ((value - F.lit(float(span["lo"]))) / F.lit(
        float(span["hi"] - span["lo"]))))


# Words that name the positive and the negative class, in order of preference.
POSITIVE_WORDS = ("1", "true", "yes", "y", "positive", "pos", "case", "malignant")
NEGATIVE_WORDS = ("0", "false", "no", "n", "negative", "neg", "control", "benign")


def positive_negative_class(df: DataFrame, target: str) -> DataFrame:
    """(negative, positive) of a two-valued column as text: number order, known words, else text order."""
    values = df.select(F.col(target).cast("string").alias("v")).filter(F.col("v").isNotNull()).distinct()
    row = values.agg(F.min("v").alias("first"), F.max("v").alias("last"), F.min(F.col("v").try_cast("double").isNotNull()).alias("numbers"),
                     F.min_by("v", F.col("v").try_cast("double")).alias("low"),
                     F.max_by("v", F.col("v").try_cast("double")).alias("high"),
                     F.min_by("v", _preference(POSITIVE_WORDS)).alias("pos"), F.min_by("v", _preference(NEGATIVE_WORDS)).alias("neg"),
                     F.min(_preference(POSITIVE_WORDS)).alias("pos_rank"), F.min(_preference(NEGATIVE_WORDS)).alias("neg_rank"))
    worded = F.col("pos_rank").isNotNull() & F.col("neg_rank").isNotNull()
    return row.select(
        F.when(F.col("numbers"), F.col("low")).when(worded, F.col("neg")).otherwise(F.col("first")).alias("negative"),
        F.when(F.col("numbers"), F.col("high")).when(worded, F.col("pos")).otherwise(F.col("last")).alias("positive"))


def _preference(words: Sequence[str]) -> Column:
    """Place of a word in the list, null when it is not there."""
    return F.nullif(F.array_position(F.array(*[F.lit(w) for w in words]), F.lower(F.trim(F.col("v")))), F.lit(0))


def sensitive_value_overlap(real: DataFrame, generated: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, reused): generated non-null values that occur in the source column."""
    out = None
    for c in columns:
        source = real.select(F.col(c).cast("string").alias("v")).filter(F.col("v").isNotNull()).distinct()
        part = generated.select(F.col(c).cast("string").alias("v")).filter(F.col("v").isNotNull()).join(
            source, "v", "left_semi").agg(F.count(F.lit(1)).alias("reused")).select(F.lit(c).alias("column"), "reused")
        out = part if out is None else out.unionByName(part)
    return out


def category_sets(real: DataFrame, synthetic: DataFrame, column: str) -> dict[str, DataFrame]:
    """Distinct non-null keys shared by both sides, and on either side."""
    left, right = (d.select(F.col(column).cast("string").alias("key")).filter(F.col("key").isNotNull())
                   for d in (real, synthetic))
    return {"intersection": left.intersect(right), "union": left.union(right).distinct()}


def check_matrix(df: DataFrame, z: str, width: int | None = None) -> None:
    """Refuse an empty table, vectors of another width, and numbers that are not finite."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.min(F.size(z)).alias("lo"), F.max(F.size(z)).alias("hi"), F.max(
        F.exists(z, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).alias("bad")).first()
    if row["n"] == 0:
        raise ValueError("At least one row is required.")
    if row["lo"] != row["hi"] or (width is not None and row["lo"] != width):
        raise ValueError(f"Latent vectors must have {width or 'one'} width; got {row['lo']} to {row['hi']}.")
    if row["bad"]:
        raise ValueError("Latent vectors must hold finite numbers only.")
