"""Seeded row generators.  Output rows carry ``row`` = 0..n-1; each draw is addressed by that number."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinframe.functions import rng
from twinframe.functions.normal import normal_cdf, normal_quantile
from twinframe.functions.ordered import dense_index, prefix_sums, smallest
from twinframe.functions.scalars import bind, category_key
from twinframe.operators.encode import fit_encoding, fit_medians, with_codes
from twinframe.operators.measures import average_ranks
from twinframe.operators.neighbours import coded, knn_exact
from twinframe.operators.profile import as_double, numeric_names
from twinframe.session import checkpoint, spread

DRAW_CHUNK = 10_000  # draws written out from one row at a time
REGULARISATION = 1e-6  # fixed value: added to the copula's covariance diagonal


def _draws(df: DataFrame, n: int) -> DataFrame:
    if n < 0:
        raise ValueError("The number of rows must not be negative.")
    return df.sparkSession.range(n).withColumnRenamed("id", "row")


def fixed_size_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement (all when n covers the table): the n smallest hash numbers."""
    u = rng.uniform(seed, "sample", key)
    return smallest(df.withColumn("_u", u), "_u", key, n).drop("_u")


def bootstrap_rows(df: DataFrame, key: str, n: int | None = None, seed: int = 42) -> DataFrame:
    """n whole rows with replacement."""
    size = df.count()
    draws = _draws(df, size if n is None else n).withColumn("_i", rng.uniform_index(size, seed, "bootstrap", "row"))
    return draws.join(dense_index(df, key, name="_i"), "_i").drop("_i")


def independent_columns(df: DataFrame, key: str, columns: Sequence[str], n: int | None = None,
                        seed: int = 42) -> DataFrame:
    """Every column drawn on its own, with replacement: one narrow join per column."""
    size = df.count()
    indexed = dense_index(df.select(key, *columns), key, name="_i")
    out = _draws(df, size if n is None else n)
    for c in columns:
        draws = out.select(F.col("row"), rng.uniform_index(size, seed, f"independent.{c}", "row").alias("_i"))
        out = out.join(draws.join(indexed.select("_i", c), "_i").select("row", c), "row")
    return out


def stratified_columns(df: DataFrame, key: str, target: str, columns: Sequence[str], n: int | None = None,
                       seed: int = 42) -> DataFrame:
    """Target levels (null is a level) by their frequency, other columns drawn inside the level.

    The level of a draw is that of one uniformly drawn row, which has exactly the frequency law.
    """
    if target not in df.columns:
        raise ValueError(f"Unknown target column: {target}")
    size = df.count()
    others = [c for c in columns if c != target]
    rows = df.select(key, category_key(F.col(target)).alias("_level"), target, *others)
    sizes = rows.groupBy("_level").agg(F.count(F.lit(1)).alias("_size"))
    picked = _draws(df, size if n is None else n).withColumn("_i", rng.uniform_index(size, seed, "level", "row"))
    levels = picked.join(dense_index(rows.select(key, "_level", target), key, name="_i"), "_i").select(
        "row", "_level", target).join(sizes, "_level")
    indexed = dense_index(rows.drop(target), key, within=["_level"], name="_j")
    out = levels.select("row", target)
    for c in others:
        draws = levels.select("row", "_level", rng.uniform_index(F.col("_size"), seed, f"stratum.{c}", "row").alias("_j"))
        out = out.join(draws.join(indexed.select("_level", "_j", c), ["_level", "_j"]).select("row", c), "row")
    return out.select("row", *[c for c in columns])


PLACES = 100_000  # sorted places that are looked up together


def _empirical_quantile(asked: DataFrame, long: DataFrame) -> DataFrame:
    """(row, column, value): linear order-statistic quantile of ``long`` (column, value) at ``asked`` (row, column, p, total).

    Every distinct value owns a range of sorted places.  Places are cut into buckets; a value opens its own
    bucket and is carried into each later bucket it covers, so a lookup is a forward fill inside one bucket.
    """
    counts = long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    width = F.lit(PLACES).cast("bigint")
    owned = prefix_sums(counts, ["column"], "value", ["n"]).join(totals, "column").withColumn(
        "start", F.col("cum_n") - F.col("n")).withColumn("w", width)
    entry = F.struct("value", "next_value", "cum_n")
    bucket = lambda place: F.floor(place / F.col("w")).cast("bigint")
    opened = owned.select("column", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("cum_n") - 1))).alias("b"),
                          "start", "w", entry.alias("entry")).select(
        "column", "b", F.greatest(F.col("start"), F.col("b") * F.col("w")).alias("place"), F.lit(0).alias("kind"),
        F.lit(None).cast("bigint").alias("row"), F.lit(None).cast("double").alias("part"), "entry")
    spot = (F.col("total") - 1) * F.col("p")
    wanted = asked.withColumn("w", width).withColumn("place", F.floor(spot).cast("bigint")).select(
        "column", bucket(F.col("place")).alias("b"), "place", F.lit(1).alias("kind"), "row",
        (spot - F.floor(spot)).alias("part"), F.lit(None).cast(opened.schema["entry"].dataType).alias("entry"))
    fill = Window.partitionBy("column", "b").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = opened.unionByName(wanted).withColumn("e", F.last("entry", ignorenulls=True).over(fill)).filter("kind = 1")
    upper = F.when(F.col("place") + 1 < F.col("e.cum_n"), F.col("e.value")).otherwise(
        F.coalesce(F.col("e.next_value"), F.col("e.value")))
    return met.select("row", "column", (F.col("e.value") + (upper - F.col("e.value")) * F.col("part")).alias("value"))


def normal_scores(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, column, rank, score): average rank and its normal score (rank - 1/2) / present."""
    ranks = average_ranks(df, key, columns)
    return ranks.withColumn("score", normal_quantile((F.col("rank") - 0.5) / F.col("present")))


def gaussian_copula(df: DataFrame, key: str, columns: Sequence[str], n: int | None = None,
                    seed: int = 42) -> DataFrame:
    """Numbers by a Gaussian copula with empirical marginals and missing rates; categories on their own.

    Bool does not count as a number here.
    """
    numeric = [c for c in numeric_names(df) if c in columns]
    categorical = [c for c in columns if c not in numeric]
    size = df.count()
    n = size if n is None else n
    out = _draws(df, n)
    if numeric:
        scores = normal_scores(df, key, numeric).groupBy(key).agg(
            *[F.max(F.when(F.col("column") == c, F.col("score"))).alias(f"s{i}") for i, c in enumerate(numeric)])
        wide = df.select(key).join(scores, key, "left").fillna(0.0, [f"s{i}" for i in range(len(numeric))])
        d = len(numeric)
        fitted = wide.agg(*[F.avg(f"s{i}").alias(f"m{i}") for i in range(d)],
                          *[F.covar_samp(f"s{i}", f"s{j}").alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]).first()
        shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"g{i}") for i, c in enumerate(numeric)],
                        *[F.count(c).alias(f"t{i}") for i, c in enumerate(numeric)]).first()
        covariance = np.array([[fitted[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)])
        factor = np.linalg.cholesky(covariance + np.eye(d) * REGULARISATION)
        normals = [rng.normal(seed, f"copula.{j}", "row") for j in range(d)]
        noise = out.select("row", *[x.alias(f"e{j}") for j, x in enumerate(normals)])
        correlated = []
        for i in range(d):
            z = F.lit(float(fitted[f"m{i}"] or 0.0))
            for j in range(i + 1):
                z = z + F.lit(float(factor[i, j])) * F.col(f"e{j}")
            correlated.append(F.struct(F.lit(numeric[i]).alias("column"), normal_cdf(z).alias("p"),
                                       F.lit(int(shares[f"t{i}"])).alias("total")))
        asked = noise.select("row", F.explode(F.array(*correlated)).alias("e")).select("row", "e.*").filter("total > 0")
        entries = F.array(*[F.struct(F.lit(c).alias("column"), as_double(df, c).alias("value")) for c in numeric])
        long = df.select(F.explode(entries).alias("e")).select("e.column", "e.value")
        drawn = _empirical_quantile(asked, long).groupBy("row").agg(
            *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"_v{i}") for i, c in enumerate(numeric)])
        out = out.join(drawn, "row", "left").select("row", *[
            F.when(rng.uniform(seed, f"copula.missing.{i}", "row") >= F.lit(float(shares[f"g{i}"])), F.col(f"_v{i}")).cast(
                df.schema[c].dataType).alias(c) for i, c in enumerate(numeric)])
    if categorical:
        out = out.join(independent_columns(df, key, categorical, n, seed), "row")
    return out.select("row", *columns)


def stratified_fit_sample(df: DataFrame, key: str, label: str, size: int | float | None, seed: int = 42) -> DataFrame:
    """At least one row per class when the classes fit, else one row of ``size`` random classes; the rest uniform.

    A float asks for that share of the rows, rounded up.
    """
    if size is None:
        return df
    rows = df.count()
    n = min(rows, max(1, int(np.ceil(rows * size))) if isinstance(size, float) else int(size))
    if n >= rows:
        return df
    u = rng.uniform(seed, "fit", key)
    marked = df.withColumn("_u", u)
    first = marked.groupBy(label).agg(F.min_by(key, F.struct("_u", key)).alias(key)).select(
        F.col(key).alias("_first"), rng.uniform(seed, "class", category_key(F.col(label))).alias("_c"))
    classes = first.count()
    if classes >= n:  # one row of each of n random classes
        chosen = smallest(first, "_c", "_first", n)
        return marked.join(chosen, F.col(key) == F.col("_first")).drop("_u", "_first", "_c")
    ahead = marked.join(first, F.col(key) == F.col("_first"), "left_semi")
    others = marked.join(first, F.col(key) == F.col("_first"), "left_anti")
    return ahead.unionByName(smallest(others, "_u", key, n - classes)).drop("_u")


def _quota(counts: DataFrame, label: str, total: int, rows: int, least: int = 0) -> DataFrame:
    """Share ``total`` over classes in proportion to ``n`` by largest remainder (ties by class text).

    The class table is small against the rows, and is itself a window by share only.
    """
    share = F.col("n") * F.lit(float(total)) / F.lit(float(rows))
    part = counts.withColumn("_base", F.greatest(F.floor(share), F.lit(least)).cast("bigint")).withColumn(
        "_rest", share - F.floor(share))
    short = total - int(part.agg(F.sum("_base")).first()[0] or 0)
    lifted = part.orderBy(F.desc("_rest"), category_key(F.col(label))).limit(max(short, 0)).select(
        category_key(F.col(label)).alias("_k"), F.lit(1).alias("_more"))
    return part.withColumn("_k", category_key(F.col(label))).join(lifted, "_k", "left").select(
        F.col("_k"), (F.col("_base") + F.coalesce("_more", F.lit(0))).cast("bigint").alias("quota"))


def _place_in_class(df: DataFrame, key: str, label: str | None, seed: int, stream: str) -> DataFrame:
    """Dense 1-based place of each row inside its class, in hash order; a hot class stays in many buckets."""
    cls = F.lit("") if label is None else category_key(F.col(label))
    return dense_index(df.withColumn("_k", cls).withColumn("_h", F.md5(F.concat_ws(
        "|", F.lit(str(seed)), F.lit(stream), F.col(key).cast("string")))), "_h", within=["_k"], name="_place").withColumn(
        "_place", F.col("_place") + 1)


def train_test_split(df: DataFrame, key: str, *, label: str | None = None, test_share: float = 0.3,
                     seed: int = 42) -> DataFrame:
    """Add ``is_test``: ceil(share * n) rows, shared over classes when every class has two rows or more."""
    rows = df.count()
    total = int(np.ceil(test_share * rows))
    if label is not None:
        sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
        check = sizes.agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("classes")).first()
        if check["least"] is None or check["least"] < 2 or check["classes"] < 2:
            label = None
    placed = _place_in_class(df, key, label, seed, "split")
    if label is None:
        return placed.withColumn("is_test", F.col("_place") <= total).drop("_k", "_h", "_place")
    quota = _quota(sizes, label, total, rows)
    return placed.join(quota, "_k").withColumn("is_test", F.col("_place") <= F.col("quota")).drop(
        "_k", "_h", "_place", "quota")


def cap_stratified(df: DataFrame, key: str, label: str, cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows with class shares kept; every class keeps at least one row."""
    rows = df.count()
    if rows <= cap:
        return df
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    quota = _quota(sizes, label, cap, rows, least=1)
    placed = _place_in_class(df, key, label, seed, "cap")
    return placed.join(quota, "_k").filter(F.col("_place") <= F.col("quota")).drop("_k", "_h", "_place", "quota")


def sample_remainder(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Rows that were not chosen."""
    return df.join(chosen.select(key), key, "left_anti")


def gather_rows(draws: DataFrame, df: DataFrame, key: str, index: str = "idx") -> DataFrame:
    """Fetch rows by drawn dense index."""
    return draws.join(dense_index(df, key, name=index), index)


def latent_interpolation(latent: DataFrame, key: str, edges: DataFrame, n: int, seed: int = 42,
                         z: str = "z") -> DataFrame:
    """Uniform anchor, uniform neighbour among its edges, a uniform point on the segment: (row, anchor, other, z)."""
    size = latent.count()
    degrees = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    anchors = _draws(latent, n).withColumn("_i", rng.uniform_index(size, seed, "anchor", "row")).join(
        dense_index(latent.select(key, F.col(z).alias("_a")), key, name="_i"), "_i").select(
        "row", F.col(key).alias("src"), "_a")
    picked = anchors.join(degrees, "src").withColumn(
        "rank", (rng.uniform_index(F.col("degree"), seed, "neighbour", "row") + 1).cast("int"))
    met = picked.join(edges.select("src", "rank", "dst"), ["src", "rank"]).join(
        latent.select(F.col(key).alias("dst"), F.col(z).alias("_b")), "dst")
    point = bind(rng.uniform(seed, "weight", "row"), lambda u: F.zip_with("_a", "_b", lambda a, b: a + u * (b - a)))
    return met.select("row", F.col("src").alias("anchor"), F.col("dst").alias("other"), point.alias(z))


def smote_interpolate(df: DataFrame, key: str, target: str, columns: Sequence[str], k: int = 5,
                      seed: int = 42) -> DataFrame:
    """Bring every class up to the largest one (published SMOTE-NC rule): (row, columns..., target).

    Numbers move a uniform part of the way to a drawn neighbour of the same class; a category is the most
    frequent one among the anchor's neighbours (smallest on a tie).  A category mismatch adds the median of
    the smallest class's numeric standard deviations to the squared distance.
    """
    features = [c for c in columns if c != target]
    numeric = [c for c in numeric_names(df) if c in features]
    categorical = [c for c in features if c not in numeric]
    medians = fit_medians(df, numeric) if numeric else {}
    rows = df.select(F.col(key), category_key(F.col(target)).alias("_cls"), target,
                     *[F.coalesce(as_double(df, c), F.lit(medians[c])).alias(c) for c in numeric],
                     *[category_key(F.col(c)).alias(c) for c in categorical])
    sizes = checkpoint(rows.groupBy("_cls").agg(F.count(F.lit(1)).alias("size")))
    largest = sizes.agg(F.max("size")).first()[0] or 0
    smallest_class = sizes.agg(F.min_by("_cls", F.struct("size", "_cls"))).first()[0]
    spreads = rows.filter(F.col("_cls") == smallest_class).agg(*[F.stddev_pop(c).alias(c) for c in numeric] or [F.lit(1.0)]).first()
    penalty = float(np.median([x or 0.0 for x in spreads])) if numeric else 1.0
    codes = [f"_code_{i}" for i in range(len(categorical))]
    placed = rows
    if categorical:  # one code a category, whatever its number of keys
        placed = with_codes(rows, fit_encoding(rows, categorical, kinds=([], categorical), narrow=0), categorical, codes)
    placed = checkpoint(placed.withColumn("_z", F.array(*numeric, *[F.col(c).cast("double") for c in codes])).drop(*codes))
    edges = checkpoint(knn_exact(placed, key, "_z", k, metric=coded(len(numeric), penalty * penalty) if categorical else "euclidean", within="_cls"))
    degrees = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    # Every class short of the largest lists its draws, in two steps so that no row holds a long list.
    short = sizes.filter(F.col("size") < largest).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(largest - 1) - F.col("size"), F.lit(DRAW_CHUNK).cast("bigint"))))
    last = F.least(F.col("_from") + (DRAW_CHUNK - 1), F.lit(largest - 1) - F.col("size"))
    draws = spread(short).select("_cls", "size", F.explode(F.sequence("_from", last)).alias("_d"))
    draws = draws.withColumn("_j", rng.uniform_index(F.col("size"), seed, "smote.anchor", "_cls", "_d"))
    anchors = draws.join(dense_index(placed, key, within=["_cls"], name="_j"), ["_cls", "_j"]).join(
        degrees, F.col(key) == F.col("src"), "left")
    picked = anchors.withColumn("rank", (rng.uniform_index(
        F.col("degree"), seed, "smote.neighbour", "_cls", "_d") + 1).cast("int"))
    other = placed.select(F.col(key).alias("dst"), *[F.col(c).alias(f"_o_{c}") for c in numeric])
    met = picked.join(edges.select("src", "rank", "dst"), ["src", "rank"], "left").join(other, "dst", "left")
    u = rng.uniform(seed, "smote.weight", "_cls", "_d")
    met = met.withColumn("_u", u)
    if categorical:
        entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in categorical])
        around = edges.select("src", "dst").join(placed.select(F.col(key).alias("dst"), F.explode(entries).alias("e")), "dst")
        votes = around.groupBy("src", "e.column", "e.value").agg(F.count(F.lit(1)).alias("n")).groupBy("src", "column").agg(
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value")).groupBy("src").agg(
            *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"_m_{c}") for c in categorical])
        met = met.join(votes, "src", "left")
    return met.select(
        F.concat_ws("|", "_cls", "_d").alias("row"), F.col(key).alias("anchor"),
        *[(F.col(c) + F.col("_u") * (F.coalesce(F.col(f"_o_{c}"), F.col(c)) - F.col(c))).alias(c) for c in numeric],
        *[F.coalesce(F.col(f"_m_{c}"), F.col(c)).alias(c) for c in categorical], target)


def product_probability(weights: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Product of several row weights, normalised; uniform when every product is zero: (key, p)."""
    product = F.lit(1.0)
    for c in columns:
        product = product * F.col(c)
    total = weights.agg(F.sum(product).alias("s"), F.count(F.lit(1)).alias("n")).first()
    p = product / F.lit(float(total["s"])) if total["s"] else F.lit(1.0 / max(total["n"], 1))
    return weights.select(key, p.alias("p"))


def resample_balanced(df: DataFrame, key: str, target: str, columns: Sequence[str], n: int, seed: int = 42, *,
                      k: int = 5) -> DataFrame:
    """n rows with replacement from the table and its interpolated minority rows."""
    made = smote_interpolate(df, key, target, columns, k, seed)
    names = [*[c for c in columns if c != target], target]
    real = df.select(F.concat(F.lit("real|"), F.col(key).cast("string")).alias("_id"), *names)
    extra = made.select(F.concat(F.lit("made|"), "row").alias("_id"), *[F.col(c).cast(df.schema[c].dataType).alias(c) for c in names])
    return bootstrap_rows(checkpoint(real.unionByName(extra)), "_id", n, seed).drop("_id")
