"""Ranking of parameter sweeps and methods, and group summaries of result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinframe.functions.ordered import quantiles

# Measure -> (direction, target).  'near' ranks by distance to the target.
PRIMARY_MEASURES: dict[str, tuple[str, float | None]] = {
    "nn_distance_ratio": ("near", 1.0),
    "discrimination_accuracy": ("near", 0.5),
    "utility_lift": ("high", None),
    "distribution_similarity_score": ("high", None),
}


def badness(measure: Column, rule: tuple[str, float | None]) -> Column:
    """Smaller is better."""
    kind, target = rule
    if kind == "near":
        return F.abs(measure - F.lit(target))
    return -measure if kind == "high" else measure


def rank_measures(df: DataFrame, by: Sequence[str], rules: Mapping[str, tuple[str, float | None]]) -> DataFrame:
    """Add min-rank ``<m>_rank`` per measure inside ``by`` and ``average_rank``; missing measures get no rank."""
    out = df
    for m, rule in rules.items():
        score = badness(F.col(m), rule)
        order = Window.partitionBy(*by, score.isNull()).orderBy(score)
        out = out.withColumn(f"{m}_rank", F.when(score.isNotNull(), F.rank().over(order)))
    ranks = F.filter(F.array(*[F.col(f"{m}_rank").cast("double") for m in rules]), lambda x: x.isNotNull())
    return out.withColumn("average_rank", F.aggregate(ranks, F.lit(0.0), lambda a, x: a + x) / F.nullif(
        F.size(ranks), F.lit(0)))


def rank_sweep(df: DataFrame, rules: Mapping[str, tuple[str, float | None]] | None = None,
               by: Sequence[str] = ("parameter",), value: str = "value") -> DataFrame:
    """Rank the settings of each parameter by mean rank, then value: adds ``place`` (1 is best)."""
    ranked = rank_measures(df, by, rules or PRIMARY_MEASURES)
    order = Window.partitionBy(*by).orderBy(F.asc_nulls_last("average_rank"), value)
    return ranked.withColumn("place", F.row_number().over(order))


def best_row_for_measure(df: DataFrame, measure: str, rule: tuple[str, float | None], order: Sequence[str],
                         by: Sequence[str] = ()) -> DataFrame:
    """The row with the best value of a measure, the first by ``order`` on a tie."""
    best = F.min_by(F.struct(*df.columns), F.struct(badness(F.col(measure), rule), *order))
    return df.filter(F.col(measure).isNotNull()).groupBy(*by).agg(best.alias("b")).select("b.*")


def cross_dataset_rank(df: DataFrame, measures: Mapping[str, tuple[str, float | None]]) -> DataFrame:
    """Per method: mean rank, wins, losses and count over every (dataset, measure)."""
    entries = F.array(*[F.struct(F.lit(m).alias("measure"), badness(F.col(m), rule).alias("score"))
                        for m, rule in measures.items()])
    long = df.select("dataset", "method", F.explode(entries).alias("e")).select(
        "dataset", "method", "e.measure", "e.score").filter(F.col("score").isNotNull())
    cell = Window.partitionBy("dataset", "measure")
    ranked = long.withColumn("rank", F.rank().over(cell.orderBy("score"))).withColumn("worst", F.max("rank").over(cell))
    return ranked.groupBy("method").agg(
        F.avg("rank").alias("mean_rank"), F.count(F.when(F.col("rank") == 1, 1)).alias("wins"),
        F.count(F.when(F.col("rank") == F.col("worst"), 1)).alias("losses"), F.count(F.lit(1)).alias("comparisons"))


def group_means(df: DataFrame, by: Sequence[str], measures: Sequence[str], *, spread: bool = False,
                runs: str | None = None) -> DataFrame:
    """Rows, means and optionally sample stds of measures in each group (null keys are a group)."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    if runs:
        aggs.append(F.count_distinct(runs).alias("runs"))
    for m in measures:
        aggs.append(F.avg(m).alias(f"{m}_mean"))
        if spread:
            aggs.append(F.stddev_samp(m).alias(f"{m}_std"))
    return df.groupBy(*by).agg(*aggs)


# Output columns of the summaries and the report columns they average.
MECHANISM_MEANS = {
    "mean_cardinality": "cardinality",
    "mean_nca_accuracy": "nca_accuracy",
    "mean_majority_accuracy": "majority_accuracy",
    "mean_pca_accuracy": "pca_accuracy",
    "mean_raw_context_accuracy": "raw_context_accuracy",
    "mean_lift_over_majority": "nca_accuracy_lift_over_majority",
    "mean_lift_over_pca": "nca_accuracy_lift_over_pca",
}
CALIBRATION_MEANS = {
    "mean_accuracy": "accuracy",
    "mean_top_confidence": "mean_top_confidence",
    "mean_confidence_gap": "confidence_gap",
    "mean_negative_log_loss": "negative_log_loss",
    "mean_brier_score": "brier_score",
    "mean_expected_calibration_error": "expected_calibration_error",
}
SENSITIVITY_KEYS = ["parameter", "value", "setup_label", "n_components", "n_iterations", "nca_fit_sample_size", "lambda_", "quantile_guard",
                    "max_constraint_retries", "calibrate_decoders"]
SENSITIVITY_MEANS = ["nn_distance_ratio", "discrimination_accuracy", "utility_lift", "distribution_similarity_score", "fit_seconds", "sample_seconds"]
UNCERTAINTY = {
    "distribution_similarity": "distribution_similarity_score",
    "discrimination_accuracy": "discrimination_accuracy",
    "utility_lift": "utility_lift",
    "nn_distance_ratio": "nn_distance_ratio",
}


def _present_mean(column: str):
    """Mean over present numbers; null and NaN are absent."""
    return F.avg(F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")))


def summarise_mechanism(rows: DataFrame) -> DataFrame:
    """Per dataset: the columns evaluated and the means of their mechanism scores."""
    return rows.groupBy("dataset").agg(F.count("column").alias("columns_evaluated"), *[_present_mean(c).alias(n) for n, c in MECHANISM_MEANS.items()])


def summarise_calibration(rows: DataFrame) -> DataFrame:
    """Per dataset and cardinality bucket: the columns evaluated and the means of their calibration scores."""
    return rows.groupBy("dataset", "cardinality_bucket").agg(
        F.count("column").alias("columns_evaluated"), *[_present_mean(c).alias(n) for n, c in CALIBRATION_MEANS.items()])


def summarise_sensitivity(rows: DataFrame) -> DataFrame:
    """Per setting: the datasets evaluated and mean scores. Settings a report lacks are null, a missing label is the value's text."""
    stand_in = {"setup_label": F.col("value").cast("string") if "value" in rows.columns else F.lit(None).cast("string"),
                "calibrate_decoders": F.col("decoder_calibration_enabled") if "decoder_calibration_enabled" in rows.columns else F.lit(None).cast("boolean")}
    full = rows.withColumns({k: stand_in.get(k, F.lit(None).cast("string")) for k in SENSITIVITY_KEYS if k not in rows.columns})
    return full.groupBy(*SENSITIVITY_KEYS).agg(F.count_distinct("dataset").alias("datasets_evaluated"), *[_present_mean(c).alias(f"mean_{c}") for c in SENSITIVITY_MEANS])


def summarise_uncertainty(rows: DataFrame) -> DataFrame:
    """Per dataset and method over runs without a skip reason: seeds, means and sample standard deviations."""
    aggs = [F.count_distinct("seed").alias("runs")]
    for name, column in UNCERTAINTY.items():
        aggs += [_present_mean(column).alias(f"{name}_mean"), F.stddev_samp(F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))).alias(f"{name}_std")]
    return rows.filter(F.coalesce("reason", F.lit("")) == "").groupBy("dataset", "method").agg(*aggs)


def summarise_imbalance(df: DataFrame, order: str, firsts: Sequence[str], means: Sequence[str],
                        reason: str = "reason") -> DataFrame:
    """Per dataset and method over rows without a skip reason: first settings by ``order`` and mean scores."""
    kept = df.filter(F.coalesce(F.col(reason), F.lit("")) == "")
    return kept.groupBy("dataset", "method").agg(
        *[F.min_by(c, order).alias(c) for c in firsts], *[F.avg(c).alias(c) for c in means])


def selection_count_join(summary: DataFrame, counts: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """Left join of selection counts to a sweep summary; never selected is 0."""
    return summary.join(counts, list(keys), "left").withColumn(count, F.coalesce(F.col(count), F.lit(0)))


def summarise_sweep(runs: DataFrame, selections: DataFrame, measures: Sequence[str],
                    keys: Sequence[str] = ("step", "parameter", "value"), seed: str = "seed") -> DataFrame:
    """Per setting: seeds, mean and std of measures, and how often it was selected."""
    means = group_means(runs, keys, measures, spread=True, runs=seed)
    counts = selections.groupBy(*keys).agg(F.count(F.lit(1)).alias("selected"))
    return selection_count_join(means, counts, keys, "selected")


def summarise_manifold(points: DataFrame) -> DataFrame:
    """Per dataset and generator: out-of-hull rate, stress medians, and the share of out-of-hull rows whose
    stress does not exceed the held-out real 95 % quantile."""
    real = quantiles(points.filter(F.col("sample_type") == "real_test"), ["dataset"], "stress", [0.5, 0.95]).groupBy(
        "dataset").agg(F.max(F.when(F.col("probability") == 0.5, F.col("quantile"))).alias("real_stress_median"),
                       F.max(F.when(F.col("probability") == 0.95, F.col("quantile"))).alias("real_stress_q95"))
    made = points.filter(F.col("sample_type") == "generated")
    keys = ["dataset", "method"]
    median = quantiles(made, keys, "stress", [0.5]).select(*keys, F.col("quantile").alias("generated_stress_median"))
    out_median = quantiles(made.filter("out_hull"), keys, "stress", [0.5]).select(
        *keys, F.col("quantile").alias("out_hull_stress_median"))
    inside_band = F.when(F.col("out_hull") & F.col("stress").isNotNull() & F.col("real_stress_q95").isNotNull(),
                         (F.col("stress") <= F.col("real_stress_q95")).cast("double"))
    rates = made.join(real, "dataset", "left").groupBy(*keys).agg(
        F.avg(F.col("out_hull").cast("double")).alias("out_hull_rate"),
        F.max("real_stress_median").alias("real_stress_median"), F.max("real_stress_q95").alias("real_stress_q95"),
        F.avg(inside_band).alias("out_hull_acceptance_at_real_q95"))
    return rates.join(median, keys, "left").join(out_median, keys, "left")


def pivot_measure(df: DataFrame, row: str, column: str, measure: str, values: Sequence) -> DataFrame:
    """Row x column table of one measure; the column values are given, so no pass is spent finding them."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.first(measure))


def ordered_results(df: DataFrame, column: str, order: Sequence[str], *then: str) -> DataFrame:
    """Sort by a preset order of codes; unknown codes come last."""
    place = F.lit(len(order))
    for i, code in reversed(list(enumerate(order))):
        place = F.when(F.col(column) == code, F.lit(i)).otherwise(place)
    return df.orderBy(place, *then)


def stack_reports(reports: Sequence[DataFrame]) -> DataFrame:
    """Concatenate reports; a column a report lacks is null there."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def result_group_label() -> Column:
    """Display group of a manifold row from its sample type, method and hull flag."""
    where = F.when(F.col("out_hull"), F.lit(" outside hull")).otherwise(F.lit(" inside hull"))
    return F.when(F.col("sample_type") == "real_test", F.lit("held-out real")).otherwise(F.concat(F.col("method"), where))
