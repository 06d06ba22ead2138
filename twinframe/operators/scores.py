"""Prediction scores over a table (truth, prediction[, probability]).  All are one or two aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.functions.ordered import prefix_sums
from twinframe.functions.scalars import normalise, safe_ratio

ECE_BINS = 10            # fixed value
LOG_LOSS_FLOOR = 1e-15   # fixed value


def accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(truth, pred, n)."""
    return df.groupBy(F.col(truth).cast("string").alias("truth"), F.col(pred).cast("string").alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(class, support, predicted, hits, recall, f1) for every class seen in truth or prediction."""
    cells = confusion(df, truth, pred)
    sides = F.array(F.struct(F.col("truth").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                             F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(F.lit(0)).cast("bigint").alias("hits")),
                    F.struct(F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("support"),
                             F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")))
    out = cells.select(F.explode(sides).alias("e")).select("e.*").groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    return out.withColumn("recall", safe_ratio(F.col("hits"), F.col("support"))).withColumn(
        "f1", F.coalesce(safe_ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")), F.lit(0.0)))


def balanced_accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Mean recall over the classes present in truth."""
    return per_class(df, truth, pred).agg(F.avg("recall").alias("balanced_accuracy"))


def f1_weighted(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return per_class(df, truth, pred).agg(
        safe_ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"))


def f1_macro(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return per_class(df, truth, pred).agg(F.avg("f1").alias("f1_macro"))


def class_recall(df: DataFrame, truth: str, pred: str, label) -> DataFrame:
    """Recall of one class, 0 when it is absent."""
    hit = (F.col(pred) == F.lit(label)).cast("double")
    return df.agg(F.coalesce(F.avg(F.when(F.col(truth) == F.lit(label), hit)), F.lit(0.0)).alias("recall"))


def score_counts(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """(score, pos, neg): the shrink step before any ordering by score."""
    return df.select(positive.alias("_p"), F.col(score).alias("score")).filter(
        F.col("score").isNotNull() & F.col("_p").isNotNull()).groupBy("score").agg(
        F.count(F.when(F.col("_p"), 1)).alias("pos"), F.count(F.when(~F.col("_p"), 1)).alias("neg")).withColumn(
        "g", F.lit(0))


def roc_auc(df: DataFrame, truth: str, score: str, label=1) -> DataFrame:
    """Rank-sum area under the curve; equal scores count half; null unless both classes are present."""
    sums = prefix_sums(score_counts(df, F.col(truth) == F.lit(label), score), ["g"], "score", ["neg"])
    below = F.col("cum_neg") - F.col("neg")
    won = F.sum(F.col("pos") * (below + F.col("neg") / F.lit(2.0)))
    return sums.agg(safe_ratio(won, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def average_precision(df: DataFrame, truth: str, score: str, label=1) -> DataFrame:
    """Step rule: precision at each distinct score times the recall gained there."""
    counts = score_counts(df, F.col(truth) == F.lit(label), score).withColumn("down", -F.col("score"))
    sums = prefix_sums(counts, ["g"], "down", ["pos", "neg"])
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return sums.agg(safe_ratio(F.sum(F.col("pos") * precision), F.sum("pos")).alias("average_precision"))


def brier_binary(df: DataFrame, truth: str, score: str, label=1) -> DataFrame:
    """Mean squared gap of probability and outcome; null unless truth has two classes."""
    hit = (F.col(truth) == F.lit(label)).cast("double")
    two = (F.min(truth) < F.max(truth)) & (F.max(
        (F.col(truth) == F.lit(label)).cast("int")) == 1)
    return df.agg(F.when(two, F.avg((F.col(score) - hit) * (F.col(score) - hit))).alias("brier"))


def classification_scores(df: DataFrame, truth: str, pred: str, score: str | None = None, label=1) -> DataFrame:
    """Accuracy and weighted F1, with area and Brier score when a probability is given, as (score, value)."""
    parts = [(accuracy(df, truth, pred), "accuracy"), (f1_weighted(df, truth, pred), "f1_weighted")]
    if score is not None:
        parts += [(roc_auc(df, truth, score, label), "roc_auc"), (brier_binary(df, truth, score, label), "brier")]
    out = None
    for part, name in parts:
        row = part.select(F.lit(name).alias("score"), F.col(name).alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def regression_scores(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Mean absolute error, root mean squared error, share of variance explained."""
    gap = F.col(truth) - F.col(pred)
    return df.agg(F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"),
                  (F.lit(1.0) - safe_ratio(F.avg(gap * gap), F.var_pop(truth))).alias("r2"))


# ---- several classes: probabilities is an array over ``classes`` in order

def class_place(truth: Column, classes: Sequence[str]) -> Column:
    """1-based place of the true class, 0 when unseen."""
    return F.coalesce(F.array_position(F.array(*[F.lit(c) for c in classes]), truth.cast("string")), F.lit(0))


def normalise_probabilities(df: DataFrame, probabilities: str, name: str = "probabilities") -> DataFrame:
    return df.withColumn(name, normalise(F.col(probabilities)))


def brier_multiclass(df: DataFrame, truth: str, probabilities: str, classes: Sequence[str]) -> DataFrame:
    """Mean over rows of the squared gap summed over classes; an unseen truth is all zeros."""
    place = class_place(F.col(truth), classes)
    gaps = F.transform(F.col(probabilities), lambda p, i: (p - F.when(i + 1 == place, 1.0).otherwise(0.0)))
    return df.agg(F.avg(F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x * x)).alias("brier_score"))


def log_loss(df: DataFrame, truth: str, probabilities: str, classes: Sequence[str]) -> DataFrame:
    place = class_place(F.col(truth), classes)
    p = F.coalesce(F.when(place > 0, F.get(F.col(probabilities), (place - 1).cast("int"))), F.lit(0.0))
    return df.agg(F.avg(-F.log(F.least(F.greatest(p, F.lit(LOG_LOSS_FLOOR)), F.lit(1.0)))).alias("negative_log_loss"))


def top_confidence(df: DataFrame, probabilities: str) -> DataFrame:
    return df.agg(F.avg(F.array_max(probabilities)).alias("mean_top_confidence"))


def top_class(probabilities: Column, classes: Sequence[str]) -> Column:
    """The first class of largest probability."""
    return F.get(F.array(*[F.lit(c) for c in classes]), (F.array_position(
        probabilities, F.array_max(probabilities)) - 1).cast("int"))


def confidence_gap(df: DataFrame, truth: str, probabilities: str, classes: Sequence[str]) -> DataFrame:
    """Mean top probability minus accuracy."""
    hit = (top_class(F.col(probabilities), classes) == F.col(truth).cast("string")).cast("double")
    return df.agg((F.avg(F.array_max(probabilities)) - F.avg(hit)).alias("confidence_gap"))


def expected_calibration_error(df: DataFrame, confidence: str, correct: str, bins: int = ECE_BINS) -> DataFrame:
    """Share-weighted gap of accuracy and confidence over equal bins; the last bin is closed."""
    place = F.least(F.floor(F.col(confidence) * F.lit(float(bins))), F.lit(bins - 1))
    cells = df.groupBy(place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("conf"), F.avg(F.col(correct).cast("double")).alias("acc"))
    return cells.agg(safe_ratio(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))), F.sum("n")).alias(
        "expected_calibration_error"))


def calibration_scores(df: DataFrame, truth: str, probabilities: str, classes: Sequence[str]) -> DataFrame:
    """All calibration scores of one probability table, in one row."""
    table = df.select(F.col(truth).cast("string").alias("t"), normalise(F.col(probabilities)).alias("p"))
    table = table.withColumn("conf", F.array_max("p")).withColumn(
        "hit", top_class(F.col("p"), classes) == F.col("t"))
    out = table.agg(F.count(F.lit(1)).alias("n_test"), F.avg(F.col("hit").cast("double")).alias("accuracy"),
                    F.avg("conf").alias("mean_top_confidence"))
    row = [out, log_loss(table, "t", "p", classes), brier_multiclass(table, "t", "p", classes),
           expected_calibration_error(table, "conf", "hit")]
    joined = row[0].withColumn("_k", F.lit(0))
    for part in row[1:]:
        joined = joined.join(part.withColumn("_k", F.lit(0)), "_k")
    return joined.drop("_k").withColumn("confidence_gap", F.col("mean_top_confidence") - F.col("accuracy"))


def majority_baseline(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """Accuracy on test rows of always answering the most frequent training class (smallest on a tie)."""
    best = train.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n")).agg(
        F.min_by(target, F.struct(-F.col("n"), F.col(target))).alias("m")).first()["m"]
    return test.agg(F.avg((F.col(target) == F.lit(best)).cast("double")).alias("majority_accuracy"))


def minority_majority(df: DataFrame, target: str) -> DataFrame:
    """(minority, majority, minority_n, majority_n) by class count; ties by class."""
    counts = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by(target, F.struct("n", target)).alias("minority"),
                      F.min_by(target, F.struct(-F.col("n"), F.col(target))).alias("majority"),
                      F.min("n").alias("minority_n"), F.max("n").alias("majority_n"))


def minority_rate(df: DataFrame, target: str, label) -> DataFrame:
    return df.agg(F.avg((F.col(target) == F.lit(label)).cast("double")).alias("minority_rate"))


def prediction_task(df: DataFrame, target: str) -> DataFrame:
    """classification for text or few distinct values (at most max(20, 5 % of rows)), else regression; plus counts."""
    numeric = dict(df.dtypes)[target] not in ("string", "boolean", "date", "timestamp", "timestamp_ntz")
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(target).alias("distinct"), F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col(target).isNull(), F.col("n"))), F.lit(0)).alias("missing"))
    few = F.col("distinct") <= F.greatest(F.lit(20).cast("bigint"), F.floor(F.col("rows") * 0.05).cast("bigint"))
    task = F.when(few, "classification").otherwise("regression") if numeric else F.lit("classification")
    return counts.select(F.lit(target).alias("target"), task.alias("task"), "distinct", "missing", "rows")


def target_choice(df: DataFrame, target: str | None) -> DataFrame:
    """(target, task, available, distinct, missing) of the configured target."""
    if target is None or target not in df.columns:
        return df.sparkSession.createDataFrame(
            [(target or "", "none" if target is None else "unavailable", False, 0, 0)],
            "target string, task string, available boolean, distinct bigint, missing bigint")
    return prediction_task(df, target).select("target", "task", F.lit(True).alias("available"), "distinct", "missing")


def trace_completeness(df: DataFrame, trace: str, required: Sequence[str]) -> DataFrame:
    """Traces, share holding every required field, mean field count.  ``trace`` is a map column."""
    names = F.map_keys(F.col(trace))
    wanted = F.array(*[F.lit(r) for r in required])
    full = F.size(F.array_intersect(names, wanted)) == len(set(required))
    return df.agg(F.count(F.lit(1)).alias("trace_count"), F.avg(full.cast("double")).alias("trace_completeness_rate"),
                  F.avg(F.size(names).cast("double")).alias("average_trace_size"))


def class_scores(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Accuracy, balanced accuracy, weighted and macro F1 in one row, from one pass over the predictions."""
    return per_class(df, truth, pred).agg(
        safe_ratio(F.sum("hits"), F.sum("support")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"),
        safe_ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"),
        F.avg("f1").alias("macro_f1"))
