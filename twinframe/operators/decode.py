"""Class probabilities from latent context: priors, forests, sigmoid calibration, and drawing a class."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import IllegalArgumentException
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.functions import rng, slots
from twinframe.functions.scalars import array_sum, bind
from twinframe.operators.samplers import _place_in_class
from twinframe.session import settle, side_by_side, spread

MAX_DEPTH = 30      # the most the forest trainer accepts
NEWTON_STEPS = 30   # of the calibration; each is one job for all classes and folds
BRANCHES = 64       # classes of one forest of a label tree
MOST_LEAVES = 100_000  # of a tree: the smallest leaf grows with the rows, so a fitted forest does not


@dataclass
class Decoder:
    """Probabilities over ``classes`` given a context vector; ``status`` tells how it was fitted."""

    classes: list[str]
    status: str
    prior: list[float] = field(default_factory=list)
    forests: list = field(default_factory=list)
    sigmoids: list = field(default_factory=list)  # per forest: [(slope, offset) per class]

    def probabilities(self, df: DataFrame, context: str, name: str) -> DataFrame:
        """Add the probability array ``name``."""
        if not self.forests:
            return df.withColumn(name, F.array(*[F.lit(float(p)) for p in self.prior]))
        # The walk down the trees is the work: all tasks share it, however few files or partitions the rows come from.
        out = spread(df).withColumn("_x", array_to_vector(context))
        parts = []
        for i, forest in enumerate(self.forests):
            model = forest.setFeaturesCol("_x").setProbabilityCol(f"_p{i}").setPredictionCol(f"_y{i}").setRawPredictionCol(f"_r{i}")
            out = model.transform(out).withColumn(f"_p{i}", _full_width(vector_to_array(f"_p{i}"), len(self.classes)))
            parts.append(_calibrated(F.col(f"_p{i}"), self.sigmoids[i]) if self.sigmoids else F.col(f"_p{i}"))
        total = parts[0]
        for part in parts[1:]:
            total = F.zip_with(total, part, lambda a, b: a + b)
        mean = F.transform(total, lambda x: x / F.lit(float(len(parts)))) if len(parts) > 1 else total
        return out.withColumn(name, mean).drop("_x", *[f"{t}{i}" for i in range(len(parts)) for t in ("_p", "_y", "_r")])


def _full_width(p: Column, width: int) -> Column:
    """A forest that never saw the last classes answers a shorter array."""
    return F.concat(p, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(p)))


def _calibrated(p: Column, sigmoids) -> Column:
    """Sigmoid per class, then shares; two classes are calibrated once; all zero gives equal shares."""
    slopes, offsets = (F.array(*[F.lit(float(x)) for x in part]) for part in zip(*sigmoids))
    raw = F.zip_with(F.zip_with(p, slopes, lambda x, a: x * a), offsets, lambda x, b: F.lit(1.0) / (F.lit(1.0) + F.exp(-(x + b))))
    if len(sigmoids) == 2:
        return bind(raw, lambda r: F.array(F.lit(1.0) - r[1], r[1]))
    return bind(raw, lambda r: bind(array_sum(r), lambda total: F.when(total > 0, F.transform(r, lambda x: x / total)).otherwise(
        F.array_repeat(F.lit(1.0 / len(sigmoids)), len(sigmoids)))))


def prior_decoder(df: DataFrame, label: str, classes: list[str]) -> Decoder:
    """Class shares, for a column without context."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values()) or 1
    return Decoder(classes, "prior_only", [counts.get(c, 0) / total for c in classes])


def class_shares(df: DataFrame, column: str) -> DataFrame:
    """(class, probability) of a column's keys."""
    total = df.count()
    return df.groupBy(F.col(column).cast("string").alias("class")).agg(
        (F.count(F.lit(1)) / F.lit(float(max(total, 1)))).alias("probability"))


def forest(trees: int = 100, depth: int = MAX_DEPTH, leaf: int = 1, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=min(depth, MAX_DEPTH),
                                  minInstancesPerNode=leaf, seed=seed, cacheNodeIds=True)


def class_table(df: DataFrame, classes: Sequence[str], name: str, place: str) -> DataFrame:
    """(name, place): the classes and their numbers, as a table to join."""
    return df.sparkSession.createDataFrame([(c, float(i)) for i, c in enumerate(classes)], f"{name} string, {place} double")


def numbered_classes(df: DataFrame, label: Column, classes: Sequence[str]) -> DataFrame:
    """df with the class number ``_y``, which says how many classes there are, so that the trainer takes any number of them."""
    width = {"ml_attr": {"type": "nominal", "num_vals": len(classes)}}
    return df.join(class_table(df, classes, "_class", "_y"), label == F.col("_class")).drop("_class").withMetadata("_y", width)


def _training(df: DataFrame, key: str, context: str, label: str, classes: list[str], size: int) -> DataFrame:
    table = settle(numbered_classes(df, F.col(label), classes), key, rows=size)
    return table.withColumn("_x", array_to_vector(context))


def fit_decoder(df: DataFrame, key: str, context: str | None, label: str, classes: list[str], *, trees: int = 100,
                depth: int = MAX_DEPTH, leaf: int = 1, seed: int = 42, calibrate: bool = False,
                folds: int | None = None) -> Decoder:
    """A forest on the context for any number of classes; class shares only without context; optionally calibrated over folds.

    The forest is fitted on all rows. A leaf holds at least ``leaf`` of them, and at least one in MOST_LEAVES.
    """
    if context is None:
        return prior_decoder(df, label, classes)
    size = df.count()
    table = _training(df, key, context, label, classes, size)
    learner = forest(trees, depth, max(leaf, -(-size // MOST_LEAVES)), seed)
    plain = lambda status: Decoder(classes, status, forests=[learner.fit(table)])
    if not calibrate:
        return plain("disabled")
    if len(classes) < 2:
        return plain("skipped_one_class")
    if folds is None:
        least = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
        if least < 2:
            return plain("skipped_insufficient_class_count")
        folds = min(5, int(least))
    try:
        return _fit_calibrated(table, key, label, classes, learner, folds, seed)
    except IllegalArgumentException as exc:  # the trainer's own refusal; a lost executor is no reason to go on without calibration
        warnings.warn(f"Calibration of {label!r} failed, the plain forest is used: {exc}", RuntimeWarning)
        return plain("failed")


def _fit_calibrated(table: DataFrame, key: str, label: str, classes: list[str], learner, folds: int, seed: int) -> Decoder:
    placed = settle(_place_in_class(table, key, label, seed, "fold").withColumn(
        "_fold", F.pmod(F.col("_place"), F.lit(folds)).cast("int")).drop("_k", "_h", "_place"), key, rows=table.count()).persist()
    width = table.schema["_y"].metadata
    try:
        fold = lambda keep: placed.filter(keep).withMetadata("_y", width)
        # A level of a forest ends in driver work, so two folds' forests grow side by side; more would only crowd the executors' memory.
        forests = side_by_side([lambda f=f: learner.copy().fit(fold(F.col("_fold") != f)) for f in range(folds)], limit=2)
        held = [m.transform(fold(F.col("_fold") == f)).select("_fold", F.col("_y").cast("int").alias("y"), _full_width(
            vector_to_array("probability"), len(classes)).alias("p")) for f, m in enumerate(forests)]
        together = held[0]
        for part in held[1:]:
            together = together.unionByName(part)
        together = spread(together).persist()
        try:
            sigmoids = fit_sigmoids(together, folds, len(classes))
        finally:
            together.unpersist()
        return Decoder(classes, "calibrated", forests=forests, sigmoids=sigmoids)
    finally:
        placed.unpersist()


def fit_sigmoids(held: DataFrame, folds: int, width: int) -> list[list[tuple[float, float]]]:
    """(slope, offset) per fold and class from held-out rows (_fold, y, p): logistic fits of "is this class" on its share.

    Targets are drawn in from 0 and 1 by one row of each kind, which keeps separable classes finite. All classes and folds
    take one damped Newton step together, for which one job returns a few sums for each of them.
    """
    count = np.zeros((folds, width))
    for r in held.groupBy("_fold", "y").count().collect():
        count[r["_fold"], r["y"]] = r["count"]
    rows = count.sum(axis=1, keepdims=True)
    high, low = (count + 1) / (count + 2), 1 / (rows - count + 2)
    slope, offset = np.zeros((folds, width)), np.log((count + 1) / (rows - count + 1))
    sums = ["loss", "ga", "gb", "haa", "hab", "hbb"]

    def totals(slope: np.ndarray, offset: np.ndarray) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((folds, len(sums), width))
            for batch in batches:
                fold, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                shares = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(fold), width)
                for f in np.unique(fold):
                    at = np.flatnonzero(fold == f)
                    p, target = shares[at], np.tile(low[f], (len(at), 1))
                    target[np.arange(len(at)), y[at]] = high[f][y[at]]
                    z = slope[f] * p + offset[f]
                    s = 1 / (1 + np.exp(-z))
                    gap, bend = s - target, s * (1 - s)
                    out[f] += np.stack([np.logaddexp(0, z) - target * z, gap * p, gap, bend * p * p, bend * p, bend]).sum(axis=1)
            f, c = (x.ravel() for x in np.indices((folds, width)))
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(c), *(pa.array(out[f, i, c]) for i in range(len(sums)))], ["f", "c", *sums])
        found = held.mapInArrow(add, "f bigint, c bigint, " + ", ".join(f"{n} double" for n in sums)).groupBy("f", "c").agg(*[F.sum(n).alias(n) for n in sums])
        out = np.zeros((len(sums), folds, width))
        for r in found.collect():
            out[:, r["f"], r["c"]] = [r[n] for n in sums]
        return out

    now = totals(slope, offset)
    for _ in range(NEWTON_STEPS):
        loss, ga, gb, haa, hab, hbb = now
        if max(np.abs(ga).max(), np.abs(gb).max()) < 1e-7 * max(1.0, rows.max()):
            break
        haa, hbb = haa + 1e-9, hbb + 1e-9
        det = np.maximum(haa * hbb - hab * hab, 1e-18)
        step = ((hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det)
        share = np.ones_like(loss)
        while True:
            new = totals(slope - share * step[0], offset - share * step[1])
            worse = new[0] > loss + 1e-12 * (1 + np.abs(loss))
            if not worse.any() or share[worse].max() < 1e-4:
                break
            share = np.where(worse, share / 4, share)
        share = np.where(worse, 0.0, share)
        if not share.any():
            break
        moved = share > 0
        slope, offset, now = slope - share * step[0], offset - share * step[1], np.where(moved, new, now)
    return [list(zip(slope[f].tolist(), offset[f].tolist())) for f in range(folds)]


def choose(probabilities: Column, u: Column) -> Column:
    """0-based class whose cumulative share holds u; an all-zero row is uniform."""
    def pick(p: Column, goal: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("run"), F.lit(0).alias("i"), F.lit(-1).alias("pick"), F.lit(0).alias("last"))

        def step(acc, x):
            run = acc["run"] + x
            hit = (acc["pick"] < 0) & (goal < run)
            return F.struct(run.alias("run"), (acc["i"] + 1).alias("i"), F.when(hit, acc["i"]).otherwise(acc["pick"]).alias("pick"),
                            F.when(x > 0, acc["i"]).otherwise(acc["last"]).alias("last"))
        return F.aggregate(p, start, step, lambda acc: F.when(acc["pick"] >= 0, acc["pick"]).otherwise(acc["last"]))
    filled = bind(probabilities, lambda p: F.when(array_sum(p) > 0, p).otherwise(F.transform(p, lambda x: F.lit(1.0))))
    return bind(filled, lambda p: bind(u * array_sum(p), lambda goal: pick(p, goal)))


def used_shares(p: Column) -> Column:
    """The shares that a draw goes by: a row's probabilities brought to the sum 1, equal ones for an all-zero row."""
    return bind(p, lambda a: bind(array_sum(a), lambda total: F.when(total > 0, F.transform(a, lambda x: x / total)).otherwise(
        F.transform(a, lambda x: F.lit(1.0) / F.size(a)))))


def decode_categorical(df: DataFrame, decoder: Decoder, context: str | None, name: str, *, sample: bool, seed: int,
                       row: str = "row", keep: str | None = None) -> DataFrame:
    """Add the class key ``name``: drawn from the probabilities, or the first most likely one; ``keep`` adds these as a map of keys."""
    out = decoder.probabilities(df, context, "_prob")
    u = rng.uniform(seed, f"decode.{name}", row)
    place = choose(F.col("_prob"), u) if sample else F.array_position(F.col("_prob"), F.array_max("_prob")) - 1
    named = class_table(df, decoder.classes, name, "_place")
    if keep is not None:
        out = out.withColumn(keep, F.map_from_arrays(F.array(*[F.lit(c) for c in decoder.classes]), used_shares(F.col("_prob"))))
    return out.withColumn("_place", place.cast("double")).drop("_prob").drop(name).join(named, "_place", "left").drop("_place")


@dataclass
class LabelTree:
    """A decoder of very many classes: their numbers are written in digits, and one decoder a digit answers given those before it.

    So there are as many forests as digits, whatever the number of classes, no row carries more than BRANCHES shares, and a draw walks
    down the tree. Classes are numbered in the order of their keys, which a dictionary table (key, idx) holds.
    """

    count: int
    base: int
    levels: list[Decoder]
    status: str

    @property
    def forests(self) -> list:
        return [f for level in self.levels for f in level.forests]

    def shares(self, df: DataFrame, level: int, context: str | None, number: str, name: str) -> DataFrame:
        """Add the shares of the next digit, given the number ``number`` that the digits so far make; branches without a class have none."""
        width = len(self.levels)
        last = (self.count - 1) // self.base ** (width - 1 - level)
        before = [F.pmod(F.floor(F.col(number) / F.lit(self.base ** (level - 1 - i))), F.lit(self.base)).cast("double") for i in range(level)]
        x = F.concat(F.col(context) if context else F.array().cast("array<double>"), F.array(*before).cast("array<double>"))
        out = self.levels[level].probabilities(df.withColumn("_xl", x), "_xl", name).drop("_xl")
        return out.withColumn(name, F.transform(name, lambda p, j: F.when(F.col(number) * self.base + j <= F.lit(last), p).otherwise(F.lit(0.0))))

    def walk(self, df: DataFrame, context: str | None, name: str, *, sample: bool, seed: int, row: str, keep: str | None = None) -> DataFrame:
        """Add the class number: a draw at each level, or the most likely branch; ``keep`` adds the branches' probabilities, level by level."""
        out = df.withColumn("_at", F.lit(0).cast("bigint"))
        for level in range(len(self.levels)):
            last = (self.count - 1) // self.base ** (len(self.levels) - 1 - level)
            out = self.shares(out, level, context, "_at", "_prob")
            stream = f"decode.{name}" + (f".{level}" if level else "")
            place = choose(F.col("_prob"), rng.uniform(seed, stream, row)) if sample else F.array_position(F.col("_prob"), F.array_max("_prob")) - 1
            if keep is not None:
                told = F.array(used_shares(F.col("_prob")))
                out = out.withColumn(keep, F.concat(keep, told) if level else told)
            out = out.withColumn("_at", F.least(F.col("_at") * self.base + place, F.lit(last)).cast("bigint")).drop("_prob")
        return out.withColumnRenamed("_at", "_idx")

    def share_of(self, df: DataFrame, context: str | None, number: str, name: str) -> DataFrame:
        """Add the probability of the class whose number is given: the product down its path."""
        out = df.withColumn("_p", F.lit(1.0))
        for level in range(len(self.levels)):
            size = self.base ** (len(self.levels) - 1 - level)
            out = self.shares(out.withColumn("_at", F.floor(F.col(number) / F.lit(size * self.base))), level, context, "_at", "_prob")
            digit = F.pmod(F.floor(F.col(number) / F.lit(size)), F.lit(self.base)).cast("int")
            out = out.withColumn("_p", F.col("_p") * F.get("_prob", digit) / array_sum(F.col("_prob"))).drop("_prob", "_at")
        return out.withColumnRenamed("_p", name)


def fit_label_tree(df: DataFrame, key: str, context: str | None, number: str, count: int, *, branches: int = BRANCHES, **settings) -> LabelTree:
    """A label tree on rows whose class number (0 to count - 1) is in ``number``; settings are those of fit_decoder."""
    levels, base = slots.depth(count, branches)
    names = [f"{i:06d}" for i in range(base)]
    made = []
    for level, digit in enumerate(slots.digits(F.col(number), levels, base)):
        before = slots.digits(F.col(number), levels, base)[:level]
        x = F.concat(F.col(context) if context else F.array().cast("array<double>"), F.array(*before).cast("array<double>"))
        rows = df.select(key, x.alias("_xl"), F.lpad(digit.cast("string"), 6, "0").alias("_digit"))
        made.append(fit_decoder(rows, key, "_xl" if context or level else None, "_digit", names, **settings))
    return LabelTree(count, base, made, made[0].status)


def decode_wide(df: DataFrame, tree: LabelTree, keys: DataFrame, context: str | None, name: str, *, sample: bool, seed: int, row: str = "row",
                keep: str | None = None) -> DataFrame:
    """Add the class key ``name`` by a walk down the tree; keys is the dictionary (key, idx)."""
    out = tree.walk(df, context, name, sample=sample, seed=seed, row=row, keep=keep).drop(name)
    return out.join(keys.select(F.col("key").alias(name), F.col("idx").alias("_idx")), "_idx", "left").drop("_idx")
