"""Learned judgements of synthetic rows: discrimination, utility, train-on-synthetic, and the combined report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.operators import clean, measures, samplers, scores
from twinframe.operators.decode import MAX_DEPTH, MOST_LEAVES, class_table, forest, numbered_classes
from twinframe.operators.encode import Encoding, encode, fit_encoding, most_frequent, tree_features
from twinframe.operators.profile import BOOL_IS_NUMERIC, numeric_names
from twinframe.plans.model import Params, TableModel, fit
from twinframe.session import checkpoint, settle, side_by_side, spread

LEAF = 3  # fixed value: smallest leaf of the judging forests
MOST_CLASSES = 10_000  # of a judged target


@dataclass
class Preprocessor:
    """Median and scale for numbers, most frequent category and one-hot for the rest, digits of the key for a wide one; bool is a number."""

    modes: dict[str, str]
    encoding: Encoding

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> "Preprocessor":
        numeric = numeric_names(df.select(*columns), BOOL_IS_NUMERIC)
        categorical = [c for c in columns if c not in numeric]
        modes = {r["column"]: r["mode"] for r in most_frequent(df, categorical).collect()} if categorical else {}
        enc = fit_encoding(cls._filled(df, modes, categorical), columns, kinds=(numeric, categorical))
        return cls(modes, enc)

    @staticmethod
    def _filled(df: DataFrame, modes: dict[str, str], categorical: Sequence[str]) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(modes.get(c))) for c in categorical})

    def transform(self, df: DataFrame, name: str = "x") -> DataFrame:
        return tree_features(encode(self._filled(df, self.modes, self.encoding.categorical), self.encoding, name=name), self.encoding, name)


def forest_predictions(train: DataFrame, test: DataFrame, x: str, y: str, *, task: str = "classification",
                       trees: int = 100, depth: int = MAX_DEPTH, leaf: int = LEAF, seed: int = 42):
    """Test rows with ``pred`` (and ``p`` over the returned class list) of a forest fitted on all training rows.

    The trainer adds up histograms level by level. A leaf holds at least ``leaf`` rows, and at least one in MOST_LEAVES of all, so what
    goes to the driver and the executors is bounded by the number of trees at any number of rows.
    """
    ready = lambda d: d.withColumn("_x", array_to_vector(F.when(F.size(x) > 0, F.col(x)).otherwise(F.array(F.lit(0.0)))))
    size = train.count()
    train = settle(train.select(x, y), x, y, rows=size)
    leaf = max(leaf, -(-size // MOST_LEAVES))
    if task == "regression":
        model = RandomForestRegressor(featuresCol="_x", labelCol="_y", predictionCol="pred", numTrees=trees,
                                      maxDepth=min(depth, MAX_DEPTH), minInstancesPerNode=leaf, seed=seed)
        fitted = model.fit(ready(train).withColumn("_y", F.col(y).cast("double")))
        return fitted.transform(ready(spread(test))).drop("_x"), []
    classes = sorted(r[0] for r in train.filter(F.col(y).isNotNull()).select(F.col(y).cast("string")).distinct().limit(MOST_CLASSES + 1).collect())
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"More than {MOST_CLASSES} classes of {y!r}: recode it.")
    numbered = settle(numbered_classes(train.filter(F.col(y).isNotNull()), F.col(y).cast("string"), classes), x, y, rows=size)
    fitted = forest(trees, depth, leaf, seed).fit(ready(numbered))
    out = fitted.transform(ready(spread(test))).withColumn("p", vector_to_array("probability")).join(
        class_table(test, classes, "pred", "prediction"), "prediction", "left").drop("_x", "rawPrediction", "probability", "prediction")
    return out, classes


def forest_scores(train: DataFrame, test: DataFrame, x: str, y: str, **settings) -> DataFrame:
    """Class scores of a forest on test rows."""
    out, _ = forest_predictions(train, test, x, y, **settings)
    told = checkpoint(out.select(F.col(y).cast("string").alias("_t"), "pred"))  # read by several scores
    return scores.class_scores(told, "_t", "pred")


def _one(df: DataFrame, values: dict, types: str) -> DataFrame:
    return df.sparkSession.createDataFrame([tuple(values.values())], types)


def discrimination_test(real: DataFrame, synthetic: DataFrame, *, target: str | None = None, real_id: str,
                        synthetic_id: str, seed: int = 42, **settings) -> DataFrame:
    """Can a forest tell real from synthetic rows: held-out accuracy, area, and 1 - 2 |accuracy - 1/2|."""
    types = "discrimination_accuracy double, discrimination_roc_auc double, discrimination_privacy_score double"
    sizes = [len(d.select(F.lit(1)).take(4)) for d in (real, synthetic)]
    if min(sizes) < 4:
        return _one(real, dict.fromkeys("abc"), types)
    skip = {target, real_id, synthetic_id}
    shared = [c for c in real.columns if c in synthetic.columns and c not in skip]
    tag = lambda d, key, side: d.select(F.concat(F.lit(f"{side}|"), F.col(key).cast("string")).alias("_id"), F.lit(side).alias("_side"), *shared)
    both = tag(real, real_id, "real").unionByName(tag(synthetic, synthetic_id, "synthetic"))
    split = checkpoint(samplers.train_test_split(both, "_id", label="_side", seed=seed))
    train, test = split.filter(~F.col("is_test")), split.filter("is_test")
    pre = Preprocessor.fit(train, shared)
    out, classes = forest_predictions(pre.transform(train), pre.transform(test), "x", "_side", seed=seed, **settings)
    out = checkpoint(out.select("_side", "pred", F.col("p")[classes.index("real")].alias("p")))
    acc = scores.accuracy(out, "_side", "pred").first()[0]
    auc = scores.roc_auc(out, "_side", "p", "real").first()[0]
    return _one(real, {"a": float(acc), "b": auc, "c": float(max(0.0, 1.0 - 2.0 * abs(acc - 0.5)))}, types)


def utility_lift(real: DataFrame, synthetic: DataFrame, *, target: str | None, real_id: str, seed: int = 42,
                 **settings) -> DataFrame:
    """Held-out score of real plus synthetic training rows minus that of real ones (weighted F1 or R2)."""
    types = "utility_task string, utility_real_score double, utility_augmented_score double, utility_lift double"
    empty = lambda task, base=None: _one(real, {"t": task, "r": base, "a": None, "l": None}, types)
    if target is None or target not in real.columns or target not in synthetic.columns:
        return empty("none")
    ours, theirs = clean.drop_null_target(real, target), clean.drop_null_target(synthetic, target)
    if len(ours.select(F.lit(1)).take(10)) < 10 or theirs.isEmpty():
        return empty("insufficient_data")
    task = scores.prediction_task(ours, target).first()["task"]
    split = checkpoint(samplers.train_test_split(ours, real_id, label=target if task == "classification" else None, seed=seed))
    train, test = split.filter(~F.col("is_test")).drop("is_test"), split.filter("is_test").drop("is_test")
    features = [c for c in real.columns if c not in (target, real_id)]

    def score(rows: DataFrame) -> float | None:
        pre = Preprocessor.fit(rows, features)
        out, _ = forest_predictions(pre.transform(rows), pre.transform(test), "x", target, task=task, seed=seed, **settings)
        if task == "regression":
            return scores.regression_scores(out, target, "pred").first()["r2"]
        told = checkpoint(out.select(F.col(target).cast("string").alias("_t"), "pred"))
        return scores.class_scores(told, "_t", "pred").first()["f1_weighted"]
    base = score(train)
    aligned = clean.align_schema_with_nulls(theirs, train.drop(real_id))
    if task == "classification":
        aligned = clean.snap_target_to_class(aligned, train, target).withColumn(target, F.col(target).cast(train.schema[target].dataType))
    aligned = clean.drop_null_target(aligned, target)
    if aligned.isEmpty():
        return empty("insufficient_synthetic_target", base)
    better = score(checkpoint(clean.augment_union(train.drop(real_id), aligned)))
    return _one(real, {"t": task, "r": base, "a": better, "l": better - base}, types)


def train_synthetic_test_real(df: DataFrame, row_id: str, target: str, *, params: Params | None = None, n: int | None = None,
                              seed: int = 42, **settings) -> DataFrame:
    """Real-trained and synthetic-trained forests on the same real test rows, in the latent space of the training rows."""
    if target not in df.columns:
        raise ValueError("A target column is required.")
    rows = clean.drop_null_target(df, target)
    if len(rows.select(F.lit(1)).take(10)) < 10:
        raise ValueError("At least 10 rows with a target are required.")
    task = scores.prediction_task(rows, target).first()["task"]
    split = checkpoint(samplers.train_test_split(rows, row_id, label=target if task == "classification" else None, seed=seed))
    train, test = split.filter(~F.col("is_test")).drop("is_test"), split.filter("is_test").drop("is_test")
    model = fit(train, row_id, params=params)
    made = checkpoint(model.generate(n))
    report = None
    for source, table in (("real_train", train), ("synthetic_from_real_train", made)):
        out, classes = forest_predictions(latent_view(model, table, target), latent_view(model, test, target), "x", target,
                                          task=task, seed=seed, **settings)
        out = checkpoint(out.withColumn("_t", F.col(target).cast("string")))
        row = {"training_source": source, "task": task, "train_rows": table.count(), "test_rows": out.count()}
        if task == "classification":
            found = scores.class_scores(out, "_t", "pred").first()
            auc = None
            if len(classes) == 2:
                auc = scores.roc_auc(out.withColumn("_s", F.col("p")[1]), "_t", "_s", classes[1]).first()[0]
            row.update(accuracy=found["accuracy"], balanced_accuracy=found["balanced_accuracy"], f1_weighted=found["f1_weighted"],
                       roc_auc=auc, mae=None, rmse=None, r2=None)
        else:
            found = scores.regression_scores(out.withColumn(target, F.col(target).cast("double")), target, "pred").first()
            row.update(accuracy=None, balanced_accuracy=None, f1_weighted=None, roc_auc=None, mae=found["mae"],
                       rmse=found["rmse"], r2=found["r2"])
        part = _one(df, row, "training_source string, task string, train_rows bigint, test_rows bigint, accuracy double, "
                             "balanced_accuracy double, f1_weighted double, roc_auc double, mae double, rmse double, r2 double")
        report = part if report is None else report.unionByName(part)
    return report


def latent_view(model: TableModel, df: DataFrame, target: str) -> DataFrame:
    """Latent coordinates without those of the target, as ``x``, with the target itself."""
    z = model.transform(df)
    if target in model.encoding.numeric:
        i = model.encoding.numeric.index(target)
        x = F.concat(F.slice("z", 1, i), F.slice("z", i + 2, max(model.width - i - 1, 0)))
    else:
        x = model.context(target)
        x = F.array(F.lit(0.0)) if x is None else x
    return z.select(x.alias("x"), target)


def main_measure_report(real: DataFrame, synthetic: DataFrame, *, target: str | None, real_id: str, synthetic_id: str,
                        seed: int = 42, **settings) -> DataFrame:
    """Distance, discrimination, utility and distribution measures in one row."""
    ids = dict(target=target, real_id=real_id, synthetic_id=synthetic_id)
    parts = [lambda: measures.nn_distance_test(real, synthetic, **ids),
             lambda: discrimination_test(real, synthetic, seed=seed, **ids, **settings),
             lambda: utility_lift(real, synthetic.drop(synthetic_id), target=target, real_id=real_id, seed=seed, **settings),
             lambda: measures.distribution_score(real.drop(real_id), synthetic.drop(synthetic_id))]

    def fetch(part) -> tuple:
        table = part()
        return table.first().asDict(), [f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields]
    values, fields = {}, []
    for found, kinds in side_by_side([lambda part=part: fetch(part) for part in parts]):
        values.update(found)
        fields += kinds
    return _one(real, values, ", ".join(fields))


def registry(target: str | None, columns: Sequence[str], params: Params | None = None, seed: int = 42):
    """Method name to a function (table, row_id, n) -> rows with ``row``; stratified only with a target."""
    methods = {
        "transport": lambda df, key, n: fit(df, key, columns=list(columns), params=params).generate(n),
        "row_bootstrap": lambda df, key, n: samplers.bootstrap_rows(df, key, n, seed).select("row", *columns),
        "independent_columns": lambda df, key, n: samplers.independent_columns(df, key, columns, n, seed),
        "gaussian_copula": lambda df, key, n: samplers.gaussian_copula(df, key, columns, n, seed),
    }
    if target is not None:
        methods["stratified_columns"] = lambda df, key, n: samplers.stratified_columns(df, key, target, columns, n, seed)
    return methods


def pick_methods(names: Sequence[str], known: dict) -> dict:
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"Unknown methods {unknown}; expected some of {sorted(known)}.")
    return {n: known[n] for n in names}


def method_comparison(df: DataFrame, row_id: str, columns: Sequence[str], *, dataset: str, target: str | None,
                      n: int | None = None, methods: Sequence[str] | None = None, params: Params | None = None,
                      seed: int = 42, learned: bool = True, sink: str | None = None, **settings) -> DataFrame:
    """One summary row per method; generated rows are kept below ``sink`` when given."""
    known = registry(target, columns, params, seed)
    real = df.select(row_id, *columns)

    def summary(name: str, make) -> DataFrame:
        made = checkpoint(make(real, row_id, n))
        if sink is not None:
            made.drop("row").write.mode("overwrite").parquet(f"{sink}/{dataset}_{name}_generated.parquet")
        row = measures.summarise_method_report(real.drop(row_id), made.drop("row"), dataset, name)
        if learned:
            more = main_measure_report(real, made, target=target, real_id=row_id, synthetic_id="row", seed=seed, **settings)
            values = more.first().asDict()
            row = row.withColumns({k: F.lit(v).cast(more.schema[k].dataType) for k, v in values.items()})
        return row
    chosen = pick_methods(methods or list(known), known)
    rows = side_by_side([lambda name=name, make=make: summary(name, make) for name, make in chosen.items()])
    return reduce(DataFrame.unionByName, rows)
