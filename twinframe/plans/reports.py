"""Diagnostic reports: what a latent block knows, decoder calibration, class rebalancing, manifold position."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.functions import slots
from twinframe.functions.scalars import MISSING, category_key
from twinframe.operators import clean, manifold, neighbours, samplers, scores
from twinframe.operators.decode import LabelTree
from twinframe.operators.project import pca_projection
from twinframe.plans.evaluate import Preprocessor, forest_predictions, forest_scores
from twinframe.plans.model import Params, TableModel, fit
from twinframe.session import checkpoint, side_by_side

MECHANISM = ("dataset string, column string, block_width bigint, cardinality bigint, missing_rate double, n_train bigint, n_test bigint, "
             "majority_accuracy double, block_accuracy double, pca_accuracy double, raw_context_accuracy double, block_balanced_accuracy double, "
             "pca_balanced_accuracy double, raw_context_balanced_accuracy double, block_macro_f1 double, pca_macro_f1 double, "
             "raw_context_macro_f1 double, block_lift_over_majority double, block_lift_over_pca double, reason string")
CALIBRATION = ("dataset string, column string, block_width bigint, cardinality bigint, cardinality_bucket string, missing_rate double, "
               "n_train bigint, n_test bigint, accuracy double, mean_top_confidence double, confidence_gap double, negative_log_loss double, "
               "brier_score double, expected_calibration_error double, reason string")
IMBALANCE = ("dataset string, method string, target_column string, minority_class string, majority_class string, train_rows bigint, "
             "test_rows bigint, synthetic_rows bigint, train_minority_rate double, augmented_minority_rate double, accuracy double, "
             "balanced_accuracy double, macro_f1 double, minority_recall double, pr_auc double, reason string")


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def report_row(spark: SparkSession, schema: str, values: dict) -> DataFrame:
    """A typed row; measures that are not given are null."""
    return spark.createDataFrame([tuple(values.get(n) for n in _names(schema))], schema)


def empty_report(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def stack(rows: Sequence[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    out = empty_report(spark, schema)
    for row in rows:
        out = out.unionByName(row)
    return out


def split_tables(df: DataFrame, row_id: str, target: str | None, seed: int) -> tuple[DataFrame, DataFrame]:
    split = checkpoint(samplers.train_test_split(df, row_id, label=target if target in df.columns else None, seed=seed))
    return split.filter(~F.col("is_test")).drop("is_test"), split.filter("is_test").drop("is_test")


def _column_facts(model: TableModel, train: DataFrame, test: DataFrame, dataset: str, column: str, n_train: int, n_test: int) -> dict:
    missing = train.agg(F.avg(F.col(column).isNull().cast("double"))).first()[0]
    return {"dataset": dataset, "column": column, "block_width": model.blocks[column][1], "missing_rate": missing,
            "cardinality": model.encoding.cardinality(column), "n_train": n_train, "n_test": n_test}


def mechanism_report(model: TableModel, train: DataFrame, test: DataFrame, dataset: str, **settings) -> DataFrame:
    """Per categorical column, held-out scores from its own block, from principal components of the context of the
    same width, from the raw context, and of always answering the most frequent class."""
    spark = train.sparkSession
    n_train, n_test = train.count(), test.count()
    tables = {}
    for name, df in (("train", train), ("test", test)):
        keys = [category_key(F.col(c)).alias(f"_k_{c}") for c in model.encoding.categorical]
        tables[name] = checkpoint(model.transform(df.select(*model.encoding.columns, *keys)).select(*model.parts, *[f"_k_{c}" for c in model.encoding.categorical]))

    def judge(c: str) -> DataFrame:
        facts = _column_facts(model, train, test, dataset, c, n_train, n_test)
        if facts["cardinality"] < 2:
            return report_row(spark, MECHANISM, {**facts, "reason": "one_train_class"})
        start, width = model.blocks[c]
        context, block = model.context(c), F.slice("z", start + 1, width)
        if c in model.sparse:  # a wide block that no step projected: the digits of its key
            digits = slots.features(F.col(slots.NAME), [model.sparse[c]], model.params.narrow)
            width, block = len(digits), F.array(*digits)
        view = {k: t.select(F.col(f"_k_{c}").alias("y"), block.alias("block"),
                            (context if context is not None else F.array(F.lit(0.0))).alias("context")) for k, t in tables.items()}
        pca = {k: pca_projection(t, "context", width, "pca", train=view["train"]) for k, t in view.items()}
        found = {"majority_accuracy": scores.majority_baseline(view["train"], view["test"], "y").first()[0]}
        for label, source, x in (("block", view, "block"), ("pca", pca, "pca"), ("raw_context", view, "context")):
            s = forest_scores(source["train"], source["test"], x, "y", **settings).first()
            found.update({f"{label}_accuracy": s["accuracy"], f"{label}_balanced_accuracy": s["balanced_accuracy"],
                          f"{label}_macro_f1": s["macro_f1"]})
        found["block_lift_over_majority"] = found["block_accuracy"] - found["majority_accuracy"]
        found["block_lift_over_pca"] = found["block_accuracy"] - found["pca_accuracy"]
        return report_row(spark, MECHANISM, {**facts, **found, "reason": "ok"})
    return stack(side_by_side([lambda c=c: judge(c) for c in model.encoding.categorical]), spark, MECHANISM)


def decoder_calibration_report(model: TableModel, train: DataFrame, test: DataFrame, dataset: str) -> DataFrame:
    """Per categorical column, how far the decoder's probabilities can be trusted on held-out rows."""
    spark = train.sparkSession
    n_train, n_test = train.count(), test.count()
    z = checkpoint(model.transform(test))
    rows = []
    for c, decoder in model.decoders.items():
        facts = _column_facts(model, train, test, dataset, c, n_train, n_test)
        n = facts["cardinality"]
        facts["cardinality_bucket"] = "binary" if n <= 2 else "low" if n <= 10 else "medium" if n <= 50 else "high"
        context = model.context(c)
        table = z.select(category_key(F.col(c)).alias("y"), *([] if context is None else [context.alias("x")]))
        if isinstance(decoder, LabelTree):
            rows.append(report_row(spark, CALIBRATION, {**_tree_scores(table, decoder, model.encoding.keys(c), context is not None), **facts, "reason": "ok"}))
            continue
        told = checkpoint(decoder.probabilities(table, "x", "p").select("y", "p"))  # read by several scores
        found = scores.calibration_scores(told, "y", "p", decoder.classes).first().asDict()
        rows.append(report_row(spark, CALIBRATION, {**found, **facts, "reason": "ok"}))
    return stack(rows, spark, CALIBRATION)


def _tree_scores(table: DataFrame, tree: LabelTree, keys: DataFrame, has_context: bool) -> dict:
    """What can be said of a label tree without the shares of all classes; a key that was never fitted has share 0."""
    x = "x" if has_context else None
    known = table.withColumn("_row", F.monotonically_increasing_id()).join(keys.select(F.col("key").alias("y"), F.col("idx").alias("true")), "y", "left")
    walked = checkpoint(tree.walk(known, x, "y", sample=False, seed=0, row="_row").withColumnRenamed("_idx", "likely"))
    shares = tree.share_of(tree.share_of(walked, x, "likely", "top"), x, "true", "p")
    p = F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(1e-15))
    found = shares.agg(F.avg((F.col("likely").eqNullSafe(F.col("true"))).cast("double")).alias("accuracy"), F.avg("top").alias("mean_top_confidence"),
                       F.avg(-F.log(p)).alias("negative_log_loss")).first().asDict()
    found["confidence_gap"] = None if found["accuracy"] is None else found["mean_top_confidence"] - found["accuracy"]
    return found


def imbalance_report(df: DataFrame, row_id: str, target: str, dataset: str, *, params: Params | None = None,
                     max_train_rows: int | None = None, max_test_rows: int | None = None, seed: int = 42, **settings) -> DataFrame:
    """Score a forest trained on the real rows, and on rows brought to balance by three generators."""
    spark = df.sparkSession
    skip = lambda reason, **more: report_row(spark, IMBALANCE, {"dataset": dataset, "target_column": target, "reason": reason, **more})
    if target not in df.columns:
        return skip("missing_target")
    rows = clean.drop_null_target(df, target)
    facts = scores.prediction_task(rows, target).first()
    if facts["rows"] is None or facts["rows"] < 20:
        return skip("insufficient_rows")
    if facts["task"] != "classification":
        return skip("target_not_classification")
    if facts["distinct"] != 2:
        return skip("target_not_binary")
    train, test = split_tables(rows, row_id, target, seed)
    if max_train_rows is not None:
        train = checkpoint(samplers.cap_stratified(train, row_id, target, max_train_rows, seed))
    if max_test_rows is not None:
        test = checkpoint(samplers.cap_stratified(test, row_id, target, max_test_rows, seed + 1))
    ends = scores.minority_majority(train, target).first()
    if ends["minority_n"] < 2 or ends["minority"] == ends["majority"]:
        return skip("insufficient_minority_rows")
    minority, need = ends["minority"], int(ends["majority_n"] - ends["minority_n"])
    features = [c for c in df.columns if c not in (row_id, target)]
    base = train.select(*features, target)
    common = {"minority_class": str(minority), "majority_class": str(ends["majority"])}

    def transport() -> DataFrame:
        few = train.filter(F.col(target) == F.lit(minority)).select(row_id, *features)
        p = params or Params(seed=seed)
        made = fit(few, row_id, columns=features, params=replace(p, n_neighbours=min(p.n_neighbours, max(1, ends["minority_n"] - 1)))).generate(need)
        return made.select(*features, F.lit(minority).alias(target))

    def smote() -> DataFrame:
        made = samplers.smote_interpolate(train, row_id, target, features, seed=seed)
        return made.select(*[F.col(c).cast(train.schema[c].dataType).alias(c) if train.schema[c].dataType.typeName() != "string"
                             else F.when(F.col(c) != MISSING, F.col(c)).alias(c) for c in features], target)

    def stratified() -> DataFrame:
        few = train.filter(F.col(target) == F.lit(minority)).select(row_id, *features, target)
        return samplers.stratified_columns(few, row_id, target, [*features, target], need, seed).drop("row")
    makers = {"real_train": None, "transport_balanced": transport, "smote_balanced": smote, "stratified_balanced": stratified}

    def judge(method: str, make) -> DataFrame:
        if make is not None and need <= 0:
            return skip("already_balanced", method=method, **common)
        try:
            added = None if make is None else make()
            whole = checkpoint(base if added is None else clean.augment_union(base, added))
            pre = Preprocessor.fit(whole, features)
            found, classes = forest_predictions(pre.transform(whole), pre.transform(test), "x", target, seed=seed, **settings)
            table = checkpoint(found.select(F.col(target).cast("string").alias("t"), "pred", F.col("p")[classes.index(str(minority))].alias("s")))
            s = scores.class_scores(table, "t", "pred").first()
            return report_row(spark, IMBALANCE, {
                "dataset": dataset, "method": method, "target_column": target, **common, "train_rows": train.count(),
                "test_rows": test.count(), "synthetic_rows": whole.count() - base.count(),
                "train_minority_rate": scores.minority_rate(train, target, minority).first()[0],
                "augmented_minority_rate": scores.minority_rate(whole, target, minority).first()[0],
                "accuracy": s["accuracy"], "balanced_accuracy": s["balanced_accuracy"], "macro_f1": s["macro_f1"],
                "minority_recall": scores.class_recall(table, "t", "pred", str(minority)).first()[0],
                "pr_auc": scores.average_precision(table, "t", "s", str(minority)).first()[0], "reason": ""})
        except ValueError as exc:
            return skip(f"evaluation_failed: {exc}", method=method, **common)
    out = side_by_side([lambda method=method, make=make: judge(method, make) for method, make in makers.items()])
    return stack(out, spark, IMBALANCE)


def manifold_report(model: TableModel, train: DataFrame, test: DataFrame, row_id: str, dataset: str, *, n: int | None = None,
                    k: int = 10, landmarks: int = 16, max_eval_points: int | None = None, seed: int = 42) -> DataFrame:
    """Stress and hull flag of held-out real rows and of rows from three generators, one row per point.

    Both look at the written-out coordinates; wide blocks that no step projected take no part.
    """
    latent = model.latent
    tested = model.transform(test).select(F.col(row_id).cast("string").alias("point"), "z")
    edges = checkpoint(neighbours.knn_exact(latent, "row_id", "z", k))
    size = n or model.encoding.rows
    made = model.transform(model.generate(size)).select(F.col("row").cast("string").alias("point"), "z")
    between = samplers.latent_interpolation(latent, "row_id", edges, size, seed).select(F.col("row").cast("string").alias("point"), "z")
    copied = samplers.bootstrap_rows(latent, "row_id", size, seed).select(F.col("row").cast("string").alias("point"), "z")
    groups = [("held_out_real", "real_test", tested), ("transport", "generated", made),
              ("latent_interpolation", "generated", between), ("latent_bootstrap", "generated", copied)]
    points = None
    for method, kind, table in groups:
        if max_eval_points is not None:
            table = samplers.fixed_size_sample(table, "point", max_eval_points, seed)
        part = table.select(F.concat_ws("|", F.lit(method), "point").alias("point"), F.lit(method).alias("method"),
                            F.lit(kind).alias("sample_type"), "z")
        points = part if points is None else points.unionByName(part)
    points = checkpoint(points)
    marks = checkpoint(samplers.fixed_size_sample(latent.select("row_id"), "row_id", landmarks, seed).select(F.col("row_id").alias("node")))
    paths = manifold.landmark_geodesics(neighbours.neighbour_graph(edges), marks)
    placed = manifold.LandmarkEmbedding.fit(paths, marks)
    stress = manifold.insertion_stress(points, "point", latent, "row_id", "z", paths, placed, k)
    hull = manifold.hull_membership(points, "point", latent, "z")
    return points.select("point", "method", "sample_type").join(stress, "point").join(hull, "point").select(
        F.lit(dataset).alias("dataset"), "method", "sample_type", "point", "stress", "raw_stress", "in_hull",
        (~F.col("in_hull")).alias("out_hull"))
