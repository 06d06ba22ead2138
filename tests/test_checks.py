"""What is refused, with what, and the small helpers of runs over settings."""

import pytest
from pyspark.sql import functions as F

from twinframe.operators import clean, encode, profile
from twinframe.plans import evaluate, reports
from twinframe.plans.experiment import Config
from twinframe.plans.model import Params


def test_matrices_are_checked(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "id bigint, z array<double>")
    clean.check_matrix(rows, "z", 2)
    for bad in (rows.limit(0), rows.withColumn("z", F.slice("z", 1, F.col("id").cast("int") + 1)), rows.withColumn("z", F.array(F.lit(float("nan")))),
                rows.withColumn("z", F.array(F.lit(None).cast("double")))):
        with pytest.raises(ValueError):
            clean.check_matrix(bad, "z")
    with pytest.raises(ValueError):
        clean.check_matrix(rows, "z", 3)


def test_input_is_checked(spark):
    df = spark.createDataFrame([(i, float(i), "ab"[i % 2]) for i in range(6)], "id bigint, x double, c string")
    enc = encode.fit_encoding(df, ["x", "c"])
    with pytest.raises(ValueError, match="Missing columns"):
        encode.encode(df.drop("c"), enc)
    with pytest.raises(ValueError, match="at least one row"):
        encode.fit_encoding(df.limit(0), ["x", "c"])
    with pytest.raises(ValueError, match="column"):
        profile.split_column_kinds(df.select())


def test_common_names(spark):
    left = spark.createDataFrame([(1, 2.0, "a", True, 1)], "a int, b double, c string, d boolean, e int")
    right = spark.createDataFrame([("x", 2, "a", False)], "a string, b int, c string, d boolean")
    assert profile.common_names(left, right) == (["b", "d"], ["a", "c"])
    assert profile.common_names(left, right, profile.BOOL_IS_CATEGORY, ["b"]) == ([], ["a", "c", "d"])


def test_empty_and_stacked_reports(spark):
    empty = reports.empty_report(spark, reports.MECHANISM)
    assert empty.count() == 0 and len(empty.columns) == 20
    row = reports.report_row(spark, reports.MECHANISM, {"dataset": "d", "reason": "skipped"})
    assert reports.stack([row, row], spark, reports.MECHANISM).schema == empty.schema and row.first()["block_accuracy"] is None


def test_seeds_and_methods():
    config = Config("d", "id", seed=7, params=Params(factor=0.5))
    assert config.seeded().seed == 7 and config.seeded(9).seed == 9 and config.seeded().factor == 0.5 and config.params.seed == 42
    assert "stratified_columns" in evaluate.registry("t", ["x"]) and "stratified_columns" not in evaluate.registry(None, ["x"])
    assert list(evaluate.pick_methods(["row_bootstrap"], evaluate.registry(None, ["x"]))) == ["row_bootstrap"]
    with pytest.raises(ValueError, match="Unknown methods"):
        evaluate.pick_methods(["none"], evaluate.registry(None, ["x"]))


def test_judging_forest_is_bounded(spark, monkeypatch):
    """With at most 8 leaves a tree stays small however many rows there are, and with more classes than allowed it is refused."""
    df = spark.range(400).select(F.array((F.col("id") % 97).cast("double")).alias("x"), (F.col("id") % 3).cast("string").alias("y"))
    monkeypatch.setattr(evaluate, "MOST_LEAVES", 8)
    seen = []
    real = evaluate.forest
    monkeypatch.setattr(evaluate, "forest", lambda trees, depth, leaf, seed: seen.append(leaf) or real(trees, depth, leaf, seed))
    out, classes = evaluate.forest_predictions(df, df, "x", "y", trees=3)
    assert seen == [50] and classes == ["0", "1", "2"] and out.count() == 400
    monkeypatch.setattr(evaluate, "MOST_CLASSES", 2)
    with pytest.raises(ValueError, match="classes"):
        evaluate.forest_predictions(df, df, "x", "y", trees=3)
