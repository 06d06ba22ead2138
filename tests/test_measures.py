import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twinframe.operators import clean, encode, measures, profile, ranking, scores

REAL = [(20, 10.0, "a", "north"), (30, 20.0, "a", "north"), (40, 30.0, "b", "south"), (50, 40.0, "rare", "west")]
MADE = [(22, 11.0, "a", "north"), (31, 21.0, "b", "south"), (39, 31.0, "b", "south"), (48, 39.0, "new", "west")]
SCHEMA = "age bigint, income double, segment string, region string"


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame(REAL, SCHEMA), spark.createDataFrame(MADE, SCHEMA)


def test_similarity(pair):
    numeric = {r["column"]: r for r in measures.numeric_similarity(*pair).collect()}
    assert numeric["age"]["mean_abs_error"] == 0.0
    assert all(0 <= r["ks_statistic"] <= 1 and 0 <= r["histogram_overlap"] <= 1 for r in numeric.values())
    categorical = {r["column"]: r for r in measures.categorical_similarity(*pair, rare_threshold=0.25).collect()}
    assert categorical["segment"]["category_coverage"] == pytest.approx(2 / 3)
    assert categorical["segment"]["total_variation_distance"] == pytest.approx(0.5)
    assert categorical["segment"]["rare_category_preservation"] == pytest.approx(0.5)


def test_identical_tables_have_no_gap(pair):
    real, _ = pair
    row = measures.distribution_score(real, real).first()
    assert row["distribution_similarity_score"] == pytest.approx(1.0) and row["distribution_numeric_kl"] == pytest.approx(0.0)
    assert measures.association_difference(real, real).first()["max_abs_association_difference"] == pytest.approx(0.0)


def test_empty_side_and_constant_column(spark):
    real = spark.createDataFrame([(1.0, None), (1.0, None)], "x double, y double")
    made = spark.createDataFrame([(1.0, None)], "x double, y double")
    found = {r["column"]: r for r in measures.numeric_similarity(real, made).collect()}
    assert found["x"]["histogram_overlap"] == 1.0 and found["x"]["ks_statistic"] == 0.0
    assert found["y"]["histogram_overlap"] is None and found["y"]["real_missing_rate"] == 1.0


def test_nearest_distances(spark):
    real = spark.createDataFrame([(i, float(i), g) for i, g in enumerate("aabb")], "id bigint, x double, g string")
    made = spark.createDataFrame([(0, 0.1, "a"), (1, 2.9, None)], "id bigint, x double, g string")
    row = measures.nn_distance_test(real, made, real_id="id", synthetic_id="id").first()
    assert row["nn_distance_ratio"] > 0 and 0 <= row["nn_suspiciously_close_rate"] <= 1


def test_scores(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (1, 1, 0.8), (1, 0, 0.4), (0, 0, 0.2)], "t int, p int, s double")
    found = {r["score"]: r["value"] for r in scores.classification_scores(df, "t", "p", "s").collect()}
    assert found["accuracy"] == 0.75 and found["roc_auc"] == 1.0
    assert found["brier"] == pytest.approx((0.01 + 0.04 + 0.36 + 0.04) / 4)
    reg = scores.regression_scores(spark.createDataFrame([(1.0, 1.0), (2.0, 2.5), (3.0, 2.5)], "t double, p double"), "t", "p").first()
    assert reg["mae"] == pytest.approx(1 / 3) and reg["r2"] == pytest.approx(0.75)
    ties = spark.createDataFrame([(0, 0.5), (1, 0.5), (1, 0.9), (0, 0.9)], "t int, s double")
    assert scores.roc_auc(ties, "t", "s").first()[0] == pytest.approx(0.5)
    assert scores.average_precision(ties, "t", "s").first()[0] == pytest.approx(0.5)
    assert scores.roc_auc(ties.filter("t = 1"), "t", "s").first()[0] is None


def test_trace_completeness(spark):
    fields = ["anchor", "b", "c", "d"]
    df = spark.createDataFrame([({f: "x" for f in fields},), ({"anchor": "x"},)], "t map<string,string>")
    row = scores.trace_completeness(df, "t", fields).first()
    assert (row["trace_count"], row["trace_completeness_rate"], row["average_trace_size"]) == (2, 0.5, 2.5)


def test_sweep_ranking(spark):
    rows = [("lambda", 0.1, 0.8, 0.60, 0.00, 0.80), ("lambda", 0.5, 0.9, 0.52, 0.10, 0.90), ("lambda", 1.0, 1.0, 0.70, 0.05, 0.70)]
    df = spark.createDataFrame(rows, "parameter string, value double, nn_distance_ratio double, discrimination_accuracy double, utility_lift double, distribution_similarity_score double")
    ranked = ranking.rank_sweep(df).orderBy("place").collect()
    assert ranked[0]["value"] == 0.5
    assert ranking.best_row_for_measure(df, "nn_distance_ratio", ("near", 1.0), ["value"]).first()["value"] == 1.0


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlation_of_a_constant(spark, method):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 1.0, 5.0), (4.0, None, 5.0)], "a double, b double, c double")
    found = {(r["left"], r["right"]): r["value"] for r in measures.association_matrix(df, method=method).collect()}
    assert found == {("a", "b"): pytest.approx(1.0), ("a", "c"): None, ("b", "c"): None}
    assert {r["difference"] for r in measures.correlation_difference(df, df, ["a", "c"]).collect()} == {None}


@pytest.mark.parametrize("by", [[], ["side"]])
def test_rank_correlation_over_shared_rows(spark, by):
    """Each pair ranks the rows it shares, whatever other columns lack; ties get mean ranks."""
    rng = np.random.default_rng(3)
    data = pd.DataFrame({c: rng.integers(0, 12, 400).astype(float) for c in "abcde"})
    data["b"] = data["a"] * 2 + data["b"]
    data.loc[rng.random(400) < 0.3, "c"] = None
    data.loc[rng.random(400) < 0.5, "d"] = None
    data["e"] = 1.0
    data["side"] = [None if i % 3 == 0 else "x" for i in range(400)]
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in data.itertuples(index=False)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, side string")
    found = {tuple(r[c] for c in [*by, "left", "right"]): r["value"]
             for r in measures.numeric_correlation(df, list("abcde"), "spearman", by).collect()}
    parts = {(): data} if not by else {(None,): data[data["side"].isna()], ("x",): data[data["side"] == "x"]}
    assert len(found) == 10 * len(parts)
    for group, part in parts.items():
        for i, x in enumerate("abcde"):
            for y in "abcde"[i + 1:]:
                both = part[[x, y]].dropna().rank()
                want = abs(both[x].corr(both[y])) if both[x].std() and both[y].std() else None
                assert found[(*group, x, y)] == (None if want is None else pytest.approx(want, abs=1e-12))


def test_manifold_summary(spark):
    rows = [("d", "held", "real_test", 0.1, False), ("d", "held", "real_test", 0.2, False), ("d", "held", "real_test", 0.3, True),
            ("d", "m", "generated", 0.1, True), ("d", "m", "generated", 0.2, True), ("d", "m", "generated", 0.9, False)]
    df = spark.createDataFrame(rows, "dataset string, method string, sample_type string, stress double, out_hull boolean")
    row = ranking.summarise_manifold(df).first()
    assert row["out_hull_rate"] == pytest.approx(2 / 3) and row["out_hull_acceptance_at_real_q95"] == 1.0


def test_column_kinds(spark):
    df = spark.createDataFrame([(i % 2, bool(i % 2), 1.0 + i % 2, float(i), "a", None) for i in range(6)],
                               "binary bigint, flag boolean, two double, wide double, text string, empty double")
    assert profile.split_column_kinds(df) == (["wide"], ["binary", "flag", "two", "text", "empty"])


def test_snap_and_classes(spark):
    real = spark.createDataFrame([(0.0,), (1.0,)], "t double")
    made = spark.createDataFrame([(-0.1,), (0.5,), (1.1,), (None,)], "t double")
    assert [r["t"] for r in clean.snap_target_to_class(made, real, "t").collect()] == [0.0, 0.0, 1.0, None]
    words = spark.createDataFrame([("benign",), ("malignant",)], "t string")
    assert tuple(clean.positive_negative_class(words, "t").first()) == ("benign", "malignant")


def test_matrix_checks(spark):
    with pytest.raises(ValueError):
        clean.check_matrix(spark.createDataFrame([], "z array<double>"), "z")
    with pytest.raises(ValueError):
        clean.check_matrix(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "z array<double>"), "z")
    with pytest.raises(ValueError):
        clean.check_matrix(spark.createDataFrame([([float("nan")],)], "z array<double>"), "z")


def test_unknown_category_is_all_zero(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    enc = encode.fit_encoding(df)
    assert enc.categories["c"] == ["__MISSING__", "a", "b"]
    new = spark.createDataFrame([("z",)], "c string")
    assert encode.encode(new, enc).first()["z"] == [0.0, 0.0, 0.0]
