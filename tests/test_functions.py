import hashlib
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.functions import normal, ordered, rng, scalars


def test_uniform_does_not_depend_on_partitions(spark):
    seen = []
    for parts in (1, 4, 16):
        df = spark.range(0, 200, 1, parts).withColumn("u", rng.uniform(3, "s", "id"))
        seen.append(sorted((r["id"], r["u"]) for r in df.collect()))
    assert seen[0] == seen[1] == seen[2]
    values = np.array([u for _, u in seen[0]])
    assert 0 <= values.min() and values.max() < 1 and abs(values.mean() - 0.5) < 0.1


def test_normal_quantile_and_cdf(spark):
    ps = [1e-6, 1e-4, 0.01, 0.3, 0.5, 0.8, 0.999]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal.normal_quantile(F.col("p")).alias("z"))
    for r in df.collect():
        assert abs(r["z"] - NormalDist().inv_cdf(r["p"])) < 1e-7
    zs = [-8.0, -7.2, -2.0, 0.0, 1.5, 9.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal.normal_cdf(F.col("z")).alias("p"))
    for r in df.collect():
        assert abs(r["p"] - NormalDist().cdf(r["z"])) < 1e-12


def test_quantiles_match_numpy(spark):
    x = np.random.default_rng(0).integers(0, 40, 500) / 3.0
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 2.0), ("c", None)], "g string, v double")
    found = {(r["g"], r["probability"]): r["quantile"] for r in ordered.quantiles(df, ["g"], "v", [0.05, 0.5, 0.9]).collect()}
    for p in (0.05, 0.5, 0.9):
        assert abs(found[("a", p)] - np.quantile(x, p)) < 1e-9
        assert found[("b", p)] == 2.0
    assert not any(g == "c" for g, _ in found)


def test_dense_index_and_prefix_sums_equal_plain_order(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 5).cast("string"))
    found = {r["id"]: r["idx"] for r in ordered.dense_index(df, "id", within=["g"]).select("id", "idx").collect()}
    groups = {}
    for i in sorted(range(3000), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
        at = groups.setdefault(None if i % 3 == 0 else i % 5, [])
        assert found[i] == len(at)
        at.append(i)
    counts = spark.range(500).select(F.lit("x").alias("g"), F.pmod(F.col("id") * 37, F.lit(500)).cast("double").alias("v"), (F.col("id") % 4 + 1).alias("n"))
    n = {float(i * 37 % 500): i % 4 + 1 for i in range(500)}
    for ranges in (None, 1, 7, 300):
        run = 0
        for r in sorted(ordered.prefix_sums(counts, ["g"], "v", ["n"], ranges=ranges).collect(), key=lambda r: r["v"]):
            run += n[r["v"]]
            assert r["cum_n"] == run and r["next_value"] == (r["v"] + 1 if r["v"] < 499 else None)


def test_smallest_equals_a_sort(spark):
    df = spark.range(2000).withColumn("u", F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0))
    order = [r["id"] for r in df.orderBy("u", "id").collect()]
    for n in (0, 1, 300, 700, 1999, 2000, 5000):
        assert sorted(r["id"] for r in ordered.smallest(df, "u", "id", n).collect()) == sorted(order[:n])


def test_bins_follow_numpy(spark):
    x = np.round(np.random.default_rng(2).integers(0, 101, 400) / 100.0, 2)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    lo, hi = float(x.min()), float(x.max())
    found = df.select(scalars.bin_index(F.col("v"), F.lit(lo), F.lit(hi), 20).alias("b")).groupBy("b").count().collect()
    expected, _ = np.histogram(x, bins=20, range=(lo, hi))
    assert {r["b"]: r["count"] for r in found} == {i: int(n) for i, n in enumerate(expected) if n}


def test_scalars(spark):
    row = spark.createDataFrame([(" Private. ", "?", 0.0, -1.9, [3.0, 9.0, 9.0])], "a string, b string, z double, t double, v array<double>").select(
        scalars.null_sentinels(F.col("a")).alias("a"), scalars.null_sentinels(F.col("b")).alias("b"), scalars.zero_as_null(F.col("z")).alias("z"),
        F.col("t").cast("bigint").alias("t"), scalars.argmax(F.col("v")).alias("m"), scalars.coerce_numeric(F.col("a")).alias("n"),
        scalars.normalise(F.col("v")).alias("p"), scalars.recode(F.lit(5), {1: "x"}).alias("r")).first()
    assert (row["a"], row["b"], row["z"], row["t"], row["m"], row["n"], row["r"]) == ("Private", None, None, -1, 1, None, None)
    assert abs(sum(row["p"]) - 1) < 1e-12


def test_nearest_class(spark):
    from twinframe.operators.clean import nearest_class
    rng = np.random.default_rng(3)
    for size in (1, 5, 2000):
        classes = np.unique(rng.integers(-3000, 3000, size) / 2.0)
        values = np.unique(np.concatenate([rng.integers(-4000, 4000, 400) / 4.0, classes[:3]]))
        found = nearest_class(*(spark.createDataFrame([(float(x),) for x in xs], f"{n} double") for xs, n in ((values, "v"), (classes, "c")))).collect()
        assert len(found) == len(values)
        for r in found:
            assert r["nearest"] == min(classes, key=lambda c: (abs(r["v"] - c), c))
    assert nearest_class(spark.createDataFrame([(1.0,)], "v double"), spark.createDataFrame([], "c double")).first()["nearest"] is None
