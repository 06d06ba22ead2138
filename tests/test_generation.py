from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from twinframe.operators import decode, manifold, neighbours, project, samplers, transport
from twinframe.operators.decode import fit_decoder
from twinframe.plans import evaluate
from twinframe.plans.job import fit_generate_job
from twinframe.plans.model import Params, TableModel, fit
from twinframe.session import FOREST_PARTS, FOREST_ROWS, settle

MIXED = [(i, a, b, i % 2, s) for i, (a, b, s) in enumerate(zip(
    [21, 22, 23, 35, 36, 37, 48, 49, 50, 62, 63, 64], ["young"] * 3 + ["adult"] * 3 + ["middle"] * 3 + ["senior"] * 3,
    [3, 4, 5, 10, 11, 12, 17, 18, 19, 24, 25, 26]))]
QUICK = Params(n_components=1, n_iterations=0, n_neighbours=3, trees=5, depth=4, factor=0.5)


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(MIXED, "id bigint, age bigint, band string, flag bigint, score bigint")


@pytest.fixture(scope="module")
def fitted(mixed):
    return fit(mixed, "id", params=QUICK)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_fit_and_generate(mixed, fitted):
    made = fitted.generate(30)
    assert made.columns == ["row", "age", "band", "flag", "score"]
    assert [f.dataType for f in made.schema.fields[1:]] == [f.dataType for f in mixed.schema.fields[1:]]
    found = made.collect()
    assert len(found) == 30 and {r["band"] for r in found} <= {"young", "adult", "middle", "senior"} and {r["flag"] for r in found} <= {0, 1}
    assert fitted.blocks == {"__numeric__": (0, 2), "band": (2, 4), "flag": (6, 2)}
    assert fitted.generate(0).count() == 0
    with pytest.raises(ValueError):
        fitted.generate(-1)


def test_same_seed_same_rows_under_any_partitioning(mixed, fitted):
    want = rows(fitted.generate(20))
    for parts in (1, 4):
        assert rows(fit(mixed.repartition(parts), "id", params=QUICK).generate(20)) == want


def test_save_and_load(spark, fitted, tmp_path):
    path = fitted.save(str(tmp_path / "model"))
    assert rows(TableModel.load(spark, path).generate(15)) == rows(fitted.generate(15))


def test_projection_rounds(mixed):
    from dataclasses import replace
    model = fit(mixed, "id", params=replace(QUICK, n_iterations=1, nca_max_iter=3))
    assert model.width == 4 and model.latent.first()["z"] is not None
    assert rows(model.transform(mixed).select("id", "z")) == rows(model.latent.select(F.col("row_id").alias("id"), "z"))


def test_one_row_falls_back_to_copies(spark):
    model = fit(spark.createDataFrame([(0, 1, "only")], "id bigint, flag bigint, label string"), "id", params=QUICK)
    assert {(r["flag"], r["label"]) for r in model.generate(3).collect()} == {(1, "only")}


def test_guard_refuses_and_counts(spark):
    latent = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "id bigint, z array<double>")
    edges = neighbours.mutual_neighbours(neighbours.knn_exact(latent, "id", "z", 2))
    bounds = transport.quantile_bounds(latent, [0], 0.25)
    assert bounds == {0: (0.75, 2.25)}
    made = transport.generate_latent(latent, "id", edges, 200, bounds=bounds, retries=3)
    found = made.collect()
    assert len(found) == 200
    for r in found:
        assert r["accepted"] == (0.75 <= r["z"][0] <= 2.25)
        assert r["accepted"] or r["attempt"] == 3
    counts = transport.guard_counts(made, 3).first()
    assert counts["violations"] == sum(not r["accepted"] for r in found)
    assert transport.quantile_bounds(latent, [], 0.1) == {} and transport.quantile_bounds(latent, [0], None) == {}


def test_rounds_give_the_same_rows(spark):
    latent = spark.createDataFrame([(i, [float(i * i % 17)]) for i in range(20)], "id bigint, z array<double>")
    edges = neighbours.mutual_neighbours(neighbours.knn_exact(latent, "id", "z", 3))
    bounds = transport.quantile_bounds(latent, [0], 0.3)
    one, many = (transport.generate_latent(latent, "id", edges, 60, bounds=bounds, retries=5, first_round=s) for s in (6, 1))
    assert rows(one) == rows(many.select(*one.columns))


def test_edge_draw_has_the_degree_law(spark):
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1), (3, 0)], "src bigint, dst bigint")
    draws = spark.range(4000).select(F.col("id").alias("row"), F.lit(0).alias("attempt"))
    share = {r["anchor"]: r["count"] / 4000 for r in transport.transport_draws(edges, draws).groupBy("anchor").count().collect()}
    for anchor, want in {0: 0.2, 1: 0.4, 2: 0.2, 3: 0.2}.items():
        assert abs(share[anchor] - want) < 0.03


def test_params_are_checked():
    for bad in (dict(n_components=0), dict(n_iterations=-1), dict(n_neighbours=0), dict(retries=-1), dict(quantile_guard=0.5),
                dict(decoder_fit_rows=0), dict(fit_sample_size=0), dict(fit_sample_size=1.5), dict(fit_sample_size=True), dict(factor=0.1, min_factor=0.2)):
        with pytest.raises(ValueError):
            Params(**bad).check()
    with pytest.raises(TypeError):
        Params(fit_sample_size="x").check()


def test_samplers_keep_support(spark):
    data = [(i, 20 + i, float(i), g, t) for i, (g, t) in enumerate([("a", 0), ("a", 0), ("b", 1), ("b", 1), (None, 1), ("c", 0)])]
    df = spark.createDataFrame(data, "id bigint, age bigint, fare double, group string, target bigint")
    columns = ["age", "fare", "group", "target"]
    for made in (samplers.independent_columns(df, "id", columns, 12), samplers.stratified_columns(df, "id", "group", columns, 12),
                 samplers.gaussian_copula(df, "id", columns, 12)):
        found = made.collect()
        assert len(found) == 12 and made.columns == ["row", *columns]
        assert {r["group"] for r in found} <= {"a", "b", "c", None}
        assert all(20 <= r["age"] <= 25 for r in found)
    strata = {(r["group"], r["target"]) for r in samplers.stratified_columns(df, "id", "group", columns, 60).collect()}
    assert strata <= {("a", 0), ("b", 1), (None, 1), ("c", 0)}


def test_copula_quantiles_follow_order_statistics(spark):
    values = [1.0, 1.0, 1.0, 4.0, 9.0]
    long = spark.createDataFrame([("x", v) for v in values], "column string, value double")
    ps = [0.0, 0.3, 0.5, 0.6, 0.7, 0.9, 0.999]
    asked = spark.createDataFrame([(i, "x", p, 5) for i, p in enumerate(ps)], "row bigint, column string, p double, total int")
    found = {r["row"]: r["value"] for r in samplers._empirical_quantile(asked, long).collect()}
    for i, p in enumerate(ps):
        assert found[i] == pytest.approx(np.quantile(values, p))


def test_smote_balances(spark):
    df = spark.createDataFrame([(i, float(i), "u" if i % 2 else "v", "rare" if i < 8 else "common") for i in range(24)],
                               "id bigint, hours double, segment string, target string")
    made = samplers.smote_interpolate(df, "id", "target", ["hours", "segment"], k=3).collect()
    assert len(made) == 8 and {r["target"] for r in made} == {"rare"} and all(0 <= r["hours"] <= 7 for r in made)


def test_split_shares_and_fit_sample(spark):
    df = spark.range(100).withColumn("c", F.when(F.col("id") < 90, "a").otherwise("b"))
    counts = {(r["c"], r["is_test"]): r["count"] for r in samplers.train_test_split(df, "id", label="c").groupBy("c", "is_test").count().collect()}
    assert counts == {("a", True): 27, ("a", False): 63, ("b", True): 3, ("b", False): 7}
    sample = samplers.stratified_fit_sample(df, "id", "c", 5).collect()
    assert len(sample) == 5 and {r["c"] for r in sample} == {"a", "b"}
    assert samplers.stratified_fit_sample(df.limit(30), "id", "c", 0.1).count() == 3
    assert samplers.fixed_size_sample(df, "id", 500).count() == 100


def test_calibration_status(spark):
    df = spark.createDataFrame([(i, [float(i)], c) for i, c in enumerate(["a", "b", "b"])], "id bigint, x array<double>, y string")
    assert fit_decoder(df, "id", "x", "y", ["a", "b"], trees=3, calibrate=True).status == "skipped_insufficient_class_count"
    assert fit_decoder(df.filter("y = 'b'"), "id", "x", "y", ["b"], trees=3, calibrate=True).status == "skipped_one_class"
    prior = fit_decoder(df, "id", None, "y", ["a", "b"])
    assert prior.status == "prior_only" and prior.prior == pytest.approx([1 / 3, 2 / 3])
    more = spark.createDataFrame([(i, [float(i)], "a" if i < 10 else "b") for i in range(20)], "id bigint, x array<double>, y string")
    done = fit_decoder(more, "id", "x", "y", ["a", "b"], trees=3, depth=3, calibrate=True, folds=2)
    assert done.status == "calibrated"
    for r in done.probabilities(more, "x", "p").collect():
        assert sum(r["p"]) == pytest.approx(1.0)


def test_forests_are_walked_by_all_tasks(spark):
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.createDataFrame([(i, [float(i)], "ab"[i % 2]) for i in range(40)], "id bigint, x array<double>, y string").coalesce(1)
    fitted = fit_decoder(rows, "id", "x", "y", ["a", "b"], trees=3, depth=3)
    assert fitted.probabilities(rows, "x", "p").rdd.getNumPartitions() == width
    out, _ = evaluate.forest_predictions(rows, rows, "x", "y", trees=3, depth=3)
    assert f"Repartition {width}, true" in out._jdf.queryExecution().optimizedPlan().toString()


def test_shares_are_listed_without_a_second_walk(spark, tmp_path):
    """No filter in front of the list may walk the trees again."""
    for name in ("fit_decoders", "calibrate_decoders"):
        spark.createDataFrame([(i, float(i % 7), i % 3, "ab"[i % 2]) for i in range(40)], "c_custkey bigint, c_acctbal double, c_nationkey bigint, c_mktsegment string").write.parquet(
            f"{tmp_path}/{name}/customer.parquet")
        out = entry_point.queries()[name](spark, f"{tmp_path}/{name}")
        assert "Filter" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert out.count() == 80


def test_training_rows_settle_in_few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = spark.range(1000)
        assert settle(df, "id").rdd.getNumPartitions() == 40
        assert settle(df, "id", rows=1000).rdd.getNumPartitions() == FOREST_PARTS
        assert settle(df, "id", rows=20 * FOREST_ROWS).rdd.getNumPartitions() == 20
        assert settle(df, "id", rows=10 ** 9).rdd.getNumPartitions() == 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def vectors(x, codes=None, count=0):
    """The Arrow form of contexts, with one sparse entry a row where codes are given."""
    lists = lambda parts, kind: pa.array([list(p) for p in parts], pa.list_(kind))
    sparse = None if codes is None else pa.StructArray.from_arrays([lists([[c] for c in codes], pa.int32()), lists([[1.0]] * len(codes), pa.float64())], ["indices", "values"])
    return project.Vectors(lists(x, pa.float64()), sparse, x.shape[1] + count)


def agreement_by_pairs(x, y, m):
    """All rows against all others, by the definition."""
    z, total = x @ m.T, 0.0
    for i in range(len(x)):
        p = np.array([np.exp(-((z[i] - z[j]) ** 2).sum()) if j != i else 0.0 for j in range(len(x))])
        total += (p / p.sum() * (y == y[i])).sum()
    return total


@pytest.mark.parametrize("count", [0, 4])
def test_projection_value_and_gradient(count):
    """With all rows as partners the value is that of the definition, and the gradient that of its differences, sparse entries included."""
    rng = np.random.default_rng(0)
    x, y, m = rng.normal(size=(12, 3)), rng.integers(0, 2, 12), rng.normal(size=(2, 3 + count))
    codes = rng.integers(0, count, 12) if count else None
    others = [[j for j in range(12) if j != i] for i in range(12)]
    flat = np.array(others).ravel()
    own, far = vectors(x, codes, count), vectors(x[flat], None if codes is None else codes[flat], count)
    f = lambda a: project.agreement(own, far, np.full(12, 11), (y[flat] == np.repeat(y, 11)), np.ones(len(flat)), a)
    whole = x if codes is None else np.hstack([x, np.eye(count)[codes]])
    assert f(m)[0] == pytest.approx(agreement_by_pairs(whole, y, m))
    g = f(m)[1]
    for i in range(2):
        for j in range(3 + count):
            step = np.zeros_like(m)
            step[i, j] = 1e-6
            assert g[i, j] == pytest.approx((agreement_by_pairs(whole, y, m + step) - agreement_by_pairs(whole, y, m - step)) / 2e-6, rel=1e-4, abs=1e-6)


def test_weight_stands_for_rows_left_out():
    """A drawn row of weight w counts as w rows at its place."""
    rng = np.random.default_rng(1)
    x, m = rng.normal(size=(6, 2)), rng.normal(size=(1, 2))
    own, same = vectors(x[:1]), np.array([True, False, True, True])
    one = project.agreement(own, vectors(x[[1, 2, 3]]), np.array([3]), same[:3], np.array([1.0, 1.0, 2.0]), m)
    two = project.agreement(own, vectors(x[[1, 2, 3, 3]]), np.array([4]), same, np.ones(4), m)
    assert one[0] == pytest.approx(two[0]) and one[1] == pytest.approx(two[1])


def test_projection_of_all_rows(spark):
    """With all other rows as partners, and with near and drawn ones, the classes end apart; the principal direction alone mixes them."""
    rng = np.random.default_rng(3)
    for rows in (40, 400):
        y = rng.integers(0, 2, rows)
        x = np.column_stack([y + 0.1 * rng.normal(size=rows), 0.7 * rng.normal(size=rows), 0.5 * rng.normal(size=rows)])
        df = spark.createDataFrame([(i, [float(v) for v in r], str(c)) for i, (r, c) in enumerate(zip(x, y))], "id bigint, x array<double>, y string")
        start = project.nca_fit(df, "id", "x", "y", 1, max_iter=0)
        found = project.nca_fit(df, "id", "x", "y", 1, max_iter=25)
        assert agreement_by_pairs(x, y, found) > max(0.97 * rows, 1.2 * agreement_by_pairs(x, y, start))
    assert project.nca_fit(df.withColumn("y", F.lit("a")), "id", "x", "y", 1) is None
    assert project.nca_fit(df.withColumn("x", F.array().cast("array<double>")), "id", "x", "y", 1) is None


def test_tiles_hold_each_row_with_its_partners(spark, monkeypatch):
    """Tiles hold whole rows however small they are: the nearest ones of each, and those drawn that are neither itself nor near."""
    monkeypatch.setattr(project, "TILE_ROWS", 20)
    x = np.random.default_rng(2).normal(size=(90, 2)).round(3)
    label = [None if i % 9 == 0 else "ab"[i % 2] for i in range(90)]
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], label[i]) for i in range(90)], "no bigint, x array<double>, label string")
    table = df.select("no", F.struct("x").alias("v"), "label")
    tiles = project.partners(table, np.array([[1.0, 0.0]]), 90, 4, 6, 42, 0).collect()
    drawn = table.select("no", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j")).select(
        "no", project.rng.uniform_index(90, 42, "nca.0", "no", "j").alias("to")).collect()
    place, seen = {tuple(v): i for i, v in enumerate(x)}, []
    for t in tiles:
        own, others = (pa.ipc.open_stream(bytes(t[c])).read_next_batch().to_pydict() for c in ("own", "others"))
        at = 0
        for v, count in zip(own["v"], own["count"]):
            i = place[tuple(v["x"])]
            mine = [(f, s, place[tuple(o["x"])]) for f, s, o in zip(*(others[c][at:at + count] for c in ("far", "same", "v")))]
            near = {j for f, _, j in mine if not f}
            gap = np.round(np.abs(x[:, 0] - x[i, 0]), 9)
            assert near == set(sorted(set(range(90)) - {i}, key=lambda j: (gap[j], j))[:4])
            assert sorted(j for f, _, j in mine if f) == sorted(r["to"] for r in drawn if r["no"] == i and r["to"] != i and r["to"] not in near)
            assert all(s == (label[j] is not None and label[j] == label[i]) for _, s, j in mine)
            seen.append(i)
            at += count
    assert sorted(seen) == list(range(90))


def test_principal_directions_equal_svd(spark):
    x = np.random.default_rng(5).normal(size=(60, 5)) @ np.diag([5.0, 2.0, 1.0, 0.1, 0.1])
    table = spark.createDataFrame([([float(v) for v in r],) for r in x], "x array<double>").select(F.struct("x").alias("v"))
    found = project.principal_directions(table, False, 60, 5, 2)
    _, _, want = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.abs((found * want[:2]).sum(axis=1)) == pytest.approx([1.0, 1.0], abs=1e-4)


def test_hull_golden(spark):
    def inside(train, points):
        t = spark.createDataFrame([([float(v) for v in p],) for p in train], "z array<double>")
        q = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id bigint, z array<double>")
        return [r["in_hull"] for r in manifold.hull_membership(q, "id", t, "z").orderBy("point").collect()]
    assert inside([(0, 0), (1, 0), (0, 1)], [(0.25, 0.25), (1, 1)]) == [True, False]
    assert inside([(0, 0), (1, 1), (2, 2)], [(1, 1), (3, 3)]) == [True, False]


@pytest.mark.parametrize("width", [1, 2, 3])
def test_hull_of_any_number_of_rows(spark, monkeypatch, width):
    """More rows than a test may be made against: groups are reduced to their corners, and the answers are those of all rows."""
    monkeypatch.setattr(manifold, "MAX_HULL_ROWS", 150)
    monkeypatch.setattr(manifold, "HULL_GROUP", 100)
    rng = np.random.default_rng(width)
    train = np.vstack([rng.normal(size=(600, width)).round(2), np.zeros((30, width))])
    asked = rng.normal(size=(80, width)) * 1.6
    t = spark.createDataFrame([([float(v) for v in p],) for p in train], "z array<double>")
    q = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(asked)], "id bigint, z array<double>")
    found = [r["in_hull"] for r in manifold.hull_membership(q, "id", t, "z").orderBy("point").collect()]
    assert found == [manifold.contains_origin(train - p, 1e-8) for p in asked] and 0 < sum(found) < 80


def test_corners_of_flat_and_equal_rows():
    square = np.array([[x, y, 1.0] for x in range(5) for y in range(5)])
    assert {(0.0, 0.0, 1.0), (0.0, 4.0, 1.0), (4.0, 0.0, 1.0), (4.0, 4.0, 1.0)} <= set(map(tuple, manifold.corners(square)))
    assert len(manifold.corners(square)) < 25 and manifold.corners(np.ones((7, 2))).tolist() == [[1.0, 1.0]]


def test_geodesics_on_a_line(spark):
    graph = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (2, 3, 1.5), (7, 8, 1.0)], "a bigint, b bigint, dist double")
    marks = spark.createDataFrame([(0,)], "node bigint")
    found = {r["node"]: r["d"] for r in manifold.landmark_geodesics(graph, marks).collect()}
    assert found == {0: 0.0, 1: 1.0, 2: 3.0, 3: 4.5}


def test_geodesics_on_a_long_chain(spark):
    """Ten thousand hops need about as many rounds as their logarithm."""
    n = 10_000
    graph = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (F.col("id") % 7 + 1).cast("double").alias("dist"))
    marks = spark.createDataFrame([(0,), (5_000,)], "node bigint")
    found = manifold.landmark_geodesics(graph, marks, plain_rounds=2).toPandas().pivot(index="node", columns="landmark", values="d").sort_index()
    way = np.concatenate([[0.0], np.cumsum(np.arange(n - 1) % 7 + 1.0)])
    assert len(found) == n
    assert np.abs(found[0].to_numpy() - way).max() == 0.0
    assert np.abs(found[5_000].to_numpy() - np.abs(way - way[5_000])).max() == 0.0


@pytest.mark.parametrize("kind", ["band", "sparse", "dense"])
def test_geodesics_against_all_paths(spark, kind):
    rng = np.random.default_rng(5)
    n = 40
    pairs = {"band": [(i, j) for i in range(n) for j in range(i + 1, min(i + 4, n))],
             "sparse": [tuple(p) for p in rng.integers(0, n, size=(42, 2))],
             "dense": [tuple(p) for p in rng.integers(0, n, size=(300, 2))]}[kind]
    rows = [(int(a), int(b), float(w)) for (a, b), w in zip(pairs, rng.integers(1, 50, size=len(pairs)))]
    best = np.full((n, n), np.inf)
    np.fill_diagonal(best, 0.0)
    for a, b, w in rows:
        best[a, b] = best[b, a] = min(best[a, b], w if a != b else 0.0)
    for m in range(n):
        best = np.minimum(best, best[:, m:m + 1] + best[m:m + 1])
    marks = spark.createDataFrame([(0,), (17,), (n + 5,)], "node bigint")
    found = {(r["landmark"], r["node"]): r["d"] for r in manifold.landmark_geodesics(
        spark.createDataFrame(rows, "a bigint, b bigint, dist double"), marks, plain_rounds=6).collect()}
    want = {(m, i): best[m, i] for m in (0, 17) for i in range(n) if np.isfinite(best[m, i])}
    assert found == {**want, (n + 5, n + 5): 0.0}


def test_geodesics_of_no_edges(spark):
    marks = spark.createDataFrame([(3,)], "node bigint")
    rows = manifold.landmark_geodesics(spark.createDataFrame([], "a bigint, b bigint, dist double"), marks).collect()
    assert [tuple(r) for r in rows] == [(3, 3, 0.0)]


def test_job_end_to_end(spark, tmp_path):
    source, sink = str(tmp_path / "in.csv"), str(tmp_path / "out.csv")
    spark.createDataFrame(MIXED, "id bigint, age bigint, band string, flag bigint, score bigint").drop("id").write.option("header", True).csv(source)
    fit_generate_job(spark, source=source, sink=sink, model_out=str(tmp_path / "m"), params=QUICK)
    assert spark.read.option("header", True).csv(sink).count() == len(MIXED)
    with pytest.raises(ValueError):
        fit_generate_job(spark, model_in=str(tmp_path / "m"), sink=str(tmp_path / "other.csv"))
    fit_generate_job(spark, model_in=str(tmp_path / "m"), sink=str(tmp_path / "other.csv"), n=4)
    assert spark.read.option("header", True).csv(str(tmp_path / "other.csv")).count() == 4


@pytest.mark.parametrize("width", [120, 1500])
def test_wide_category_keeps_its_context(spark, width):
    """More classes than a trainer infers from the labels alone: the context still decides."""
    classes = [f"k{i:04d}" for i in range(width)]
    rows = [(i, [float(i % width), float(i % 2)], classes[i % width]) for i in range(2 * width)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y string")
    decoder = decode.fit_decoder(df, "id", "x", "y", classes, trees=3, depth=14)
    assert decoder.status == "disabled" and decoder.forests
    out = decode.decode_categorical(df.withColumnRenamed("id", "row"), decoder, "x", "made", sample=False, seed=1).collect()
    assert len(out) == 2 * width and sum(r.made == r.y for r in out) > (120 if width == 120 else 60)  # by chance 2


def test_sigmoids_of_all_classes_at_once_equal_one_by_one(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    shares = rng.dirichlet(np.ones(4), 300)
    labels = np.array([rng.choice(4, p=0.7 * s + 0.3 / 4) for s in shares])
    folds = np.arange(300) % 2
    held = spark.createDataFrame([(int(f), int(y), p.tolist()) for f, y, p in zip(folds, labels, shares)], "_fold int, y int, p array<double>")
    found = decode.fit_sigmoids(held, 2, 4)
    for f in range(2):
        for c in range(4):
            p, y = shares[folds == f, c], labels[folds == f] == c
            target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
            a, b = found[f][c]
            gap = 1 / (1 + np.exp(-(a * p + b))) - target
            assert abs((gap * p).sum()) < 1e-3 and abs(gap.sum()) < 1e-3


def test_transport_draws_every_row_and_one_class(spark):
    latent = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "id bigint, z array<double>")
    edges = spark.createDataFrame([(0, 1), (1, 0), (2, 3)], "src bigint, dst bigint")  # no edge starts at 3
    assert transport.generate_latent(latent, "id", edges, 300).count() == 300
    with pytest.raises(ValueError):
        transport.generate_latent(latent, "id", edges.filter("src = 2"), 3)
    classes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b"), (3, "b")], "src bigint, cls string")
    made = transport.generate_latent(latent, "id", edges, 50, classes=classes, target="b").collect()
    assert len(made) == 50 and {r["anchor"] for r in made} == {1}
    with pytest.raises(ValueError):
        transport.generate_latent(latent, "id", edges, 3, classes=classes, target="c")
    with pytest.raises(ValueError):
        transport.generate_latent(latent, "id", edges, 3, target="b")


def test_row_ids_do_not_follow_the_layout(spark):
    from twinframe.plans.job import with_row_id
    df = spark.createDataFrame([(i % 7, None if i % 3 else "x") for i in range(40)], "a int, b string")
    one, many = (sorted(map(tuple, with_row_id(df.repartition(k)).collect()), key=str) for k in (1, 8))
    assert one == many and len({r[-1] for r in one}) == 40


def test_wrong_latent_width_is_refused(fitted):
    vectors = fitted.latent.sparkSession.createDataFrame([(0, [0.0] * (fitted.width + 1))], "row bigint, z array<double>")
    with pytest.raises(Exception, match="coordinates"):
        fitted.inverse_transform(vectors).collect()


def test_bounded_decoder_rows_keep_every_class(mixed):
    model = fit(mixed, "id", params=replace(QUICK, decoder_fit_rows=8))
    assert all(set(d.classes) == set(model.encoding.categories[c]) for c, d in model.decoders.items())
    assert model.generate(15).count() == 15


# ---- wide categories

WIDE = [(i, float(i % 30), f"k{i % 300:03d}", "ab"[i % 2], None if i % 50 == 7 else f"g{i // 20:02d}") for i in range(600)]


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame(WIDE, "id bigint, x double, key string, side string, many string").repartition(5)


def written_out(model, df):
    """Latent rows as dense one-hot vectors, by the encoding's dictionary."""
    codes = {(r["column"], r["key"]): r["idx"] for r in model.encoding.dictionary.collect()}
    out = {}
    for r in df.collect():
        z = list(r["z"])
        for c, (first, count) in model.encoding.slots().items():
            block = [0.0] * count
            for i, v in zip(r["_slots"]["indices"], r["_slots"]["values"]):
                if first <= i < first + count:
                    block[i - first] = v
            z += block
        out[r[0]] = np.array(z)
    return out, codes


def test_wide_encoding_equals_one_hot(wide):
    from twinframe.plans.model import fit_latent
    sparse, dense = (fit_latent(wide, "id", ["x", "key", "side", "many"], replace(QUICK, narrow=n)) for n in (8, 1000))
    assert sparse.encoding.wide == ["key", "many"] and dense.encoding.wide == [] and sparse.width == 3
    found, codes = written_out(sparse, sparse.latent)
    want = {r["row_id"]: np.array(r["z"]) for r in dense.latent.collect()}
    order = [0] + list(range(301, 303)) + list(range(1, 301)) + list(range(303, dense.width))
    assert all((found[i] == want[i][order]).all() for i in want)
    assert [codes[("key", f"k{i:03d}")] for i in range(300)] == list(range(300))
    plan = sparse.transform(wide)._jdf.queryExecution().toString()
    assert "k299" not in plan and "k150" not in plan
    unknown = wide.limit(1).withColumn("key", F.lit("never seen"))
    assert len(sparse.transform(unknown).first()["_slots"]["indices"]) == 1


def test_wide_neighbours_and_moved_rows_equal_dense(wide):
    """The same edges and the same generated vectors, whether blocks are written out or not."""
    made = {}
    for n in (8, 1000):
        model = fit(wide, "id", columns=["x", "key", "side"], params=replace(QUICK, narrow=n, quantile_guard=None, trees=2))
        made[n] = (rows(model.edges), model, model.generate_latent(40))
    assert made[8][0] == made[1000][0]
    found, _ = written_out(made[8][1], made[8][2].select("row", "z", "_slots"))
    want = {r["row"]: np.array(r["z"]) for r in made[1000][2].collect()}
    order = [0, 301, 302, *range(1, 301)]
    for i, z in want.items():
        assert found[i] == pytest.approx(z[order])


def test_wide_model_generates_and_is_saved(spark, wide, tmp_path):
    model = fit(wide, "id", params=replace(QUICK, narrow=8, depth=12))
    assert isinstance(model.decoders["key"], decode.LabelTree) and model.decoders["key"].base ** len(model.decoders["key"].levels) >= 300
    out = model.generate(80).collect()
    assert len(out) == 80 and {r["key"] for r in out} <= {f"k{i:03d}" for i in range(300)} and len({r["key"] for r in out}) > 20
    assert {r["many"] for r in out} <= {None, *(f"g{i:02d}" for i in range(30))}
    again = TableModel.load(spark, model.save(str(tmp_path / "wide")))
    assert rows(again.generate(80)) == rows(model.generate(80))


def test_reports_of_wide_columns(wide):
    from twinframe.plans import reports
    model = fit(wide, "id", params=replace(QUICK, narrow=8, depth=8))
    found = {r["column"]: r for r in reports.decoder_calibration_report(model, wide, wide, "wide").collect()}
    assert found["key"]["cardinality"] == 300 and 0 <= found["key"]["accuracy"] <= 1 and found["key"]["negative_log_loss"] > 0
    rows = {r["column"]: r for r in reports.mechanism_report(model, wide, wide.limit(100), "wide", trees=2, depth=4).collect()}
    assert rows["many"]["reason"] == "ok" and rows["many"]["block_accuracy"] is not None


def test_wide_blocks_are_projected(wide):
    """Every wide block ends as a few coordinates; the transform of the fitted rows gives the fitted rows."""
    model = fit(wide, "id", params=replace(QUICK, narrow=8, n_iterations=1, n_components=2, nca_max_iter=4))
    assert model.sparse == {} and model.width == 7 and model.latent.columns == ["row_id", "z"]
    found = {r["id"]: r["z"] for r in model.transform(wide).select("id", "z").collect()}
    for r in model.latent.collect():
        assert found[r["row_id"]] == pytest.approx(r["z"])
    assert model.generate(20).count() == 20


def test_label_tree_shares(spark):
    """Shares of all classes add up to one, a draw gives only known classes, and the context decides."""
    df = spark.createDataFrame([(i, [float(i % 50)], i % 50) for i in range(400)], "id bigint, x array<double>, idx bigint")
    tree = decode.fit_label_tree(df, "id", "x", "idx", 50, branches=7, trees=5, depth=12)
    assert len(tree.levels) == 3 and tree.base == 4
    each = df.limit(8).select("id", "x", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("n"))
    sums = tree.share_of(each, "x", "n", "p").groupBy("id").agg(F.sum("p").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in sums)
    likely = tree.walk(df, "x", "made", sample=False, seed=1, row="id").collect()
    assert sum(r["_idx"] == r["idx"] for r in likely) > 200 and all(0 <= r["_idx"] < 50 for r in likely)
    assert all(0 <= r["_idx"] < 50 for r in tree.walk(df, "x", "made", sample=True, seed=1, row="id").collect())


def test_trace_tells_the_probabilities(fitted):
    made = fitted.trace(25).collect()
    assert len(made) == 25
    for r in made:
        for column in ("band", "flag"):
            told = r["probabilities"][column]
            assert sorted(told) == sorted(fitted.decoders[column].classes) and abs(sum(told.values()) - 1) < 1e-9
            assert told[str(r[column])] > 0
    plain = {r["row"]: (r["band"], r["flag"]) for r in fitted.generate(25).collect()}
    assert plain == {r["row"]: (r["band"], r["flag"]) for r in made}


def test_trace_tells_the_shares_of_a_label_tree(wide):
    model = fit(wide, "id", params=replace(QUICK, narrow=8))
    for r in model.trace(10).collect():
        levels = r["probabilities"]["key"]
        assert len(levels) == len(model.decoders["key"].levels) and all(abs(sum(x) - 1) < 1e-9 for x in levels)


def test_decoders_are_fitted_on_all_rows(spark, monkeypatch):
    from twinframe.plans import model as plan
    seen = []

    def count(rows, *given, **settings):
        seen.append(rows.count())
        return decode.Decoder(["0", "1"], "prior_only", [0.5, 0.5])
    monkeypatch.setattr(plan, "fit_decoder", count)
    monkeypatch.setattr(plan, "fit_label_tree", count)
    df = spark.range(100_300).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).cast("string").alias("c"),
                                     (F.col("id") % 97).cast("string").alias("wide"))
    fit(df, "id", params=QUICK, edges=spark.createDataFrame([(0, 7), (7, 0)], "src bigint, dst bigint"))
    assert seen == [100_300] * 2


def test_smallest_leaf_grows_with_the_rows(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i)], "ab"[i % 2]) for i in range(200)], "id long, x array<double>, y string")
    leaf = lambda: fit_decoder(df, "id", "x", "y", ["a", "b"], trees=2, depth=3).forests[0].getMinInstancesPerNode()
    assert leaf() == 1
    monkeypatch.setattr(decode, "MOST_LEAVES", 60)
    assert leaf() == 4


def test_partners_in_slices_and_nothing_left_on_disk(spark, monkeypatch):
    """Slices give each row the partners it has without them, and a projection deletes the tables it wrote."""
    import os
    from pathlib import Path

    from twinframe.session import checkpoint
    table = checkpoint(spark.range(50).select(F.col("id").alias("no"), F.struct(F.array((F.col("id") * 7 % 50).cast("double"), F.lit(1.0)).alias("x")).alias("v"),
                                              (F.col("id") % 3).cast("string").alias("label")))
    kept = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    files = lambda: sum(len(names) for _, _, names in os.walk(kept))

    def found():
        out, before = {}, files()
        tiles = project.partners(table, np.array([[1.0, 0.0]]), 50, 4, 6, 42, 0)
        for t in tiles.collect():
            own, others = (pa.ipc.open_stream(t[x]).read_next_batch().to_pydict() for x in ("own", "others"))
            at = 0
            for v, n in zip(own["v"], own["count"]):
                out[v["x"][0]] = sorted((far, same, w["x"][0]) for far, same, w in zip(*(others[c][at:at + n] for c in ("far", "same", "v"))))
                at += n
        project.discard(tiles)
        assert files() == before
        return out
    whole = found()
    monkeypatch.setattr(project, "SHUFFLED", 200)
    assert found() == whole and len(whole) == 50
    df = spark.createDataFrame([(i, [float(i % 9), float(i)], "ab"[i % 2]) for i in range(80)], "id long, x array<double>, y string")
    before = files()
    assert project.nca_fit(df, "id", "x", "y", 1, max_iter=2) is not None and files() == before


def test_geodesics_by_one_task_and_by_rounds(spark):
    """One task, rounds, and contraction down to what one task holds give the same lengths; a landmark may be named twice or have no edge."""
    rng = np.random.default_rng(8)
    edges = [(f"n{i}", f"n{j}", round(float(abs(i - j) + rng.random()), 3)) for i in range(90) for j in (i + 1, i + 3) if j < 90 and (i < 60) == (j < 60)]
    graph = spark.createDataFrame(edges, "a string, b string, dist double")
    marks = spark.createDataFrame([("n0",), ("n59",), ("n0",), ("alone",)], "node string")
    found = [sorted((r["landmark"], r["node"], round(r["d"], 9)) for r in manifold.landmark_geodesics(graph, marks, **how).collect())
             for how in ({}, dict(local=0), dict(local=60, plain_rounds=2))]
    assert found[0] == found[1] == found[2] and len(found[0]) == 2 * 60 + 1 + 1


def test_path_lengths_take_detours():
    node, to, dist = np.array([0, 0, 1, 2, 2]), np.array([1, 2, 3, 1, 3]), np.array([5.0, 1.0, 1.0, 1.0, 9.0])
    assert manifold.path_lengths(node, to, dist, 5, 0).tolist() == [0.0, 2.0, 1.0, 3.0, np.inf]
