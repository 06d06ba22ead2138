import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinframe.operators import neighbours


def points(spark, values):
    return spark.createDataFrame([(i, [float(x) for x in np.atleast_1d(v)]) for i, v in enumerate(values)], "id bigint, z array<double>")


def lists(edges):
    out = {}
    for r in edges.orderBy("src", "rank").collect():
        out.setdefault(r["src"], []).append(r["dst"])
    return out


def brute(rows, k, metric="euclidean", ids=None):
    x = np.array(rows, dtype=float).reshape(len(rows), -1)
    if metric == "cosine":
        x = x / np.sqrt((x ** 2).sum(axis=1, keepdims=True))
    gap = x[:, None, :] - x[None, :, :]
    d = {"euclidean": lambda: np.sqrt((gap ** 2).sum(-1)), "manhattan": lambda: np.abs(gap).sum(-1), "cosine": lambda: (gap ** 2).sum(-1) / 2}[metric]()
    d = d.round(9)
    np.fill_diagonal(d, np.inf)
    return {i: [int(j) for j in np.lexsort((np.arange(len(x)), d[i]))[:min(k, len(x) - 1)]] for i in range(len(x))}


def test_golden_one_dimension(spark):
    edges = neighbours.knn_exact(points(spark, [0, 1, 10, 11]), "id", "z", 1)
    assert lists(edges) == {0: [1], 1: [0], 2: [3], 3: [2]}
    assert sorted(map(tuple, neighbours.mutual_neighbours(edges).collect())) == [(0, 1), (1, 0), (2, 3), (3, 2)]


def test_fallback_edge_goes_one_way(spark):
    edges = neighbours.knn_exact(points(spark, [0, 1, 2]), "id", "z", 1)
    assert sorted(map(tuple, neighbours.mutual_neighbours(edges).collect())) == [(0, 1), (1, 0), (2, 1)]


def test_many_copies_of_one_row(spark):
    rows = [[0.0, 0.0]] * 40 + [[1.0, 0.0], [0.0, 2.0], [5.0, 5.0]] * 2
    assert lists(neighbours.knn_exact(points(spark, rows), "id", "z", 3)) == brute(rows, 3)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_cells_and_bounds_give_exact_lists(spark, monkeypatch, metric):
    monkeypatch.setattr(neighbours, "CELL", 20)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "QUERIES", 8)
    rng = np.random.default_rng(5)
    rows = np.vstack([rng.normal(0, 1, (120, 3)).round(1), rng.normal(8, 0.2, (100, 3)).round(1), np.zeros((30, 3))])
    assert lists(neighbours.knn_exact(points(spark, rows), "id", "z", 4, metric=metric)) == brute(rows, 4, metric)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_split_cells_give_exact_lists(spark, monkeypatch, metric):
    """Three pivots at most, so that their cells are split."""
    for name, value in (("CELL", 10), ("CROWDED", 1), ("MAX_PIVOTS", 3), ("BLOCK", 16), ("QUERIES", 8)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(7)
    rows = np.vstack([rng.normal(0, 1, (120, 3)).round(1), rng.normal(8, 0.2, (100, 3)).round(1), np.ones((30, 3))])
    assert lists(neighbours.knn_exact(points(spark, rows), "id", "z", 4, metric=metric)) == brute(rows, 4, metric)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_strips_give_exact_lists_without_routes(spark, monkeypatch, metric):
    """Where no cell can be ruled out, no query is copied to the cells."""
    monkeypatch.setattr(neighbours, "ROUTED", 0)
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "STRIP", 40 * 3 * 8)
    monkeypatch.setattr(neighbours, "TABLE", 200)

    def routed(*_):
        raise AssertionError("copied to cells")
    monkeypatch.setattr(neighbours, "_open_leaves", routed)
    rng = np.random.default_rng(11)
    rows = np.vstack([rng.normal(0, 1, (150, 3)).round(1), rng.normal(8, 0.2, (80, 3)).round(1), np.full((30, 3), 2.0)])
    assert lists(neighbours.knn_exact(points(spark, rows), "id", "z", 4, metric=metric)) == brute(
        rows / np.linalg.norm(rows, axis=1, keepdims=True) if metric == "cosine" else rows, 4, metric)


def test_strips_of_classes_and_codes(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = np.hstack([rng.normal(0, 1, (300, 2)).round(1), rng.integers(0, 30, (300, 2))])
    df = points(spark, rows).withColumn("g", F.col("id") % 3)
    find = lambda **more: sorted(map(tuple, neighbours.knn_exact(df, "id", "z", 3, **more).collect()))
    wanted = find(metric=neighbours.coded(2)), find(within="g")
    monkeypatch.setattr(neighbours, "ROUTED", 0)
    monkeypatch.setattr(neighbours, "STRIP", 50 * 4 * 8)
    assert (find(metric=neighbours.coded(2)), find(within="g")) == wanted


def test_tables_of_distances_stay_small(monkeypatch):
    """However many rows a batch holds, a task compares a bounded block with the pivots."""
    sizes, whole = [], neighbours.tile_distances
    monkeypatch.setattr(neighbours, "tile_distances", lambda a, b, m: (sizes.append(len(a) * len(b)), whole(a, b, m))[1])
    rows = np.random.default_rng(3).normal(0, 1, (4000, 2))
    cell, radius = neighbours._home(rows, rows[:1000], "euclidean")
    assert max(sizes) <= neighbours.TABLE < 4000 * 1000
    d = whole(rows, rows[:1000], "euclidean")
    assert (cell == d.argmin(axis=1)).all() and (radius == d.min(axis=1)).all()


def test_recall_in_split_cells(spark, monkeypatch):
    for name, value in (("CELL", 20), ("CROWDED", 1), ("MAX_PIVOTS", 4)):
        monkeypatch.setattr(neighbours, name, value)
    rows = points(spark, np.random.default_rng(2).normal(size=(400, 2)))
    near = neighbours.knn_approx(rows, "id", "z", 5, probes=3)
    assert neighbours.recall_at_k(near, neighbours.knn_exact(rows, "id", "z", 5)).first()["recall"] > 0.85


@pytest.mark.parametrize("most", [2048, 3])
def test_cross_join_in_cells(spark, monkeypatch, most):
    for name, value in (("CELL", 20), ("CROWDED", 1), ("MAX_PIVOTS", most)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(90, 2)).round(2), rng.normal(size=(150, 2)).round(2)
    found = {(r["src"], r["rank"]): r["dst"] for r in neighbours.knn_cross(points(spark, a), "id", points(spark, b), "id", "z", 2).collect()}
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)).round(9)
    for i in range(len(a)):
        order = np.lexsort((np.arange(len(b)), d[i]))[:2]
        assert [found[(i, 1)], found[(i, 2)]] == list(order)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=2, max_size=25), st.integers(1, 4))
def test_ties_and_copies_at_random(spark, rows, k):
    assert lists(neighbours.knn_exact(points(spark, rows), "id", "z", k)) == brute(rows, k)


def test_classes_stay_apart(spark):
    df = points(spark, [0, 1, 2, 3, 4, 9]).withColumn("c", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    found = lists(neighbours.knn_exact(df, "id", "z", 1, within="c"))
    assert found == {0: [2], 1: [3], 2: [0], 3: [1], 4: [2], 5: [3]}


def test_approximate_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 50)
    rows = points(spark, np.random.default_rng(1).normal(size=(400, 2)))
    exact = neighbours.knn_exact(rows, "id", "z", 5)
    near = neighbours.knn_approx(rows, "id", "z", 5, probes=3)
    assert neighbours.recall_at_k(near, exact).first()["recall"] > 0.9


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        neighbours.knn_exact(points(spark, [0, 1]), "id", "z", 0)
    with pytest.raises(ValueError):
        neighbours.knn_exact(points(spark, [0, 1]), "id", "z", 1, metric="other")


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_descent_finds_nearly_all(spark, metric):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(350, 12)), np.ones((30, 12)), 3 + rng.normal(size=(120, 12))]).round(3)
    table = points(spark, x)
    found = neighbours.knn_descent(table, "id", "z", 5, metric=metric)
    assert found.count() == 2500 and found.filter("src = dst").count() == 0
    recall = neighbours.recall_at_k(found, neighbours.knn_exact(table, "id", "z", 5, metric=metric)).first()
    assert recall["recall"] >= 0.95
    with pytest.raises(ValueError):
        neighbours.knn_descent(table, "id", "z", 5, metric="inner_product")


def test_descent_keeps_classes_apart_and_small_tables_exact(spark):
    rows = [[float(i % 9), float(i % 5)] for i in range(60)]
    table = points(spark, rows).withColumn("c", F.col("id") % 2)
    found = neighbours.knn_descent(table, "id", "z", 3, within="c").collect()
    assert len(found) == 180 and all(r["src"] % 2 == r["dst"] % 2 for r in found)
    assert lists(neighbours.knn_descent(points(spark, [0, 1, 10, 11]), "id", "z", 1)) == {0: [1], 1: [0], 2: [3], 3: [2]}
    assert lists(neighbours.knn_descent(points(spark, [[1.0]] * 6), "id", "z", 2)) == brute([[1.0]] * 6, 2)


def test_codes_stand_for_one_hot_blocks(spark):
    """A code a block gives the distances of the block written out; -1 is a row of zeros."""
    rng = np.random.default_rng(2)
    numbers, codes = rng.normal(size=(80, 2)).round(3), rng.integers(-1, 12, (80, 2))
    hot = np.hstack([numbers, *[np.vstack([np.zeros(12), np.eye(12)])[codes[:, j] + 1] for j in range(2)]])
    coded = neighbours.knn_exact(points(spark, np.hstack([numbers, codes])), "id", "z", 4, metric=neighbours.coded(2))
    assert lists(coded) == brute(hot, 4)


def test_strips_of_narrow_vectors_are_bounded_by_rows(spark):
    """Memory of a task: 64 MB of one-number vectors would be eight million rows."""
    for rows, width in ((10_000_000, 1), (10_000_000, 7), (5_000_000, 64)):
        strips = spark.range(1).select(neighbours._strips(F.lit(rows), width)).first()[0]
        assert rows / strips <= 1 << 18 and rows * width * 8 / strips <= neighbours.STRIP
    assert [spark.range(1).select(neighbours._strips(F.lit(n), 7)).first()[0] for n in (1, 5000, 900_000)] == [1, 5, 8]


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("line", [40, 10_000])
def test_one_coordinate_is_searched_along_the_line(spark, monkeypatch, metric, line):
    """Ties on both sides, copies beyond the length of a list, gaps at the cuts: the lists are the exact ones, and no row is searched in cells."""
    monkeypatch.setattr(neighbours, "LINE", line)
    monkeypatch.setattr(neighbours, "_search", lambda *a: pytest.fail("searched in cells"))
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.integers(0, 60, 300) / 4.0, rng.normal(size=300) * 5 + 20.0, np.full(30, 7.5), [1e4, -1e4, 0.0, -0.0, 0.5, 0.5 + 2e-10]])
    for k in (1, 5):
        assert lists(neighbours.knn_exact(points(spark, values), "id", "z", k, metric=metric)) == brute(values, k, "manhattan")


def test_odd_values_leave_the_line(spark):
    few = spark.createDataFrame([(i, [v]) for i, v in enumerate([1.0, 2.0, float("inf"), 4.5])], "id bigint, z array<double>")
    found = lists(neighbours.knn_exact(few.filter("id <> 2"), "id", "z", 5))
    assert found == {0: [1, 3], 1: [0, 3], 3: [1, 0]}
    assert neighbours._on_line(few.selectExpr("id AS dst", "z AS vec", "1 AS copy"), 2) is None
