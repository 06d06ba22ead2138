"""The registered sweeps ask for their whole work."""

import pytest

import __spark_entry__ as entry_point
from twinframe.operators.decode import MAX_DEPTH
from twinframe.plans import sweeps
from twinframe.plans.model import Params

CUSTOMERS = [(i, float(37 * i % 9000), i % 25, "AB"[i % 2]) for i in range(60)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(CUSTOMERS, "c_custkey bigint, c_acctbal double, c_nationkey int, c_mktsegment string").write.parquet(f"{at}/customer.parquet")
    return at


@pytest.fixture
def asked(monkeypatch):
    """(setup, params, other settings) of every run, none of which is made."""
    found = []

    def run(df, row_id, params, *, dataset, target, parameter, value, setup, n=None, seed=42, **settings):
        found.append((setup, params, dict(settings, n=n, rows=df.count())))
        return sweeps.report_row(df.sparkSession, sweeps.RUN, {"dataset": dataset, "parameter": parameter, "value": str(value), "setup": setup})
    monkeypatch.setattr(sweeps, "run_setting", run)
    return found


def published(found):
    return all((p.trees, p.depth) == (Params().trees, MAX_DEPTH) and more == {"n": None, "rows": len(CUSTOMERS)} for _, p, more in found)


def test_setup_report_runs_all_setups(spark, folder, asked):
    out = entry_point.queries()["setup_report"](spark, folder)
    names = [*sweeps.SETUPS, *(f"{p}={v}" for p, values in sweeps.VARIANTS.items() for v in values)]
    assert sorted(r["setup"] for r in out.collect()) == sorted(names) and len(names) == 9
    assert sorted(s for s, _, _ in asked) == sorted(names) and published(asked)
    accurate = next(p for s, p, _ in asked if s == "accurate")
    assert (accurate.n_iterations, accurate.retries, accurate.calibrate) == (2, 20, True)


def test_parameter_grid_report_runs_the_whole_grid(spark, folder, asked):
    out = entry_point.queries()["parameter_grid_report"](spark, folder)
    want = sorted(f"{p}={v}" for p, values in sweeps.GRID.items() for v in values)
    assert sorted(r["setup"] for r in out.collect()) == want and len(want) == 29
    assert sorted(s for s, _, _ in asked) == want and published(asked)


def test_full_experiment_asks_for_everything(spark, folder, monkeypatch):
    """Each report is asked for once, on all rows, with all setups, variants, methods and seeds and published forests."""
    from twinframe.plans import evaluate, experiment, reports
    asked = {}

    def note(name):
        def report(*tables, **given):
            asked[name] = dict(given, rows=tables[0].count() if hasattr(tables[0], "count") else None)
            return spark.range(1)
        return report
    monkeypatch.setattr(experiment, "starter_run", lambda df, config: (df, df, df))
    monkeypatch.setattr(experiment, "fit", lambda df, row_id, params: params)
    monkeypatch.setattr(evaluate, "method_comparison", note("comparison"))
    for name, part in (("mechanism_report", reports), ("decoder_calibration_report", reports), ("manifold_report", reports), ("imbalance_report", reports),
                       ("setup_report", sweeps), ("repeated_seed_report", sweeps)):
        monkeypatch.setattr(part, name, note(name))
    out = {r["report"]: r["rows"] for r in entry_point.queries()["full_experiment"](spark, folder).collect()}
    assert sorted(out) == ["calibration", "comparison", "generated", "imbalance", "manifold", "mechanism", "profile", "runtime", "sensitivity", "similarity",
                           "uncertainty"]
    assert asked["setup_report"]["setups"] == sweeps.SETUPS and asked["setup_report"]["variants"] == sweeps.VARIANTS
    assert asked["repeated_seed_report"]["seeds"] == (42, 43, 44)
    assert asked["comparison"]["methods"] is None and asked["repeated_seed_report"]["methods"] is None
    for name in ("comparison", "setup_report", "repeated_seed_report", "imbalance_report"):
        given = asked[name]
        p = given.get("params") or given["base"]
        assert given["rows"] == len(CUSTOMERS) and (p.trees, p.depth) == (Params().trees, MAX_DEPTH) and not {"trees", "depth"} & set(given)
    assert all(given.get("n") is None and "learned" not in given for given in asked.values())
