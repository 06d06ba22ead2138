from pyspark.ml import Pipeline, PipelineModel

from twinframe.plans.estimator import TableSampler, TableSamplerModel
from twinframe.plans.model import Params, fit

ROWS = [(i, float(i % 7), "ab"[i % 2]) for i in range(24)]
QUICK = dict(n_components=1, n_iterations=0, n_neighbours=3, trees=2, depth=3, factor=0.5)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_parameters():
    stage = TableSampler(idCol="id", **QUICK)
    assert stage.settings() == Params(**QUICK) and stage.getOrDefault("seed") == 42
    assert stage.set("n_neighbours", 5).getOrDefault(stage.n_neighbours) == 5
    other = stage.copy({stage.seed: 7})
    assert other.settings().seed == 7 and stage.settings().seed == 42


def test_pipeline_stage(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id bigint, x double, c string")
    fitted = Pipeline(stages=[TableSampler(idCol="id", outputCol="latent", **QUICK)]).fit(df)
    want = fit(df, "id", params=Params(**QUICK))
    assert rows(fitted.transform(df).select("id", "latent")) == rows(want.transform(df).select("id", "z"))
    assert rows(fitted.stages[0].generate(10)) == rows(want.generate(10))
    fitted.write().overwrite().save(str(tmp_path / "pipeline"))
    again = PipelineModel.load(str(tmp_path / "pipeline"))
    assert isinstance(again.stages[0], TableSamplerModel) and again.stages[0].getOrDefault("n_neighbours") == 3
    assert rows(again.transform(df).select("id", "latent")) == rows(want.transform(df).select("id", "z"))
    TableSampler(idCol="id", columns=["x"], **QUICK).write().overwrite().save(str(tmp_path / "stage"))
    assert TableSampler.load(str(tmp_path / "stage")).fit(df).table.encoding.columns == ["x"]
