"""The fitted model as a pipeline stage: an Estimator with a parameter for each setting, and its Model."""

from __future__ import annotations

from dataclasses import MISSING, fields

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param
from pyspark.ml.param import Params as StageParams
from pyspark.ml.param import TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

from twinframe.plans.model import Params, TableModel, fit

SETTINGS = [f.name for f in fields(Params)]


class TableSamplerParams(StageParams):
    """idCol, columns and outputCol, and each setting of a fitted model under its own name."""

    idCol = Param(StageParams._dummy(), "idCol", "column that names a row", TypeConverters.toString)
    columns = Param(StageParams._dummy(), "columns", "columns to learn; all but idCol when not set", TypeConverters.toListString)
    outputCol = Param(StageParams._dummy(), "outputCol", "column for the latent vector", TypeConverters.toString)

    def settings(self) -> Params:
        """The settings as the library takes them, checked."""
        return Params(**{name: self.getOrDefault(name) for name in SETTINGS}).check()


for _field in fields(Params):
    setattr(TableSamplerParams, _field.name, Param(StageParams._dummy(), _field.name, f"setting {_field.name} of the fitted model"))

DEFAULTS = {f.name: f.default for f in fields(Params) if f.default is not MISSING}


class TableSampler(Estimator, TableSamplerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a mixed-type table; settings are those of Params: TableSampler(idCol="id", n_neighbours=5)."""

    def __init__(self, **values):
        super().__init__()
        self._setDefault(outputCol="z", **DEFAULTS)
        self._set(**values)

    def set(self, param, value=None, **values) -> "TableSampler":
        """Set one parameter, by its name too."""
        self._set(**{param if isinstance(param, str) else param.name: value}, **values)
        return self

    def _fit(self, dataset: DataFrame) -> "TableSamplerModel":
        columns = list(self.getOrDefault("columns")) if self.isDefined("columns") else None
        table = fit(dataset, self.getOrDefault("idCol"), columns=columns, params=self.settings())
        return self._copyValues(TableSamplerModel(table))


class _Writer(MLWriter):
    def __init__(self, instance: "TableSamplerModel"):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.table.save(f"{path}/table")


class _Reader(MLReader):
    def load(self, path: str) -> "TableSamplerModel":
        spark = SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = TableSamplerModel(TableModel.load(spark, f"{path}/table"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class TableSamplerModel(Model, TableSamplerParams, MLReadable, MLWritable):
    """A fitted table: ``transform`` adds the latent vector, ``generate`` makes new rows; ``table`` has all else."""

    def __init__(self, table: TableModel | None = None):
        super().__init__()
        self._setDefault(outputCol="z", **DEFAULTS)
        self.table = table

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.table.transform(dataset, self.getOrDefault("outputCol"))

    def inverseTransform(self, latent: DataFrame, sample: bool = True) -> DataFrame:
        return self.table.inverse_transform(latent, sample=sample)

    def generate(self, n: int | None = None) -> DataFrame:
        return self.table.generate(n)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()
