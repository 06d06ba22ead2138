"""File in, fitted model, generated rows out: the body of a spark-submit job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.plans.model import Params, TableModel, fit
from twinframe.sources.tables import read_table, write_table


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A stable id where the input has none: a digest of the row plus its place among equal rows.

    Equal rows are counted and written out again from the count with 1, 2, 3, ..., so ids do not depend on how the
    input was split.
    """
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in df.columns]), 256)
    counted = df.select(digest.alias("_d"), F.struct(*df.columns).alias("_row")).groupBy("_d").agg(
        F.first("_row").alias("_row"), F.count(F.lit(1)).alias("_n"))
    copies = counted.withColumn("_p", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return copies.select("_row.*", F.concat_ws("-", "_d", "_p").alias(name))


def generate_to_sink(model: TableModel, path: str, n: int | None = None, mode: str = "errorifexists") -> str:
    return write_table(model.generate(n).drop("row"), path, mode)


def fit_generate_job(spark: SparkSession, *, source: str | None = None, model_in: str | None = None,
                     model_out: str | None = None, sink: str | None = None, n: int = 0, row_id: str | None = None,
                     params: Params | None = None, mode: str = "errorifexists") -> TableModel:
    """Fit a file or load a model, optionally save the model, optionally write n rows (0: as many as were read)."""
    if (source is None) == (model_in is None):
        raise ValueError("Give either an input table or a fitted model.")
    if n < 0:
        raise ValueError("n must not be negative.")
    if model_in is not None:
        if n == 0 and sink is not None:
            raise ValueError("A model alone has no input rows to count: give n.")
        model = TableModel.load(spark, model_in)
    else:
        table = read_table(spark, source)
        if row_id is None:
            from twinframe.session import checkpoint
            table, row_id = checkpoint(with_row_id(table)), "row_id"
        model = fit(table, row_id, params=params)
    if model_out is not None:
        model.save(model_out)
    if sink is not None:
        generate_to_sink(model, sink, n or None, mode)
    return model
