"""Registry and helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinframe.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BATCH_BYTES = 16 << 20  # of one Arrow batch sent to Python
RANGES = 4  # of a global order, for each shuffle partition


def query(name: str, sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame, with its SQL twin when there is one."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder the cluster shares; a local one only where a local session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a shared folder.")
        base = tempfile.mkdtemp(prefix="twinframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and any executor may be lost after."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def python_ready(spark: SparkSession) -> None:
    """Before Python work: this package on the workers, and Arrow batches bounded by bytes as well as by rows."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_size(texts: Iterable[str], limit: int = 1 << 21, each: int = 64) -> Iterator[list[str]]:
    """Lists of consecutive texts of about limit characters, where a text counts each more; one text is never cut."""
    block, size = [], 0
    for text in texts:
        block.append(text)
        size += len(text) + each
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def crc_of_id(column: str):
    """CRC-32 of an id written as text; the folds of the learned operators."""
    return F.crc32(F.col(column).cast("string"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name with as many underscores behind it as no column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with running totals of whole numbers in one order over all rows, each row's own number included.

    Rows are numbered and written, then cut into ranges of the order; a range's total (one row a range) moves the totals of the ranges
    behind it. Rows that tie follow in the order they were written in, so a group of ties of any size is cut like all else.
    """
    tie, part, first = fresh(df, "tie", "part", "first")
    made = fresh(df, *[f"total_{name}" for name in sums])
    numbered = keep(df.withColumn(tie, F.monotonically_increasing_id()))
    ranged = keep(numbered.repartitionByRange(RANGES * width(df.sparkSession), *order, F.col(tie)).withColumn(part, F.spark_partition_id()))
    whole = ranged.groupBy(part).agg(*[F.sum(value).alias(m) for m, value in zip(made, sums.values())])
    earlier = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # over one row a range
    offsets = whole.select(F.col(part).alias(first), *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(m) for m in made])
    inside = W.partitionBy(part).orderBy(*order, F.col(tie)).rowsBetween(W.unboundedPreceding, W.currentRow)
    here = ranged.select("*", *[F.sum(value).over(inside).alias(name) for name, value in sums.items()])
    return (here.join(F.broadcast(offsets), F.col(part) == F.col(first))
            .select(*df.columns, *[(F.col(name) + F.col(m)).cast("bigint").alias(name) for name, m in zip(sums, made)]))
