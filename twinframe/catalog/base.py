"""Registry of runnable queries and their SQL twins, with the helpers both sides share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.session import checkpoint

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame under a name, with its SQL twin when there is one."""
    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(fn(Tables(spark, folder)))
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


class Tables:
    """The driver's tables by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def scratch(self) -> str:
        """A new folder below the cluster's shared checkpoint folder; a local one only where none is named."""
        base = (self.spark.conf.get("spark.checkpoint.dir", None)
                or self.spark.sparkContext.getConf().get("spark.checkpoint.dir"))
        if not base:
            if not self.spark.sparkContext.master.startswith("local"):
                raise RuntimeError("Set spark.checkpoint.dir to a shared folder.")
            base = tempfile.mkdtemp(prefix="twinframe-")
        return f"{base}/{uuid.uuid4().hex}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, negative zero removed, whole numbers to one width."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append((F.round(F.col(f.name).cast("double"), digits) + F.lit(0.0)).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# ---- SQL side

def r(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"


def u(seed: int, stream: str, *keys: str) -> str:
    text = ", ".join([f"'{seed}'", f"'{stream}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {text})), 1, 13)) AS BIGINT) / pow(2, 52))"


def uidx(size: str, seed: int, stream: str, *keys: str) -> str:
    return f"CAST(floor({u(seed, stream, *keys)} * ({size})) AS BIGINT)"


def dense(key: str, within: str = "") -> str:
    part = f"PARTITION BY {within} " if within else ""
    return f"(row_number() OVER ({part}ORDER BY md5(CAST({key} AS VARCHAR)), {key}) - 1)"


def long_sql(source: str, columns: list[str], carry: str = "side", cast: str = "DOUBLE", value: str = "v") -> str:
    lead = f"{carry}, " if carry else ""
    return " UNION ALL ".join(
        f"SELECT {lead}'{c}' AS col, CAST({c} AS {cast}) AS {value} FROM {source}" for c in columns)


def quantile_sql(expr: str, q: float) -> str:
    return f"quantile_cont({expr}, {q})"
