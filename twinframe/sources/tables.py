"""Reading and writing tables by file name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted suffixes.
PARQUET = (".parquet", ".pq")
TEXT = (".csv", ".txt")
COMPRESSED = {".gz": "gzip", ".bz2": "bzip2", ".zst": "zstd"}
REFUSED = (".zip", ".xz")


def table_format(path: str) -> tuple[str, str | None]:
    """('parquet' | 'csv', codec or None) from the file name; an outer compression suffix is looked through."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    parts = ["." + p for p in name.split(".")[1:]]
    if not parts:
        raise ValueError(f"A file extension is required for {path}.")
    codec = None
    if len(parts) > 1 and parts[-1] in COMPRESSED:
        codec = COMPRESSED[parts.pop()]
    if parts[-1] in REFUSED:
        raise ValueError(f"{parts[-1]} files cannot be split or read by Spark: unpack {path} or use gz, bz2 or zst.")
    if parts[-1] in PARQUET:
        return "parquet", codec
    if parts[-1] in TEXT:
        return "csv", codec
    raise ValueError(f"Unsupported file extension for {path}. Use CSV or Parquet.")


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV (header, types inferred unless a schema is given) or Parquet."""
    kind, _ = table_format(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Write a folder of part files in the format the name asks for."""
    kind, codec = table_format(path)
    writer = df.write.mode(mode)
    if codec:
        writer = writer.option("compression", codec)
    if kind == "parquet":
        writer.parquet(path)
    else:
        writer.option("header", True).csv(path)
    return path


def read_delimited_dirty(spark: SparkSession, path: str, names: Sequence[str], *, sep: str = ",",
                         null_word: str = "?", skip_prefix: str | None = None, header: bool = False) -> DataFrame:
    """Headerless text with given names: leading blanks trimmed, ``null_word`` is null, preamble lines skipped."""
    schema = ", ".join(f"`{n}` string" for n in names)
    reader = (spark.read.schema(schema).option("sep", sep).option("header", header)
              .option("nullValue", null_word).option("ignoreLeadingWhiteSpace", True))
    if skip_prefix:
        reader = reader.option("comment", skip_prefix)
    return reader.csv(path)


def read_result_set(spark: SparkSession, pattern: str, *, columns: Sequence[str] = (),
                    labels: Mapping[str, str] | None = None, label_key: str = "method",
                    label_name: str = "label") -> DataFrame:
    """All result files that match a pattern as one table; absent columns are null; codes get a label."""
    kind, _ = table_format(pattern)
    df = spark.read.parquet(pattern) if kind == "parquet" else (
        spark.read.option("header", True).option("inferSchema", True).csv(pattern))
    return add_labels(with_columns_present(df, columns), labels, label_key, label_name)


def with_columns_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast("double") for c in columns if c not in df.columns})


def add_labels(df: DataFrame, labels: Mapping[str, str] | None, key: str, name: str) -> DataFrame:
    """Display label of a code; an unknown code keeps itself."""
    if not labels:
        return df
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return df.withColumn(name, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(key)), F.col(key)))


def with_reference_rows(results: DataFrame, reference: DataFrame, key: str, keep: Sequence[str]) -> DataFrame:
    """One result set plus chosen rows of another; columns missing on a side become null."""
    return results.unionByName(reference.filter(F.col(key).isin(*keep)), allowMissingColumns=True)
