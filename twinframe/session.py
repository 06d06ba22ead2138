"""Session and scratch-folder helpers."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from threading import Lock, local

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "twinframe") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(app)
             .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


PARALLEL_JOBS = 4  # independent Spark jobs submitted side by side


def side_by_side(tasks: Sequence[Callable], limit: int = PARALLEL_JOBS) -> list:
    """Results of independent pieces of driver code, whose Spark jobs then share the executors."""
    if len(tasks) < 2:
        return [task() for task in tasks]
    with ThreadPoolExecutor(min(limit, len(tasks))) as pool:
        return [future.result() for future in [pool.submit(task) for task in tasks]]


_shipped: set[str] = set()
_shipping = Lock()  # columns are fitted side by side


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, wherever the driver was started from."""
    context = spark.sparkContext
    with _shipping:
        if context.applicationId not in _shipped:
            root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
            archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="twinframe-"), "twinframe"), "zip", root, "twinframe")
            context.addPyFile(archive)
            _shipped.add(context.applicationId)


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys) -> DataFrame:
    """Keep the session's full shuffle width in front of Python work.

    Adaptive execution merges small shuffle partitions by bytes, which would leave heavy arithmetic over few
    bytes to a handful of tasks.
    """
    ship_package(df.sparkSession)
    return df.repartition(shuffle_width(df), *keys)


FOREST_PARTS = 8          # partitions of a small training table
FOREST_ROWS = 1 << 15     # rows of one partition of a larger one


def settle(df: DataFrame, *keys, rows: int | None = None) -> DataFrame:
    """One layout for one content: rows placed and sorted by key.

    The forest trainer draws its bags by partition number and position, so its input must not depend on how
    the source happened to be split. At each level every partition sends a histogram of every open node, however few
    rows it has, so for ``rows`` training rows there are no more partitions than these rows are worth.
    """
    width = shuffle_width(df)
    if rows is not None:
        width = min(width, max(FOREST_PARTS, -(-rows // FOREST_ROWS)))
    ship_package(df.sparkSession)
    return df.repartition(width, *keys).sortWithinPartitions(*keys)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage into the checkpoint folder the cluster names; survives lost executors.

    Only a session that names no folder (tests, one machine) gets one of its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("Set spark.checkpoint.dir to a shared folder.")
            folder = tempfile.mkdtemp(prefix="twinframe-")
        context.setCheckpointDir(folder)
    out = df.checkpoint(eager=True)
    if getattr(_made, "here", None) is not None:
        _made.here.append(out)
    return out


_made = local()  # checkpoints of a thread inside ``scratch``


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Delete the checkpoints that this thread makes inside when it ends; those taken out of the list stay.

    For steps that are repeated: what each of them wrote would else lie on disk until the application ends.
    """
    outer, made = getattr(_made, "here", None), []
    _made.here = made
    try:
        yield made
    finally:
        _made.here = outer
        discard(*made)
        context = made[0].sparkSession.sparkContext if made else None
        made.clear()
        if context is not None:  # a shuffle's files are deleted when a collection in the driver finds that no plan refers to them
            gc.collect()
            context._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete the files of the checkpoints that these tables are read from; nobody may read them any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        leaves = df._jdf.queryExecution().logical().collectLeaves()
        for leaf in (leaves.apply(i) for i in range(leaves.size())):
            file = leaf.rdd().getCheckpointFile() if leaf.getClass().getSimpleName() == "LogicalRDD" else None
            if file is not None and file.isDefined():
                path = context._jvm.org.apache.hadoop.fs.Path(file.get())
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
