"""Global order without a one-task window: dense numbering and prefix sums.

Both split the order into buckets or ranges, total these (a small table), turn the totals into offsets and
finish inside each.  No step sees more of a group in one task than one bucket or range of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinframe.session import checkpoint

HASH_DIGITS = 4          # 65,536 buckets for dense numbering: 1.5 million rows each at 10^11 rows
RANGE_ROWS = 200_000     # rows aimed at per range of a value order


def hash_bucket(key: Column, digits: int = HASH_DIGITS) -> Column:
    return F.substring(F.md5(key.cast("string")), 1, digits)


def dense_index(df: DataFrame, key: str, *, within: Sequence[str] = (), name: str = "idx") -> DataFrame:
    """Number rows 0, 1, 2, ... in the order (md5 of the key's text, key), inside each ``within`` group.

    ``key`` must be unique inside a group.  Null groups count as a group.
    """
    within = list(within)
    marked = df.withColumn("_hash", F.md5(F.col(key).cast("string"))).withColumn("_bucket", F.substring("_hash", 1, HASH_DIGITS))
    totals = marked.groupBy(*within, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_o_{c}") for c in within], F.col("_bucket").alias("_o_bucket"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    match = F.col("_bucket") == F.col("_o_bucket")
    for c in within:
        match = match & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    inside = Window.partitionBy(*within, "_bucket").orderBy("_hash", key)
    numbered = marked.withColumn("_pos", F.row_number().over(inside) - 1)
    return (numbered.join(offsets, match)
            .withColumn(name, (F.col("_pos") + F.col("_offset")).cast("bigint"))
            .drop("_hash", "_bucket", "_pos", "_offset", "_o_bucket", *[f"_o_{c}" for c in within]))


def smallest(df: DataFrame, u: str, key: str, n: int) -> DataFrame:
    """The n rows that come first by (u, key), for u spread evenly over [0, 1): whole cells of u, and a rank inside the last one."""
    cell = F.least(F.floor(F.col(u) * F.lit(float(16 ** HASH_DIGITS))), F.lit(16 ** HASH_DIGITS - 1)).cast("int")
    marked = df.withColumn("_cell", cell)
    taken, edge = 0, -1
    for r in sorted(marked.groupBy("_cell").count().collect()):  # one number a cell
        edge = r["_cell"]
        if taken + r["count"] > n:
            break
        taken += r["count"]
    else:
        return df
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy(u, key))
    last = marked.filter(F.col("_cell") == edge).withColumn("_rank", rank).filter(F.col("_rank") <= n - taken).drop("_rank")
    return marked.filter(F.col("_cell") < edge).unionByName(last).drop("_cell")


def prefix_sums(counts: DataFrame, group: Sequence[str], value: str, sums: Sequence[str], *,
                ranges: int | None = None) -> DataFrame:
    """Running totals of ``sums`` by ascending ``value`` inside ``group``.

    ``counts`` holds one row per (group, value), values not null.  Adds ``cum_<s>`` for each sum and
    ``next_value``, the following value in the group (null for the last).  The order over (group, value) is cut
    into ranges of about RANGE_ROWS rows, as many as the number of rows asks for; a group may lie in many of them.
    The result does not depend on the cuts.
    """
    group = list(group)
    if ranges is None:
        counts = checkpoint(counts)
        ranges = -(-counts.count() // RANGE_ROWS)
    sized = counts
    if ranges > 1:  # written, so that a range means the same rows to all that follows
        sized = checkpoint(counts.repartitionByRange(ranges, *group, value).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*group, *(["_part"] if ranges > 1 else [])).orderBy(value)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if ranges <= 1:
        return sized.select("*", *[F.sum(s).over(running).alias(f"cum_{s}") for s in sums], F.lead(value).over(inside).alias("next_value"))
    totals = sized.groupBy(*group, "_part").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums], F.min(value).alias("_first"))
    order = Window.partitionBy(*group).orderBy("_part")  # at most one row a range
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group, "_part",
        *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_off_{s}") for s in sums],
        F.lead("_first").over(order).alias("_next_first"))
    local = sized.select("*", *[F.sum(s).over(running).alias(f"_cum_{s}") for s in sums], F.lead(value).over(inside).alias("_next"))
    return local.join(offsets, [*group, "_part"]).select(
        *counts.columns,
        *[(F.col(f"_cum_{s}") + F.col(f"_off_{s}")).alias(f"cum_{s}") for s in sums],
        F.coalesce("_next", "_next_first").alias("next_value"))


def quantiles(long: DataFrame, group: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """Exact quantiles, linear between neighbours: (group..., probability, quantile).

    Order statistics are read off prefix sums, so a column of any size stays spread out.
    """
    group = list(group)
    counts = long.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*group).agg(F.sum("n").alias("_total"))
    rows = prefix_sums(counts, group, value, ["n"]).join(totals, group)
    spot = lambda p: F.floor((F.col("_total") - 1) * p)
    hit = F.filter(F.array(*[F.lit(float(p)) for p in probabilities]),
                   lambda p: (spot(p) >= F.col("cum_n") - F.col("n")) & (spot(p) < F.col("cum_n")))
    found = rows.withColumn("probability", F.explode(hit))
    p = F.col("probability")
    part = (F.col("_total") - 1) * p - spot(p)
    upper = F.when(spot(p) + 1 < F.col("cum_n"), F.col(value)).otherwise(F.coalesce("next_value", value))
    return found.select(*group, "probability", (F.col(value) + (upper - F.col(value)) * part).alias("quantile"))
