"""Time the headline queries: one JSON line with seconds per query.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores, BENCH_QUERIES an optional comma list.
BENCH_PUBLISHED=1 adds fit and sample at the published settings, which take minutes.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from twinframe.catalog import load
from twinframe.operators.samplers import fixed_size_sample
from twinframe.plans.model import Params, fit
from twinframe.session import checkpoint, local_session

HEADLINE = ["table_profile", "column_summary", "standardise", "quantile_bounds", "numeric_similarity", "categorical_similarity",
            "association_matrix", "distribution_score", "spearman_abs", "roc_auc", "train_test_split", "bootstrap_rows",
            "stratified_columns", "gaussian_copula", "knn_exact", "knn_exact_embeddings", "knn_approx", "mutual_neighbours",
            "nn_distance_test", "transport_candidates", "quantile_guard_retry", "generate_rows"]


def published(spark, folder: str) -> dict[str, float]:
    """Fit and sample at the published settings: 2,500 rows, 8 categorical and 4 numeric columns, 100 trees of full depth, 1,000 rows drawn."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    lines = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(
        read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
    names = ["l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority", "c_mktsegment", "p_type", "p_brand"]
    table = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), *names, F.concat(F.lit("n"), "c_nationkey").alias("nation"),
                         "l_quantity", "l_extendedprice", "l_discount", "c_acctbal")
    rows = checkpoint(fixed_size_sample(table.dropDuplicates(["id"]), "id", 2500))
    start = time.time()
    model = fit(rows, "id", params=Params())
    middle = time.time()
    model.generate(1000).write.format("noop").mode("overwrite").save()
    return {"published_fit": round(middle - start, 3), "published_sample": round(time.time() - middle, 3)}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cores, "twinframe-bench")
    queries, _ = load()
    spark.read.parquet(f"{folder}/customer.parquet").groupBy("c_mktsegment").count().collect()
    seconds = {}
    for name in names:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    if os.environ.get("BENCH_PUBLISHED"):
        seconds |= published(spark, folder)
        print({k: v for k, v in seconds.items() if k.startswith("published")}, file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
