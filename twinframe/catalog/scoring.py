"""Prediction scores, rankings and result summaries, on scores derived from whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinframe.catalog.base import Tables, query, r, u
from twinframe.functions import rng, scalars
from twinframe.operators import clean, ranking, samplers, scores
from twinframe.operators.measures import two_column_summary
from twinframe.sources import tables as src

# ---------------------------------------------------------------- prediction scores
# Orders with made-up probabilities: truth is the order status, a class score is a seeded uniform of the key.

CLASSES = ["F", "O", "P"]
_RAW = [u(7, f"score.{c}", "o_orderkey") for c in CLASSES]
S = f"""raw AS (SELECT o_orderkey, o_orderstatus AS truth, {', '.join(f"{x} + CASE WHEN o_orderstatus = '{c}' THEN 0.5::DOUBLE ELSE 0 END AS w{c}" for x, c in zip(_RAW, CLASSES))} FROM orders),
    s AS (SELECT *, wF / (wF + wO + wP) AS pF, wO / (wF + wO + wP) AS pO, wP / (wF + wO + wP) AS pP, greatest(wF, wO, wP) / (wF + wO + wP) AS conf,
    CASE WHEN wF >= wO AND wF >= wP THEN 'F' WHEN wO >= wP THEN 'O' ELSE 'P' END AS pred, CAST(truth = 'F' AS INT) AS y FROM raw)"""
PER = f"""WITH {S}, k AS (SELECT c, (SELECT count(*) FROM s WHERE truth = c) AS support, (SELECT count(*) FROM s WHERE pred = c) AS predicted, (SELECT count(*) FROM s WHERE truth = c AND pred = c) AS hits
    FROM (SELECT truth AS c FROM s UNION SELECT pred FROM s)), pc AS (SELECT *, hits * 1.0::DOUBLE / support AS recall, 2.0::DOUBLE * hits / (support + predicted) AS f1 FROM k)"""


def scored(t: Tables):
    """(truth, y, pred, probabilities, score)."""
    raw = F.array(*[rng.uniform(7, f"score.{c}", "o_orderkey") + F.when(F.col("o_orderstatus") == c, 0.5).otherwise(0.0) for c in CLASSES])
    table = scores.normalise_probabilities(t.orders.select("o_orderkey", F.col("o_orderstatus").alias("truth"), raw.alias("raw")), "raw")
    return table.withColumn("pred", scores.top_class(F.col("probabilities"), CLASSES)).withColumn(
        "y", (F.col("truth") == "F").cast("int")).withColumn("score", F.col("probabilities")[0])


@query("accuracy", f"WITH {S} SELECT {r('avg(CAST(truth = pred AS INT))')} AS accuracy FROM s")
def _(t: Tables):
    return scores.accuracy(scored(t), "truth", "pred")


@query("balanced_accuracy", f"{PER} SELECT {r('avg(recall)')} AS balanced_accuracy FROM pc")
def _(t: Tables):
    return scores.balanced_accuracy(scored(t), "truth", "pred")


@query("f1_weighted", f"{PER} SELECT {r('sum(f1 * support) / sum(support)')} AS f1_weighted FROM pc")
def _(t: Tables):
    return scores.f1_weighted(scored(t), "truth", "pred")


@query("f1_macro", f"{PER} SELECT {r('avg(f1)')} AS f1_macro FROM pc")
def _(t: Tables):
    return scores.f1_macro(scored(t), "truth", "pred")


@query("class_recall", f"{PER} SELECT {r('recall')} AS recall FROM pc WHERE c = 'P'")
def _(t: Tables):
    return scores.class_recall(scored(t), "truth", "pred", "P")


_AUC = "(SELECT (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0) * 1.0::DOUBLE) FROM (SELECT y, rank() OVER (ORDER BY pF) + (count(*) OVER (PARTITION BY pF) - 1) / 2.0::DOUBLE AS rk FROM s))"


@query("roc_auc", f"WITH {S} SELECT {r(_AUC)} AS roc_auc")
def _(t: Tables):
    return scores.roc_auc(scored(t), "y", "score")


@query("average_precision", f"""WITH {S}, g AS (SELECT pF, sum(y) AS pos, count(*) AS n FROM s GROUP BY 1), c AS (SELECT pos, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (ORDER BY pF DESC))
    SELECT {r('sum(pos * (cp * 1.0::DOUBLE / cn)) / sum(pos)')} AS average_precision FROM c""")
def _(t: Tables):
    return scores.average_precision(scored(t), "y", "score")


@query("brier_binary", f"WITH {S} SELECT {r('avg(pow(pF - y, 2))')} AS brier FROM s")
def _(t: Tables):
    return scores.brier_binary(scored(t), "y", "score")


@query("classification_scores", f"""{PER}, b AS (SELECT truth = 'F' AS t, CAST(pF >= 0.5 AS INT) AS p, y, pF FROM s),
    f AS (SELECT sum(f1 * n) / sum(n) AS v FROM (SELECT y, count(*) AS n, 2.0::DOUBLE * count(*) FILTER (p = y) / (count(*) + (SELECT count(*) FROM b x WHERE x.p = b.y)) AS f1 FROM b GROUP BY y))
    SELECT 'accuracy' AS score, {r('avg(CAST(p = y AS INT))')} AS value FROM b UNION ALL SELECT 'f1_weighted', {r('v')} FROM f
    UNION ALL SELECT 'roc_auc', {r(_AUC)} UNION ALL SELECT 'brier', {r('avg(pow(pF - y, 2))')} FROM s""")
def _(t: Tables):
    table = scored(t).withColumn("p", (F.col("score") >= 0.5).cast("int"))
    return scores.classification_scores(table, "y", "p", "score")


_HOT = [("pF", "F"), ("pO", "O"), ("pP", "P")]


@query("brier_multiclass", f"WITH {S} SELECT {r('avg(' + ' + '.join(f'''pow({p} - CAST(truth = '{c}' AS INT), 2)''' for p, c in _HOT) + ')')} AS brier_score FROM s")
def _(t: Tables):
    return scores.brier_multiclass(scored(t), "truth", "probabilities", CLASSES)


_LOG = "avg(-ln(least(greatest(CASE truth WHEN 'F' THEN pF WHEN 'O' THEN 1e-15 ELSE pP END, 1e-15), 1.0)))"


@query("log_loss", f"WITH {S} SELECT {r(_LOG)} AS negative_log_loss FROM s")
def _(t: Tables):
    table = scored(t).withColumn("two", F.array(F.col("probabilities")[0], F.col("probabilities")[2]))
    return scores.log_loss(table, "truth", "two", ["F", "P"])


@query("top_confidence", f"WITH {S} SELECT {r('avg(conf)')} AS mean_top_confidence FROM s")
def _(t: Tables):
    return scores.top_confidence(scored(t), "probabilities")


@query("confidence_gap", f"WITH {S} SELECT {r('avg(conf) - avg(CAST(truth = pred AS INT))')} AS confidence_gap FROM s")
def _(t: Tables):
    return scores.confidence_gap(scored(t), "truth", "probabilities", CLASSES)


@query("normalise_probabilities", f"WITH {S} SELECT o_orderkey, {r('pF')} AS f, {r('pO')} AS o, {r('pP')} AS p FROM s")
def _(t: Tables):
    p = F.col("probabilities")
    return scored(t).select("o_orderkey", p[0].alias("f"), p[1].alias("o"), p[2].alias("p"))


_ECE = """(SELECT sum(n * abs(acc - cf)) / sum(n) FROM (SELECT least(floor(conf * 10.0::DOUBLE), 9) AS b, count(*) AS n, avg(conf) AS cf, avg(CAST(truth = pred AS INT)) AS acc FROM s GROUP BY 1))"""


@query("expected_calibration_error", f"WITH {S} SELECT {r(_ECE)} AS expected_calibration_error")
def _(t: Tables):
    table = scored(t).select(F.array_max("probabilities").alias("conf"), (F.col("truth") == F.col("pred")).alias("hit"))
    return scores.expected_calibration_error(table, "conf", "hit")


@query("calibration_scores", f"""WITH {S} SELECT count(*) AS n_test, {r('avg(CAST(truth = pred AS INT))')} AS accuracy, {r('avg(conf)')} AS mean_top_confidence,
    {r(_LOG.replace("WHEN 'O' THEN 1e-15", "WHEN 'O' THEN pO"))} AS negative_log_loss, {r('avg(' + ' + '.join(f'''pow({p} - CAST(truth = '{c}' AS INT), 2)''' for p, c in _HOT) + ')')} AS brier_score,
    {r(_ECE)} AS expected_calibration_error, {r('avg(conf) - avg(CAST(truth = pred AS INT))')} AS confidence_gap FROM s""")
def _(t: Tables):
    return scores.calibration_scores(scored(t), "truth", "raw", CLASSES)


@query("regression_scores", f"""WITH p AS (SELECT l_extendedprice AS y, l_quantity * (SELECT sum(l_extendedprice) / sum(l_quantity) FROM lineitem) AS p FROM lineitem)
    SELECT {r('avg(abs(y - p))')} AS mae, {r('sqrt(avg(pow(y - p, 2)))')} AS rmse, {r('1 - avg(pow(y - p, 2)) / var_pop(y)')} AS r2 FROM p""")
def _(t: Tables):
    unit = t.lineitem.agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("u")).first()["u"]
    return scores.regression_scores(t.lineitem.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.lit(unit)).alias("p")), "y", "p")


@query("majority_baseline", f"""WITH m AS (SELECT l_returnflag AS f FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT {r('avg(CAST(l_returnflag = f AS INT))')} AS majority_accuracy FROM lineitem, m WHERE l_linestatus = 'O'""")
def _(t: Tables):
    return scores.majority_baseline(t.lineitem.filter("l_linestatus = 'F'"), t.lineitem.filter("l_linestatus = 'O'"), "l_returnflag")


@query("minority_majority", """WITH c AS (SELECT l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT (SELECT f FROM c ORDER BY n, f LIMIT 1) AS minority, (SELECT f FROM c ORDER BY n DESC, f LIMIT 1) AS majority, (SELECT min(n) FROM c) AS minority_n, (SELECT max(n) FROM c) AS majority_n""")
def _(t: Tables):
    return scores.minority_majority(t.lineitem, "l_returnflag")


@query("minority_rate", f"SELECT {r('avg(toxic)')} AS minority_rate FROM labels")
def _(t: Tables):
    return scores.minority_rate(t.labels, "toxic", 1)


@query("prediction_task", " UNION ALL ".join(
    f"SELECT '{c}' AS target, CASE WHEN count(DISTINCT {c}) <= greatest(20, CAST(floor(count(*) * 0.05) AS BIGINT)) {'OR true' if text else ''} THEN 'classification' ELSE 'regression' END AS task, "
    f"count(DISTINCT {c}) AS \"distinct\", 0::BIGINT AS missing, count(*) AS rows FROM {tb}" for tb, c, text in (
        ("lineitem", "l_extendedprice", False), ("lineitem", "l_linenumber", False), ("customer", "c_name", True))))
def _(t: Tables):
    return scores.prediction_task(t.lineitem, "l_extendedprice").unionByName(scores.prediction_task(t.lineitem, "l_linenumber")).unionByName(
        scores.prediction_task(t.customer, "c_name"))


@query("target_choice", """SELECT 'l_linenumber' AS target, 'classification' AS task, true AS available, count(DISTINCT l_linenumber) AS "distinct", 0::BIGINT AS missing FROM lineitem
    UNION ALL SELECT 'absent', 'unavailable', false, 0, 0""")
def _(t: Tables):
    return scores.target_choice(t.lineitem, "l_linenumber").unionByName(scores.target_choice(t.lineitem, "absent"))


@query("score_lift", f"""{PER} SELECT {r("(SELECT avg(CAST(truth = pred AS INT)) FROM s) - (SELECT max(n) * 1.0 / sum(n) FROM (SELECT count(*) AS n FROM s GROUP BY truth))")} AS lift""")
def _(t: Tables):
    table = scored(t)
    major = scores.majority_baseline(table, table, "truth").first()[0]
    return scores.accuracy(table, "truth", "pred").select((F.col("accuracy") - F.lit(major)).alias("lift"))


@query("utility_table", f"""WITH p AS (SELECT l_linestatus AS evaluation, l_extendedprice AS y, l_quantity * 1500.0 AS p FROM lineitem)
    SELECT evaluation, {r('avg(abs(y - p))')} AS mae, {r('sqrt(avg(pow(y - p, 2)))')} AS rmse, {r('1 - avg(pow(y - p, 2)) / var_pop(y)')} AS r2 FROM p GROUP BY 1""")
def _(t: Tables):
    parts = [scores.regression_scores(t.lineitem.filter(F.col("l_linestatus") == s).select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p")), "y", "p").withColumn(
        "evaluation", F.lit(s)) for s in ("F", "O")]
    return ranking.stack_reports(parts)


@query("trace_completeness", f"""SELECT count(*) AS trace_count, {r("avg(CAST(event_type <> 'error' AND user_id % 2 = 0 AS INT))")} AS trace_completeness_rate,
    {r("avg(1 + CAST(event_type <> 'error' AS INT) + CAST(user_id % 2 = 0 AS INT))")} AS average_trace_size FROM events""")
def _(t: Tables):
    parts = F.map_concat(F.create_map(F.lit("anchor"), F.col("event_id").cast("string")),
                         F.when(F.col("event_type") != "error", F.create_map(F.lit("neighbour"), F.col("event_type"))).otherwise(F.create_map().cast("map<string,string>")),
                         F.when(F.col("user_id") % 2 == 0, F.create_map(F.lit("displacement"), F.col("props"))).otherwise(F.create_map().cast("map<string,string>")))
    return scores.trace_completeness(t.events.select(parts.alias("trace")), "trace", ["anchor", "neighbour", "displacement"])


@query("two_column_summary", "SELECT " + ", ".join(
    [f"(SELECT count(*) FROM {tb}) AS {s}_rows" for s, tb in (("real", "customer"), ("synthetic", "supplier"))]
    + [f"{r(f'(SELECT {f}({p}_{c}) FROM {tb})')} AS {s}_{x}_{n}" for s, tb, p in (("real", "customer", "c"), ("synthetic", "supplier", "s"))
       for x, c in (("x", "acctbal"), ("y", "nationkey")) for n, f in (("mean", "avg"), ("std", "stddev_samp"))]))
def _(t: Tables):
    return two_column_summary(t.customer.select(F.col("c_acctbal").alias("x"), F.col("c_nationkey").alias("y")),
                              t.supplier.select(F.col("s_acctbal").alias("x"), F.col("s_nationkey").alias("y")))


# ---------------------------------------------------------------- rankings and summaries
# A sweep table out of line items: parameter = return flag, value = line number, measures are group means.

SWEEP = """sweep AS (SELECT l_returnflag AS parameter, l_linenumber AS value, round(avg(l_quantity) / 25, 3) AS nn_distance_ratio, round(avg(l_discount) * 10, 3) AS discrimination_accuracy,
    CASE WHEN l_linenumber = 5 THEN NULL ELSE round(avg(l_tax), 4) END AS utility_lift, round(avg(l_extendedprice) / 1000, 1) AS distribution_similarity_score FROM lineitem GROUP BY 1, 2)"""
_BAD = {"nn_distance_ratio": "abs(nn_distance_ratio - 1.0::DOUBLE)", "discrimination_accuracy": "abs(discrimination_accuracy - 0.5::DOUBLE)", "utility_lift": "-utility_lift",
        "distribution_similarity_score": "-distribution_similarity_score"}
RANKED = f"""WITH {SWEEP}, bad AS (SELECT *, {', '.join(f'{e} AS b_{m}' for m, e in _BAD.items())} FROM sweep),
    ranked AS (SELECT *, {', '.join(f'CASE WHEN b_{m} IS NOT NULL THEN rank() OVER (PARTITION BY parameter ORDER BY b_{m} NULLS LAST) END AS {m}_rank' for m in _BAD)} FROM bad),
    av AS (SELECT *, list_avg([{', '.join(f'CAST({m}_rank AS DOUBLE)' for m in _BAD)}]) AS average_rank FROM ranked)"""


def sweep(t: Tables):
    base = t.lineitem.groupBy(F.col("l_returnflag").alias("parameter"), F.col("l_linenumber").alias("value")).agg(
        F.round(F.avg("l_quantity") / 25, 3).alias("nn_distance_ratio"), F.round(F.avg("l_discount") * 10, 3).alias("discrimination_accuracy"),
        F.round(F.avg("l_tax"), 4).alias("utility_lift"), F.round(F.avg("l_extendedprice") / 1000, 1).alias("distribution_similarity_score"))
    return base.withColumn("utility_lift", F.when(F.col("value") != 5, F.col("utility_lift")))


@query("rank_sweep", RANKED + f" SELECT parameter, value, {', '.join(f'{m}_rank' for m in _BAD)}, {r('average_rank')} AS average_rank, row_number() OVER (PARTITION BY parameter ORDER BY round(average_rank, 9), value) AS place FROM av")
def _(t: Tables):
    return ranking.rank_sweep(sweep(t)).select("parameter", "value", *[f"{m}_rank" for m in _BAD], "average_rank", "place")


@query("best_row_for_measure", RANKED + " SELECT parameter, min_by(value, (b_nn_distance_ratio, value)) AS value FROM av GROUP BY 1")
def _(t: Tables):
    return ranking.best_row_for_measure(sweep(t), "nn_distance_ratio", ("near", 1.0), ["value"], ["parameter"]).select("parameter", "value")


# Repeated runs: the seed is the line status.
RUNS = """runs AS (SELECT l_linestatus AS seed, 1::BIGINT AS step, l_returnflag AS parameter, l_linenumber AS value, round(avg(l_quantity) / 25, 4) AS nn_distance_ratio, round(avg(l_discount) * 10, 4) AS discrimination_accuracy,
    round(avg(l_tax), 5) AS utility_lift, round(avg(l_extendedprice) / 1000, 2) AS distribution_similarity_score FROM lineitem GROUP BY 1, 2, 3, 4)"""
_SUMMARY = f"""sm AS (SELECT step, parameter, value, count(*) AS rows, count(DISTINCT seed) AS runs, {', '.join(f'avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std' for m in _BAD)} FROM runs GROUP BY 1, 2, 3),
    picks AS (SELECT seed, step, parameter, min_by(value, (abs(nn_distance_ratio - 1.0::DOUBLE), value)) AS value FROM runs GROUP BY 1, 2, 3),
    pick AS (SELECT step, parameter, value, count(*) AS selected FROM picks GROUP BY 1, 2, 3)"""


def runs(t: Tables):
    return t.lineitem.groupBy(F.col("l_linestatus").alias("seed"), F.lit(1).cast("bigint").alias("step"), F.col("l_returnflag").alias("parameter"), F.col("l_linenumber").alias("value")).agg(
        F.round(F.avg("l_quantity") / 25, 4).alias("nn_distance_ratio"), F.round(F.avg("l_discount") * 10, 4).alias("discrimination_accuracy"),
        F.round(F.avg("l_tax"), 5).alias("utility_lift"), F.round(F.avg("l_extendedprice") / 1000, 2).alias("distribution_similarity_score"))


def picks(t: Tables):
    return ranking.best_row_for_measure(runs(t), "nn_distance_ratio", ("near", 1.0), ["value"], ["seed", "step", "parameter"])


_SM_COLS = ", ".join(f"{r(f'{m}_{k}')} AS {m}_{k}" for m in _BAD for k in ("mean", "std"))


@query("summarise_sweep", f"WITH {RUNS}, {_SUMMARY} SELECT sm.step, sm.parameter, sm.value, rows, runs, {_SM_COLS}, coalesce(selected, 0) AS selected FROM sm LEFT JOIN pick USING (step, parameter, value)")
def _(t: Tables):
    return ranking.summarise_sweep(runs(t), picks(t), list(_BAD))


@query("selection_count_join", f"WITH {RUNS}, {_SUMMARY} SELECT step, parameter, value, rows, coalesce(selected, 0) AS selected FROM sm LEFT JOIN pick USING (step, parameter, value)")
def _(t: Tables):
    keys = ["step", "parameter", "value"]
    return ranking.selection_count_join(runs(t).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")), picks(t).groupBy(*keys).agg(F.count(F.lit(1)).alias("selected")), keys, "selected")


@query("rank_sweep_by_step", f"WITH {RUNS}, {_SUMMARY}, b AS (SELECT step, parameter, value, abs(round(nn_distance_ratio_mean, 9) - 1.0::DOUBLE) AS b1, -round(distribution_similarity_score_mean, 9) AS b2 FROM sm), "
       "k AS (SELECT *, rank() OVER (PARTITION BY step ORDER BY b1) AS nn_rank, rank() OVER (PARTITION BY step ORDER BY b2) AS ds_rank FROM b) "
       f"SELECT step, parameter, value, nn_rank, ds_rank, {r('(nn_rank + ds_rank) / 2.0')} AS average_rank FROM k")
def _(t: Tables):
    means = ranking.group_means(runs(t), ["step", "parameter", "value"], list(_BAD))
    table = means.select("step", "parameter", "value", F.round("nn_distance_ratio_mean", 9).alias("nn"), F.round("distribution_similarity_score_mean", 9).alias("ds"))
    return ranking.rank_sweep(table, {"nn": ("near", 1.0), "ds": ("high", None)}, by=["step"]).drop("place", "nn", "ds")


_CROSS = {"utility_lift": ("high", None), "distribution_similarity_score": ("high", None), "discrimination_accuracy": ("near", 0.5)}


@query("cross_dataset_rank", f"""WITH {SWEEP}, l AS (SELECT value AS dataset, parameter AS method, 'u' AS m, -utility_lift AS s FROM sweep UNION ALL SELECT value, parameter, 'd', -distribution_similarity_score FROM sweep
    UNION ALL SELECT value, parameter, 'a', abs(discrimination_accuracy - 0.5::DOUBLE) FROM sweep),
    k AS (SELECT *, rank() OVER (PARTITION BY dataset, m ORDER BY s) AS rk FROM l WHERE s IS NOT NULL), w AS (SELECT *, max(rk) OVER (PARTITION BY dataset, m) AS mx FROM k)
    SELECT method, {r('avg(rk)')} AS mean_rank, count(*) FILTER (rk = 1) AS wins, count(*) FILTER (rk = mx) AS losses, count(*) AS comparisons FROM w GROUP BY 1""")
def _(t: Tables):
    return ranking.cross_dataset_rank(sweep(t).withColumnsRenamed({"value": "dataset", "parameter": "method"}), _CROSS)


def _report(t: Tables, columns: dict[str, str]):
    """Report rows under their own column names, from the order lines."""
    return t.lineitem.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def _report_sql(columns: dict[str, str]) -> str:
    return "WITH report AS (SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in columns.items()) + " FROM lineitem) "


_LINE = {"dataset": "l_returnflag", "`column`": "l_linestatus"}
_ACCURACY = {"cardinality": "l_linenumber * 3", "nca_accuracy": "l_discount * 7", "majority_accuracy": "l_tax * 5", "pca_accuracy": "l_quantity / 50",
             "raw_context_accuracy": "nullif(l_quantity, 7) / 60", "nca_accuracy_lift_over_majority": "l_discount * 7 - l_tax * 5",
             "nca_accuracy_lift_over_pca": "l_discount * 7 - l_quantity / 50"}
_CONFIDENCE = {"accuracy": "l_quantity / 50", "mean_top_confidence": "l_discount * 9", "confidence_gap": "l_quantity / 50 - l_discount * 9",
               "negative_log_loss": "l_extendedprice / 10000", "brier_score": "nullif(l_tax, 0) * 3", "expected_calibration_error": "l_tax * 2"}
_BUCKET = {"cardinality_bucket": "CASE WHEN l_linenumber <= 2 THEN 'binary' WHEN l_linenumber <= 4 THEN 'low' END"}
_SCORES = {"distribution_similarity_score": "l_quantity / 50", "discrimination_accuracy": "l_discount * 9", "utility_lift": "nullif(l_tax, 0)", "nn_distance_ratio": "l_extendedprice / 9000"}
_SETTING = {"dataset": "l_returnflag", "parameter": "l_linestatus", "value": "nullif(l_linenumber, 7)", "n_components": "l_linenumber % 3",
            "decoder_calibration_enabled": "l_linenumber > 3", "fit_seconds": "l_quantity", "sample_seconds": "l_tax", **_SCORES}
_RUN = {"dataset": "l_returnflag", "method": "l_linestatus", "seed": "l_linenumber", "reason": "CASE WHEN l_quantity > 45 THEN 'too few rows' WHEN l_quantity > 20 THEN '' END", **_SCORES}


def _sql_names(columns: dict[str, str]) -> dict[str, str]:
    return {c.strip("`"): e for c, e in columns.items()}


def _means(spec: dict[str, str]) -> str:
    return ", ".join(f"{r(f'avg({c})')} AS {n}" for n, c in spec.items())


@query("summarise_mechanism", _report_sql(_sql_names({**_LINE, **_ACCURACY})) + f'SELECT dataset, count("column") AS columns_evaluated, {_means(ranking.MECHANISM_MEANS)} FROM report GROUP BY 1')
def _(t: Tables):
    return ranking.summarise_mechanism(_report(t, {**_LINE, **_ACCURACY}))


@query("summarise_calibration", _report_sql(_sql_names({**_LINE, **_BUCKET, **_CONFIDENCE}))
       + f'SELECT dataset, cardinality_bucket, count("column") AS columns_evaluated, {_means(ranking.CALIBRATION_MEANS)} FROM report GROUP BY 1, 2')
def _(t: Tables):
    return ranking.summarise_calibration(_report(t, {**_LINE, **_BUCKET, **_CONFIDENCE}))


@query("summarise_imbalance", f"""SELECT o_orderstatus AS dataset, o_orderpriority AS method, min_by(o_custkey, o_orderkey) AS first_customer, {r('avg(o_totalprice)')} AS score FROM orders
    WHERE o_custkey > 20 GROUP BY 1, 2""")
def _(t: Tables):
    table = t.orders.select(F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("method"), "o_orderkey", F.col("o_custkey").alias("first_customer"),
                            F.col("o_totalprice").alias("score"), F.when(F.col("o_custkey") > 20, "").otherwise("already_balanced").alias("reason"))
    return ranking.summarise_imbalance(table, "o_orderkey", ["first_customer"], ["score"])


@query("summarise_uncertainty", _report_sql(_RUN) + "SELECT dataset, method, count(DISTINCT seed) AS runs, " + ", ".join(
    f"{r(f'avg({c})')} AS {n}_mean, {r(f'stddev_samp({c})')} AS {n}_std" for n, c in ranking.UNCERTAINTY.items()) + " FROM report WHERE coalesce(reason, '') = '' GROUP BY 1, 2")
def _(t: Tables):
    return ranking.summarise_uncertainty(_report(t, _RUN))


@query("summarise_sensitivity", _report_sql(_SETTING) + "SELECT parameter, value, CAST(value AS VARCHAR) AS setup_label, n_components, NULL::VARCHAR AS n_iterations, NULL::VARCHAR AS nca_fit_sample_size, "
       "NULL::VARCHAR AS lambda_, NULL::VARCHAR AS quantile_guard, NULL::VARCHAR AS max_constraint_retries, decoder_calibration_enabled AS calibrate_decoders, count(DISTINCT dataset) AS datasets_evaluated, "
       + ", ".join(f"{r(f'avg({c})')} AS mean_{c}" for c in ranking.SENSITIVITY_MEANS) + " FROM report GROUP BY ALL")
def _(t: Tables):
    return ranking.summarise_sensitivity(_report(t, _SETTING))


_POINTS = """pts AS (SELECT l_returnflag AS dataset, CASE WHEN l_linestatus = 'F' THEN 'held_out' WHEN l_linenumber < 4 THEN 'transport' ELSE 'bootstrap' END AS method,
    CASE WHEN l_linestatus = 'F' THEN 'real_test' ELSE 'generated' END AS sample_type, CASE WHEN l_tax = 0.08 THEN NULL ELSE l_extendedprice / 1000 END AS stress, l_discount > 0.04 AS out_hull FROM lineitem)"""


def points(t: Tables):
    return t.lineitem.select(
        F.col("l_returnflag").alias("dataset"), F.when(F.col("l_linestatus") == "F", "held_out").when(F.col("l_linenumber") < 4, "transport").otherwise("bootstrap").alias("method"),
        F.when(F.col("l_linestatus") == "F", "real_test").otherwise("generated").alias("sample_type"),
        F.when(F.col("l_tax") != 0.08, F.col("l_extendedprice") / 1000).alias("stress"), (F.col("l_discount") > 0.04).alias("out_hull"))


@query("summarise_manifold", f"""WITH {_POINTS}, re AS (SELECT dataset, median(stress) AS md, quantile_cont(stress, 0.95) AS q FROM pts WHERE sample_type = 'real_test' GROUP BY 1)
    SELECT p.dataset, p.method, {r('avg(CAST(out_hull AS INT))')} AS out_hull_rate, {r('max(md)')} AS real_stress_median, {r('max(q)')} AS real_stress_q95,
    {r('avg(CAST(stress <= q AS INT)) FILTER (out_hull AND stress IS NOT NULL)')} AS out_hull_acceptance_at_real_q95, {r('median(stress)')} AS generated_stress_median,
    {r('median(stress) FILTER (out_hull)')} AS out_hull_stress_median FROM pts p JOIN re USING (dataset) WHERE sample_type = 'generated' GROUP BY 1, 2""")
def _(t: Tables):
    return ranking.summarise_manifold(points(t))


@query("result_group_label", f"""WITH {_POINTS} SELECT CASE WHEN sample_type = 'real_test' THEN 'held-out real' WHEN out_hull THEN method || ' outside hull' ELSE method || ' inside hull' END AS label, count(*) AS n FROM pts GROUP BY 1""")
def _(t: Tables):
    return points(t).groupBy(ranking.result_group_label().alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("pivot_measure", f"""SELECT l_linenumber, {', '.join(r(f"avg(l_tax) FILTER (l_returnflag = '{f}')") + f' AS "{f}"' for f in 'ANR')} FROM lineitem GROUP BY 1""")
def _(t: Tables):
    cells = t.lineitem.groupBy("l_linenumber", "l_returnflag").agg(F.avg("l_tax").alias("tax"))
    return ranking.pivot_measure(cells, "l_linenumber", "l_returnflag", "tax", ["A", "N", "R"])


@query("ordered_results", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def _(t: Tables):
    cells = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return ranking.ordered_results(cells, "o_orderstatus", ["P", "F", "O"], "o_orderpriority")


@query("stack_reports", "SELECT 'customer' AS kind, count(*) AS n, " + r("avg(c_acctbal)") + " AS balance, CAST(NULL AS DOUBLE) AS price FROM customer UNION ALL SELECT 'part', count(*), NULL, " + r("avg(p_retailprice)") + " FROM part")
def _(t: Tables):
    return ranking.stack_reports([t.customer.agg(F.lit("customer").alias("kind"), F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("balance")),
                                  t.part.agg(F.lit("part").alias("kind"), F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("price"))])


@query("two_sample_t", f"""SELECT {r("(avg(l_extendedprice) FILTER (l_linestatus = 'F') - avg(l_extendedprice) FILTER (l_linestatus = 'O')) / sqrt(((count(*) FILTER (l_linestatus = 'F') - 1) * var_samp(l_extendedprice) FILTER (l_linestatus = 'F') + (count(*) FILTER (l_linestatus = 'O') - 1) * var_samp(l_extendedprice) FILTER (l_linestatus = 'O')) / (count(*) - 2) * (1.0 / count(*) FILTER (l_linestatus = 'F') + 1.0 / count(*) FILTER (l_linestatus = 'O')))")} AS t,
    CAST(count(*) - 2 AS BIGINT) AS degrees FROM lineitem""")
def _(t: Tables):
    from twinframe.operators.density import two_sample_t
    return two_sample_t(t.lineitem, "l_extendedprice", F.col("l_linestatus") == "F").select("t", "degrees")
