"""Real-versus-synthetic measures.  The two sides are the finished and the open line items (together the whole
table), or customers and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinframe.catalog.base import Tables, long_sql, query, r
from twinframe.functions import scalars
from twinframe.operators import clean, measures, neighbours, profile
from twinframe.session import checkpoint

NUM = ["l_quantity", "l_extendedprice", "l_discount", "tax"]
CAT = ["l_returnflag", "line"]


def sides(t: Tables):
    """Finished and open line items; tax 0 is missing, line 7 is missing."""
    rows = t.lineitem.select(
        "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", scalars.zero_as_null(F.col("l_tax")).alias("tax"),
        "l_returnflag", F.nullif(F.col("l_linenumber"), F.lit(7)).cast("string").alias("line"))
    return (rows.filter("l_linestatus = 'F'").drop("l_linestatus"), rows.filter("l_linestatus = 'O'").drop("l_linestatus"))


SIDES = """s AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'real' ELSE 'synthetic' END AS side, l_quantity, l_extendedprice, l_discount,
    nullif(l_tax, 0) AS tax, l_returnflag, CAST(nullif(l_linenumber, 7) AS VARCHAR) AS line FROM lineitem)"""
LONG = f"WITH {SIDES}, long AS ({long_sql('s', NUM)})"
ECDF = LONG + """, vc AS (SELECT col, v, count(*) FILTER (side = 'real') AS nr, count(*) FILTER (side = 'synthetic') AS ns FROM long WHERE v IS NOT NULL GROUP BY 1, 2),
    e AS (SELECT col, v, lead(v) OVER w AS nv, sum(nr) OVER w * 1.0 / sum(nr) OVER (PARTITION BY col) AS f,
        sum(ns) OVER w * 1.0 / sum(ns) OVER (PARTITION BY col) AS g FROM vc WINDOW w AS (PARTITION BY col ORDER BY v)),
    kw AS (SELECT col, max(abs(CAST(f AS DOUBLE) - CAST(g AS DOUBLE))) AS ks, sum(abs(CAST(f AS DOUBLE) - CAST(g AS DOUBLE)) * coalesce(nv - v, 0)) AS w FROM e GROUP BY 1)"""
HIST = """, ends AS (SELECT col, min(v) AS lo, max(v) AS hi, count(*) FILTER (side = 'real') AS tr, count(*) FILTER (side = 'synthetic') AS ts FROM long WHERE v IS NOT NULL GROUP BY 1),
    g0 AS (SELECT long.col, side, v, lo, hi, (hi - lo) / 20.0::DOUBLE AS wd, least(CAST(floor((v - lo) / (hi - lo) * 20.0::DOUBLE) AS BIGINT), 19) AS b FROM long JOIN ends USING (col) WHERE v IS NOT NULL),
    g1 AS (SELECT *, CASE WHEN v < lo + b * wd THEN b - 1 ELSE b END AS b1 FROM g0),
    g2 AS (SELECT *, CASE WHEN v >= (b1 + 1) * wd + lo AND b1 < 19 THEN b1 + 1 ELSE b1 END AS bin FROM g1),
    filled AS (SELECT col, bin, count(*) FILTER (side = 'real') AS nr, count(*) FILTER (side = 'synthetic') AS ns FROM g2 GROUP BY 1, 2),
    hist AS (SELECT ends.col, b.bin, coalesce(nr, 0) AS nr, coalesce(ns, 0) AS ns, tr, ts FROM ends CROSS JOIN (SELECT range AS bin FROM range(20)) b LEFT JOIN filled ON filled.col = ends.col AND filled.bin = b.bin),
    ov AS (SELECT col, sum(least(nr * 1.0::DOUBLE / tr, ns * 1.0::DOUBLE / ts)) AS overlap FROM hist GROUP BY 1),
    kl AS (SELECT col, sum(((nr + 1e-12) / (tr + 2e-11)) * ln(((nr + 1e-12) / (tr + 2e-11)) / ((ns + 1e-12) / (ts + 2e-11)))) AS kl FROM hist GROUP BY 1)"""
KEYS = f"WITH {SIDES}, keys AS ({long_sql('s', CAT, cast='VARCHAR', value='k')})"
PROBS = KEYS + """, kc AS (SELECT col, k, count(*) FILTER (side = 'real') AS nr, count(*) FILTER (side = 'synthetic') AS ns FROM keys WHERE k IS NOT NULL GROUP BY 1, 2),
    pr AS (SELECT col, k, nr * 1.0::DOUBLE / sum(nr) OVER (PARTITION BY col) AS p, ns * 1.0::DOUBLE / sum(ns) OVER (PARTITION BY col) AS q FROM kc),
    dv AS (SELECT col, sum(abs(p - q)) / 2 AS tv, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS jsd FROM pr GROUP BY 1)"""


@query("ecdf", ECDF + f"""SELECT col AS "column", {r('v')} AS value, {r('nv')} AS next_value, {r('f')} AS real_share, {r('g')} AS synthetic_share FROM e""")
def _(t: Tables):
    return measures.ecdf(*sides(t), NUM)


@query("ks_statistic", ECDF + f"""SELECT col AS "column", {r('ks')} AS ks_statistic FROM kw""")
def _(t: Tables):
    return measures.ks_statistic(*sides(t), NUM)


@query("wasserstein_1d", ECDF + f"""SELECT col AS "column", {r('w')} AS wasserstein_distance FROM kw""")
def _(t: Tables):
    return measures.wasserstein_1d(*sides(t), NUM)


@query("histogram_overlap", LONG + HIST + f"""SELECT col AS "column", {r('overlap')} AS histogram_overlap FROM ov""")
def _(t: Tables):
    return measures.histogram_overlap(*sides(t), NUM)


@query("histogram_kl", LONG + HIST + f"""SELECT col AS "column", {r('kl')} AS histogram_kl FROM kl""")
def _(t: Tables):
    return measures.histogram_kl(*sides(t), NUM)


_NUMERIC = ECDF + HIST + f""", mo AS (SELECT col, count(v) FILTER (side = 'real') AS rc, count(v) FILTER (side = 'synthetic') AS sc,
    avg(v) FILTER (side = 'real') AS rm, avg(v) FILTER (side = 'synthetic') AS sm, stddev_samp(v) FILTER (side = 'real') AS rs, stddev_samp(v) FILTER (side = 'synthetic') AS ss,
    avg(CAST(v IS NULL AS INT)) FILTER (side = 'real') AS rg, avg(CAST(v IS NULL AS INT)) FILTER (side = 'synthetic') AS sg FROM long GROUP BY 1),
    num AS (SELECT col AS "column", rc AS real_count, sc AS synthetic_count, {r('rm')} AS real_mean, {r('sm')} AS synthetic_mean, {r('rs')} AS real_std, {r('ss')} AS synthetic_std,
    {r('rg')} AS real_missing_rate, {r('sg')} AS synthetic_missing_rate, {r('abs(rm - sm)')} AS mean_abs_error, {r('abs(rs - ss)')} AS std_abs_error,
    {r('ks')} AS ks_statistic, {r('w')} AS wasserstein_distance, {r('overlap')} AS histogram_overlap FROM mo JOIN kw USING (col) JOIN ov USING (col))"""


@query("numeric_similarity", _NUMERIC + " SELECT * FROM num")
def _(t: Tables):
    return measures.numeric_similarity(*sides(t))


@query("aligned_probabilities", PROBS + f"""SELECT col AS "column", k AS key, {r('p')} AS p_real, {r('q')} AS p_synthetic FROM pr""")
def _(t: Tables):
    return measures.aligned_probabilities(*sides(t), CAT)


@query("total_variation", PROBS + f"""SELECT col AS "column", {r('tv')} AS total_variation_distance FROM dv""")
def _(t: Tables):
    return measures.total_variation(*sides(t), CAT)


@query("jensen_shannon", PROBS + f"""SELECT col AS "column", {r('jsd')} AS jensen_shannon_divergence FROM dv""")
def _(t: Tables):
    return measures.jensen_shannon(*sides(t), CAT)


_CATEGORICAL = PROBS + f""", cs AS (SELECT col, count(*) FILTER (p > 0) AS ru, count(*) FILTER (q > 0) AS su, count(*) FILTER (p > 0 AND q > 0) AS bu,
    count(*) FILTER (p > 0 AND p <= 0.01) AS rare, count(*) FILTER (p > 0 AND p <= 0.01 AND q > 0) AS kept FROM pr GROUP BY 1),
    gone AS (SELECT col, avg(CAST(k IS NULL AS INT)) FILTER (side = 'real') AS rg, avg(CAST(k IS NULL AS INT)) FILTER (side = 'synthetic') AS sg FROM keys GROUP BY 1),
    cat AS (SELECT col AS "column", ru AS real_unique, su AS synthetic_unique, {r('bu * 1.0 / ru')} AS category_coverage, rare AS rare_category_count, {r('kept * 1.0 / nullif(rare, 0)')} AS rare_category_preservation,
    {r('tv')} AS total_variation_distance, {r('jsd')} AS jensen_shannon_divergence, {r('rg')} AS real_missing_rate, {r('sg')} AS synthetic_missing_rate FROM cs JOIN dv USING (col) JOIN gone USING (col))"""


@query("categorical_similarity", _CATEGORICAL + " SELECT * FROM cat")
def _(t: Tables):
    return measures.categorical_similarity(*sides(t))


@query("distribution_score", PROBS + ", long AS (" + long_sql("s", NUM) + ")" + HIST + f""", row AS (SELECT (SELECT avg(overlap) FROM ov) AS o, (SELECT avg(kl) FROM kl) AS k, (SELECT avg(jsd) FROM dv) AS j, (SELECT avg(tv) FROM dv) AS t)
    SELECT {r('o')} AS distribution_histogram_overlap, {r('k')} AS distribution_numeric_kl, {r('j')} AS distribution_categorical_jsd, {r('t')} AS distribution_categorical_tv,
    {r('(o + 1 - j + 1 - t) / 3')} AS distribution_similarity_score FROM row""")
def _(t: Tables):
    return measures.distribution_score(*sides(t))


# ---------------------------------------------------------------- dependence

_NUM_PAIRS = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1:]]


def corr_sql(source: str, pairs, carry: str = "") -> str:
    lead, tail = (f"{carry}, ", f" GROUP BY {carry}") if carry else ("", "")
    return " UNION ALL ".join(f"SELECT {lead}'{a}' AS l, '{b}' AS r, abs(corr({a}, {b})) AS v FROM {source}{tail}" for a, b in pairs)


@query("pearson_abs", f"WITH {SIDES} SELECT l AS \"left\", r AS \"right\", {r('v')} AS value FROM ({corr_sql('s', _NUM_PAIRS)})")
def _(t: Tables):
    real, made = sides(t)
    return measures.numeric_correlation(real.unionByName(made), NUM)


@query("spearman_abs", "WITH " + ", ".join(
    f"r{i} AS (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS x, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS y "
    f"FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL)" for i, (a, b) in enumerate([("l_quantity", "l_extendedprice"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_tax")]))
    + " " + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {r('abs(corr(x, y))')} AS value FROM r{i}"
                               for i, (a, b) in enumerate([("l_quantity", "l_extendedprice"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_tax")])))
def _(t: Tables):
    return measures.numeric_correlation(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"], "spearman")


def cramer_sql(source: str, a: str, b: str, carry: str = "") -> str:
    c, cc = (f"{carry}, ", f"PARTITION BY {carry}") if carry else ("", "")
    on = f"{carry}, " if carry else ""
    return f"""SELECT {c}'{a}' AS l, '{b}' AS r, CASE WHEN least(count(DISTINCT a), count(DISTINCT b)) <= 1 THEN 0
        ELSE sqrt(greatest(sum(n * n * 1.0::DOUBLE / (rn * 1.0::DOUBLE * cn)) - 1, 0) / (least(count(DISTINCT a), count(DISTINCT b)) - 1)) END AS v FROM (
        SELECT {c}a, b, n, sum(n) OVER (PARTITION BY {on}a) AS rn, sum(n) OVER (PARTITION BY {on}b) AS cn FROM (
        SELECT {c}{a} AS a, {b} AS b, count(*) AS n FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL)) {'GROUP BY ' + carry if carry else ''}"""


_CAT_PAIRS = [("p_brand", "p_type"), ("p_brand", "p_name"), ("p_type", "p_name")]


@query("cramers_v", "SELECT l AS \"left\", r AS \"right\", " + r("v") + " AS value FROM (" + " UNION ALL ".join(cramer_sql("part", a, b) for a, b in _CAT_PAIRS) + ")")
def _(t: Tables):
    return measures.cramers_v(t.part, _CAT_PAIRS)


_U_PAIRS = [("line", "l_returnflag"), ("l_returnflag", "line")]


def theil_sql(x: str, y: str) -> str:
    return f"""SELECT '{x}' AS "left", '{y}' AS "right", {r('(h - c) / h')} AS value FROM
        (SELECT -sum(p * log2(p)) AS h, max(total) AS total FROM (SELECT count(*) * 1.0::DOUBLE / sum(count(*)) OVER () AS p, sum(count(*)) OVER () AS total FROM s WHERE {x} IS NOT NULL GROUP BY {x})),
        (SELECT -sum(n * log2(n * 1.0::DOUBLE / bn)) / (SELECT count({x}) FROM s) AS c FROM (SELECT count(*) AS n, sum(count(*)) OVER (PARTITION BY {y}) AS bn FROM s WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY {x}, {y}))"""


@query("theils_u", f"WITH {SIDES} " + " UNION ALL ".join(theil_sql(x, y) for x, y in _U_PAIRS))
def _(t: Tables):
    real, made = sides(t)
    return measures.theils_u(real.unionByName(made), _U_PAIRS)


def ratio_sql(source: str, c: str, m: str, carry: str = "") -> str:
    g = f"{carry}, " if carry else ""
    by = f"GROUP BY {carry}" if carry else ""
    part = f"PARTITION BY {carry}" if carry else ""
    return f"""SELECT {g}'{c}' AS c, '{m}' AS m, CASE WHEN sum(tot) = 0 THEN 0 ELSE sqrt(sum(n * pow(gm - mu, 2)) / sum(tot)) END AS v FROM (
        SELECT {g}c, count(*) AS n, avg(x) AS gm, max(mu) AS mu, sum(pow(x - mu, 2)) AS tot FROM (
        SELECT {g}{c} AS c, {m} AS x, avg({m}) OVER ({part}) AS mu FROM {source} WHERE {c} IS NOT NULL AND {m} IS NOT NULL) GROUP BY {g}c) {by}"""


_MIXED = [(c, m) for c in CAT for m in NUM]


@query("correlation_ratio", f"WITH {SIDES} SELECT c AS category, m AS measure, {r('v')} AS value FROM (" + " UNION ALL ".join(ratio_sql("s", c, m) for c, m in _MIXED) + ")")
def _(t: Tables):
    real, made = sides(t)
    return measures.correlation_ratio(real.unionByName(made), _MIXED)


_MATRIX = f"""WITH {SIDES}, am AS ({corr_sql('s', _NUM_PAIRS, 'side')} UNION ALL {cramer_sql('s', 'l_returnflag', 'line', 'side')}
    UNION ALL SELECT side, m, c, v FROM ({' UNION ALL '.join(ratio_sql('s', c, m, 'side') for c, m in _MIXED)}))"""


@query("association_matrix", _MATRIX + f" SELECT side, l AS \"left\", r AS \"right\", {r('v')} AS value FROM am")
def _(t: Tables):
    return measures.association_matrix(profile.tagged_union(*sides(t)), by=["side"])


_GAPS = _MATRIX + """, gp AS (SELECT l, r, max(v) FILTER (side = 'real') AS rv, max(v) FILTER (side = 'synthetic') AS sv FROM am GROUP BY 1, 2)"""


@query("association_difference", _GAPS + f" SELECT {r('avg(abs(rv - sv))')} AS mean_abs_association_difference, {r('max(abs(rv - sv))')} AS max_abs_association_difference FROM gp")
def _(t: Tables):
    return measures.association_difference(*sides(t))


@query("upper_triangle", _GAPS + f" SELECT l AS \"left\", r AS \"right\", {r('rv')} AS real_value, {r('sv')} AS synthetic_value, {r('abs(rv - sv)')} AS gap FROM gp")
def _(t: Tables):
    return measures.association_gaps(*sides(t))


@query("correlation_difference", f"WITH {SIDES} " + " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {r(f'''corr({a}, {b}) FILTER (side = 'real') - corr({a}, {b}) FILTER (side = 'synthetic')''')} AS difference FROM s" for a, b in _NUM_PAIRS))
def _(t: Tables):
    return measures.correlation_difference(*sides(t), NUM)


_REPORT_ROWS = " UNION ALL ".join(
    [f"SELECT 'numeric' AS family, \"column\" AS subject, '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM num" for m in (
        "real_count", "real_mean", "real_std", "real_missing_rate", "synthetic_count", "synthetic_mean", "synthetic_std", "synthetic_missing_rate",
        "mean_abs_error", "std_abs_error", "ks_statistic", "wasserstein_distance", "histogram_overlap")]
    + [f"SELECT 'categorical', \"column\", '{m}', CAST({m} AS DOUBLE) FROM cat" for m in (
        "real_missing_rate", "synthetic_missing_rate", "real_unique", "synthetic_unique", "category_coverage", "rare_category_count",
        "rare_category_preservation", "total_variation_distance", "jensen_shannon_divergence")]
    + [f"SELECT 'dependence', l || '|' || r, '{m}', {r(e)} FROM gp" for m, e in (
        ("real_value", "rv"), ("synthetic_value", "sv"), ("gap", "abs(rv - sv)"))])
_ALL = (_NUMERIC + _CATEGORICAL[len(f"WITH {SIDES}"):].replace("keys AS", "keys AS", 1)
        + _GAPS[len(f"WITH {SIDES}"):])


@query("similarity_report", _ALL + " SELECT * FROM (" + _REPORT_ROWS + ")")
def _(t: Tables):
    return measures.similarity_report(*sides(t))


_METHOD = {"numeric_mean_abs_error": ("num", "mean_abs_error"), "numeric_std_abs_error": ("num", "std_abs_error"),
           "numeric_ks_statistic": ("num", "ks_statistic"), "numeric_wasserstein_distance": ("num", "wasserstein_distance"),
           "numeric_histogram_overlap": ("num", "histogram_overlap"), "categorical_total_variation": ("cat", "total_variation_distance"),
           "categorical_jensen_shannon": ("cat", "jensen_shannon_divergence"), "categorical_coverage": ("cat", "category_coverage"),
           "rare_category_preservation": ("cat", "rare_category_preservation")}


@query("summarise_method_report", _ALL.replace("(round(", "((").replace(", 6) + 0.0)", ") + 0.0)") + " SELECT 'lineitem' AS dataset, 'open_lines' AS method, (SELECT count(*) FROM s WHERE side = 'real') AS n_real, (SELECT count(*) FROM s WHERE side = 'synthetic') AS n_synthetic, "
       + ", ".join(f"{r(f'(SELECT avg({c}) FROM {v})')} AS {n}" for n, (v, c) in _METHOD.items())
       + f", {r('(SELECT avg(abs(rv - sv)) FROM gp)')} AS mean_abs_association_difference, {r('(SELECT max(abs(rv - sv)) FROM gp)')} AS max_abs_association_difference")
def _(t: Tables):
    return measures.summarise_method_report(*sides(t), "lineitem", "open_lines")


@query("category_intersection", "SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS key FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def _(t: Tables):
    return clean.category_sets(t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k")), "k")["intersection"]


@query("category_union", "SELECT CAST(c_nationkey AS VARCHAR) AS key FROM customer UNION SELECT CAST(s_nationkey AS VARCHAR) FROM supplier")
def _(t: Tables):
    return clean.category_sets(t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k")), "k")["union"]


@query("augment_union", "SELECT side, count(*) AS n, " + r("sum(balance)") + " AS total FROM (SELECT 'real' AS side, c_acctbal AS balance FROM customer UNION ALL SELECT 'made', s_acctbal FROM supplier) GROUP BY 1")
def _(t: Tables):
    real = t.customer.select(F.lit("real").alias("side"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    made = t.supplier.select(F.col("s_acctbal").alias("balance"), F.lit("made").alias("side"))
    return clean.augment_union(real, made).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("balance").alias("total"))


@query("sensitive_value_overlap", """SELECT 'nation' AS "column", count(*) AS reused FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer)
    UNION ALL SELECT 'name', count(*) FROM supplier WHERE s_name IN (SELECT c_name FROM customer)""")
def _(t: Tables):
    return clean.sensitive_value_overlap(t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name")),
                                         t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name")), ["nation", "name"])


@query("top_values_two_sided", """WITH k AS (SELECT 'real' AS side, c_nationkey AS v FROM customer UNION ALL SELECT 'made', s_nationkey FROM supplier),
    t AS (SELECT v FROM k GROUP BY 1 ORDER BY count(*) DESC, CAST(v AS VARCHAR) LIMIT 8)
    SELECT CAST(v AS VARCHAR) AS value, """ + r("count(*) FILTER (side = 'real') * 1.0 / (SELECT count(*) FROM customer)") + " AS real_share, " +
       r("count(*) FILTER (side = 'made') * 1.0 / (SELECT count(*) FROM supplier)") + " AS synthetic_share FROM k WHERE v IN (SELECT v FROM t) GROUP BY 1")
def _(t: Tables):
    return measures.top_values_two_sided(t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k")), "k", 8)


# ---------------------------------------------------------------- neighbour joins

Z = """z AS (SELECT c_custkey AS id, c_mktsegment AS seg, (c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer) AS a,
    (c_nationkey - (SELECT avg(c_nationkey) FROM customer)) / (SELECT stddev_pop(c_nationkey) FROM customer) AS b FROM customer)"""
DIST = "round(sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2) + CASE WHEN x.seg = y.seg THEN 0 ELSE 2 END), 9)"
KNN = f"""WITH {Z}, pairs AS (SELECT x.id AS src, y.id AS dst, {DIST} AS dist FROM z x JOIN z y ON x.id <> y.id),
    knn AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank, dist FROM pairs QUALIFY rank <= 6)"""
MUTUAL = KNN + """, both_ways AS (SELECT a.src, a.dst FROM knn a JOIN knn b ON a.src = b.dst AND a.dst = b.src),
    mutual AS (SELECT * FROM both_ways UNION ALL SELECT src, dst FROM knn WHERE rank = 1 AND src NOT IN (SELECT src FROM both_ways))"""


def customer_latent(t: Tables):
    from twinframe.operators.encode import encode, fit_encoding
    enc = fit_encoding(t.customer, ["c_acctbal", "c_nationkey", "c_mktsegment"])
    return encode(t.customer, enc).select("c_custkey", "c_mktsegment", "z")


def customer_edges(t: Tables, k: int = 6):
    return neighbours.knn_exact(customer_latent(t), "c_custkey", "z", k)


@query("knn_exact", KNN + f" SELECT src, dst, rank, {r('dist')} AS dist FROM knn")
def _(t: Tables):
    return customer_edges(t)


def _embedding_sql(distance: str, k: int) -> str:
    return f"""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT x.id AS src, y.id AS dst, round({distance}, 9) AS dist FROM e x JOIN e y ON x.id <> y.id)
        SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank, {r('dist')} AS dist FROM p QUALIFY rank <= {k}"""


@query("knn_exact_embeddings", _embedding_sql("list_distance(x.v, y.v)", 5))
def _(t: Tables):
    return neighbours.knn_exact(t.embeddings, "vec_id", "embedding", 5)


@query("knn_exact_cosine", _embedding_sql("1 - list_cosine_similarity(x.v, y.v)", 5))
def _(t: Tables):
    return neighbours.knn_exact(t.embeddings, "vec_id", "embedding", 5, metric="cosine")


@query("knn_exact_manhattan", _embedding_sql("list_sum(list_transform(list_zip(x.v, y.v), lambda q: abs(q[1] - q[2])))", 3))
def _(t: Tables):
    return neighbours.knn_exact(t.embeddings, "vec_id", "embedding", 3, metric="manhattan")


@query("knn_approx")
def _(t: Tables):
    return neighbours.knn_approx(customer_latent(t), "c_custkey", "z", 6, probes=3)


@query("knn_recall", "SELECT count(*) * 6 AS edges, true AS enough FROM customer")
def _(t: Tables):
    """Recall of the probed cells against the exact lists."""
    latent = checkpoint(customer_latent(t))
    near = neighbours.knn_approx(latent, "c_custkey", "z", 6, probes=8)
    found = neighbours.recall_at_k(near, neighbours.knn_exact(latent, "c_custkey", "z", 6))
    return found.select("edges", (F.col("recall") >= 0.9).alias("enough"))


@query("knn_descent", "SELECT count(*) * 5 AS edges, true AS enough FROM embeddings")
def _(t: Tables):
    """Recall of neighbour descent in 64 dimensions against the exact lists."""
    found = neighbours.recall_at_k(neighbours.knn_descent(t.embeddings, "vec_id", "embedding", 5), neighbours.knn_exact(t.embeddings, "vec_id", "embedding", 5))
    return found.select("edges", (F.col("recall") >= 0.95).alias("enough"))


@query("top_k_neighbours", """SELECT c_nationkey AS src, s_suppkey AS dst, """ + r("dist") + """ AS dist, rank FROM (SELECT c_nationkey, s_suppkey, abs(s_acctbal - m) AS dist,
    row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(s_acctbal - m), s_suppkey) AS rank FROM (SELECT c_nationkey, avg(c_acctbal) AS m FROM customer GROUP BY 1) JOIN supplier ON s_nationkey = c_nationkey) WHERE rank <= 2""")
def _(t: Tables):
    middle = t.customer.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m"))
    pairs = t.supplier.join(middle, F.col("s_nationkey") == F.col("c_nationkey")).select(
        F.col("c_nationkey").alias("src"), F.col("s_suppkey").alias("dst"), F.abs(F.col("s_acctbal") - F.col("m")).alias("dist"))
    return neighbours.top_k_neighbours(pairs, 2)


@query("mutual_neighbours", MUTUAL + " SELECT src, dst FROM mutual")
def _(t: Tables):
    return neighbours.mutual_neighbours(customer_edges(t))


@query("mutual_neighbours_by_class", f"""WITH {Z}, pairs AS (SELECT x.id AS src, y.id AS dst, {DIST} AS dist FROM z x JOIN z y ON x.id <> y.id AND x.seg = y.seg),
    knn AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank, dist FROM pairs QUALIFY rank <= 4)""" + MUTUAL[len(KNN):] + " SELECT src, dst FROM mutual")
def _(t: Tables):
    return neighbours.mutual_neighbours(neighbours.knn_exact(customer_latent(t), "c_custkey", "z", 4, within="c_mktsegment"))


@query("neighbour_graph", KNN + f" SELECT least(src, dst) AS a, greatest(src, dst) AS b, {r('max(dist)')} AS dist FROM knn GROUP BY 1, 2")
def _(t: Tables):
    return neighbours.neighbour_graph(customer_edges(t))


_JOINT = """WITH u AS (SELECT 'real' AS side, CAST(c_custkey AS VARCHAR) AS id, c_acctbal AS bal, c_nationkey AS nat FROM customer
    UNION ALL SELECT 'synthetic', CAST(s_suppkey AS VARCHAR), s_acctbal, s_nationkey FROM supplier),
    f AS (SELECT side, id, (bal - avg(bal) OVER ()) / stddev_pop(bal) OVER () AS a, (nat - avg(nat) OVER ()) / stddev_pop(nat) OVER () AS b FROM u)"""
_NEAR = _JOINT + """, d AS (SELECT 'synthetic_to_real' AS kind, x.id, min(round(sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2)), 9)) AS dist FROM f x JOIN f y ON x.side = 'synthetic' AND y.side = 'real' GROUP BY 2
    UNION ALL SELECT 'real_to_real', x.id, min(round(sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2)), 9)) FROM f x JOIN f y ON x.side = 'real' AND y.side = 'real' AND x.id <> y.id GROUP BY 2)"""


def _parties(t: Tables):
    real = t.customer.select(F.col("c_custkey").alias("cid"), F.col("c_acctbal").alias("bal"), F.col("c_nationkey").alias("nat"))
    return real, t.supplier.select(F.col("s_suppkey").alias("sid"), F.col("s_acctbal").alias("bal"), F.col("s_nationkey").alias("nat"))


@query("knn_cross", _NEAR + f" SELECT kind, id, {r('dist')} AS dist FROM d")
def _(t: Tables):
    return measures.nearest_distances(*_parties(t), real_id="cid", synthetic_id="sid")


@query("nn_distance_test", _NEAR + f""", q AS (SELECT quantile_cont(dist, 0.05) AS lim FROM d WHERE kind = 'real_to_real')
    SELECT {r("avg(dist) FILTER (kind = 'synthetic_to_real')")} AS nn_synthetic_to_real_mean, {r("avg(dist) FILTER (kind = 'real_to_real')")} AS nn_real_to_real_mean,
    {r("avg(CAST(dist < lim AS INT)) FILTER (kind = 'synthetic_to_real')")} AS nn_suspiciously_close_rate,
    {r("avg(dist) FILTER (kind = 'synthetic_to_real') / avg(dist) FILTER (kind = 'real_to_real')")} AS nn_distance_ratio FROM d, q""")
def _(t: Tables):
    return measures.nn_distance_test(*_parties(t), real_id="cid", synthetic_id="sid")


@query("nn_distance_summary", _NEAR + f" SELECT kind, {r('avg(dist)')} AS mean, count(*) AS rows, {r('quantile_cont(dist, 0.05)')} AS p05, {r('median(dist)')} AS median, {r('quantile_cont(dist, 0.95)')} AS p95 FROM d GROUP BY 1")
def _(t: Tables):
    return measures.nn_distance_summary(measures.nearest_distances(*_parties(t), real_id="cid", synthetic_id="sid"))


@query("nn_distance_report", "WITH p AS (SELECT c_custkey AS id, c_acctbal AS x, c_nationkey * 100.0 AS y FROM customer), q AS (SELECT s_suppkey AS id, s_acctbal AS x, s_nationkey * 100.0 AS y FROM supplier) "
       f"SELECT 'generated_to_real' AS kind, q.id AS src, {r('min(round(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)), 9))')} AS dist FROM q, p GROUP BY 2 "
       f"UNION ALL SELECT 'real_to_real', a.id, {r('min(round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 9))')} FROM p a JOIN p b ON a.id <> b.id GROUP BY 2")
def _(t: Tables):
    p = t.customer.select(F.col("c_custkey").alias("id"), F.array("c_acctbal", F.col("c_nationkey") * 100.0).alias("xy"))
    q = t.supplier.select(F.col("s_suppkey").alias("id"), F.array("s_acctbal", F.col("s_nationkey") * 100.0).alias("xy"))
    return measures.two_kind_distances(p, q, "id", "xy")
