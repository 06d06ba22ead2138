"""Seeded samplers over whole tables; each draw is an md5 number that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinframe.catalog.base import Tables, dense, query, r, u, uidx
from twinframe.catalog.measures import KNN, customer_edges, customer_latent
from twinframe.functions import rng
from twinframe.functions import normal as nf
from twinframe.functions.ordered import dense_index
from twinframe.operators import samplers

SEED = 42


@query("fixed_size_sample", f"SELECT o_orderkey, {r('o_totalprice')} AS o_totalprice FROM orders ORDER BY {u(SEED, 'sample', 'o_orderkey')}, o_orderkey LIMIT 1000")
def _(t: Tables):
    return samplers.fixed_size_sample(t.orders, "o_orderkey", 1000).select("o_orderkey", "o_totalprice")


_BOOT = f"""WITH ix AS (SELECT *, {dense('c_custkey')} AS i FROM customer), d AS (SELECT range AS "row", {uidx('(SELECT count(*) FROM customer)', SEED, 'bootstrap', 'range')} AS i FROM range((SELECT count(*) FROM customer)))"""


@query("bootstrap_rows", _BOOT + f' SELECT "row", c_custkey, c_nationkey, c_mktsegment, {r("c_acctbal")} AS c_acctbal FROM d JOIN ix USING (i)')
def _(t: Tables):
    return samplers.bootstrap_rows(t.customer, "c_custkey").select("row", "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")


def _independent_sql(columns) -> str:
    parts = ", ".join(f"""d_{c} AS (SELECT range AS "row", {c} FROM range((SELECT count(*) FROM customer)) JOIN ix ON i = {uidx('(SELECT count(*) FROM customer)', SEED, f'independent.{c}', 'range')})""" for c in columns)
    return f"WITH ix AS (SELECT *, {dense('c_custkey')} AS i FROM customer), {parts}"


@query("independent_columns", _independent_sql(["c_mktsegment", "c_nationkey", "c_acctbal"]) + f""" SELECT "row", c_mktsegment, c_nationkey, {r('c_acctbal')} AS c_acctbal
    FROM d_c_mktsegment JOIN d_c_nationkey USING ("row") JOIN d_c_acctbal USING ("row")""")
def _(t: Tables):
    return samplers.independent_columns(t.customer, "c_custkey", ["c_mktsegment", "c_nationkey", "c_acctbal"])


def _stratum(c: str) -> str:
    return f"""(SELECT l."row", ix.{c} FROM lv l JOIN ix ON ix.lvl = l.lvl AND ix.j = {uidx('l.size', SEED, f'stratum.{c}', 'l."row"')})"""


@query("stratified_columns", f"""WITH base AS (SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), '__MISSING__') AS lvl, nullif(c_mktsegment, 'BUILDING') AS segment, c_nationkey, c_acctbal FROM customer),
    ix AS (SELECT *, {dense('c_custkey')} AS i, {dense('c_custkey', 'lvl')} AS j, count(*) OVER (PARTITION BY lvl) AS size FROM base),
    lv AS (SELECT range AS "row", lvl, segment, size FROM range((SELECT count(*) FROM customer)) JOIN ix ON i = {uidx('(SELECT count(*) FROM customer)', SEED, 'level', 'range')})
    SELECT lv."row", lv.segment, a.c_nationkey, {r('b.c_acctbal')} AS c_acctbal FROM lv JOIN {_stratum('c_nationkey')} a ON a."row" = lv."row" JOIN {_stratum('c_acctbal')} b ON b."row" = lv."row" """)
def _(t: Tables):
    table = t.customer.withColumn("segment", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    return samplers.stratified_columns(table, "c_custkey", "segment", ["segment", "c_nationkey", "c_acctbal"])


@query("gather_rows", f"""SELECT o_orderkey AS draw, c_custkey FROM orders JOIN (SELECT c_custkey, {dense('c_custkey')} AS idx FROM customer) ON idx = o_custkey % (SELECT count(*) FROM customer)""")
def _(t: Tables):
    n = t.customer.count()
    draws = t.orders.select(F.col("o_orderkey").alias("draw"), F.pmod("o_custkey", F.lit(n)).alias("idx"))
    return samplers.gather_rows(draws, t.customer.select("c_custkey"), "c_custkey").select("draw", "c_custkey")


@query("sample_remainder", f"SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders ORDER BY {u(SEED, 'sample', 'o_orderkey')}, o_orderkey LIMIT 1000)")
def _(t: Tables):
    return samplers.sample_remainder(t.orders, samplers.fixed_size_sample(t.orders, "o_orderkey", 1000), "o_orderkey").select("o_orderkey")


@query("stratified_fit_sample", f"""WITH b AS (SELECT p_partkey, p_name, {u(SEED, 'fit', 'p_partkey')} AS u FROM part), f AS (SELECT p_name, min_by(p_partkey, (u, p_partkey)) AS k FROM b GROUP BY 1)
    SELECT p_partkey, b.p_name FROM b LEFT JOIN f ON f.k = b.p_partkey ORDER BY f.k IS NULL, CASE WHEN f.k IS NOT NULL THEN {u(SEED, 'class', 'b.p_name')} ELSE u END, p_partkey LIMIT (SELECT CAST(ceil(count(*) * 0.1) AS BIGINT) FROM part)""")
def _(t: Tables):
    return samplers.stratified_fit_sample(t.part.select("p_partkey", "p_name"), "p_partkey", "p_name", 0.1)


def _placed(table: str, key: str, cls: str, stream: str) -> str:
    h = f"md5(concat_ws('|', '{SEED}', '{stream}', CAST({key} AS VARCHAR)))"
    return f"SELECT {key}, {cls} AS k, row_number() OVER (PARTITION BY {cls} ORDER BY md5({h}), {h}) AS place FROM {table}"


def _quota(table: str, cls: str, total: str, least: int) -> str:
    return f"""c0 AS (SELECT {cls} AS k, count(*) * CAST({total} AS DOUBLE) / (SELECT CAST(count(*) AS DOUBLE) FROM {table}) AS share FROM {table} GROUP BY 1), c1 AS (SELECT k, greatest(CAST(floor(share) AS BIGINT), {least}) AS base, share - floor(share) AS rest FROM c0),
    quota AS (SELECT k, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, k) <= {total} - (SELECT sum(base) FROM c1) THEN 1 ELSE 0 END AS quota FROM c1)"""


@query("train_test_split", f"WITH placed AS ({_placed('lineitem_keyed', 'id', 'l_returnflag', 'split')}), {_quota('lineitem', 'l_returnflag', '(SELECT CAST(ceil(count(*) * 0.3) AS BIGINT) FROM lineitem)', 0)} SELECT id, place <= quota AS is_test FROM placed JOIN quota USING (k)".replace(
    "lineitem_keyed", "(SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || l_extendedprice::DECIMAL(18,2) || '-' || l_quantity::BIGINT AS id, l_returnflag FROM lineitem)"))
def _(t: Tables):
    keyed = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_quantity").cast("bigint")).alias("id"), "l_returnflag")
    return samplers.train_test_split(keyed, "id", label="l_returnflag").select("id", "is_test")


@query("train_test_split_plain", f"WITH placed AS ({_placed('customer', 'c_custkey', 'CAST(1 AS INT)', 'split')}) SELECT c_custkey, place <= (SELECT ceil(count(*) * 0.3) FROM customer) AS is_test FROM placed")
def _(t: Tables):
    return samplers.train_test_split(t.customer, "c_custkey").select("c_custkey", "is_test")


@query("cap_stratified", f"WITH placed AS ({_placed('part', 'p_partkey', 'p_name', 'cap')}), {_quota('part', 'p_name', 'CAST(500 AS BIGINT)', 1)} SELECT p_partkey, k AS p_name FROM placed JOIN quota USING (k) WHERE place <= quota")
def _(t: Tables):
    return samplers.cap_stratified(t.part.select("p_partkey", "p_name"), "p_partkey", "p_name", 500)


@query("latent_bootstrap", f"""WITH ix AS (SELECT vec_id, embedding, {dense('vec_id')} AS i FROM embeddings), d AS (SELECT range AS "row", {uidx('(SELECT count(*) FROM embeddings)', SEED, 'bootstrap', 'range')} AS i FROM range((SELECT count(*) FROM embeddings)))
    SELECT "row", vec_id, {r('CAST(embedding[1] AS DOUBLE)')} AS first, {r('CAST(embedding[64] AS DOUBLE)')} AS last FROM d JOIN ix USING (i)""")
def _(t: Tables):
    made = samplers.bootstrap_rows(t.embeddings, "vec_id")
    return made.select("row", "vec_id", F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[63].cast("double").alias("last"))


@query("latent_interpolation", KNN + f""", ix AS (SELECT *, {dense('id')} AS i FROM z), n AS (SELECT count(*) AS n FROM z),
    a AS (SELECT range AS "row", id, a, b FROM range((SELECT n FROM n)), n JOIN ix ON i = {uidx('n', SEED, 'anchor', 'range')}),
    m AS (SELECT a."row", a.id AS anchor, a.a AS a0, a.b AS b0, k.dst AS other, {u(SEED, 'weight', 'a."row"')} AS w FROM a JOIN knn k ON k.src = a.id AND k.rank = 1 + {uidx('6', SEED, 'neighbour', 'a."row"')})
    SELECT m."row", anchor, other, {r('a0 + w * (z.a - a0)')} AS z0, {r('b0 + w * (z.b - b0)')} AS z1 FROM m JOIN z ON z.id = m.other""")
def _(t: Tables):
    latent = customer_latent(t)
    made = samplers.latent_interpolation(latent, "c_custkey", customer_edges(t), latent.count())
    return made.select("row", "anchor", "other", F.col("z")[0].alias("z0"), F.col("z")[1].alias("z1"))


@query("product_probability", f"""WITH w AS (SELECT c_custkey, abs(c_acctbal) AS a, c_nationkey * 1.0::DOUBLE AS b FROM customer) SELECT c_custkey, round(a * b / (SELECT sum(a * b) FROM w), 9) + 0.0 AS p FROM w""".replace(", 9)", ", 6)"))
def _(t: Tables):
    w = t.customer.select("c_custkey", F.abs("c_acctbal").alias("a"), F.col("c_nationkey").cast("double").alias("b"))
    return samplers.product_probability(w, "c_custkey", ["a", "b"])


# ---------------------------------------------------------------- copula parts

def _poly(x: str, coefficients) -> str:
    out = f"({coefficients[0]!r}::DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r}::DOUBLE))"
    return out


def quantile_of_normal_sql(p: str) -> str:
    c = f"(least(greatest({p}, 1e-6), 1.0::DOUBLE - 1e-6))"
    lo, hi, q = f"sqrt(-2.0 * ln({c}))", f"sqrt(-2.0 * ln(1.0 - {c}))", f"({c} - 0.5)"
    sq = f"({q} * {q})"
    return f"""CASE WHEN {c} < 0.02425 THEN {_poly(lo, nf._TAIL_TOP)} / {_poly(lo, nf._TAIL_BOTTOM)} WHEN {c} > 1 - 0.02425 THEN -{_poly(hi, nf._TAIL_TOP)} / {_poly(hi, nf._TAIL_BOTTOM)}
        ELSE {_poly(sq, nf._CENTRE_TOP)} * {q} / {_poly(sq, nf._CENTRE_BOTTOM)} END"""


@query("normal_quantile", f"WITH p AS (SELECT o_orderkey, {u(3, 'p', 'o_orderkey')} AS p FROM orders) SELECT o_orderkey, {r(quantile_of_normal_sql('p'))} AS z FROM p")
def _(t: Tables):
    return t.orders.select("o_orderkey", nf.normal_quantile(rng.uniform(3, "p", "o_orderkey")).alias("z"))


_CDF_Z = f"WITH p AS (SELECT o_orderkey, {u(3, 'p', 'o_orderkey')} * 12 - 6 AS z FROM orders), t AS (SELECT o_orderkey, z, exp(-z * z / 2) * {_poly('abs(z)', nf._CDF_TOP)} / {_poly('abs(z)', nf._CDF_BOTTOM)} AS tail FROM p)"


@query("normal_cdf", _CDF_Z + f" SELECT o_orderkey, {r('CASE WHEN z > 0 THEN 1 - tail ELSE tail END')} AS p FROM t")
def _(t: Tables):
    return t.orders.select("o_orderkey", nf.normal_cdf(rng.uniform(3, "p", "o_orderkey") * 12 - 6).alias("p"))


@query("average_rank_score", " UNION ALL ".join(
    f"SELECT p_partkey, '{c}' AS \"column\", {r('rk')} AS rank, {r(quantile_of_normal_sql('((rk - 0.5) / n)'))} AS score FROM (SELECT p_partkey, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS rk, count(*) OVER () AS n FROM part WHERE {c} <> 7)"
    for c in ("p_size", "p_retailprice")))
def _(t: Tables):
    table = t.part.select("p_partkey", F.nullif(F.col("p_size"), F.lit(7)).alias("p_size"), F.nullif(F.col("p_retailprice"), F.lit(7.0)).alias("p_retailprice"))
    return samplers.normal_scores(table, "p_partkey", ["p_size", "p_retailprice"]).select("p_partkey", "column", "rank", "score")


def _normal_sql(stream: str) -> str:
    return f"(sqrt(-2.0 * ln(1.0 - {u(SEED, stream + '.r', 'range')})) * cos(2 * pi() * {u(SEED, stream + '.a', 'range')}))"


def _score_sql(column: str) -> str:
    ranked = f"SELECT p_partkey, rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0::DOUBLE AS rk, count(*) OVER () AS n FROM src WHERE {column} IS NOT NULL"
    return f"(SELECT p_partkey, {quantile_of_normal_sql('((rk - 0.5) / n)')} AS s FROM ({ranked}))"


def _cdf_sql(z: str) -> str:
    tail = f"exp(-{z} * {z} / 2) * {_poly(f'abs({z})', nf._CDF_TOP)} / {_poly(f'abs({z})', nf._CDF_BOTTOM)}"
    return f"CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END"


def _marginal_sql(p: str, column: str) -> str:
    spot = f"((len({column}_sorted) - 1) * {p})"
    low = f"CAST(floor({spot}) AS BIGINT)"
    return f"({column}_sorted[{low} + 1] + ({column}_sorted[least({low} + 2, len({column}_sorted))] - {column}_sorted[{low} + 1]) * ({spot} - {low}))"


@query("gaussian_copula", f"""WITH src AS (SELECT p_partkey, CAST(nullif(p_size, 7) AS DOUBLE) AS a, p_retailprice AS b, p_type, p_brand FROM part), ix AS (SELECT *, {dense('p_partkey')} AS i FROM part),
    wide AS (SELECT coalesce(sa.s, 0) AS s0, coalesce(sb.s, 0) AS s1 FROM src LEFT JOIN {_score_sql('a')} sa USING (p_partkey) LEFT JOIN {_score_sql('b')} sb USING (p_partkey)),
    fit AS (SELECT avg(s0) AS m0, avg(s1) AS m1, covar_samp(s0, s0) + 1e-6 AS c00, covar_samp(s0, s1) AS c01, covar_samp(s1, s1) + 1e-6 AS c11 FROM wide),
    half AS (SELECT m0, m1, sqrt(c00) AS l00, c01 / sqrt(c00) AS l10, sqrt(c11 - c01 * c01 / c00) AS l11 FROM fit),
    sorted AS (SELECT list_sort(list(a) FILTER (a IS NOT NULL)) AS a_sorted, list_sort(list(b) FILTER (b IS NOT NULL)) AS b_sorted, 1 - count(a) * 1.0::DOUBLE / count(*) AS a_gone, 1 - count(b) * 1.0::DOUBLE / count(*) AS b_gone FROM src),
    noise AS (SELECT range, {_normal_sql('copula.0')} AS e0, {_normal_sql('copula.1')} AS e1 FROM range((SELECT count(*) FROM part))),
    z AS (SELECT range, m0 + l00 * e0 AS z0, m1 + l10 * e0 + l11 * e1 AS z1 FROM noise, half), q AS (SELECT range, {_cdf_sql('z0')} AS p0, {_cdf_sql('z1')} AS p1 FROM z),
    drawn AS (SELECT range, CASE WHEN {u(SEED, 'copula.missing.0', 'range')} >= a_gone THEN CAST(trunc({_marginal_sql('p0', 'a')}) AS BIGINT) END AS p_size,
        CASE WHEN {u(SEED, 'copula.missing.1', 'range')} >= b_gone THEN {_marginal_sql('p1', 'b')} END AS p_retailprice FROM q, sorted),
    typed AS (SELECT range, p_type FROM range((SELECT count(*) FROM part)) JOIN ix ON i = {uidx('(SELECT count(*) FROM part)', SEED, 'independent.p_type', 'range')}),
    branded AS (SELECT range, p_brand FROM range((SELECT count(*) FROM part)) JOIN ix ON i = {uidx('(SELECT count(*) FROM part)', SEED, 'independent.p_brand', 'range')})
    SELECT range AS "row", p_size, {r('p_retailprice')} AS p_retailprice, p_type, p_brand FROM drawn JOIN typed USING (range) JOIN branded USING (range)""")
def _(t: Tables):
    table = t.part.withColumn("p_size", F.nullif(F.col("p_size"), F.lit(7)))
    return samplers.gaussian_copula(table, "p_partkey", ["p_size", "p_retailprice", "p_type", "p_brand"])


_SMOTE = f"""WITH base AS (SELECT c_custkey AS id, CASE WHEN c_acctbal > 8000 THEN 'yes' ELSE 'no' END AS cls, c_acctbal AS bal, CAST(c_nationkey AS DOUBLE) AS nat, c_mktsegment AS seg FROM customer),
    sizes AS (SELECT cls, count(*) AS size, max(count(*)) OVER () AS largest FROM base GROUP BY 1),
    pen AS (SELECT (stddev_pop(bal) + stddev_pop(nat)) / 2 AS p FROM base WHERE cls = (SELECT cls FROM sizes ORDER BY size, cls LIMIT 1)),
    pairs AS (SELECT x.id AS src, y.id AS dst, round(sqrt(pow(x.bal - y.bal, 2) + pow(x.nat - y.nat, 2) + CASE WHEN x.seg = y.seg THEN 0 ELSE p * p END), 9) AS dist FROM base x JOIN base y ON x.id <> y.id AND x.cls = y.cls, pen),
    near AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM pairs QUALIFY rank <= 5),
    degree AS (SELECT src, count(*) AS degree FROM near GROUP BY 1),
    votes AS (SELECT src, seg FROM (SELECT src, seg, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, seg) AS place FROM near JOIN base ON id = dst GROUP BY 1, 2) WHERE place = 1),
    ix AS (SELECT *, {dense('id', 'cls')} AS j FROM base),
    draws AS (SELECT cls, size, range AS d FROM range((SELECT max(largest) FROM sizes)), sizes WHERE range < largest - size),
    picked AS (SELECT draws.cls, d, ix.id AS anchor, ix.bal, ix.nat, ix.seg FROM draws JOIN ix ON ix.cls = draws.cls AND j = {uidx('size', SEED, 'smote.anchor', 'draws.cls', 'd')}),
    made AS (SELECT picked.cls || '|' || d AS "row", anchor, picked.bal + {u(SEED, 'smote.weight', 'picked.cls', 'd')} * (coalesce(o.bal, picked.bal) - picked.bal) AS c_acctbal,
        picked.nat + {u(SEED, 'smote.weight', 'picked.cls', 'd')} * (coalesce(o.nat, picked.nat) - picked.nat) AS c_nationkey, coalesce(votes.seg, picked.seg) AS c_mktsegment, picked.cls AS rich
        FROM picked LEFT JOIN degree ON degree.src = anchor LEFT JOIN near ON near.src = anchor AND rank = 1 + {uidx('degree', SEED, 'smote.neighbour', 'picked.cls', 'd')}
        LEFT JOIN base o ON o.id = near.dst LEFT JOIN votes ON votes.src = anchor)"""


@query("smote_interpolate", _SMOTE + f""" SELECT "row", anchor, {r('c_acctbal')} AS c_acctbal, {r('c_nationkey')} AS c_nationkey, c_mktsegment, rich FROM made""")
def _(t: Tables):
    table = t.customer.withColumn("rich", F.when(F.col("c_acctbal") > 8000, "yes").otherwise("no"))
    return samplers.smote_interpolate(table, "c_custkey", "rich", ["c_acctbal", "c_nationkey", "c_mktsegment"])


@query("resample_balanced", _SMOTE + f""", pool AS (SELECT 'real|' || id AS pid, bal AS c_acctbal, CAST(nat AS BIGINT) AS c_nationkey, seg AS c_mktsegment, cls AS rich FROM base
    UNION ALL SELECT 'made|' || "row", c_acctbal, CAST(trunc(c_nationkey) AS BIGINT), c_mktsegment, rich FROM made), numbered AS (SELECT *, {dense('pid')} AS i FROM pool)
    SELECT range AS "row", {r('c_acctbal')} AS c_acctbal, c_nationkey, c_mktsegment, rich FROM range((SELECT count(*) FROM customer)) JOIN numbered ON i = {uidx('(SELECT count(*) FROM pool)', SEED, 'bootstrap', 'range')}""")
def _(t: Tables):
    table = t.customer.withColumn("rich", F.when(F.col("c_acctbal") > 8000, "yes").otherwise("no"))
    return samplers.resample_balanced(table, "c_custkey", "rich", ["c_acctbal", "c_nationkey", "c_mktsegment"], table.count())
