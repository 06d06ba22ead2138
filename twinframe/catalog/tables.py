"""Sources, cleaning and profiling over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinframe.catalog.base import Tables, dense, long_sql, query, r, u
from twinframe.functions import scalars
from twinframe.operators import clean, encode, profile
from twinframe.sources import tables as src

# ---------------------------------------------------------------- sources

@query("read_table", "SELECT l_returnflag, count(*) AS n, " + r("sum(l_quantity)") + " AS quantity FROM lineitem GROUP BY 1")
def _(t: Tables):
    return src.read_table(t.spark, t.path("lineitem")).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("write_table", "SELECT o_orderkey, o_orderpriority, " + r("o_totalprice") + " AS o_totalprice FROM orders")
def _(t: Tables):
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    path = src.write_table(rows, t.scratch() + ".csv.gz")
    return src.read_table(t.spark, path, rows.schema)


@query("read_delimited_dirty", """SELECT c_custkey, nullif(c_mktsegment, 'MACHINERY') AS segment,
    (round(c_acctbal, 2) + 0.0) AS balance FROM customer""")
def _(t: Tables):
    lines = t.customer.select(F.concat_ws(
        "; ", F.col("c_custkey").cast("string"), F.when(F.col("c_mktsegment") == "MACHINERY", "?").otherwise(F.col("c_mktsegment")),
        F.col("c_acctbal").cast("decimal(18,2)").cast("string")))
    path = t.scratch() + ".csv"
    lines.write.text(path)
    raw = src.read_delimited_dirty(t.spark, path, ["key", "segment", "balance"], sep=";", skip_prefix="|")
    return raw.select(F.col("key").cast("bigint").alias("c_custkey"), "segment",
                      scalars.coerce_numeric(F.col("balance")).alias("balance"))


_FLAG_LABELS = {"A": "Accepted", "R": "Returned"}
_RESULTS_SQL = """SELECT l_returnflag AS method, l_linestatus AS dataset, count(*) AS n, {mean} AS mean_price
    FROM lineitem GROUP BY 1, 2""".format(mean=r("avg(l_extendedprice)"))


def _result_files(t: Tables) -> str:
    """One result file per method, as a comparison run leaves them; the later file lacks a column."""
    folder = t.scratch()
    base = t.lineitem.groupBy(F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("dataset")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_extendedprice").alias("mean_price"))
    src.write_table(base.filter("method <> 'N'"), f"{folder}/first_comparison.csv")
    src.write_table(base.filter("method = 'N'").drop("mean_price"), f"{folder}/second_comparison.csv")
    return folder


@query("read_result_set", f"""SELECT method, dataset, n, CASE WHEN method = 'N' THEN NULL ELSE mean_price END AS mean_price,
    CASE method WHEN 'A' THEN 'Accepted' WHEN 'R' THEN 'Returned' ELSE method END AS label,
    CAST(NULL AS DOUBLE) AS fit_seconds FROM ({_RESULTS_SQL})""")
def _(t: Tables):
    folder = _result_files(t)
    whole = src.read_result_set(t.spark, f"{folder}/first_comparison.csv", columns=["fit_seconds"], labels=_FLAG_LABELS)
    part = src.read_result_set(t.spark, f"{folder}/second_comparison.csv", columns=["mean_price", "fit_seconds"], labels=_FLAG_LABELS)
    return whole.unionByName(part)


@query("read_result_with_reference_rows", f"""SELECT method, dataset, n, mean_price FROM ({_RESULTS_SQL}) WHERE method <> 'N'
    UNION ALL SELECT method, dataset, n, NULL FROM ({_RESULTS_SQL}) WHERE method = 'N' AND dataset = 'O'""")
def _(t: Tables):
    folder = _result_files(t)
    main, extra = (src.read_result_set(t.spark, f"{folder}/{n}_comparison.csv") for n in ("first", "second"))
    return src.with_reference_rows(main, extra, "dataset", ["O"])


@query("method_label", """SELECT l_returnflag AS method, CASE l_returnflag WHEN 'A' THEN 'Accepted' WHEN 'R' THEN 'Returned'
    ELSE l_returnflag END AS label, count(*) AS n FROM lineitem GROUP BY 1""")
def _(t: Tables):
    return src.add_labels(t.lineitem.groupBy(F.col("l_returnflag").alias("method")).agg(F.count(F.lit(1)).alias("n")),
                          _FLAG_LABELS, "method", "label")


@query("load_prepared_table", "SELECT p_partkey, p_brand, p_type, p_size, " + r("p_retailprice") + " AS p_retailprice FROM part")
def _(t: Tables):
    return clean.drop_redundant_columns(src.read_table(t.spark, t.path("part")), ["p_name", "absent"])


# ---------------------------------------------------------------- cleaning

@query("drop_redundant_columns", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def _(t: Tables):
    return clean.drop_redundant_columns(t.orders, ["o_totalprice", "o_custkey", "o_orderdate", "absent"])


@query("null_sentinels", """SELECT event_id, CASE WHEN event_type IN ('error') THEN NULL ELSE rtrim(trim(event_type || '..'), '.') END
    AS kind FROM events""")
def _(t: Tables):
    dirty = t.events.select("event_id", F.when(F.col("event_type") == "error", F.lit(" ? ")).otherwise(
        F.concat(F.lit("  "), "event_type", F.lit(".. "))).alias("kind"))
    return clean.clean_text(dirty, ["kind"], sentinels=("?", ""))


@query("zero_as_null", "SELECT l_orderkey, l_linenumber, " + r("nullif(l_tax, 0)") + " AS tax FROM lineitem")
def _(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", scalars.zero_as_null(F.col("l_tax")).alias("tax"))


@query("recode_values", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS status FROM orders""")
def _(t: Tables):
    return t.orders.select("o_orderkey", scalars.recode(F.col("o_orderstatus"), {"F": "finished", "O": "open"}).alias("status"))


@query("threshold_label", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'credit' ELSE 'debt' END AS side FROM customer")
def _(t: Tables):
    return t.customer.select("c_custkey", scalars.threshold_label(F.col("c_acctbal"), 0, "credit", "debt").alias("side"))


@query("rename_columns", "SELECT s_suppkey AS supplier, s_name AS name, s_nationkey AS s_nationkey, " + r("s_acctbal") + " AS balance FROM supplier")
def _(t: Tables):
    return clean.rename_columns(t.supplier, {"s_suppkey": "supplier", "s_name": "name", "s_acctbal": "balance"})


@query("coerce_numeric", "SELECT event_id, " + r("TRY_CAST(regexp_extract(props, ': (\\d+)', 1) AS DOUBLE)") +
       " AS k, TRY_CAST(event_type AS DOUBLE) AS bad FROM events")
def _(t: Tables):
    return t.events.select("event_id", scalars.coerce_numeric(F.regexp_extract("props", r": (\d+)", 1)).alias("k"),
                           scalars.coerce_numeric(F.col("event_type")).alias("bad"))


@query("collapse_one_hot", """SELECT l_orderkey, l_linenumber, 'flag_' || CASE l_returnflag WHEN 'A' THEN '01' WHEN 'N' THEN '02' ELSE '03' END AS flag FROM lineitem""")
def _(t: Tables):
    wide = t.lineitem.select("l_orderkey", "l_linenumber", *[(F.col("l_returnflag") == f).cast("int").alias(f"is_{f}") for f in "ANR"])
    return wide.select("l_orderkey", "l_linenumber", scalars.collapse_one_hot(["is_A", "is_N", "is_R"], "flag_%02d").alias("flag"))


@query("union_train_test", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(t: Tables):
    first, second = t.orders.filter("o_orderstatus = 'F'"), t.orders.filter("o_orderstatus <> 'F'")
    return clean.union_splits(first, second).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("band_numeric", """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.8) AS b FROM orders)
    SELECT o_orderkey, CASE WHEN o_totalprice <= a THEN 'basic' WHEN o_totalprice <= b THEN 'team' ELSE 'enterprise' END AS tier FROM orders, q""")
def _(t: Tables):
    from twinframe.functions.ordered import quantiles
    long = t.orders.select(F.lit("p").alias("g"), F.col("o_totalprice").alias("v"))
    cuts = [x["quantile"] for x in quantiles(long, ["g"], "v", [0.25, 0.8]).orderBy("probability").collect()]
    return t.orders.select("o_orderkey", scalars.band(F.col("o_totalprice"), cuts, ["basic", "team", "enterprise"]).alias("tier"))


@query("split_column_kinds", """SELECT * FROM (SELECT 'l_quantity' AS "column", CASE WHEN count(DISTINCT l_quantity) > 2 THEN 'numeric' ELSE 'categorical' END AS kind FROM lineitem
    UNION ALL SELECT 'l_tax', CASE WHEN count(DISTINCT l_tax) > 2 THEN 'numeric' ELSE 'categorical' END FROM lineitem
    UNION ALL SELECT 'two', CASE WHEN count(DISTINCT l_linenumber % 2) > 2 THEN 'numeric' ELSE 'categorical' END FROM lineitem
    UNION ALL SELECT 'l_returnflag', 'categorical' UNION ALL SELECT 'is_open', 'categorical')""")
def _(t: Tables):
    return profile.column_kinds(t.lineitem.select("l_quantity", "l_tax", (F.col("l_linenumber") % 2).alias("two"), "l_returnflag",
                                                  (F.col("l_linestatus") == "O").alias("is_open")))


@query("categorical_columns", """SELECT 'o_orderstatus' AS "column" UNION ALL SELECT 'o_orderpriority'""")
def _(t: Tables):
    kinds = profile.column_kinds(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"))
    return kinds.filter("kind = 'categorical'").select("column")


@query("category_keys", "SELECT doc_id, coalesce(nullif(lang, 'en'), '__MISSING__') AS key FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", scalars.category_key(F.nullif(F.col("lang"), F.lit("en"))).alias("key"))


@query("category_value_map", """SELECT 'brand' AS "column", coalesce(p_brand, '__MISSING__') AS key, p_brand AS value FROM part GROUP BY 2, 3""")
def _(t: Tables):
    return encode.category_value_map(t.part.select("p_partkey", F.col("p_brand").alias("brand")), ["brand"], "p_partkey")


@query("restore_types", "SELECT c_custkey, CAST(trunc(c_acctbal / 7.0) AS BIGINT) AS whole, c_mktsegment FROM customer")
def _(t: Tables):
    made = t.customer.select("c_custkey", (F.col("c_acctbal") / 7.0).alias("whole"), "c_mktsegment")
    return encode.restore_types(made, {"c_custkey": "bigint", "whole": "bigint", "c_mktsegment": "string"})


@query("align_features", "SELECT 'real' AS side, count(*) AS n, " + r("sum(acctbal)") + " AS total FROM (SELECT c_acctbal AS acctbal FROM customer)"
       " UNION ALL SELECT 'synthetic', count(*), " + r("sum(s_acctbal)") + " FROM supplier")
def _(t: Tables):
    real = t.customer.select(F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nation"), "c_mktsegment")
    made = t.supplier.select("s_name", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("acctbal"))
    a, b = clean.align_features(real, made, target="nation")
    assert a.columns == b.columns == ["acctbal"]
    return a.agg(F.lit("real").alias("side"), F.count(F.lit(1)).alias("n"), F.sum("acctbal").alias("total")).unionByName(
        b.agg(F.lit("synthetic").alias("side"), F.count(F.lit(1)).alias("n"), F.sum("acctbal").alias("total")))


@query("align_schema_with_nulls", "SELECT s_nationkey AS nation, CAST(NULL AS VARCHAR) AS segment, " + r("s_acctbal") + " AS acctbal FROM supplier")
def _(t: Tables):
    like = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("acctbal"))
    return clean.align_schema_with_nulls(t.supplier.select(F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nation"), "s_name"), like)


@query("snap_target_to_class", """WITH c AS (SELECT DISTINCT CAST(l_linenumber AS DOUBLE) AS k FROM lineitem),
    v AS (SELECT DISTINCT l_quantity / 6.0 AS x FROM lineitem),
    m AS (SELECT x, min_by(k, (abs(x - k), k)) AS k FROM v, c GROUP BY x)
    SELECT l_orderkey, l_linenumber, (k + 0.0) AS label FROM lineitem JOIN m ON x = l_quantity / 6.0""")
def _(t: Tables):
    made = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 6.0).alias("label"))
    return clean.snap_target_to_class(made, t.lineitem.select(F.col("l_linenumber").alias("label")), "label")


@query("drop_null_target", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def _(t: Tables):
    return clean.drop_null_target(t.lineitem.withColumn("l_returnflag", F.nullif(F.col("l_returnflag"), F.lit("N"))), "l_returnflag").groupBy(
        "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("cardinality_bucket", """SELECT name, CASE WHEN n <= 2 THEN 'binary' WHEN n <= 10 THEN 'low' WHEN n <= 50 THEN 'medium' ELSE 'high' END AS bucket FROM (
    SELECT 'p_brand' AS name, count(DISTINCT p_brand) AS n FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part
    UNION ALL SELECT 'p_name', count(DISTINCT p_name) FROM part)""")
def _(t: Tables):
    return profile.table_profile(t.part, ["p_brand", "p_type", "p_name"]).select(
        F.col("column").alias("name"), scalars.cardinality_bucket(F.col("distinct")).alias("bucket"))


@query("positive_negative_class", """SELECT 'linestatus' AS name, min(l_linestatus) AS negative, max(l_linestatus) AS positive FROM lineitem
    UNION ALL SELECT 'quality', CAST(min(quality) AS VARCHAR), CAST(max(quality) AS VARCHAR) FROM labels
    UNION ALL SELECT 'words', min(CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END), max(CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END) FROM labels""")
def _(t: Tables):
    words = t.labels.select(F.when(F.col("toxic") == 1, "yes").otherwise("no").alias("w"))
    parts = [("linestatus", t.lineitem, "l_linestatus"), ("quality", t.labels, "quality"), ("words", words, "w")]
    out = None
    for name, df, c in parts:
        row = clean.positive_negative_class(df, c).withColumn("name", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("minmax_rescale", """WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_orderstatus <> 'P'),
    m AS (SELECT median(o_totalprice) AS md FROM orders WHERE o_orderstatus <> 'P')
    SELECT o_orderkey, """ + r("10 + 34 * ((CASE WHEN o_orderstatus = 'P' THEN md ELSE o_totalprice END - lo) / (hi - lo))") + " AS size FROM orders, s, m")
def _(t: Tables):
    holes = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("x"))
    return clean.rescale_marker(holes, "x").select("o_orderkey", "size")


@query("string_scalars", """SELECT p_partkey, lower(p_brand) AS low, rtrim(trim('  ' || p_type || '..'), '.') AS stripped,
    printf('part_%05d', p_partkey) AS label, concat_ws('/', p_brand, p_type) AS both FROM part""")
def _(t: Tables):
    return t.part.select("p_partkey", F.lower("p_brand").alias("low"),
                         F.rtrim(F.trim(F.concat(F.lit("  "), "p_type", F.lit(".."))), F.lit(".")).alias("stripped"),
                         F.format_string("part_%05d", "p_partkey").alias("label"), F.concat_ws("/", "p_brand", "p_type").alias("both"))


@query("math_scalars", "SELECT o_orderkey, " + ", ".join(f"{r(e)} AS {n}" for n, e in (
    ("e", "exp(o_totalprice / 1000000)"), ("l1", "ln(1 + o_totalprice)"), ("l2", "log2(o_totalprice + 1)"), ("root", "sqrt(o_totalprice)"),
    ("gap", "abs(o_totalprice - 100000)"), ("clipped", "least(greatest(o_totalprice, 50000.0), 150000.0)"),
    ("rint", "round_even(o_totalprice / 1000, 0)"), ("down", "floor(o_totalprice / 1000)"), ("mod", "CAST(o_orderkey % 120 AS DOUBLE)"),
    ("six", "round(o_totalprice / 3, 6)"))) + " FROM orders")
def _(t: Tables):
    x = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey", F.exp(x / 1000000).alias("e"), F.log1p(x).alias("l1"), F.log2(x + 1).alias("l2"), F.sqrt(x).alias("root"),
        F.abs(x - 100000).alias("gap"), F.least(F.greatest(x, F.lit(50000.0)), F.lit(150000.0)).alias("clipped"),
        F.rint(x / 1000).alias("rint"), F.floor(x / 1000).cast("double").alias("down"),
        F.pmod("o_orderkey", F.lit(120)).cast("double").alias("mod"), F.round(x / 3, 6).alias("six"))


@query("array_scalars", """SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS top, list_position(embedding, list_min(embedding)) - 1 AS bottom,
    """ + r("sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))") + " AS norm, " +
       r("list_dot_product(CAST(embedding AS DOUBLE[]), list_reverse(CAST(embedding AS DOUBLE[])))") + " AS dot, len(embedding[5:12]) + len(embedding[1:4]) AS width FROM embeddings")
def _(t: Tables):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select("vec_id", scalars.argmax(v).alias("top"), scalars.argmin(v).alias("bottom"), scalars.norm(v).alias("norm"),
                               scalars.dot(v, F.reverse(v)).alias("dot"), F.size(F.concat(F.slice(v, 5, 8), F.slice(v, 1, 4))).alias("width"))


@query("conditional_scalars", """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_orderstatus IN ('F', 'P') THEN 'closed' ELSE 'rest' END AS pick,
    coalesce(nullif(o_orderpriority, '5-LOW'), 'none') AS filled, nullif(o_orderpriority, '5-LOW') IS NULL AS gone FROM orders""")
def _(t: Tables):
    p = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    return t.orders.select("o_orderkey", F.when(F.col("o_totalprice") > 200000, "high").when(
        F.col("o_orderstatus").isin("F", "P"), "closed").otherwise("rest").alias("pick"), F.coalesce(p, F.lit("none")).alias("filled"), p.isNull().alias("gone"))


@query("category_series", "SELECT CAST(p_size AS VARCHAR) AS key, count(*) AS n FROM part WHERE p_size <> 7 GROUP BY 1")
def _(t: Tables):
    keys = t.part.select(F.nullif(F.col("p_size"), F.lit(7)).cast("string").alias("key"))
    return keys.na.drop().groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("safe_ratio", "SELECT l_linestatus, " + r("sum(l_tax) / nullif(sum(CASE WHEN l_returnflag = 'N' THEN 0 ELSE 0 END), 0)") + " AS none, " +
       r("sum(l_tax) / nullif(sum(l_discount), 0)") + " AS ratio FROM lineitem GROUP BY 1")
def _(t: Tables):
    return t.lineitem.groupBy("l_linestatus").agg(scalars.safe_ratio(F.sum("l_tax"), F.sum(F.lit(0))).alias("none"),
                                                  scalars.safe_ratio(F.sum("l_tax"), F.sum("l_discount")).alias("ratio"))


@query("safe_mean", "SELECT l_returnflag, " + r("avg(CASE WHEN l_quantity > 10 THEN l_tax END)") + " AS some, NULL::DOUBLE AS none FROM lineitem GROUP BY 1")
def _(t: Tables):
    some = F.when(F.col("l_quantity") > 10, F.col("l_tax")).otherwise(F.lit(float("nan")))
    return t.lineitem.groupBy("l_returnflag").agg(scalars.safe_mean(some).alias("some"), scalars.safe_mean(F.lit(float("nan"))).alias("none"))


# ---------------------------------------------------------------- profile

def _profile_sql(table: str, cols: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{k}' AS dtype, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "distinct", count(*) AS rows FROM {table}"""
        for c, k in cols.items())


_EVENTS = {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}
_EVENTS_SQL = "(SELECT event_id, user_id, nullif(event_type, 'error') AS event_type, value, props FROM events)"


def _events(t: Tables):
    return t.events.select("event_id", "user_id", F.nullif(F.col("event_type"), F.lit("error")).alias("event_type"), "value", "props")


@query("table_profile", _profile_sql(_EVENTS_SQL, _EVENTS))
def _(t: Tables):
    return profile.table_profile(_events(t))


@query("column_summary", "WITH n AS (" + long_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "") + """),
    k AS (SELECT 'l_returnflag' AS col, l_returnflag AS v FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem),
    c AS (SELECT col, v, count(*) AS n, sum(count(*)) OVER (PARTITION BY col) AS total FROM k GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS rk FROM c)
    SELECT col AS "column", 0.0::DOUBLE AS missing_rate, """ + f"{r('avg(v)')} AS mean, {r('stddev_samp(v)')} AS std, {r('min(v)')} AS min, {r('max(v)')} AS max, {r('median(v)')} AS median," +
       """ count(DISTINCT v) AS "distinct", CAST(NULL AS VARCHAR) AS top_values, 'double' AS dtype FROM n GROUP BY 1
    UNION ALL SELECT col, 0.0, NULL, NULL, NULL, NULL, NULL, count(*), string_agg(printf('%s: %.1f%%', v, 100.0 * n / total), ', ' ORDER BY rk), 'string' FROM o GROUP BY 1""")
def _(t: Tables):
    return profile.column_summary(t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"))


@query("dataset_inventory", """SELECT 'orders' AS dataset, count(*) AS rows, 3::BIGINT AS numeric_columns, 3::BIGINT AS categorical_columns, 0::BIGINT AS missing FROM orders
    UNION ALL SELECT 'events', count(*), 3, 2, count(*) FILTER (event_type = 'error') FROM events
    UNION ALL SELECT 'part', count(*), 3, 3, 0 FROM part""")
def _(t: Tables):
    return profile.dataset_inventory({"orders": t.orders, "events": _events(t), "part": t.part})


def _plan_sql(cols: dict[str, tuple[str, bool]]) -> str:
    parts = []
    for c, (k, number) in cols.items():
        parts.append(f"""SELECT '{c}' AS "column", '{k}' AS dtype, count(DISTINCT {c}) AS "distinct", count(*) - count({c}) AS missing,
            {r(f'count(DISTINCT {c}) * 1.0 / count(*)')} AS distinct_share, '{'standardised_numeric' if number else 'categorical_projection'}' AS strategy,
            {1 if number else (1 if c == 'event_type' else 2)}::BIGINT AS latent_width,
            {'false' if number else f'count(DISTINCT {c}) > greatest(50, CAST(floor(count(*) * 0.3) AS BIGINT))'} AS wide_category FROM {_EVENTS_SQL}""")
    return " UNION ALL ".join(parts)


@query("encoding_plan", _plan_sql({c: (k, c in ("event_id", "user_id", "value")) for c, k in _EVENTS.items()}))
def _(t: Tables):
    return profile.encoding_plan(_events(t), {"event_type": 1}).drop("rationale")


@query("drop_plan", """SELECT d.* FROM (SELECT 'c_name' AS "column", 'drop' AS action, 'redundant alias or duplicate of the target' AS reason,
    count(DISTINCT c_name) AS "distinct", count(*) - count(c_name) AS missing FROM customer) d""")
def _(t: Tables):
    plan = profile.drop_plan(t.customer, ["c_name", "not_there"])
    return plan.join(profile.table_profile(t.customer, ["c_name"]).select("column", "distinct", "missing"), "column")


_SHARED = {"c_nationkey": True, "c_acctbal": True, "c_name": False}


@query("common_columns", " UNION ALL ".join(f"""SELECT '{c}' AS "column", {str(n).lower()} AS is_numeric, count(DISTINCT {c}) AS "distinct" FROM
    (SELECT {c} FROM customer UNION ALL SELECT {'s' + c[1:]} FROM supplier)""" for c, n in _SHARED.items()))
def _(t: Tables):
    """Columns that customers and suppliers share, and their values on both sides."""
    other = t.supplier.select(*[F.col(c).alias("c" + c[1:]) for c in t.supplier.columns])
    numeric, categorical = profile.common_names(t.customer, other)
    both = t.customer.select(*numeric, *categorical).unionByName(other.select(*numeric, *categorical))
    found = profile.table_profile(both).select("column", F.col("column").isin(numeric).alias("is_numeric"), "distinct")
    return found


@query("high_cardinality_check", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT coalesce({c}, '__MISSING__')) AS "distinct", count(*) AS rows,
    count(DISTINCT coalesce({c}, '__MISSING__')) > greatest(50, CAST(floor(count(*) * 0.3) AS BIGINT)) AS wide FROM customer""" for c in ("c_name", "c_mktsegment")))
def _(t: Tables):
    return profile.high_cardinality_check(t.customer, ["c_name", "c_mktsegment"])


@query("impute_median", "WITH m AS (SELECT median(nullif(l_tax, 0)) AS md FROM lineitem) SELECT l_orderkey, l_linenumber, " + r("coalesce(nullif(l_tax, 0), md)") + " AS tax FROM lineitem, m")
def _(t: Tables):
    return encode.impute_median(t.lineitem.select("l_orderkey", "l_linenumber", scalars.zero_as_null(F.col("l_tax")).alias("tax")), ["tax"])


@query("impute_mode", """WITH m AS (SELECT lang FROM documents WHERE lang <> 'en' GROUP BY 1 ORDER BY count(*) DESC, lang LIMIT 1)
    SELECT doc_id, coalesce(nullif(documents.lang, 'en'), m.lang) AS lang FROM documents, m""")
def _(t: Tables):
    return encode.impute_mode(t.documents.select("doc_id", F.nullif(F.col("lang"), F.lit("en")).alias("lang")), ["lang"])


@query("standardise", "WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders) SELECT o_orderkey, " + r("(o_totalprice - m) / s") + " AS z FROM orders, s")
def _(t: Tables):
    enc = encode.fit_encoding(t.orders, ["o_totalprice"])
    return t.orders.select("o_orderkey", encode.standardised(t.orders, enc, "o_totalprice").alias("z"))


@query("quantile_bounds", "WITH l AS (" + long_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "") + f""")
    SELECT col AS "column", {r('quantile_cont(v, 0.1)')} AS low, {r('quantile_cont(v, 0.9)')} AS high FROM l GROUP BY 1""")
def _(t: Tables):
    from twinframe.functions.ordered import quantiles
    long = encode._long_numbers(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return quantiles(long, ["column"], "value", [0.1, 0.9]).groupBy("column").agg(F.min("quantile").alias("low"), F.max("quantile").alias("high"))


@query("quick_similarity", f"""SELECT 'balance' AS "column", 'numeric' AS kind, {r('a.m')} AS real_mean, {r('b.m')} AS synthetic_mean, {r('abs(a.m - b.m)')} AS abs_mean_delta,
    0.0::DOUBLE AS real_missing, 0.0::DOUBLE AS synthetic_missing, CAST(NULL AS BIGINT) AS real_unique, CAST(NULL AS BIGINT) AS synthetic_unique, CAST(NULL AS DOUBLE) AS category_coverage
    FROM (SELECT avg(c_acctbal) AS m FROM customer) a, (SELECT avg(s_acctbal) AS m FROM supplier) b
    UNION ALL SELECT 'nation', 'categorical', NULL, NULL, NULL, {r("(SELECT avg(CAST(c_nationkey = 3 AS INT)) FROM customer)")}, 0.0, (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey <> 3), (SELECT count(DISTINCT s_nationkey) FROM supplier),
    {r("(SELECT count(*) FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey <> 3) WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)) * 1.0 / (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey <> 3)")}""")
def _(t: Tables):
    real = t.customer.select(F.col("c_acctbal").alias("balance"), F.nullif(F.col("c_nationkey"), F.lit(3)).cast("string").alias("nation"))
    return profile.quick_similarity(real, t.supplier.select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("string").alias("nation")))


@query("top_values", """SELECT 'p_name' AS "column", rank, value, n, share FROM (SELECT p_name AS value, count(*) AS n, """ + r("count(*) * 1.0 / sum(count(*)) OVER ()") +
       " AS share, row_number() OVER (ORDER BY count(*) DESC, p_name) AS rank FROM part GROUP BY 1) WHERE rank <= 8")
def _(t: Tables):
    return profile.top_values(t.part, ["p_name"], 8)


@query("first_columns_limit", "SELECT l_orderkey, l_partkey, " + r("l_quantity") + " AS l_quantity FROM lineitem")
def _(t: Tables):
    names = profile.numeric_names(t.lineitem, exclude=["l_suppkey", "l_linenumber"])[:3]
    return t.lineitem.select(*names)


@query("other_columns", "SELECT s_name, s_nationkey FROM supplier")
def _(t: Tables):
    return t.supplier.select(*[c for c in t.supplier.columns if c not in ("s_suppkey", "s_acctbal")])


