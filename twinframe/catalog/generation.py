"""Latent encoding, transport, decoding and the fitted model, on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinframe.catalog.base import Tables, dense, query, r, u, uidx
from twinframe.catalog.measures import DIST, KNN, MUTUAL, Z, _JOINT, customer_edges, customer_latent
from twinframe.operators import decode, encode, neighbours, project, transport
from twinframe.plans import job, model
from twinframe.session import checkpoint

COLUMNS = ["c_acctbal", "c_nationkey", "c_mktsegment"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
SEED = 42
# Forests and projections have the published settings; projections are fitted on all rows.
SETTINGS = dict(n_components=1, n_neighbours=6, factor=0.25, n_iterations=0)


def params(**changes) -> model.Params:
    return model.Params(**{**SETTINGS, **changes})


def customer_model(t: Tables, **changes) -> model.TableModel:
    return model.fit(t.customer, "c_custkey", columns=COLUMNS, params=params(**changes))


def spread(df, key: str, vec: str = "z", name: str = "value"):
    """(key, position, value) rows of a vector column."""
    return df.select(key, F.posexplode(vec).alias("position", name))


# ---------------------------------------------------------------- encoding

@query("one_hot_block", "SELECT c_custkey, k.position, CAST(coalesce(c_mktsegment, '__MISSING__') = k.key AS DOUBLE) AS value FROM customer, (SELECT key, row_number() OVER (ORDER BY key) - 1 AS position FROM (SELECT DISTINCT c_mktsegment AS key FROM customer)) k")
def _(t: Tables):
    enc = encode.fit_encoding(t.customer, ["c_mktsegment"])
    return spread(t.customer.select("c_custkey", encode.one_hot(t.customer, enc, "c_mktsegment").alias("z")), "c_custkey")


_Z_SQL = f"""WITH {Z}, lat AS (SELECT id, 0 AS position, a AS value FROM z UNION ALL SELECT id, 1, b FROM z {' '.join(f"UNION ALL SELECT id, {i + 2}, CAST(seg = '{s}' AS DOUBLE) FROM z" for i, s in enumerate(SEGMENTS))})"""


@query("assemble_latent", _Z_SQL + f" SELECT id AS c_custkey, CAST(position AS BIGINT) AS position, {r('value')} AS value FROM lat")
def _(t: Tables):
    return spread(customer_latent(t), "c_custkey")


@query("context_without_column", _Z_SQL + f" SELECT id AS c_custkey, CAST(position AS BIGINT) AS position, {r('value')} AS value FROM lat WHERE position < 2")
def _(t: Tables):
    enc = encode.fit_encoding(t.customer, COLUMNS)
    z = encode.encode(t.customer, enc)
    context = encode.without_block(F.col("z"), enc.blocks()["c_mktsegment"], enc.width)
    return spread(z.select("c_custkey", context.alias("z")), "c_custkey")


@query("joint_feature_matrix", _JOINT + f" SELECT side, id, 0::BIGINT AS position, {r('a')} AS value FROM f UNION ALL SELECT side, id, 1, {r('b')} FROM f")
def _(t: Tables):
    from twinframe.catalog.measures import _parties
    out = encode.joint_features(*_parties(t), real_id="cid", synthetic_id="sid")
    return out.select("side", "id", F.posexplode("z").alias("position", "value"))


PARTS = ["p_retailprice", "p_size", "p_type", "p_name"]  # two numbers, two wide categories
_SLOTS = """SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) - 1 AS a, (SELECT count(DISTINCT p_type) FROM part) + dense_rank() OVER (ORDER BY p_name) - 1 AS b FROM part"""


@query("sparse_latent", f"SELECT p_partkey, slot, 1.0::DOUBLE AS value FROM (SELECT p_partkey, a AS slot FROM ({_SLOTS}) UNION ALL SELECT p_partkey, b FROM ({_SLOTS}))")
def _(t: Tables):
    z = encode.encode(t.part, encode.fit_encoding(t.part, PARTS, narrow=0))
    entries = F.arrays_zip(F.col("_slots.indices").alias("slot"), F.col("_slots.values").alias("value"))
    return z.select("p_partkey", F.explode(entries).alias("e")).select("p_partkey", "e.*")


@query("knn_exact_sparse", f"""WITH z AS (SELECT p_partkey AS id, (p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part) AS x,
        (p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part) AS y, p_type AS t, p_name AS n FROM part),
    pairs AS (SELECT p.id AS src, q.id AS dst, round(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + 2 * CAST(p.t <> q.t AS INT) + 2 * CAST(p.n <> q.n AS INT)), 9) AS d
        FROM z p JOIN z q ON p.id <> q.id)
    SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rank, {r('d')} AS dist FROM pairs QUALIFY rank <= 4""")
def _(t: Tables):
    enc = encode.fit_encoding(t.part, PARTS, narrow=8)
    z = encode.encode(t.part, enc).select("p_partkey", encode.search_vector(list(enc.slots().values())).alias("v"))
    return neighbours.knn_exact(checkpoint(z), "p_partkey", "v", 4, metric=neighbours.coded(enc.width))


@query("nca_projection")
def _(t: Tables):
    enc = encode.fit_encoding(t.customer, ["c_acctbal", "c_nationkey"])
    table = encode.encode(t.customer, enc).select("c_custkey", "z", "c_mktsegment")
    matrix = project.nca_fit(table, "c_custkey", "z", "c_mktsegment", 1)
    return spread(table.select("c_custkey", project.apply_matrix(F.col("z"), matrix, 2).alias("z")), "c_custkey")


@query("iterative_refit")
def _(t: Tables):
    fitted = model.fit_latent(t.customer, "c_custkey", COLUMNS, params(n_iterations=1))
    return spread(fitted.latent, "row_id")


@query("transform_rows", _Z_SQL + f" SELECT id AS c_custkey, CAST(position AS BIGINT) AS position, {r('value')} AS value FROM lat")
def _(t: Tables):
    fitted = model.fit_latent(t.customer, "c_custkey", COLUMNS, params())
    return spread(fitted.transform(t.customer), "c_custkey")


@query("pca_projection")
def _(t: Tables):
    return spread(project.pca_projection(t.embeddings, "embedding", 3), "vec_id", "pca")


@query("project_two_dims")
def _(t: Tables):
    half = {"real": t.embeddings.filter("label < 5"), "generated": t.embeddings.filter("label >= 5")}
    return project.project_two_dims({k: d.select("vec_id", "embedding") for k, d in half.items()}, "embedding").select("side", "vec_id", "x", "y")


@query("latent_view", f"WITH {Z} SELECT id AS c_custkey, {r('a')} AS latent_0, {r('b')} AS latent_1, " + ", ".join(f"CAST(seg = '{s}' AS DOUBLE) AS latent_{i + 2}" for i, s in enumerate(SEGMENTS)) + " FROM z")
def _(t: Tables):
    return customer_latent(t).select("c_custkey", *[F.col("z")[i].alias(f"latent_{i}") for i in range(7)])


@query("latent_view_without_target", f"WITH {Z} SELECT id AS c_custkey, {r('a')} AS latent_0, {r('b')} AS latent_1, seg AS c_mktsegment FROM z")
def _(t: Tables):
    fitted = model.fit_latent(t.customer, "c_custkey", COLUMNS, params())
    view = fitted.transform(t.customer).select("c_custkey", fitted.context("c_mktsegment").alias("x"), "c_mktsegment")
    return view.select("c_custkey", F.col("x")[0].alias("latent_0"), F.col("x")[1].alias("latent_1"), "c_mktsegment")


# ---------------------------------------------------------------- anchors and transport

def mutual(t: Tables):
    return checkpoint(neighbours.mutual_neighbours(checkpoint(customer_edges(t))))


def classes(t: Tables):
    return t.customer.select(F.col("c_custkey").alias("src"), F.col("c_mktsegment").alias("cls"))


@query("anchor_weights", MUTUAL + f" SELECT src, count(*) AS degree, {r('count(*) * 1.0 / (SELECT count(*) FROM mutual)')} AS weight FROM mutual GROUP BY 1")
def _(t: Tables):
    return transport.anchor_weights(mutual(t))


@query("anchor_weights_by_class", MUTUAL + f""", d AS (SELECT z.id AS src, seg, count(m.src) AS degree FROM z LEFT JOIN mutual m ON m.src = z.id GROUP BY 1, 2)
    SELECT src, degree, {r('degree * 1.0 / sum(degree) OVER (PARTITION BY seg) / (SELECT count(DISTINCT seg) FROM z)')} AS weight FROM d""")
def _(t: Tables):
    return transport.anchor_weights(mutual(t), classes(t))


@query("valid_anchors", MUTUAL + " SELECT DISTINCT src FROM mutual WHERE dst IN (SELECT src FROM mutual)")
def _(t: Tables):
    return transport.valid_anchors(mutual(t))


@query("class_conditional_anchor", MUTUAL + f""", d AS (SELECT src, count(*) AS degree FROM mutual GROUP BY 1)
    SELECT src, degree, {r('degree * 1.0 / sum(degree) OVER ()')} AS weight FROM d JOIN z ON z.id = src AND seg = 'BUILDING'""")
def _(t: Tables):
    return transport.class_conditional_anchor(transport.anchor_weights(mutual(t)), classes(t), "BUILDING")


_EDGES = MUTUAL + f""", num AS (SELECT src, dst, {dense("(src || '|' || dst)")} AS e, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS slot, count(*) OVER (PARTITION BY src) AS degree FROM mutual),
    tot AS (SELECT count(*) AS n FROM mutual), draws AS (SELECT a.range AS "row", b.range AS attempt FROM range((SELECT count(*) FROM customer)) a, range(LASTTRY) b),
    ab AS (SELECT "row", attempt, src AS anchor, dst AS b FROM draws, tot JOIN num ON e = {uidx('n', SEED, 'edge', '"row"', 'attempt')}),
    abc AS (SELECT ab."row", attempt, anchor, b, nb.dst AS c FROM ab JOIN num nb ON nb.src = ab.b AND nb.slot = {uidx('nb.degree', SEED, 'third', 'ab."row"', 'attempt')})"""
_MOVED = _EDGES + f""", moved AS (SELECT "row", attempt, anchor, abc.b, abc.c, za.a + 0.25 * (zc.a - zb.a) AS z0, za.b + 0.25 * (zc.b - zb.b) AS z1,
    {', '.join(f"CAST(za.seg = '{s}' AS INT) + 0.25 * (CAST(zc.seg = '{s}' AS INT) - CAST(zb.seg = '{s}' AS INT)) AS s{i}" for i, s in enumerate(SEGMENTS))}
    FROM abc JOIN z za ON za.id = anchor JOIN z zb ON zb.id = abc.b JOIN z zc ON zc.id = abc.c)"""


@query("sample_anchor", _EDGES.replace("LASTTRY", "1") + ' SELECT "row", anchor, b, c FROM abc')
def _(t: Tables):
    draws = t.spark.range(t.customer.count()).select(F.col("id").alias("row"), F.lit(0).alias("attempt"))
    return transport.transport_draws(mutual(t), draws, SEED).select("row", "anchor", "b", "c")


def _wide(df):
    return df.select(*[c for c in df.columns if c != "z"], F.col("z")[0].alias("z0"), F.col("z")[1].alias("z1"),
                     *[F.col("z")[i + 2].alias(f"s{i}") for i in range(5)])


_MOVED_COLS = '"row", attempt, anchor, b, c, ' + ", ".join(f"{r(f'CAST({c} AS DOUBLE)')} AS {c}" for c in ["z0", "z1", "s0", "s1", "s2", "s3", "s4"])


@query("transport_candidates", _MOVED.replace("LASTTRY", "1") + f" SELECT {_MOVED_COLS} FROM moved")
def _(t: Tables):
    latent = checkpoint(customer_latent(t))
    draws = t.spark.range(latent.count()).select(F.col("id").alias("row"), F.lit(0).alias("attempt"))
    return _wide(transport.transport_candidates(latent, "c_custkey", mutual(t), draws, seed=SEED, factor=0.25, min_factor=0.25))


_GUARDED = _MOVED.replace("LASTTRY", "6") + """, bd AS (SELECT quantile_cont(a, 0.1) AS la, quantile_cont(a, 0.9) AS ha, quantile_cont(b, 0.1) AS lb, quantile_cont(b, 0.9) AS hb FROM z),
    ok AS (SELECT moved.*, z0 BETWEEN la AND ha AND z1 BETWEEN lb AND hb AS accepted FROM moved, bd),
    kept AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY "row" ORDER BY CASE WHEN accepted THEN attempt ELSE 100 - attempt END) = 1)"""


def guarded(t: Tables):
    latent = checkpoint(customer_latent(t))
    bounds = transport.quantile_bounds(latent, [0, 1], 0.1)
    return transport.generate_latent(latent, "c_custkey", mutual(t), latent.count(), seed=SEED, factor=0.25, min_factor=0.25, bounds=bounds, retries=5)


@query("quantile_guard_retry", _GUARDED + f" SELECT {_MOVED_COLS}, accepted FROM kept")
def _(t: Tables):
    return _wide(guarded(t))


@query("guard_counts", _GUARDED + " SELECT CAST(sum(CASE WHEN accepted THEN attempt ELSE 5 END) AS BIGINT) AS retries, count(*) FILTER (NOT accepted) AS violations FROM kept")
def _(t: Tables):
    return transport.guard_counts(guarded(t), 5)


@query("decode_numeric", _GUARDED + f""" SELECT "row", {r('z0 * (SELECT stddev_pop(c_acctbal) FROM customer) + (SELECT avg(c_acctbal) FROM customer)')} AS c_acctbal,
    CAST(trunc(round(z1 * (SELECT stddev_pop(c_nationkey) FROM customer) + (SELECT avg(c_nationkey) FROM customer), 9)) AS BIGINT) AS c_nationkey FROM kept""")
def _(t: Tables):
    enc = encode.fit_encoding(t.customer, COLUMNS)
    return guarded(t).select("row", *[v.alias(c) for c, v in encode.decode_numeric(F.col("z"), enc).items()])


_CLASS_MUTUAL = f"""WITH {Z}, pairs AS (SELECT x.id AS src, y.id AS dst, {DIST} AS dist FROM z x JOIN z y ON x.id <> y.id AND x.seg = y.seg),
    knn AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank, dist FROM pairs QUALIFY rank <= 4)""" + MUTUAL[len(KNN):]
_THIRD = f"""third AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS slot, count(*) OVER (PARTITION BY src) AS degree FROM mutual),
    draws AS (SELECT range AS "row", 0 AS attempt FROM range((SELECT count(*) FROM customer)))"""
_WITH_C = f"""SELECT "row", anchor, b, t.dst AS c FROM ab JOIN third t ON t.src = b AND t.slot = {uidx('t.degree', SEED, 'third', '"row"', 'attempt')}"""


@query("transport_by_class", _CLASS_MUTUAL + f""", {_THIRD},
    inside AS (SELECT seg, src, dst, {dense("(src || '|' || dst)", "seg")} AS e FROM mutual JOIN z ON z.id = src WHERE dst IN (SELECT src FROM mutual)),
    sizes AS (SELECT seg, n, {dense('seg')} AS ci FROM (SELECT seg, count(*) AS n FROM inside GROUP BY 1)),
    picked AS (SELECT "row", attempt, seg, n FROM draws JOIN sizes ON ci = {uidx('(SELECT count(*) FROM sizes)', SEED, 'class', '"row"', 'attempt')}),
    ab AS (SELECT "row", attempt, src AS anchor, dst AS b FROM picked JOIN inside ON inside.seg = picked.seg AND e = {uidx('n', SEED, 'edge', '"row"', 'attempt')})
    {_WITH_C}""")
def _(t: Tables):
    latent = checkpoint(customer_latent(t))
    edges = checkpoint(neighbours.mutual_neighbours(neighbours.knn_exact(latent, "c_custkey", "z", 4, within="c_mktsegment")))
    made = transport.generate_latent(latent, "c_custkey", edges, latent.count(), seed=SEED, factor=0.25, min_factor=0.25, classes=classes(t))
    return made.select("row", "anchor", "b", "c")


@query("transport_one_class", MUTUAL + f""", {_THIRD},
    live AS (SELECT src, dst, {dense("(src || '|' || dst)")} AS e FROM mutual JOIN z ON z.id = src AND seg = 'BUILDING' WHERE dst IN (SELECT src FROM mutual)),
    ab AS (SELECT "row", attempt, src AS anchor, dst AS b FROM draws JOIN live ON e = {uidx('(SELECT count(*) FROM live)', SEED, 'edge', '"row"', 'attempt')})
    {_WITH_C}""")
def _(t: Tables):
    latent = checkpoint(customer_latent(t))
    made = transport.generate_latent(latent, "c_custkey", mutual(t), latent.count(), seed=SEED, factor=0.25, min_factor=0.25, classes=classes(t), target="BUILDING")
    return made.select("row", "anchor", "b", "c")


# ---------------------------------------------------------------- decoding and the model

@query("prior_decoder", "SELECT c_mktsegment AS class, " + r("count(*) * 1.0 / (SELECT count(*) FROM customer)") + " AS probability FROM customer GROUP BY 1")
def _(t: Tables):
    return decode.class_shares(t.customer, "c_mktsegment")


def _decoded(t: Tables, **changes):
    enc = encode.fit_encoding(t.customer, COLUMNS)
    z = encode.encode(t.customer, enc)
    rows = checkpoint(z.select("c_custkey", encode.without_block(F.col("z"), enc.blocks()["c_mktsegment"], enc.width).alias("x"), F.col("c_mktsegment").alias("label")))
    return rows, decode.fit_decoder(rows, "c_custkey", "x", "label", enc.categories["c_mktsegment"], **changes)


@query("fit_decoders")
def _(t: Tables):
    rows, fitted = _decoded(t)
    out = fitted.probabilities(rows, "x", "p")
    return out.select("c_custkey", "label", F.posexplode_outer("p").alias("position", "probability"))


@query("calibrate_decoders")
def _(t: Tables):
    rows, fitted = _decoded(t, calibrate=True)
    out = fitted.probabilities(rows, "x", "p")
    return out.select("c_custkey", "label", F.lit(fitted.status).alias("status"), F.posexplode_outer("p").alias("position", "probability"))


@query("decode_categorical")
def _(t: Tables):
    rows, fitted = _decoded(t)
    drawn = decode.decode_categorical(rows, fitted, "x", "drawn", sample=True, seed=SEED, row="c_custkey")
    return decode.decode_categorical(drawn, fitted, "x", "likely", sample=False, seed=SEED, row="c_custkey").select("c_custkey", "label", "drawn", "likely")


@query("generate_rows")
def _(t: Tables):
    return customer_model(t).generate()


@query("generate_wide_category", "SELECT count(*) AS rows, 0::BIGINT AS unknown, true AS fitted FROM customer")
def _(t: Tables):
    """A category of more than a hundred keys still has a fitted forest, and only its own keys come out."""
    wide = t.customer.select("c_custkey", "c_acctbal", F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("c_place"))
    fitted = model.fit(wide, "c_custkey", params=params())
    known = wide.select(F.col("c_place").alias("k"), F.lit(1).alias("known")).distinct()
    return fitted.generate().join(known, F.col("c_place") == F.col("k"), "left").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("known").isNull(), 1)).alias("unknown"),
        F.lit(bool(fitted.decoders["c_place"].forests)).alias("fitted"))


@query("generate_key_category", "SELECT count(*) AS rows, 0::BIGINT AS unknown, true AS walked FROM part")
def _(t: Tables):
    """A category with a key for nearly each row: sparse entries, a label tree, and only known keys come out."""
    wide = t.part.select("p_partkey", "p_retailprice", "p_size", "p_type", F.concat_ws("-", "p_name", F.pmod("p_partkey", F.lit(1000)).cast("string")).alias("p_key"))
    fitted = model.fit(wide, "p_partkey", params=params())
    known = wide.select(F.col("p_key").alias("k"), F.lit(1).alias("known")).distinct()
    return fitted.generate().join(known, F.col("p_key") == F.col("k"), "left").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("known").isNull(), 1)).alias("unknown"),
        F.lit(len(fitted.decoders["p_key"].levels) > 1).alias("walked"))


@query("make_generator")
def _(t: Tables):
    fitted = customer_model(t, search="approx")
    return fitted.generate_latent().drop("z")


@query("inverse_transform")
def _(t: Tables):
    fitted = customer_model(t)
    return fitted.inverse_transform(fitted.latent.withColumnRenamed("row_id", "row"), sample=False)


@query("generation_trace")
def _(t: Tables):
    shares = F.transform_values("probabilities.c_mktsegment", lambda k, p: F.round(p, 6))
    return customer_model(t).trace().withColumn("displacement", F.array_join(F.transform("displacement", lambda x: F.round(x, 4).cast("string")), ",")
                                                ).withColumn("probabilities", F.to_json(F.struct(shares.alias("c_mktsegment"))))


@query("generate_two_column")
def _(t: Tables):
    points = t.part.select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return model.fit(points, "p_partkey", params=params()).generate()


@query("generate_to_sink")
def _(t: Tables):
    path = job.generate_to_sink(customer_model(t), t.scratch() + ".parquet")
    return t.spark.read.parquet(path)


@query("model_save_load")
def _(t: Tables):
    path = customer_model(t).save(t.scratch())
    return model.TableModel.load(t.spark, path).generate()


@query("fit_generate_job")
def _(t: Tables):
    folder = t.scratch()
    t.customer.select(*COLUMNS).write.option("header", True).csv(f"{folder}/in.csv")
    job.fit_generate_job(t.spark, source=f"{folder}/in.csv", sink=f"{folder}/out.parquet", params=params())
    return t.spark.read.parquet(f"{folder}/out.parquet")
