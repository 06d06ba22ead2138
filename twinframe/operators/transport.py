"""New latent rows by moving an anchor along a displacement seen between two neighbours."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.functions import rng, slots
from twinframe.functions.ordered import dense_index, quantiles
from twinframe.functions.scalars import bind, category_key
from twinframe.session import checkpoint

def anchor_weights(edges: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(src, weight): mutual degree over its sum; with (src, cls) given, every class gets the same mass."""
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    if classes is None:
        total = degree.agg(F.sum("degree")).first()[0] or 1
        return degree.select("src", "degree", (F.col("degree") / F.lit(float(total))).alias("weight"))
    rows = classes.join(degree, "src", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    sums = rows.groupBy("cls").agg(F.sum("degree").alias("_s"), F.count(F.lit(1)).alias("_n"))
    k = sums.count()
    inside = F.when(F.col("_s") > 0, F.col("degree") / F.nullif(F.col("_s"), F.lit(0))).otherwise(F.lit(1.0) / F.col("_n"))
    return rows.join(sums, "cls").select("src", "degree", (inside / F.lit(float(k))).alias("weight"))


def valid_anchors(edges: DataFrame) -> DataFrame:
    """Rows with a neighbour that itself has a neighbour."""
    sources = edges.select(F.col("src").alias("dst")).distinct()
    return edges.join(sources, "dst", "left_semi").select("src").distinct()


def neighbour_arrays(edges: DataFrame) -> DataFrame:
    """(src, others): the sorted neighbours of each row, at most k of them."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("others"))


def live_edges(edges: DataFrame) -> DataFrame:
    """Edges whose end has an edge of its own: only those can be drawn first, so that a third row always exists."""
    return edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")


def numbered_edges(edges: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Directed edges with a dense number ``e``, global or inside ``within``."""
    keyed = edges.withColumn("_key", F.concat_ws("|", F.col("src").cast("string"), F.col("dst").cast("string")))
    return dense_index(keyed, "_key", within=within, name="e").drop("_key")


def transport_draws(edges: DataFrame, draws: DataFrame, seed: int = 42, *, classes: DataFrame | None = None,
                    target: str | None = None) -> DataFrame:
    """(row, attempt, anchor, b, c) for a draw table (row, attempt).

    Anchor by degree and B uniform among its neighbours is one uniform draw over directed edges; C is a
    uniform edge of B.  With classes (src, cls), the class is drawn uniformly first, or is always ``target``.
    Edges that end where no edge starts are never drawn, so every draw gives a row; without any other edge this raises.
    """
    if target is not None and classes is None:
        raise ValueError("A target class needs the classes of the rows.")
    live = live_edges(edges)
    address = ("row", "attempt")
    ends = [F.col("src").alias("anchor"), F.col("dst").alias("b")]
    if classes is None or target is not None:
        if target is not None:
            live = live.join(classes.filter(category_key(F.col("cls")) == F.lit(target)).select("src"), "src", "left_semi")
        total = live.count()
        if not total:
            raise ValueError("No anchor has a neighbour with a neighbour" + (f" in class {target!r}." if target is not None else "."))
        first = draws.withColumn("e", rng.uniform_index(total, seed, "edge", *address)).join(
            numbered_edges(live).select("e", *ends), "e")
    else:
        inside = numbered_edges(live.join(classes, "src"), ["cls"])
        sizes = inside.groupBy("cls").agg(F.count(F.lit(1)).alias("_n"))
        k = sizes.count()
        if not k:
            raise ValueError("No anchor has a neighbour with a neighbour.")
        named = dense_index(sizes, "cls", name="_ci")
        first = draws.withColumn("_ci", rng.uniform_index(k, seed, "class", *address)).join(named, "_ci").withColumn(
            "e", rng.uniform_index(F.col("_n"), seed, "edge", *address)).join(inside.select("cls", "e", *ends), ["cls", "e"])
    slot = rng.uniform_index(F.size("others"), seed, "third", *address).cast("int")
    return first.join(neighbour_arrays(edges).withColumnRenamed("src", "b"), "b").select(
        "row", "attempt", "anchor", "b", F.get("others", slot).alias("c"))


def transport_candidates(latent: DataFrame, key: str, edges: DataFrame, draws: DataFrame, *, seed: int = 42,
                         factor: float = 1.0, min_factor: float = 1.0, z: str = "z",
                         classes: DataFrame | None = None, target: str | None = None) -> DataFrame:
    """(row, attempt, anchor, b, c, z) with z = A + alpha (C - B), alpha uniform between the two factors; sparse entries move alike."""
    if factor < min_factor:
        raise ValueError("factor must not be below min_factor.")
    chosen = transport_draws(edges, draws, seed, classes=classes, target=target)
    sparse = slots.NAME in latent.columns
    for name, end in (("anchor", "a"), ("b", "b"), ("c", "c")):
        chosen = chosen.join(latent.select(F.col(key).alias(name), F.col(z).alias(f"_z{end}"), *([F.col(slots.NAME).alias(f"_s{end}")] if sparse else [])), name)
    alpha = (rng.uniform(seed, "alpha", "row", "attempt") * (factor - min_factor) + min_factor
             if factor > min_factor else F.lit(float(factor)))
    step = F.zip_with("_zc", "_zb", lambda c, b: c - b)
    moved = bind(alpha, lambda f: F.zip_with(F.col("_za"), step, lambda a, s: a + f * s))
    entries = [bind(alpha, lambda f: slots.moved(F.col("_sa"), F.col("_sb"), F.col("_sc"), f)).alias(slots.NAME)] if sparse else []
    return chosen.select("row", "attempt", "anchor", "b", "c", moved.alias(z), *entries)


def quantile_bounds(latent: DataFrame, coordinates: Sequence[int], q: float | None, z: str = "z") -> dict[int, tuple[float, float]]:
    """Lower and upper q quantile of the guarded coordinates; nothing to guard gives an empty dict."""
    if q is None or not coordinates:
        return {}
    if not 0 <= q < 0.5:
        raise ValueError("The guard must be None or lie in [0, 0.5).")
    entries = F.array(*[F.struct(F.lit(i).alias("coordinate"), F.col(z)[i].alias("value")) for i in coordinates])
    long = latent.select(F.explode(entries).alias("e")).select("e.*")
    found: dict[int, list[float]] = {}
    for r in quantiles(long, ["coordinate"], "value", [q, 1 - q]).orderBy("coordinate", "probability").collect():
        found.setdefault(r["coordinate"], []).append(float(r["quantile"]))
    return {i: (v[0], v[-1]) for i, v in found.items()}


def within_bounds(bounds: dict[int, tuple[float, float]], z: str = "z") -> Column:
    """Whether every guarded coordinate lies inside its closed bounds."""
    ok = F.lit(True)
    for i, (low, high) in bounds.items():
        ok = ok & F.col(z)[i].between(F.lit(low), F.lit(high))
    return ok


def generate_latent(latent: DataFrame, key: str, edges: DataFrame, n: int, *, seed: int = 42, factor: float = 1.0,
                    min_factor: float = 1.0, bounds: dict[int, tuple[float, float]] | None = None, retries: int = 5,
                    z: str = "z", classes: DataFrame | None = None, target: str | None = None, first_round: int = 1) -> DataFrame:
    """(row, attempt, accepted, anchor, b, c, z): the first attempt inside the bounds, else the last one; with sparse entries where the latent rows have them.

    Each attempt draws a new anchor at its own address, so the answer does not depend on how many attempts are
    looked at together: they go in growing rounds over the rows still refused, the first of ``first_round`` attempts.
    With ``target`` every anchor is of that class.
    """
    if retries < 0 or n < 0:
        raise ValueError("n and retries must not be negative.")
    guard = bounds or {}
    last = retries if guard else 0

    def attempts(rows: DataFrame, start: int, end: int) -> DataFrame:
        draws = rows.select("row", F.explode(F.sequence(F.lit(start), F.lit(end))).alias("attempt"))
        made = transport_candidates(latent, key, edges, draws, seed=seed, factor=factor, min_factor=min_factor, z=z,
                                    classes=classes, target=target).withColumn("accepted", within_bounds(guard, z))
        if start == end:
            return made
        body = [c for c in made.columns if c != "row"]
        order = F.when(F.col("accepted"), F.col("attempt")).otherwise(F.lit(end + 1) - F.col("attempt") / F.lit(end + 1.0))
        return made.groupBy("row").agg(F.min_by(F.struct(*body), order).alias("k")).select("row", "k.*")
    pending = latent.sparkSession.range(n).withColumnRenamed("id", "row")
    if last == 0:
        return attempts(pending, 0, 0)
    done, start, size = [], 0, max(1, first_round)
    while True:
        end = min(last, start + size - 1)
        best = checkpoint(attempts(pending, start, end))
        if end == last:
            done.append(best)
            return reduce(DataFrame.unionByName, done)
        done.append(best.filter("accepted"))
        pending, start, size = best.filter(~F.col("accepted")).select("row"), end + 1, end + 1


def guard_counts(generated: DataFrame, retries: int) -> DataFrame:
    """Total retries and rows left outside the bounds."""
    return generated.agg(
        F.sum(F.when(F.col("accepted"), F.col("attempt")).otherwise(F.lit(retries)).cast("bigint")).alias("retries"),
        F.count(F.when(~F.col("accepted"), 1)).alias("violations"))


def class_conditional_anchor(weights: DataFrame, classes: DataFrame, target: str) -> DataFrame:
    """Anchor weights restricted to one class and normalised again."""
    kept = weights.join(classes.filter(category_key(F.col("cls")) == F.lit(target)).select("src"), "src")
    total = kept.agg(F.sum("weight")).first()[0]
    if not total:
        raise ValueError(f"No rows match class {target!r}.")
    return kept.withColumn("weight", F.col("weight") / F.lit(float(total)))
