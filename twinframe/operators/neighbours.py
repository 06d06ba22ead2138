"""Nearest-neighbour joins.

Exact search: rows are assigned to the nearest of a bounded set of pivot rows (cells).  A first round looks
only inside the home cell and gives each query an upper bound of its k-th distance.  A second round visits
just those cells that the triangle inequality cannot rule out.  Cells are cut into blocks and crowded blocks
are salted, so a task compares at most BLOCK x QUERIES rows and only the best k per query leave it.
Rows with the same vector are searched once, and at most k+1 of them are kept as candidates: further copies
can never be among anyone's k nearest under the order (distance, id).

Cells are a tree of two levels: where a cell of the first level holds more than a few times CELL rows, rows of it
become pivots of the second, so cells stay small as the table grows.  The pivots of the first level are bounded and
known to the driver, those of the second stay in tables and meet rows and queries by cell.

One-hot blocks need not be written out: under the metric of ``coded(p, weight)`` a vector is p numbers and one code a block, and two codes
that differ add weight to the squared distance, just as their two slots would (half of it where one code is -1, an unknown key).

Rows that are sent to many cells (in many dimensions no bound rules a cell out) are not copied to each of them. Queries and data are dealt into
strips of STRIP bytes instead, every strip of the one meets every strip of the other, and the cells are ruled out inside the task, so what is
shuffled grows with the number of strips and not with that of the cells.

Vectors of one coordinate lie on a line: it is cut into stretches of LINE rows, each stretch also gets the few rows next to it on both sides, and
its lists are final, so every row is searched once.

Approximate search visits the nearest ``probes`` cells only, and in a cell that was split its nearest ``probes`` parts. Neighbour descent starts
from such lists and lets the neighbours of a row, in both directions, measure each other, round by round, until hardly a list changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinframe.functions.scalars import norm
from twinframe.session import checkpoint, spread

METRICS = ("euclidean", "manhattan", "cosine", "hamming")
APPROX_METRICS = METRICS + ("inner_product",)
CELL = 512          # rows aimed at per cell of a large table; a small one has as many cells as rows in a cell
MAX_PIVOTS = 2048   # of the first level: bounds what the driver holds and each task receives
CROWDED = 4         # times CELL: a first-level cell with more rows is split
PARTS = 1 << 20     # most parts of one cell; a leaf's number is cell * PARTS + part
BLOCK = 1024        # candidate rows per task group
QUERIES = 2048      # query rows per task group
LEAST_LIST = 16     # neighbours that descent carries for each row, or twice as many as asked for
START_PROBES = 2    # of the lists that neighbour descent starts from: rows near a border know both sides
DESCENT_ROUNDS = 12 # at most
SETTLED = 0.001     # share of all list entries that are new when descent ends
AROUND = 2          # times the list length: members that meet around a row, the nearest ones
SALTS = 64          # parts in which the rows that list one row are ranked first
TABLE = 1 << 19     # entries of a distance table that a task holds at once
STRIP = 1 << 26     # bytes of vectors on each side of a pair of strips
STRIP_ROWS = 1 << 18  # rows of it at most: a row of a few numbers takes some 250 bytes more in a task
LEAST_STRIPS = 8    # on each side, where there are rows for them: their pairs are the tasks
ROUTED = 4          # times the copies that strips need: with more routes than that, queries meet the data in strips
LOOKED_AT = 4096    # rows whose routes are counted to choose between them
LINE = 1 << 14      # rows of a stretch, where vectors have one coordinate
DIGITS = 9          # distances equal to this many digits are ties, broken by id


def coded(numbers: int, weight: float = 2.0) -> str:
    """Name of the Euclidean metric of vectors whose coordinates from ``numbers`` on are codes."""
    return f"coded:{numbers}:{weight!r}"


def _plain(metric: str, width: int) -> tuple[int, float]:
    """(coordinates that are numbers, weight of a mismatch of the others)."""
    if not metric.startswith("coded:"):
        return width, 0.0
    _, numbers, weight = metric.split(":")
    return int(numbers), float(weight)


def _mismatch(a: np.ndarray, b: np.ndarray, weight: float) -> np.ndarray:
    return (a != b) * ((a >= 0).astype(float) + (b >= 0)) * (weight / 2.0)


def tile_distances(left: np.ndarray, right: np.ndarray, metric: str) -> np.ndarray:
    """Distances of two row blocks, added up coordinate by coordinate so that equal rows give equal sums."""
    total = np.zeros((len(left), len(right)))
    if metric.startswith("coded:"):
        numbers, weight = _plain(metric, left.shape[1])
        for j in range(left.shape[1]):
            if j < numbers:
                gap = left[:, j, None] - right[None, :, j]
                total += gap * gap
            else:
                total += _mismatch(left[:, j, None], right[None, :, j], weight)
        return np.sqrt(total)
    for j in range(left.shape[1]):
        gap = left[:, j, None] - right[None, :, j]
        if metric == "manhattan":
            total += np.abs(gap)
        elif metric == "hamming":
            total += gap != 0
        else:
            total += gap * gap
    if metric == "euclidean":
        return np.sqrt(total)
    if metric == "cosine":
        return total / 2.0
    if metric == "hamming":
        return total / max(left.shape[1], 1)
    return total


def _slices(rows: int, width: int) -> Iterator[slice]:
    """Pieces of a block whose tables of ``width`` columns stay small, whatever the size of the block."""
    step = max(1, TABLE // max(width, 1))
    return (slice(at, min(at + step, rows)) for at in range(0, rows, step))


def _home(vectors: np.ndarray, pivots: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(nearest pivot, distance to it) of every row."""
    cell, radius = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    for part in _slices(len(vectors), len(pivots)):
        d = tile_distances(vectors[part], pivots, metric)
        cell[part] = d.argmin(axis=1)
        radius[part] = d[np.arange(len(d)), cell[part]]
    return cell, radius


def _bound_metric(metric: str) -> str:
    """Cells are laid out and bounded in a true metric; unit vectors turn cosine into Euclidean."""
    return "euclidean" if metric in ("cosine", "inner_product") else metric


def _as_bound(distance: np.ndarray, metric: str) -> np.ndarray:
    return np.sqrt(2.0 * distance) if metric == "cosine" else distance


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), -1)


def _tile_candidates(left: np.ndarray, right: np.ndarray, keep: int, metric: str):
    """(rows, cols, dist) holding at least the ``keep`` nearest of every row, ties included.

    Euclidean tiles are screened with one matrix product; what passes, with room for its rounding error, is
    measured coordinate by coordinate.
    """
    if metric in ("euclidean", "cosine") or metric.startswith("coded:"):
        numbers, weight = _plain(metric, left.shape[1])
        centre = right[:, :numbers].mean(axis=0)
        a, b = left[:, :numbers] - centre, right[:, :numbers] - centre
        na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        rough = na[:, None] + nb[None, :] - 2.0 * (a @ b.T)
        for j in range(numbers, left.shape[1]):
            rough += _mismatch(left[:, j, None], right[None, :, j], weight)
        edge = np.maximum(np.partition(rough, keep - 1, axis=1)[:, keep - 1], 0.0)
        room = 1e-11 * (na + nb.max()) + 10.0 ** (1 - DIGITS) * (np.sqrt(edge) + 1.0)
        rows, cols = np.nonzero(rough <= (edge + room)[:, None])
        total = np.zeros(len(rows))
        for j in range(left.shape[1]):
            if j < numbers:
                gap = left[rows, j] - right[cols, j]
                total += gap * gap
            else:
                total += _mismatch(left[rows, j], right[cols, j], weight)
        return rows, cols, np.round(total / 2.0 if metric == "cosine" else np.sqrt(total), DIGITS)
    if metric == "inner_product":
        dist = -np.round(left @ right.T, DIGITS)
    else:
        dist = np.round(tile_distances(left, right, metric), DIGITS)
    edge = np.partition(dist, keep - 1, axis=1)[:, keep - 1]
    rows, cols = np.nonzero(dist <= edge[:, None])
    return rows, cols, dist[rows, cols]


def _within(left: np.ndarray, right: np.ndarray, limit: np.ndarray, keep: int, metric: str):
    """As ``_tile_candidates``, without rows beyond each query's ``limit``; a tile that a limit empties is not measured to the digit."""
    if metric in ("euclidean", "cosine"):
        centre = right.mean(axis=0)
        a, b = left - centre, right - centre
        na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        most = np.where(np.isfinite(limit), _as_bound(limit, metric), 1e150) ** 2
        room = 1e-11 * (na + nb.max()) + 10.0 ** (1 - DIGITS) * (np.sqrt(most) + 1.0)
        rough = a @ (-2.0 * b.T)
        rough += nb[None, :]
        rows = np.flatnonzero((rough <= (most + room - na)[:, None]).any(axis=1))
    elif metric == "manhattan" and len(right):
        total, gap = np.zeros((len(left), len(right)), np.float32), np.empty((len(left), len(right)), np.float32)
        with np.errstate(over="ignore", invalid="ignore"):
            a, b = left.astype(np.float32), np.ascontiguousarray(right.T.astype(np.float32))
            for j in range(left.shape[1]):
                np.subtract(a[:, j, None], b[j], out=gap)
                np.abs(gap, out=gap)
                total += gap
        # Single precision: each step errs by 2 ** -24 of the coordinates it takes and of the sum so far.
        size = np.abs(left).sum(axis=1) + np.abs(right).sum(axis=1).max()
        room = 2.0 ** -22 * (left.shape[1] + 2) * size + 10.0 ** (1 - DIGITS)
        rows = np.flatnonzero((total <= (limit + room)[:, None]).any(axis=1) | ~(size < 1e30))
    else:
        rows = np.arange(len(left))
    if not len(rows):
        return rows, rows, np.zeros(0)
    at, cols, dist = _tile_candidates(left[rows], right, keep, metric)
    near = dist <= limit[rows][at]
    return rows[at[near]], cols[near], dist[near]


def best_of_tile(queries: pd.DataFrame, data: pd.DataFrame, need: int, metric: str) -> pd.DataFrame:
    """The ``need`` nearest data rows of each query row, by (rounded distance, id)."""
    if len(queries) == 0 or len(data) == 0:
        return pd.DataFrame({"src": queries["src"].iloc[:0], "dst": data["dst"].iloc[:0], "dist": np.zeros(0)})
    data = data.sort_values("dst", kind="stable")
    left, right = _matrix(queries["vec"]), _matrix(data["vec"])
    keep = min(need, len(right))
    rows, cols, dist = _tile_candidates(left, right, keep, metric)
    order = np.lexsort((cols, dist, rows))
    rows, cols, dist = rows[order], cols[order], dist[order]
    first = np.searchsorted(rows, np.arange(len(left)))
    chosen = np.arange(len(rows)) - first[rows] < keep
    return pd.DataFrame({"src": queries["src"].to_numpy()[rows[chosen]], "dst": data["dst"].to_numpy()[cols[chosen]],
                         "dist": dist[chosen]})


def _prepared(df: DataFrame, key: str, vec: str, metric: str, within: str | None, name: str) -> DataFrame:
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    if metric == "cosine":
        length = norm(v)
        v = F.transform(v, lambda x: x / F.when(length == 0, F.lit(1.0)).otherwise(length))
    cls = F.lit("") if within is None else F.coalesce(F.col(within).cast("string"), F.lit(""))
    return df.select(cls.alias("cls"), F.col(key).alias(name), v.alias("vec"))


def _copies(rows: DataFrame, key: str, keep: int) -> DataFrame:
    """At most ``keep`` rows, smallest ids first, of every distinct vector, with their place ``copy``."""
    place = Window.partitionBy("cls", "vec").orderBy(key)
    return rows.withColumn("copy", F.row_number().over(place)).filter(F.col("copy") <= keep)


def _pivots(points: DataFrame, key: str, count: int) -> np.ndarray:
    size = int(min(MAX_PIVOTS, max(1, round(count ** 0.5), count // CELL)))
    chosen = points.orderBy(F.md5(F.col(key).cast("string")), F.col(key)).limit(size).select("vec").collect()
    return np.array([r["vec"] for r in chosen], dtype=float).reshape(len(chosen), -1)


def _assign(rows: DataFrame, pivots: np.ndarray, metric: str) -> DataFrame:
    """Add the home cell and the distance to its pivot."""
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cell, radius = _home(_matrix(batch["vec"]), pivots, metric)
                yield batch.assign(cell=cell, radius=radius)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return spread(rows).mapInPandas(place, f"{fields}, cell bigint, radius double")


def _parts(placed: DataFrame, sizes: dict[int, int], bound: str) -> DataFrame:
    """(cell, pivots): for each crowded cell some of its rows, about one in CELL, as an array of vectors; bounded by the cell's size."""
    rows = F.create_map(*[F.lit(x) for item in sizes.items() for x in item])[F.col("cell")]
    chosen = F.pmod(F.xxhash64(F.lit(1), "dst"), rows) < F.greatest(F.lit(1), F.floor(rows / F.lit(CELL)))
    some = placed.filter(F.col("cell").isin(list(sizes))).filter(chosen)
    listed = some.groupBy("cell").agg(F.array_sort(F.collect_set("vec")).alias("pivots"))
    every = placed.sparkSession.createDataFrame([(c,) for c in sizes], "cell bigint")  # a cell whose hashes chose none stays whole
    return every.join(listed, "cell", "left").withColumn("pivots", F.slice(F.coalesce("pivots", F.array().cast("array<array<double>>")), 1, PARTS))


def _by_cell(rows: DataFrame, parts: DataFrame, sizes: dict[int, int], work, schema: str, key: str) -> DataFrame:
    """work(rows of one cell, its pivots) -> rows, for rows of crowded cells; many rows of one cell go to several tasks."""
    load = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(4 * QUERIES)).cast("bigint").alias("salts"))
    left = rows.join(load, "cell").withColumn("salt", _share(key, "salts")).drop("salts")
    right = parts.join(load, "cell").select("cell", "pivots", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])

    def run(group: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        listed = pivots["pivots"].iloc[0] if len(pivots) else []
        if not len(group) or not len(listed):
            return work(group, np.zeros((0, 0)))
        return work(group, np.array([np.asarray(v, dtype=float) for v in listed], dtype=float).reshape(len(listed), -1))
    return left.groupBy("cell", "salt").cogroup(right.groupBy("cell", "salt")).applyInPandas(run, schema)


def _to_leaves(rows: DataFrame, parts: DataFrame | None, sizes: dict[int, int], bound: str, key: str) -> DataFrame:
    """rows (cls, key, vec, cell, radius) with their leaf: part 0 of a whole cell, the nearest part of a crowded one; radius is that to its pivot."""
    whole = rows if parts is None else rows.filter(~F.col("cell").isin(list(sizes)))
    out = whole.withColumn("leaf", F.col("cell") * PARTS)
    if parts is None:
        return out

    def place(group: pd.DataFrame, pivots: np.ndarray) -> pd.DataFrame:
        group = group.drop(columns="salt")
        if not len(group) or not len(pivots):
            return group.assign(leaf=group["cell"] * PARTS)
        part, radius = _home(_matrix(group["vec"]), pivots, bound)
        return group.assign(radius=radius, leaf=group["cell"] * PARTS + part)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return out.unionByName(_by_cell(rows.filter(F.col("cell").isin(list(sizes))), parts, sizes, place, f"{fields}, leaf bigint", key))


def _open_leaves(routes: DataFrame, parts: DataFrame | None, sizes: dict[int, int], reach: DataFrame | None, metric: str, probes: int | None) -> DataFrame:
    """(cls, src, vec, cell) with the leaf as cell: a whole cell as it is, of a crowded one the parts that may hold a nearer row, or the nearest ones.

    routes: (cls, src, vec, cell, ub); reach: (cell, reach) with the radius of each part.
    """
    bound = _bound_metric(metric)
    columns = ["cls", "src", "vec"]
    if parts is None:
        return routes.select(*columns, (F.col("cell") * PARTS).alias("cell"))
    out = routes.filter(~F.col("cell").isin(list(sizes))).select(*columns, (F.col("cell") * PARTS).alias("cell"))
    kind = routes.schema["src"].dataType.simpleString()

    def visit(group: pd.DataFrame, table: np.ndarray) -> pd.DataFrame:
        if not len(group) or not len(table):
            return group[columns].assign(cells=[np.array([c * PARTS], np.int64) for c in group["cell"]])
        pivots, radii, vectors = table[:, :-1], table[:, -1], _matrix(group["vec"])
        limit, first, found = _as_bound(group["ub"].to_numpy(dtype=float), metric), group["cell"].to_numpy() * PARTS, []
        for piece in _slices(len(vectors), len(pivots)):
            d = tile_distances(vectors[piece], pivots, bound)
            if probes is None:
                wanted = d - radii[None, :] <= (limit[piece] + 1e-7 * (1.0 + np.abs(d).max(axis=1)))[:, None]
                wanted[:, radii < 0] = False
            else:
                wanted = np.zeros(d.shape, bool)
                np.put_along_axis(wanted, np.argsort(d, axis=1, kind="stable")[:, :probes], True, axis=1)
            found += [c + np.flatnonzero(w) for c, w in zip(first[piece], wanted)]
        return group[columns].assign(cells=found)

    # The radius of a part rides behind its pivot's coordinates.
    with_reach = parts if reach is None else parts.join(reach, "cell", "left")
    listed = with_reach.withColumn("pivots", F.transform("pivots", lambda v, i: F.concat(v, F.array(F.lit(0.0) if reach is None else F.coalesce(
        F.element_at(F.col("reach"), i), F.lit(-1.0)))))).select("cell", "pivots")
    found = _by_cell(routes.filter(F.col("cell").isin(list(sizes))), listed, sizes, visit, f"cls string, src {kind}, vec array<double>, cells array<bigint>", "src")
    return out.unionByName(found.select(*columns, F.explode("cells").alias("cell")))


def _other_cells(queries: DataFrame, pivots: np.ndarray, radii: np.ndarray, metric: str, split: frozenset[int] = frozenset()) -> DataFrame:
    """(cls, src, vec, ub, cells): cells that may hold a row nearer than the query's bound ``ub``; the home cell only if it was split."""
    bound = _bound_metric(metric)
    between = tile_distances(pivots, pivots, bound)
    again = np.isin(np.arange(len(pivots)), list(split))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            vectors, homes = _matrix(batch["vec"]), batch["cell"].to_numpy()
            limits = _as_bound(batch["ub"].to_numpy(dtype=float), metric)
            for piece in _slices(len(vectors), len(pivots)):
                d, home = tile_distances(vectors[piece], pivots, bound), homes[piece]
                own = d[np.arange(len(d)), home]
                slack = 1e-7 * (1.0 + np.abs(d).max(axis=1))
                nearest = d - radii[None, :]
                if bound == "euclidean" or bound.startswith("coded:"):  # both lie in a Euclidean space
                    gap = between[home]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        plane = np.where(gap > 0, (d * d - own[:, None] ** 2) / (2.0 * gap), 0.0)
                    nearest = np.maximum(nearest, plane)
                open_ = nearest <= (limits[piece] + slack)[:, None]
                open_[:, radii < 0] = False
                open_[np.arange(len(d)), home] = again[home]
                yield batch[["cls", "src", "vec", "ub"]].iloc[piece].assign(cells=[np.flatnonzero(r).astype("int64") for r in open_])
    kind = queries.schema["src"].dataType.simpleString()
    return queries.select("cls", "src", "vec", "cell", "ub").mapInPandas(
        visit, f"cls string, src {kind}, vec array<double>, ub double, cells array<bigint>")


def _nearest_cells(queries: DataFrame, pivots: np.ndarray, radii: np.ndarray, metric: str, probes: int) -> DataFrame:
    bound = _bound_metric(metric)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                vectors = _matrix(batch["vec"])
                for piece in _slices(len(vectors), len(pivots)):
                    d = tile_distances(vectors[piece], pivots, bound)
                    order = np.argsort(d, axis=1, kind="stable")[:, :probes].astype("int64")
                    yield batch[["cls", "src", "vec"]].iloc[piece].assign(cells=list(order))
    kind = queries.schema["src"].dataType.simpleString()
    return (spread(queries.select("cls", "src", "vec")).mapInPandas(
        visit, f"cls string, src {kind}, vec array<double>, cells array<bigint>")
        .select("cls", "src", "vec", F.explode("cells").alias("cell")))


def _share(key: str, parts: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.col(parts))


def _compare(routes: DataFrame, data: DataFrame, need: int, metric: str) -> DataFrame:
    """Best ``need`` candidates per (query, block) for queries routed to cells: (src, dst, dist)."""
    load = routes.groupBy("cls", "cell").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(QUERIES)).cast("bigint").alias("salts"))
    size = data.groupBy("cls", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("bigint").alias("blocks"))
    layout = load.join(size, ["cls", "cell"])
    left = routes.join(layout, ["cls", "cell"]).select(
        "cls", "cell", _share("src", "salts").alias("salt"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), "src", "vec")
    right = data.join(layout, ["cls", "cell"]).select(
        "cls", "cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"),
        _share("dst", "blocks").alias("block"), "dst", "vec")
    # Both sides may come from one table: fresh columns keep them apart.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    keys = ["cls", "cell", "salt", "block"]
    schema = (f"src {routes.schema['src'].dataType.simpleString()}, "
              f"dst {data.schema['dst'].dataType.simpleString()}, dist double")
    return spread(left, *keys).groupBy(*keys).cogroup(spread(right, *keys).groupBy(*keys)).applyInPandas(
        lambda q, d: best_of_tile(q, d, need, metric), schema)


def _strips(rows: Column, width: int) -> Column:
    """Strips for so many rows: as many as STRIP and STRIP_ROWS ask for, and a few at least."""
    return F.greatest(F.ceil(rows * F.lit(max(max(width, 1) * 8 / STRIP, 1 / STRIP_ROWS))), F.least(F.lit(LEAST_STRIPS), F.ceil(rows / F.lit(BLOCK)))).cast("bigint")


def _nearer(best: np.ndarray, at: np.ndarray, rows: np.ndarray, cols: np.ndarray, dist: np.ndarray) -> None:
    """Put candidates (row, place of the data row, distance) into the lists ``best`` and ``at``, ordered by (distance, place)."""
    order = np.lexsort((cols, dist, rows))
    rows, cols, dist = rows[order], cols[order], dist[order]
    touched, first = np.unique(rows, return_index=True)
    place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    few = place < best.shape[1]
    line = np.searchsorted(touched, rows[few])
    more_d, more_at = np.full((len(touched), best.shape[1]), np.inf), np.full((len(touched), best.shape[1]), np.iinfo(np.int64).max)
    more_d[line, place[few]], more_at[line, place[few]] = dist[few], cols[few]
    d, c = np.hstack([best[touched], more_d]), np.hstack([at[touched], more_at])
    by = np.lexsort((c, d), axis=1)[:, :best.shape[1]]
    best[touched], at[touched] = np.take_along_axis(d, by, axis=1), np.take_along_axis(c, by, axis=1)


def best_of_strip(queries: pd.DataFrame, data: pd.DataFrame, need: int, metric: str) -> pd.DataFrame:
    """The ``need`` nearest data rows (cell, dst, vec) of each query row (src, vec, ub), by (rounded distance, id).

    Cells that lie beyond a query's bound are passed over; the bound falls as its list fills.
    """
    empty = pd.DataFrame({"src": queries["src"].iloc[:0], "dst": data["dst"].iloc[:0], "dist": np.zeros(0)})
    if not len(queries) or not len(data):
        return empty
    data = data.sort_values("dst", kind="stable")
    left, right, bound = _matrix(queries["vec"]), _matrix(data["vec"]), _bound_metric(metric)
    numeric = bound in ("euclidean", "manhattan")
    ub = queries["ub"].to_numpy(dtype=float)
    best, at = np.full((len(left), need), np.inf), np.full((len(left), need), np.iinfo(np.int64).max)
    cells = data["cell"].to_numpy()
    order = np.argsort(cells, kind="stable")
    ends = np.flatnonzero(np.diff(cells[order])) + 1
    for cell in np.split(order, ends):
        centre = right[cell].mean(axis=0, keepdims=True) if numeric else right[cell[:1]]
        reach = tile_distances(right[cell], centre, bound).max()
        for members in (cell[piece] for piece in _slices(len(cell), QUERIES)):
            block = right[members]
            for piece in _slices(len(left), max(len(members), left.shape[1])):
                far = tile_distances(left[piece], centre, bound)[:, 0]
                limit = np.minimum(ub[piece], best[piece, -1])
                near = np.flatnonzero(far - reach <= _as_bound(limit, metric) + 1e-7 * (1.0 + far + reach))
                if not len(near):
                    continue
                near += piece.start
                rows, cols, dist = _within(left[near], block, np.minimum(ub[near], best[near, -1]), min(need, len(members)), metric)
                if len(rows):
                    _nearer(best, at, near[rows], members[cols], dist)
    rows, place = np.nonzero(np.isfinite(best))
    return pd.DataFrame({"src": queries["src"].to_numpy()[rows], "dst": data["dst"].to_numpy()[at[rows, place]], "dist": best[rows, place]})


def _in_strips(queries: DataFrame, data: DataFrame, need: int, metric: str, width: int) -> DataFrame:
    """Best ``need`` candidates per (query, strip of data) of all data of the query's class: (src, dst, dist).

    queries: (cls, src, vec, ub); data: (cls, cell, dst, vec).
    """
    layout = queries.groupBy("cls").agg(_strips(F.count(F.lit(1)), width).alias("lefts")).join(
        data.groupBy("cls").agg(_strips(F.count(F.lit(1)), width).alias("rights")), "cls")
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(parts) - 1))
    left = queries.join(layout, "cls").select("cls", _share("src", "lefts").alias("lhs"), every("rights").alias("rhs"), "src", "vec", "ub")
    right = data.join(layout, "cls").select("cls", every("lefts").alias("lhs"), _share("dst", "rights").alias("rhs"), "cell", "dst", "vec")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    keys = ["cls", "lhs", "rhs"]
    schema = f"src {queries.schema['src'].dataType.simpleString()}, dst {data.schema['dst'].dataType.simpleString()}, dist double"
    return spread(left, *keys).groupBy(*keys).cogroup(spread(right, *keys).groupBy(*keys)).applyInPandas(
        lambda q, d: best_of_strip(q, d, need, metric), schema)


def _merge(found: DataFrame, need: int) -> DataFrame:
    order = Window.partitionBy("src").orderBy("dist", "dst")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= need)


def _search(points: DataFrame, data: DataFrame, need: int, metric: str, probes: int | None) -> DataFrame:
    """(src, dst, dist, place) for distinct query points against candidate rows."""
    bound = _bound_metric(metric)
    distinct = data.filter(F.col("copy") == 1)
    count = distinct.count()
    if count == 0:
        raise ValueError("The searched table must contain at least one row.")
    pivots = _pivots(distinct, "dst", count)
    placed = checkpoint(_assign(data.select("cls", "dst", "vec"), pivots, bound))
    radii, sizes = np.full(len(pivots), -1.0), {}
    for r in placed.groupBy("cell").agg(F.max("radius").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        radii[r["cell"]] = r["radius"]
        if r["n"] > CROWDED * CELL:
            sizes[r["cell"]] = r["n"]
    parts = checkpoint(_parts(placed, sizes, bound)) if sizes else None
    leaves = _to_leaves(placed, parts, sizes, bound, "dst")
    leaves = checkpoint(leaves) if sizes else leaves
    stored = leaves.select("cls", "dst", "vec", F.col("leaf").alias("cell"))
    if probes is not None:
        near = _nearest_cells(points, pivots, radii, metric, probes).withColumn("ub", F.lit(0.0))
        return _merge(_compare(_open_leaves(near, parts, sizes, None, metric, probes), stored, need, metric), need)
    queries = _to_leaves(_assign(points.select("cls", "src", "vec"), pivots, bound), parts, sizes, bound, "src")
    queries = checkpoint(queries) if sizes else queries
    home = _merge(_compare(queries.select("cls", "src", "vec", F.col("leaf").alias("cell")), stored, need, metric), need)
    bounds = home.groupBy("src").agg(
        F.array_sort(F.collect_list(F.struct("dist", "dst"))).alias("best"))
    ub = F.when(F.size("best") >= need, F.element_at("best", -1)["dist"]).otherwise(F.lit(float("inf")))
    first = checkpoint(queries.join(bounds, "src", "left").withColumn("ub", F.coalesce(ub, F.lit(float("inf")))))
    split, width = frozenset(sizes), pivots.shape[1]
    strips = sum(d.agg(_strips(F.count(F.lit(1)), width)).first()[0] for d in (points, placed))
    asked = first.filter(F.pmod(F.xxhash64(F.lit(2), "src"), F.lit(max(1, count // LOOKED_AT))) == 0)  # only to choose between two exact ways
    opened = _other_cells(asked, pivots, radii, metric, split).agg(F.avg(F.size("cells"))).first()[0]
    if opened is not None and opened > ROUTED * strips:
        return _merge(_in_strips(first.select("cls", "src", "vec", "ub"), stored, need, metric, width), need)
    routes = _other_cells(first, pivots, radii, metric, split).select("cls", "src", "vec", "ub", F.explode("cells").alias("cell"))
    if sizes:
        part = leaves.filter(F.col("cell").isin(list(sizes))).groupBy("cell", F.pmod("leaf", F.lit(PARTS)).alias("part")).agg(F.max("radius").alias("radius"))
        reach = part.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct(F.col("part").cast("int"), "radius"))).alias("reach"))
        at_home = first.select(F.col("src").alias("_src"), F.col("leaf").alias("_leaf"))
        open_leaves = _open_leaves(routes, parts, sizes, reach, metric, None)
        open_leaves = open_leaves.join(at_home, (F.col("src") == F.col("_src")) & (F.col("cell") == F.col("_leaf")), "left_anti")
    else:
        open_leaves = _open_leaves(routes, None, sizes, None, metric, None)
    more = _compare(open_leaves, stored, need, metric)
    seen = first.select("src", F.explode("best").alias("e")).select("src", "e.dst", "e.dist")
    return _merge(seen.unionByName(more), need)


def _beside(y: np.ndarray) -> np.ndarray:
    """On a line, rows that lie further apart than this differ in their rounded distance to a row on one side of both."""
    return 2.0 * 10.0 ** -DIGITS + 1e-12 * (1.0 + np.abs(y))


def best_of_line(y: np.ndarray, asked: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in ``asked``, places in ``y``, distance): the ``need`` nearest of y of each asked one, ordered by (rounded distance, place in y)."""
    order = np.argsort(y, kind="stable")
    line, at = y[order], np.empty(len(y), np.int64)
    at[order] = np.arange(len(y))
    keep, spot = min(need, len(y)), at[asked]
    own, found = line[spot], []

    def window(rows: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
        near = spot[rows][:, None] + np.arange(-half, half + 1)[None, :]
        gap = own[rows][:, None] - line[np.clip(near, 0, len(line) - 1)]
        return near, np.where((near < 0) | (near >= len(line)), np.inf, np.round(np.sqrt(gap * gap), DIGITS))

    # The nearest in each direction bound the last distance; what ties with it may lie further along the line.
    edge = np.empty(len(asked))
    for piece in _slices(len(asked), 2 * keep - 1):
        rows = np.arange(piece.start, piece.stop)
        edge[piece] = np.partition(window(rows, keep - 1)[1], keep - 1, axis=1)[:, keep - 1]
    room = edge + _beside(own)
    span = np.maximum(spot - np.searchsorted(line, own - room), np.searchsorted(line, own + room, side="right") - 1 - spot)
    half, done = max(keep - 1, 1), np.zeros(len(asked), bool)
    while not done.all():
        wide = np.flatnonzero(~done & (span <= half))
        for piece in _slices(len(wide), 2 * half + 1):
            rows = wide[piece]
            near, dist = window(rows, half)
            place = np.where(np.isinf(dist), len(line), order[np.clip(near, 0, len(line) - 1)])
            first = np.lexsort((place, dist), axis=1)[:, :keep]
            found.append((np.repeat(rows, keep), np.take_along_axis(place, first, axis=1).ravel(), np.take_along_axis(dist, first, axis=1).ravel()))
        done[wide] = True
        half *= 2
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found))


def _on_line(data: DataFrame, need: int) -> DataFrame | None:
    """(src, vec, best): the sorted lists of the distinct rows of ``data`` (dst, vec, copy), whose vectors are one finite number each; None where they are not.

    The line is cut into stretches. Of the ``need`` nearest rows beyond an end of a stretch, none lies behind the first ``need`` of the next one.
    """
    y = F.col("vec")[0]
    odd = (F.size("vec") != 1) | y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))
    size = data.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(odd, 1)).alias("odd")).first()
    if not size["n"] or size["odd"]:
        return None
    kind = data.schema["dst"].dataType.simpleString()
    rows = data.select("dst", (F.col("copy") == 1).alias("asked"), y.alias("y"))
    count = size["n"] // max(LINE, 8 * need)
    cuts = np.unique(rows.approxQuantile("y", [i / count for i in range(1, count)], 1 / (8 * count))) if count > 1 else np.zeros(0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(cuts, batch.column(2).to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], ["dst", "asked", "y", "at"])

    def ends(group: pa.Table) -> pa.Table:
        values = np.sort(group["y"].to_numpy())
        low, high = values[min(need, len(values)) - 1], values[-min(need, len(values))]
        return pa.table({"at": group["at"][:1], "n": [len(values)], "low": [low], "high": [high]})

    fields = f"dst {kind}, asked boolean, y double, at bigint"
    placed = checkpoint(spread(spread(rows).mapInArrow(place, fields), "at"))
    if len(cuts):
        known = {r["at"]: r for r in placed.groupBy("at").applyInArrow(ends, "at bigint, n bigint, low double, high double").collect()}
        if len(known) != len(cuts) + 1 or min(r["n"] for r in known.values()) < need:
            return None
        low, high = (np.array([known[i][c] for i in range(len(known))]) for c in ("low", "high"))

        def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                value, at = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                yield batch
                for there, wanted in ((-1, (at > 0) & (value <= low[at] + _beside(value))), (1, (at < len(cuts)) & (value >= high[at] - _beside(value)))):
                    some = batch.filter(pa.array(wanted))
                    guests = pa.array(np.zeros(some.num_rows, bool))
                    yield pa.RecordBatch.from_arrays([some.column(0), guests, some.column(2), pa.array(at[wanted] + there, pa.int64())], batch.schema.names)
        placed = placed.mapInArrow(beside, fields)

    def lists(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group["dst"])).combine_chunks()
        ids = group["dst"].combine_chunks()
        asked = np.flatnonzero(group["asked"].to_numpy())
        keep = min(need, len(ids))
        src, dst, dist = best_of_line(group["y"].to_numpy(), asked, keep)
        entries = pa.StructArray.from_arrays([pa.array(dist), ids.take(pa.array(dst))], ["dist", "dst"])
        best = pa.ListArray.from_arrays(pa.array(np.arange(0, len(src) + 1, keep), pa.int32()), entries)
        own = pa.array(asked[src[::keep]])
        vec = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1), pa.int32()), group["y"].combine_chunks().take(own))
        return pa.table({"src": ids.take(own), "vec": vec, "best": best})
    return spread(placed, "at").groupBy("at").applyInArrow(lists, f"src {kind}, vec array<double>, best array<struct<dist:double,dst:{kind}>>")


def _check(k: int, metric: str, allowed) -> None:
    if k < 1:
        raise ValueError("k must be at least 1.")
    if metric not in allowed and not metric.startswith("coded:"):
        raise ValueError(f"Unknown metric {metric!r}; expected one of {allowed}.")


def _self_lists(df: DataFrame, key: str, vec: str, k: int, metric: str, within: str | None,
                probes: int | None) -> DataFrame:
    rows = _prepared(df, key, vec, metric, within, "dst")
    data = checkpoint(_copies(rows, "dst", k + 1))
    points = data.filter(F.col("copy") == 1).withColumnRenamed("dst", "src")
    best = _on_line(data, k + 1) if within is None and probes is None and metric in ("euclidean", "manhattan") else None
    return _own_arrays(rows, points, _listed(_search(points, data, k + 1, metric, probes)) if best is None else best, k)


def _self_edges(df: DataFrame, key: str, vec: str, k: int, metric: str, within: str | None,
                probes: int | None) -> DataFrame:
    return _each(_self_lists(df, key, vec, k, metric, within, probes))


def _listed(found: DataFrame) -> DataFrame:
    return found.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dist", "dst"))).alias("best"))


def _own_arrays(rows: DataFrame, points: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """(src, others) of all rows from the sorted lists (src, best), perhaps with vec, of their distinct vectors; others are (dist, dst)."""
    lists = points.select("cls", "vec", "src").join(best, [c for c in ("src", "vec") if c in best.columns]).select("cls", "vec", "best")
    own = rows.withColumnRenamed("dst", "src").join(lists, ["cls", "vec"])
    others = F.slice(F.filter("best", lambda e: e["dst"] != F.col("src")), 1, k)
    return own.select("src", others.alias("others"))


def _each(lists: DataFrame) -> DataFrame:
    """(src, dst, rank, dist) of lists (src, others)."""
    return lists.select("src", F.posexplode("others").alias("pos", "e")).select(
        "src", "e.dst", (F.col("pos") + 1).cast("int").alias("rank"), "e.dist")


def knn_exact(df: DataFrame, key: str, vec: str, k: int, *, metric: str = "euclidean",
              within: str | None = None) -> DataFrame:
    """The k nearest other rows of every row: (src, dst, rank, dist); ties by id; classes kept apart by ``within``."""
    _check(k, metric, METRICS)
    return _self_edges(df, key, vec, k, metric, within, None)


def knn_lists(df: DataFrame, key: str, vec: str, k: int) -> DataFrame:
    """(src, dst): the k nearest other rows of every row as ``knn_exact`` finds them, as one sorted array."""
    _check(k, "euclidean", METRICS)
    return _self_lists(df, key, vec, k, "euclidean", None, None).select("src", F.col("others.dst").alias("dst"))


def knn_approx(df: DataFrame, key: str, vec: str, k: int, *, metric: str = "euclidean", probes: int = 4,
               within: str | None = None) -> DataFrame:
    """As ``knn_exact``, looking only in the ``probes`` nearest cells, at any size of the table."""
    _check(k, metric, APPROX_METRICS)
    return _self_edges(df, key, vec, k, metric, within, probes)


def _pair_distances(v: np.ndarray, metric: str) -> np.ndarray:
    """Distances among a few vectors, rounded as everywhere."""
    if metric in ("euclidean", "cosine"):
        gap = v[:, None, :] - v[None, :, :]
        total = (gap * gap).sum(axis=2)
        return np.round(total / 2.0 if metric == "cosine" else np.sqrt(total), DIGITS)
    return np.round(tile_distances(v, v, metric), DIGITS)


def _meet(around: DataFrame, metric: str) -> DataFrame:
    """(src, dst, dist): pairs of members around a row, at least one of them new, that would enter the list of src.

    around: (members) arrays of (id, vec, fresh, worst); worst is the last distance of the member's own list.
    """
    kind = next(f.dataType for f in around.schema["members"].dataType.elementType if f.name == "id").simpleString()

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            src, dst, dist = [], [], []
            for members in batch["members"]:
                v = np.array([np.asarray(m["vec"], dtype=float) for m in members])
                fresh, worst = np.array([m["fresh"] for m in members]), np.array([m["worst"] for m in members], dtype=float)
                ids = np.array([m["id"] for m in members], dtype=object)
                d = _pair_distances(v, metric)
                wanted = (fresh[:, None] | fresh[None, :]) & (d <= worst[:, None])
                np.fill_diagonal(wanted, False)
                i, j = np.nonzero(wanted)
                src.append(ids[i])
                dst.append(ids[j])
                dist.append(d[i, j])
            if src:
                yield pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst), "dist": np.concatenate(dist)})
    return spread(around).mapInPandas(meet, f"src {kind}, dst {kind}, dist double")


def _descend(points: DataFrame, need: int, metric: str, rounds: int) -> DataFrame:
    """(src, dst, dist): lists of the ``need`` nearest other points by neighbour descent."""
    vectors = points.select(F.col("src").alias("id"), "vec")
    data = points.select("cls", F.col("src").alias("dst"), "vec", F.lit(1).alias("copy"))
    order = Window.partitionBy("src").orderBy("dist", "dst")
    nearest = lambda df: df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= need).drop("_rank")
    start = _search(points, data, need + 1, metric, START_PROBES).filter("src <> dst").select("src", "dst", "dist")
    lists = checkpoint(nearest(start).withColumn("fresh", F.lit(True)))
    total = max(lists.count(), 1)
    for _ in range(rounds):
        ends = lists.select(F.col("src").alias("mid"), F.col("dst").alias("id"), "dist", "fresh").unionByName(
            lists.select(F.col("dst").alias("mid"), F.col("src").alias("id"), "dist", "fresh"))
        ends = ends.groupBy("mid", "id").agg(F.min("dist").alias("dist"), F.max("fresh").alias("fresh"))
        # A row that very many list is ranked in parts first, so no task sees them all.
        for parts in ([F.pmod(F.xxhash64("id"), F.lit(SALTS))], []):
            ranked = Window.partitionBy("mid", *parts).orderBy("dist", "id")
            ends = ends.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= AROUND * need).drop("_rank")
        worst = lists.groupBy("src").agg(F.when(F.count(F.lit(1)) >= need, F.max("dist")).otherwise(F.lit(float("inf"))).alias("worst"))
        known = checkpoint(vectors.join(worst, F.col("id") == F.col("src"), "left").select("id", "vec", F.coalesce("worst", F.lit(float("inf"))).alias("worst")))
        own = known.select(F.col("id").alias("mid"), F.struct("id", "vec", F.lit(False).alias("fresh"), "worst").alias("m"))
        others = ends.select("mid", "id", "fresh").join(known, "id").select("mid", F.struct("id", "vec", "fresh", "worst").alias("m"))
        around = own.unionByName(others).groupBy("mid").agg(F.collect_list("m").alias("members"))
        around = around.filter(F.exists("members", lambda m: m["fresh"])).select("members")
        met = _meet(around, metric).groupBy("src", "dst").agg(F.min("dist").alias("dist")).withColumn("fresh", F.lit(True))
        both = lists.withColumn("fresh", F.lit(False)).unionByName(met).groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.min("fresh").alias("fresh"))
        lists = checkpoint(nearest(both))
        if lists.filter("fresh").count() <= SETTLED * total:
            break
    return lists.select("src", "dst", "dist")


def knn_descent(df: DataFrame, key: str, vec: str, k: int, *, metric: str = "euclidean", within: str | None = None,
                rounds: int = DESCENT_ROUNDS) -> DataFrame:
    """As ``knn_exact``, approximately, by neighbour descent: the work of a round is rows times k squared, in any number of dimensions.

    Equal vectors descend once; their copies are put into the lists at the end. Inner products are refused: that a neighbour of a
    neighbour is likely near holds for distances only.
    """
    _check(k, metric, METRICS)
    rows = _prepared(df, key, vec, metric, within, "dst")
    data = checkpoint(_copies(rows, "dst", k + 1))
    points = checkpoint(data.filter(F.col("copy") == 1).select("cls", "vec", F.col("dst").alias("src")))
    lists = _descend(points, max(LEAST_LIST, 2 * (k + 1)), metric, rounds)
    own = points.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("dist"))
    copies = data.join(points.select("cls", "vec", F.col("src").alias("point")), ["cls", "vec"]).select("point", F.col("dst").alias("copy_id"))
    every = lists.unionByName(own).join(copies, F.col("dst") == F.col("point")).select("src", F.col("copy_id").alias("dst"), "dist")
    return _each(_own_arrays(rows, points, _listed(every), k))


def knn_cross(queries: DataFrame, query_key: str, data: DataFrame, data_key: str, vec: str, k: int, *,
              metric: str = "euclidean") -> DataFrame:
    """The k nearest data rows of every query row: (src, dst, rank, dist)."""
    _check(k, metric, METRICS)
    asked = _prepared(queries, query_key, vec, metric, None, "src")
    points = checkpoint(_copies(asked, "src", 1))
    kept = checkpoint(_copies(_prepared(data, data_key, vec, metric, None, "dst"), "dst", k))
    best = _search(points, kept, k, metric, None).withColumnRenamed("src", "point")
    members = asked.join(points.select("cls", "vec", F.col("src").alias("point")), ["cls", "vec"])
    return members.select("src", "point").join(best, "point").select(
        "src", "dst", F.col("place").cast("int").alias("rank"), "dist")


def top_k_neighbours(pairs: DataFrame, k: int) -> DataFrame:
    """The k smallest distances per source of a pair table."""
    order = Window.partitionBy("src").orderBy("dist", "dst")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mutual_neighbours(edges: DataFrame) -> DataFrame:
    """Directed (src, dst) pairs that list each other; a row without any keeps its single nearest, one way."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    mutual = edges.join(back, ["src", "dst"], "left_semi").select("src", "dst")
    alone = edges.filter(F.col("rank") == 1).select("src", "dst").join(mutual, "src", "left_anti")
    return mutual.unionByName(alone)


def neighbour_graph(edges: DataFrame) -> DataFrame:
    """Undirected distance graph (a < b, dist): the larger distance when both directions exist."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.max("dist").alias("dist"))


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact edges that an approximate search found."""
    hits = exact.select("src", "dst").join(found.select("src", "dst", F.lit(1).alias("hit")), ["src", "dst"], "left")
    return hits.agg(F.count(F.lit(1)).alias("edges"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
