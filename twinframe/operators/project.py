"""Supervised linear projection: neighbourhood components, and principal components, of latent contexts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.functions import rng
from twinframe.functions.ordered import dense_index
from twinframe.functions.scalars import dot
from twinframe.operators.neighbours import knn_lists
from twinframe.session import checkpoint, discard, scratch, spread

MAX_COORDINATES = 1_000_000  # of a context: the matrix and its gradient are held by the driver and by each task
NEAR, FAR = 32, 32           # partners of a row: its nearest under the current projection, and rows drawn from all others
REFRESH = 4                  # steps before partners are looked for anew; each time twice as many as before
MEMORY = 8                   # steps the ascent looks back on
POWER_ROUNDS = 8             # of the principal directions
OWN, CLOSE, DRAWN = 0, 1, 2  # a row itself, its near partners, its drawn ones
TILE_ROWS, TILE_BYTES = 1 << 17, 1 << 24  # partners written together
SHUFFLED = 1 << 25           # partners on their way to their rows at once


class Vectors:
    """Contexts of a batch: written-out coordinates and, behind them, sparse ones."""

    def __init__(self, dense: pa.Array, sparse: pa.Array | None, total: int):
        self.n, self.total = len(dense), total
        flat = dense.flatten().to_numpy(zero_copy_only=False)
        self.width = len(flat) // self.n if self.n else 0
        self.dense = flat.reshape(self.n, self.width)
        self.row = self.number = np.zeros(0, np.int64)
        self.value = np.zeros(0)
        if sparse is not None and self.n:
            lists = sparse.field("indices")
            self.row = np.repeat(np.arange(self.n), np.diff(lists.offsets.to_numpy()))
            self.number = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + self.width
            self.value = sparse.field("values").flatten().to_numpy(zero_copy_only=False)

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """Rows times the transposed matrix."""
        out = self.dense @ matrix[:, :self.width].T
        for j, line in enumerate(matrix):
            out[:, j] += np.bincount(self.row, self.value * line[self.number], minlength=self.n)
        return out

    def back(self, u: np.ndarray) -> np.ndarray:
        """The sum over rows of u times the row: (columns of u, coordinates)."""
        out = np.zeros((u.shape[1], self.total))
        out[:, :self.width] = u.T @ self.dense
        for j in range(u.shape[1]):
            out[j, self.width:] = np.bincount(self.number - self.width, self.value * u[self.row, j], minlength=self.total - self.width)
        return out


def agreement(own: Vectors, partners: Vectors, counts: np.ndarray, same: np.ndarray, weight: np.ndarray, matrix: np.ndarray) -> tuple[float, np.ndarray]:
    """Soft class agreement of rows with their partners, and its gradient.

    Row i has the next counts[i] partners, at least one. A partner is chosen with a chance that falls with the squared distance of
    the projections; weight tells how many rows it stands for.
    """
    a, b = own.times(matrix), partners.times(matrix)
    row = np.repeat(np.arange(own.n), counts)
    first = np.cumsum(counts) - counts
    gap = a[row] - b
    pull = np.log(weight) - (gap * gap).sum(axis=1)
    p = np.exp(pull - np.maximum.reduceat(pull, first)[row])
    p /= np.add.reduceat(p, first)[row]
    agree = np.add.reduceat(p * same, first)
    moved = (p * (agree[row] - same))[:, None] * gap
    return float(agree.sum()), 2.0 * (own.back(np.add.reduceat(moved, first, axis=0)) - partners.back(moved))


def summed(df: DataFrame, work: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of a vector of numbers; each task sends its own sum once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += work(batch)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["i", "v"])
    out = np.zeros(size)
    for r in df.mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def _vectors(struct: pa.StructArray, sparse: bool, total: int) -> Vectors:
    return Vectors(struct.field("x"), struct.field("s") if sparse else None, total)


def principal_directions(table: DataFrame, sparse: bool, rows: int, total: int, k: int) -> np.ndarray:
    """(k x total) leading directions of the centred vectors of (v), by repeated products with all rows."""
    ones = lambda batch: _vectors(batch.column(0), sparse, total).back(np.ones((batch.num_rows, 1))).ravel()
    mean = summed(table.select("v"), ones, total) / rows
    wide = min(k + 4, total)
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(total, wide)))[0]
    for _ in range(POWER_ROUNDS):
        def product(batch: pa.RecordBatch, q: np.ndarray = q) -> np.ndarray:
            v = _vectors(batch.column(0), sparse, total)
            y = v.times(q.T) - mean @ q
            return np.append((v.back(y) - np.outer(y.sum(axis=0), mean)).ravel(), (y.T @ y).ravel())
        found = summed(table.select("v"), product, wide * total + wide * wide)
        _, turn = np.linalg.eigh(found[wide * total:].reshape(wide, wide))
        lead = (q @ turn[:, ::-1]).T  # under the q that the products were made with
        q = np.linalg.qr(found[:wide * total].reshape(wide, total).T)[0]
    flip = np.sign(lead[np.arange(wide), np.abs(lead).argmax(axis=1)])
    return (lead * np.where(flip == 0, 1.0, flip)[:, None])[:k]


def _written(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _read(tile: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(tile.as_buffer()).read_next_batch()


def tile(part: pa.RecordBatch, rows: int) -> list[bytes]:
    """Rows (src, kind, dst, label, v) of whole groups, ordered by src, as (own, others): vectors and number of partners; far, same and vector of these.

    Drawn partners that are among the near ones of the row are left out.
    """
    src, kind, dst = (part.column(i).to_numpy() for i in range(3))
    code = part.column(3).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    own = np.flatnonzero(kind == OWN)
    row = np.searchsorted(src[own], src)
    pair, close = row * rows + dst, kind == CLOSE
    at = np.flatnonzero(close | ((kind == DRAWN) & ~np.isin(pair, pair[close])))
    same = (code[at] == code[own][row[at]]) & (code[at] >= 0)
    counts = np.bincount(row[at], minlength=len(own))
    v = part.column(4)
    return [_written(pa.RecordBatch.from_arrays([v.take(pa.array(own)), pa.array(counts)], ["v", "count"])),
            _written(pa.RecordBatch.from_arrays([pa.array(kind[at] == DRAWN), pa.array(same), v.take(pa.array(at))], ["far", "same", "v"]))]


def partners(table: DataFrame, matrix: np.ndarray, rows: int, near: int, far: int, seed: int, turn: int) -> DataFrame:
    """(own, others): tiles of rows with their partners, written: near ones and drawn ones that are not among them.

    ``table`` holds (no, v, label), rows numbered from 0. A tile holds whole Arrow batches, so that a pass does not turn every partner from a row into a batch again.
    Rows meet their partners slice by slice, so that of what is shuffled only SHUFFLED partners lie on disk at a time. The tiles are the caller's to discard.
    """
    with scratch() as made:
        placed = checkpoint(project(table.select("no", "v.*"), matrix, len(matrix)).select("no", "y"))
        lists = checkpoint(knn_lists(placed, "no", "y", near))
        del placed
        made.remove(lists)
    step = max(1, SHUFFLED // (near + far + 1))
    tiles = []
    for low in range(0, rows, step):
        with scratch() as made:
            tiles.append(_tiles(table, lists, low, low + step, rows, far, seed, turn))
            made.remove(tiles[-1])
    discard(lists)
    return reduce(DataFrame.unionByName, tiles)


def _tiles(table: DataFrame, lists: DataFrame, low: int, high: int, rows: int, far: int, seed: int, turn: int) -> DataFrame:
    """Tiles of the rows from ``low`` up to ``high``; lists: (src, dst) with an array of the near partners."""
    inside = lambda df, number: df.filter((F.col(number) >= low) & (F.col(number) < high))
    own = inside(table, "no")
    pairs = inside(lists, "src").select("src", F.explode("dst").alias("dst"), F.lit(CLOSE).alias("kind"))
    if far:
        pairs = pairs.unionByName(own.select(F.col("no").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(far - 1))).alias("_j")).select(
            "src", rng.uniform_index(rows, seed, f"nca.{turn}", "src", "_j").alias("dst"), F.lit(DRAWN).alias("kind")).filter("src <> dst"))
    columns = ["src", "kind", "dst", "label", "v"]
    met = pairs.join(table.withColumnRenamed("no", "dst").hint("shuffle_hash"), "dst").select(*columns).unionByName(
        own.select(F.col("no").alias("src"), F.lit(OWN).alias("kind"), F.col("no").alias("dst"), "label", "v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda part: pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in tile(part, rows)], ["own", "others"])
        whole = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        held, size, count = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size, count = size + batch.nbytes, count + batch.num_rows
            if size >= TILE_BYTES or count >= TILE_ROWS:
                part = whole(held)
                src = part.column(0).to_numpy()
                cut = int(np.searchsorted(src, src[-1]))  # the last group may go on
                if cut:
                    yield made(part.slice(0, cut))
                held = [part.slice(cut)]
                size, count = held[0].nbytes, held[0].num_rows
        if held:
            yield made(whole(held))
    return checkpoint(spread(met, "src").sortWithinPartitions("src", "kind", "dst").mapInArrow(pack, "own binary, others binary"))


def nca_fit(rows: DataFrame, key: str, context: str, label: str, width: int, *, sparse: str | None = None, slot_count: int = 0,
            max_iter: int = 100, tolerance: float = 1e-5, near: int = NEAR, far: int = FAR, seed: int = 42) -> np.ndarray | None:
    """(width x context) matrix maximising the soft class agreement of all rows; None when there is nothing to learn.

    A row's chance to choose another falls with their projected distance. Its nearest rows under the current projection count
    each, the others through some that are drawn from them, each of which stands for its share; where both together are all others, all
    count and the result is exact. Partners are written next to their row, so a step is one pass over them without a shuffle, and
    looked for anew after 4, 8, 16, ... further steps, or when nothing more is gained. Ascent by limited-memory quasi-Newton steps from the principal directions.
    The context may have sparse entries behind its coordinates.
    """
    v = F.struct(F.col(context).cast("array<double>").alias("x"), *([F.col(sparse).alias("s")] if sparse else []))
    listed = rows.select(F.col(key).cast("string").alias("_id"), v.alias("v"), F.col(label).alias("label"))
    table = checkpoint(dense_index(listed, "_id", name="no").select("no", "v", "label"))
    size = table.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v.x")).alias("w"), F.min("label").alias("a"), F.max("label").alias("b")).first()
    n, total = size["n"], max(size["w"] or 0, 0) + slot_count
    if total == 0 or size["a"] == size["b"]:
        return None
    if total > MAX_COORDINATES:
        raise ValueError(f"A context of more than {MAX_COORDINATES} coordinates cannot be projected: drop or recode its widest columns.")
    k, has = min(width, total), sparse is not None
    if n - 1 <= near + far:
        near, far = n - 1, 0
    matrix = principal_directions(table, has, n, total, k)
    shape = matrix.shape
    stands = max(n - 1 - near, 0)

    def evaluate(tiles: DataFrame, m: np.ndarray) -> tuple[float, np.ndarray]:
        def work(batch: pa.RecordBatch) -> np.ndarray:
            value = np.zeros(1 + m.size)
            for mine, theirs in zip(batch.column(0), batch.column(1)):
                own, others = _read(mine), _read(theirs)
                counts, distant = own.column(1).to_numpy(), others.column(0).to_numpy(zero_copy_only=False)
                first = np.cumsum(counts) - counts
                drawn = np.repeat(np.add.reduceat(distant.astype(float), first), counts)
                weight = np.where(distant, stands / np.maximum(drawn, 1.0), 1.0)
                f, g = agreement(_vectors(own.column(0), has, total), _vectors(others.column(2), has, total), counts,
                                 others.column(1).to_numpy(zero_copy_only=False), weight, m.reshape(shape))
                value += np.append(f, g.ravel())
            return value
        found = summed(tiles, work, 1 + m.size)
        return found[0], found[1:]

    point, step, spans, turn = matrix.ravel(), 0, REFRESH, 0
    while step < max_iter:
        tiles = partners(table, point.reshape(shape), n, near, far, seed, turn)
        point, made, settled = ascend(lambda m: evaluate(tiles, m), point, min(spans, max_iter - step) if far else max_iter, tolerance)
        discard(tiles)  # before the next ones are written
        if settled and (made <= 2 or not far):  # nothing was gained from new partners
            break
        step, spans, turn = step + spans, spans * 2, turn + 1
    discard(table)
    return point.reshape(shape)


def ascend(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], point: np.ndarray, steps: int, tolerance: float) -> tuple[np.ndarray, int, bool]:
    """(point, evaluations, whether nothing more is gained): quasi-Newton ascent that halves a step until the value grows."""
    value, slope = evaluate(point)
    pairs, made = [], 1
    while made <= steps:
        direction, kept = slope.copy(), []
        for s, y in reversed(pairs):
            share = s @ direction / (s @ y)
            kept.append(share)
            direction -= share * y
        if pairs:
            s, y = pairs[-1]
            direction *= abs(s @ y) / (y @ y)
            for (s, y), share in zip(pairs, reversed(kept)):
                direction += s * (share - y @ direction / (s @ y))
        else:
            direction /= max(np.abs(slope).max(), 1e-12)
        length = 1.0
        while made <= steps:
            trial = point + length * direction
            f, g = evaluate(trial)
            made += 1
            if f > value:
                break
            length *= 0.4
            if length * np.abs(direction).max() < 1e-9:
                return point, made, True
        else:
            return point, made, False
        moved, bent, gain = trial - point, slope - g, f - value
        point, value, slope = trial, f, g
        if moved @ bent > 1e-12 * (moved @ moved):  # the value bends downwards along the step
            pairs = [*pairs, (moved, bent)][-MEMORY:]
        if gain < tolerance * max(abs(value), 1.0):
            return point, made, True
    return point, made, False


def project(df: DataFrame, matrix: np.ndarray | None, k: int, *, x: str = "x", sparse: str = "s", name: str = "y") -> DataFrame:
    """df with the projected context, zero padded to k values; no matrix gives zeros.

    Where df has sparse entries, the matrix goes on over them behind the written-out context.
    """
    if matrix is None or sparse not in df.columns:
        return df.withColumn(name, apply_matrix(F.col(x), matrix, k))
    whole = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(matrix))  # at most MAX_COORDINATES columns

    @F.arrow_udf("array<double>")
    def projected(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for dense, entries in batches:
            out = Vectors(dense, entries, whole.value.shape[1]).times(whole.value)
            out = np.concatenate([out, np.zeros((len(out), k - out.shape[1]))], axis=1)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, k), pa.int32()), pa.array(out.ravel()))
    return df.withColumn(name, projected(F.col(x), F.col(sparse)))


def apply_matrix(context: Column, matrix: np.ndarray | None, width: int) -> Column:
    """Projected context, zero padded to ``width``; no matrix gives zeros."""
    rows = [] if matrix is None else [dot(context, F.array(*[F.lit(float(x)) for x in row])) for row in matrix]
    return F.array(*rows, *[F.lit(0.0)] * (width - len(rows)))


def pca_projection(df: DataFrame, vec: str, width: int, name: str = "pca", train: DataFrame | None = None) -> DataFrame:
    """Leading principal components of centred vectors, zero padded to ``width``."""
    base = train if train is not None else df
    size = base.select(F.size(vec).alias("n")).first()["n"]
    k = min(width, size)
    mean = base.agg(F.array(*[F.avg(F.col(vec)[i]) for i in range(size)]).alias("m")).first()["m"]
    centre = F.array_compact(F.array(*[F.lit(float(x)) for x in mean]))
    centred = lambda d: d.withColumn("_c", array_to_vector(F.zip_with(F.col(vec).cast("array<double>"), centre, lambda a, b: a - b)))
    model = PCA(k=k, inputCol="_c", outputCol="_pc").fit(centred(base))
    out = model.transform(centred(df)).withColumn(name, vector_to_array("_pc")).drop("_c", "_pc")
    if k < width:
        out = out.withColumn(name, F.concat(F.col(name), F.array(*[F.lit(0.0)] * (width - k))))
    return out


def project_two_dims(tables: dict[str, DataFrame], vec: str) -> DataFrame:
    """Standardise the stacked vectors of several tables, keep two principal components: (side, ..., x, y)."""
    stacked = None
    for side, df in tables.items():
        part = df.withColumn("side", F.lit(side))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    size = stacked.select(F.size(vec).alias("n")).first()["n"]
    fitted = stacked.agg(*[f(F.col(vec)[i]).alias(f"{t}{i}") for i in range(size)
                           for t, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = F.array(*[(F.col(vec)[i] - F.lit(float(fitted[f"m{i}"]))) / F.lit(float(fitted[f"s{i}"] or 0.0) or 1.0)
                       for i in range(size)])
    out = pca_projection(stacked.withColumn("_v", scaled), "_v", 2, "_p")
    return out.withColumn("x", F.col("_p")[0]).withColumn("y", F.col("_p")[1]).drop("_v", "_p")
