"""Fit a mixed-type table, then make new rows of the same schema."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.functions import slots
from twinframe.functions.scalars import MISSING, category_key
from twinframe.operators import neighbours, samplers, transport
from twinframe.operators.decode import MAX_DEPTH, Decoder, LabelTree, decode_categorical, decode_wide, fit_decoder, fit_label_tree
from twinframe.operators.encode import NARROW, Encoding, decode_numeric, encode, fit_encoding, search_vector, without_block
from twinframe.operators.profile import HIGH_CARDINALITY_DISTINCT, HIGH_CARDINALITY_SHARE
from twinframe.operators.project import nca_fit, project
from twinframe.session import checkpoint, side_by_side


@dataclass
class Params:
    n_components: int | Mapping[str, int] = 2
    n_iterations: int = 1
    n_neighbours: int = 10
    factor: float = 1.0
    min_factor: float | None = None
    seed: int = 42
    fit_sample_size: int | float | None = None  # rows a projection is fitted on; None: all
    nca_max_iter: int = 100
    search: str = "exact"
    probes: int = 4
    trees: int = 100
    depth: int = MAX_DEPTH
    decoder_fit_rows: int | None = None  # a forest sees at most so many rows, at least one of each class; None: all
    narrow: int = NARROW  # a category of more keys is kept in sparse entries and decoded by a label tree
    calibrate: bool = False
    folds: int | None = None
    quantile_guard: float | None = 0.1
    retries: int = 5

    def check(self) -> "Params":
        widths = self.n_components.values() if isinstance(self.n_components, Mapping) else [self.n_components]
        if any(w < 1 for w in widths):
            raise ValueError("n_components must be at least 1.")
        if self.n_iterations < 0:
            raise ValueError("n_iterations must not be negative.")
        if self.n_neighbours < 1:
            raise ValueError("n_neighbours must be at least 1.")
        if self.retries < 0:
            raise ValueError("retries must not be negative.")
        if self.quantile_guard is not None and not 0 <= self.quantile_guard < 0.5:
            raise ValueError("quantile_guard must be None or lie in [0, 0.5).")
        if self.min_factor is not None and self.factor < self.min_factor:
            raise ValueError("factor must not be below min_factor.")
        size = self.fit_sample_size
        if isinstance(size, bool) or (isinstance(size, int) and size < 1) or (
                isinstance(size, float) and not 0 < size <= 1):
            raise ValueError("fit_sample_size must be None, a positive whole number or a share in (0, 1].")
        if size is not None and not isinstance(size, (int, float)):
            raise TypeError("fit_sample_size must be None, a positive whole number or a share in (0, 1].")
        if self.decoder_fit_rows is not None and self.decoder_fit_rows < 1:
            raise ValueError("decoder_fit_rows must be None or positive.")
        if self.search not in ("exact", "approx", "descent"):
            raise ValueError("search must be 'exact', 'approx' or 'descent'.")
        return self

    def width(self, column: str) -> int:
        return int(self.n_components.get(column, 2)) if isinstance(self.n_components, Mapping) else int(self.n_components)


@dataclass
class Step:
    """One projection: block ``column`` becomes ``matrix`` times all other blocks.

    The matrix has a column for each written-out coordinate of the other blocks, then, if there are wide blocks, one for each of their slots;
    ``slot`` is the block of the column itself among these.
    """

    column: str
    before: tuple[int, int]
    total: int
    matrix: list[list[float]] | None
    width: int
    slot: tuple[int, int] | None = None

    def apply(self, df: DataFrame, z: str = "z", sparse: str = slots.NAME) -> DataFrame:
        context = with_context(df, self.before, self.total, self.slot, z, sparse)
        matrix = None if self.matrix is None else np.array(self.matrix)
        out = project(context, matrix, self.width, x="_x", sparse="_s", name="_y")
        start, size = self.before
        out = out.withColumn(z, F.concat(F.slice(z, 1, start), F.col("_y"), F.slice(z, start + size + 1, max(self.total - start - size, 0))))
        return (out.withColumn(sparse, F.col("_s")) if self.slot else out).drop("_x", "_s", "_y")


def with_context(df: DataFrame, block: tuple[int, int], total: int, slot: tuple[int, int] | None, z: str = "z", sparse: str = slots.NAME) -> DataFrame:
    """Add all but one block of a latent vector: coordinates _x and, where there are wide blocks, sparse entries _s."""
    out = df.withColumn("_x", without_block(F.col(z), block, total))
    if sparse not in df.columns:
        return out
    return out.withColumn("_s", F.col(sparse) if slot is None else slots.without(F.col(sparse), slot))


@dataclass
class TableModel:
    """Fitted state: bounded statistics and matrices, tables (latent rows, edges, the dictionary of wide columns) and the decoders.

    Latent rows have written-out coordinates z and, while wide columns are not projected, sparse entries; ``sparse`` are the blocks of these.
    """

    params: Params
    encoding: Encoding
    steps: list[Step]
    blocks: dict[str, tuple[int, int]]
    latent: DataFrame          # row_id, z, perhaps entries
    edges: DataFrame | None    # src, dst; None when only whole latent rows can be drawn
    bounds: dict[int, tuple[float, float]]
    decoders: dict[str, Decoder | LabelTree] = field(default_factory=dict)
    row_id: str = "row_id"
    sparse: dict[str, tuple[int, int]] = field(default_factory=dict)

    @property
    def width(self) -> int:
        """Of the written-out coordinates."""
        return sum(w for _, w in self.blocks.values())

    @property
    def parts(self) -> list[str]:
        """The columns of a latent vector."""
        return ["z", slots.NAME] if self.sparse else ["z"]

    def transform(self, df: DataFrame, name: str = "z") -> DataFrame:
        """Add the latent vector of new rows: row-wise, but for the dictionary joins of wide columns, whose entries are added."""
        out = encode(df, self.encoding, name=name)
        for step in self.steps:
            out = step.apply(out, name)
        return out if self.sparse or not self.encoding.wide else out.drop(slots.NAME)

    def neighbour_vector(self) -> tuple[Column, str]:
        """(vector, metric) in which latent rows are compared: Euclidean, with one code in place of each wide block."""
        if not self.sparse:
            return F.col("z"), "euclidean"
        return search_vector(list(self.sparse.values())), neighbours.coded(self.width)

    def context(self, column: str) -> Column | None:
        """What a decoder sees: all other blocks, wide ones as the digits of their strongest key; None when there is no other."""
        others = [block for c, block in self.sparse.items() if c != column]
        if self.width == self.blocks[column][1] and not others:
            return None
        dense = without_block(F.col("z"), self.blocks[column], self.width)
        return F.concat(dense, F.array(*slots.features(F.col(slots.NAME), others, self.params.narrow))) if others else dense

    def inverse_transform(self, latent: DataFrame, *, sample: bool = True, row: str = "row", probabilities: bool = False) -> DataFrame:
        """Latent rows (row, z, perhaps entries) to rows of the fitted schema; other columns are kept in front.

        A vector of another width than the model's raises when it is read. ``probabilities`` adds a struct of that name with those that each
        category was decoded by: a map of keys, for a label tree the branches' shares of each level.
        """
        keep = [c for c in latent.columns if c not in self.parts]
        wrong = F.raise_error(F.concat(F.lit(f"A latent vector must have {self.width} coordinates, found "), F.size("z").cast("string")))
        out = latent.withColumn("z", F.when(F.size("z") == self.width, F.col("z")).otherwise(wrong))
        for column, decoder in self.decoders.items():
            context = self.context(column)
            if context is not None:
                out = out.withColumn("_ctx", context)
            given = dict(context=None if context is None else "_ctx", name=f"_c_{column}", sample=sample, seed=self.params.seed, row=row,
                         keep=f"_p_{column}" if probabilities else None)
            out = decode_wide(out, decoder, self.encoding.keys(column), **given) if isinstance(decoder, LabelTree) else decode_categorical(out, decoder, **given)
        numbers = decode_numeric(F.col("z"), self.encoding)
        cells = []
        for c in self.encoding.columns:
            kind = self.encoding.types[c]
            if c in numbers:
                cells.append(numbers[c].alias(c))
            else:
                key = F.col(f"_c_{c}")
                cells.append(F.when(key != F.lit(MISSING), key).cast(kind).alias(c))
        told = [F.struct(*[F.col(f"_p_{c}").alias(c) for c in self.decoders]).alias("probabilities")] if probabilities and self.decoders else []
        return out.select(*keep, *cells, *told)

    def generate_latent(self, n: int | None = None, *, classes: DataFrame | None = None, target: str | None = None) -> DataFrame:
        """(row, attempt, accepted, anchor, b, c, z, perhaps entries); with classes (src, cls) of the fitted rows balanced over classes, or all of one."""
        n = self.encoding.rows if n is None else n
        if n < 0:
            raise ValueError("n must not be negative.")
        p = self.params
        if self.edges is None:
            latent = self.latent
            if target is not None:
                if classes is None:
                    raise ValueError("A target class needs the classes of the rows.")
                latent = latent.join(classes.filter(category_key(F.col("cls")) == F.lit(target)).select(F.col("src").alias("row_id")), "row_id")
                if n and latent.isEmpty():
                    raise ValueError(f"No rows match class {target!r}.")
            rows = samplers.bootstrap_rows(latent, "row_id", n, p.seed)
            nothing = F.lit(None).cast(self.latent.schema["row_id"].dataType)
            return rows.select("row", F.lit(0).alias("attempt"), F.lit(True).alias("accepted"),
                               F.col("row_id").alias("anchor"), nothing.alias("b"), nothing.alias("c"), *self.parts)
        return transport.generate_latent(
            self.latent, "row_id", self.edges, n, seed=p.seed, factor=p.factor,
            min_factor=p.factor if p.min_factor is None else p.min_factor, bounds=self.bounds, retries=p.retries,
            classes=classes, target=target)

    def generate(self, n: int | None = None, *, classes: DataFrame | None = None, target: str | None = None) -> DataFrame:
        """(row, columns...): n new rows, as many as were fitted by default."""
        return self.inverse_transform(self.generate_latent(n, classes=classes, target=target).select("row", *self.parts)).select("row", *self.encoding.columns)

    def trace(self, n: int | None = None) -> DataFrame:
        """Each generated row with the rows it came from, its displacement of the written-out coordinates, whether it was accepted and the
        probabilities its categories were drawn from."""
        made = self.generate_latent(n)
        at = self.latent.select(F.col("row_id").alias("b"), F.col("z").alias("_zb")).join(
            made.select("row", "b", "c"), "b").join(
            self.latent.select(F.col("row_id").alias("c"), F.col("z").alias("_zc")), "c").select(
            "row", F.zip_with("_zc", "_zb", lambda c, b: c - b).alias("displacement"))
        return self.inverse_transform(made.join(at, "row", "left"), probabilities=True)

    def save(self, path: str) -> str:
        """A folder: JSON state, latent rows, edges and dictionary as Parquet, one folder per forest."""
        spark = self.latent.sparkSession
        told = lambda d: {"classes": d.classes, "status": d.status, "prior": d.prior, "sigmoids": d.sigmoids, "forests": len(d.forests)}
        state = {"params": asdict(self.params), "encoding": json.loads(self.encoding.to_json()),
                 "steps": [asdict(s) for s in self.steps], "blocks": self.blocks, "sparse": self.sparse,
                 "bounds": {str(k): v for k, v in self.bounds.items()}, "has_edges": self.edges is not None,
                 "decoders": {c: {"count": d.count, "base": d.base, "status": d.status, "levels": [told(x) for x in d.levels]}
                              if isinstance(d, LabelTree) else told(d) for c, d in self.decoders.items()}}
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")
        self.latent.write.mode("overwrite").parquet(f"{path}/latent")
        if self.edges is not None:
            self.edges.write.mode("overwrite").parquet(f"{path}/edges")
        if self.encoding.dictionary is not None:
            self.encoding.dictionary.write.mode("overwrite").parquet(f"{path}/dictionary")
        for place, d in enumerate(self.decoders.values()):
            for i, forest in enumerate(d.forests):
                forest.write().overwrite().save(f"{path}/forest-{place}-{i}")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TableModel":
        state = json.loads(spark.read.text(f"{path}/state").first()[0])
        decoders = {}
        for place, (c, d) in enumerate(state["decoders"].items()):
            known = iter(range(10 ** 6))
            read = lambda n: [RandomForestClassificationModel.load(f"{path}/forest-{place}-{next(known)}") for _ in range(n)]
            made = lambda x: Decoder(x["classes"], x["status"], x["prior"], read(x["forests"]), x["sigmoids"])
            decoders[c] = LabelTree(d["count"], d["base"], [made(x) for x in d["levels"]], d["status"]) if "levels" in d else made(d)
        steps = [Step(s["column"], tuple(s["before"]), s["total"], s["matrix"], s["width"], tuple(s["slot"]) if s["slot"] else None) for s in state["steps"]]
        encoding = Encoding(**state["encoding"])
        if encoding.sizes:
            encoding.dictionary = spark.read.parquet(f"{path}/dictionary")
        return cls(Params(**state["params"]), encoding, steps,
                   {k: tuple(v) for k, v in state["blocks"].items()}, spark.read.parquet(f"{path}/latent"),
                   spark.read.parquet(f"{path}/edges") if state["has_edges"] else None,
                   {int(k): tuple(v) for k, v in state["bounds"].items()}, decoders, sparse={k: tuple(v) for k, v in state["sparse"].items()})


def fit_latent(df: DataFrame, row_id: str, columns: list[str], params: Params) -> TableModel:
    """Encoding, projection rounds and the latent table, without neighbours or decoders."""
    enc = fit_encoding(df, columns, narrow=params.narrow)
    limit = max(HIGH_CARDINALITY_DISTINCT, int(enc.rows * HIGH_CARDINALITY_SHARE))
    for c in enc.categorical:
        if enc.cardinality(c) > limit:
            warnings.warn(f"Column {c!r} has {enc.cardinality(c)} categories; recode it on purpose before fitting.", UserWarning)
    keys = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(f"_k_{c}") for c in enc.categorical]
    table = encode(df, enc).select(F.col(row_id).alias("row_id"), "z", *([slots.NAME] if enc.wide else []), *keys)
    table = checkpoint(table)
    blocks, sparse, steps = enc.blocks(), enc.slots(), []
    every = sum(enc.sizes.values())
    for _ in range(params.n_iterations):
        for c in enc.categorical:
            total = sum(w for _, w in blocks.values())
            matrix, open_ = None, [x for x in sparse if x != c]
            if (total > blocks[c][1] or open_) and enc.cardinality(c) > 1:
                seen = with_context(table, blocks[c], total, sparse.get(c)).select("row_id", F.col("_x").alias("x"), *([F.col("_s").alias("s")] if sparse else []),
                                                                                    F.col(f"_k_{c}").alias("label"))
                sample = samplers.stratified_fit_sample(seen, "row_id", "label", params.fit_sample_size, params.seed)
                matrix = nca_fit(sample, "row_id", "x", "label", params.width(c), sparse="s" if sparse else None, slot_count=every if sparse else 0,
                                 max_iter=params.nca_max_iter, seed=params.seed)
            step = Step(c, blocks[c], total, None if matrix is None else matrix.tolist(), params.width(c), sparse.pop(c, None))
            steps.append(step)
            table = step.apply(table)
            if step.slot and not sparse:
                table = table.drop(slots.NAME)
            blocks, at = {name: (0, step.width if name == c else w) for name, (_, w) in blocks.items()}, 0
            for name, (_, w) in blocks.items():
                blocks[name], at = (at, w), at + w
    if steps:
        table = checkpoint(table)
    return TableModel(params, enc, steps, blocks, table, None, {}, sparse=sparse)


def fit(df: DataFrame, row_id: str, *, columns: list[str] | None = None, params: Params | None = None,
        edges: Callable[[DataFrame], DataFrame] | DataFrame | None = None) -> TableModel:
    """Fit everything.  ``edges`` may replace the neighbour search by a table (src, dst) or a function of the latent table."""
    p = (params or Params()).check()
    columns = columns or [c for c in df.columns if c != row_id]
    model = fit_latent(df, row_id, columns, p)
    table, enc = model.latent, model.encoding

    def decoder(c: str) -> Decoder:
        context = model.context(c)
        rows = table.select("row_id", F.col(f"_k_{c}").alias("label"), *([] if context is None else [context.alias("x")]))
        if context is not None and p.decoder_fit_rows is not None:
            rows = samplers.stratified_fit_sample(rows, "row_id", "label", p.decoder_fit_rows, p.seed)
        x, settings = None if context is None else "x", dict(trees=p.trees, depth=p.depth, seed=p.seed, calibrate=p.calibrate, folds=p.folds)
        if c not in enc.sizes:
            return fit_decoder(rows, "row_id", x, "label", enc.categories[c], **settings)
        numbered = checkpoint(rows.join(enc.keys(c), F.col("label") == F.col("key")).drop("key"))
        return fit_label_tree(numbered, "row_id", x, "idx", enc.sizes[c], branches=p.narrow, **settings)
    model.decoders = dict(zip(enc.categorical, side_by_side([lambda c=c: decoder(c) for c in enc.categorical])))
    model.latent = table.select("row_id", *model.parts)
    if enc.rows >= 2 and (model.width or model.sparse):
        if isinstance(edges, DataFrame):
            found = edges
        elif edges is not None:
            found = edges(model.latent)
        else:
            k = min(p.n_neighbours, enc.rows - 1)
            vector, metric = model.neighbour_vector()
            placed = model.latent.select("row_id", vector.alias("v"))
            find = {"exact": neighbours.knn_exact, "descent": neighbours.knn_descent,
                    "approx": lambda *a, **more: neighbours.knn_approx(*a, probes=p.probes, **more)}[p.search]
            lists = find(placed, "row_id", "v", k, metric=metric)
            found = neighbours.mutual_neighbours(checkpoint(lists))
        model.edges = checkpoint(found.select("src", "dst"))
        model.bounds = transport.quantile_bounds(model.latent, range(len(enc.numeric)), p.quantile_guard)
    return model
