"""Vector search over a kept cell index: exact by the cells' radii, for any number of queries and for filtered collections.

Vectors of length 1 go to the nearest of a bounded number of pivots; a cell keeps the largest angle to its pivot. What a
cell can hold for a query follows from the angle to the pivot less that radius. A query is searched in its nearest cell
first, and then in those cells only that may hold something as good as its k-th find. Queries and vectors of a cell meet
in blocks of bounded size, so neither side is ever broadcast or gathered; filters apply before distances.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.operators.postings import version_of
from gridwright.sources.scratch import keep, shared_dir

PIVOTS = 1024  # at most; the square root of the vectors' number if that is less
ROWS, ASKED = 4096, 1024  # vectors and queries of a block
DIGITS = 9  # scores are ranked by as many
SLACK = 3e-9
NOTHING = -1  # the cell of vectors of length 0, whose cosine is 0


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def _usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(1e150), F.lit(False)))


def _units(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return rows / np.where(norm > 0, norm, 1.0)[:, None]


def _dealt(pivots: np.ndarray):
    """(cell, angle) in front of what comes in, vectors made units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = pivots.shape[1]
        for b in batches:
            u = _units(_matrix(b.column("v"), d))
            near = u @ pivots.T
            cell = near.argmax(axis=1) if len(u) else np.zeros(0, np.int64)
            zero = ~u.any(axis=1)
            angle = np.where(zero, 0.0, np.arccos(np.clip(near[np.arange(len(u)), cell], -1.0, 1.0)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1) * d, pa.int32()), pa.array(u.ravel()))
            at = b.schema.get_field_index("v")
            yield pa.RecordBatch.from_arrays([pa.array(np.where(zero, NOTHING, cell), pa.int32()), pa.array(angle, pa.float64()), *[flat if i == at else c for i, c in enumerate(b.columns)]], ["cell", "angle", *b.schema.names])

    return run


def _bounds(pivots: np.ndarray, cells: np.ndarray, radii: np.ndarray, first: bool):
    """(query, q, cell): the cell whose pivot is nearest to each query, or all others that may reach its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = pivots.shape[1]
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                b = whole.slice(a, 1024)
                u = _units(_matrix(b.column("q"), d))
                angle = np.arccos(np.clip(u @ pivots[cells].T, -1.0, 1.0))  # the cell of zero vectors is handled apart
                most = np.where(angle <= radii, 1.0, np.cos(np.maximum(angle - radii, 0.0)))
                most[:, cells == NOTHING] = 0.0
                most[~u.any(axis=1)] = 0.0
                nearest = np.where(cells == NOTHING, np.inf, angle).argmin(axis=1)
                if first:
                    row, col = np.arange(len(u)), nearest
                else:
                    floor = b.column("floor").to_numpy(zero_copy_only=False).astype(float)
                    able = most >= np.where(np.isnan(floor), -2.0, floor)[:, None] - SLACK
                    able[np.arange(len(u)), nearest] = False
                    row, col = np.nonzero(able)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * d, pa.int32()), pa.array(u[row].ravel()))
                yield pa.RecordBatch.from_arrays([b.column("query").take(pa.array(row)), flat, pa.array(cells[col], pa.int32())], ["query", "q", "cell"])

    return run


def _best(k: int):
    """The k best vectors of a block for each query of a block."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out_q, out_v, scores = [], [], []
        if queries.num_rows and vectors.num_rows:
            d = len(queries["q"][0])
            vectors = vectors.take(pa.compute.sort_indices(vectors["id"]))
            near = _matrix(queries["q"].combine_chunks(), d) @ _matrix(vectors["v"].combine_chunks(), d).T
            near[near < vectors["least"].to_numpy()] = -np.inf
            ranked = np.round(near, DIGITS)
            for i, own in enumerate(ranked):
                at = np.arange(len(own)) if len(own) <= k else np.flatnonzero(own >= np.partition(own, -k)[-k])
                at = at[np.isfinite(own[at])]
                at = at[np.argsort(-own[at], kind="stable")][:k]  # equal scores stay in the order of ids
                out_q.extend([i] * len(at))
                out_v.extend(at.tolist())
                scores.extend(near[i, at].tolist())
        return pa.table([queries["query"].take(pa.array(out_q, pa.int64())), vectors["id"].take(pa.array(out_v, pa.int64())), pa.array(scores, pa.float64())], names=["query", "id", "score"])

    return run


class CellIndex:
    """Cells of ``vectors(id, v, …)``, kept under a hash of ids and vectors; further columns are there to filter by.

    Vectors take part that are not null, have no null or non-finite entries and are as long as most are; queries, too.
    A vector or query of length 0 has a cosine of 0 with all. Rows of one id are rows. No vectors, no finds.
    """

    def __init__(self, rows: DataFrame, pivots: np.ndarray, cells: np.ndarray, radii: np.ndarray, sizes: np.ndarray, built: bool = False):
        self.rows, self.pivots, self.cells, self.radii, self.sizes, self.built = rows, pivots, cells, radii, sizes, built

    @staticmethod
    def of(vectors: DataFrame) -> CellIndex:
        spark = vectors.sparkSession
        hashed = vectors.select("id", F.xxhash64(*[f"`{c}`" for c in vectors.columns if c != "id"]).cast("string").alias("text"))
        v = version_of(hashed).first()
        path = f"{shared_dir(spark)}/gridwright/cells/{v.n}-{v.version}"
        kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
        shape = ", ".join(["cell int", "angle double", *(f"`{c}` {'array<double>' if c == 'v' else t}" for c, t in kinds.items())])

        def opened() -> CellIndex | None:
            try:
                at = spark.read.schema("rows string").parquet(f"{path}/done").first()
                if at is None:
                    return None
                found = spark.read.schema("cell int, pivot array<double>, radius double, n long").parquet(f"{path}/radii").orderBy("cell").collect()  # PIVOTS + 1 rows at most
            except AnalysisException:
                return None
            pivots = np.array([r.pivot for r in found if r.cell != NOTHING], float)
            own = [r for r in found if r.n]
            return CellIndex(spark.read.schema(shape).parquet(at.rows), pivots, *(np.array([getattr(r, c) for r in own]) for c in ("cell", "radius", "n")))

        if index := opened():
            return index
        usable = vectors.where(_usable(F.col("v"))).where(F.size("v") > 0)
        most = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        d = most.d if most else 1
        rows = usable.where(F.size("v") == d).withColumn("v", F.col("v").cast("array<double>"))
        chosen = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(max(1, min(PIVOTS, int(np.sqrt(most["count"])) if most else 1))).collect()
        pivots = _units(np.array([r.v for r in chosen], float).reshape(-1, d)) if chosen else np.zeros((1, d))
        to = f"{path}/rows-{uuid.uuid4().hex}"
        rows.mapInArrow(_dealt(pivots), shape).repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("cell").write.parquet(to)
        stats = {r.cell: r for r in spark.read.schema(shape).parquet(to).groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()}
        radii = [(i, p.tolist(), float(stats[i].radius), stats[i].n) if i in stats else (i, p.tolist(), 0.0, 0) for i, p in enumerate(pivots)]
        if NOTHING in stats:
            radii.append((NOTHING, [], 0.0, stats[NOTHING].n))
        spark.createDataFrame(radii, "cell int, pivot array<double>, radius double, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/radii")
        spark.createDataFrame([(to,)], "rows string").coalesce(1).write.mode("overwrite").parquet(f"{path}/done")
        index = opened()
        index.built = True
        return index

    def _meet(self, asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
        """``asked(query, q, cell)`` against the cells' rows, block by block: ``(query, id, score)``, k of each block at most."""
        spark = asked.sparkSession
        parts = spark.createDataFrame([(int(c), -(-int(n) // ROWS)) for c, n in zip(self.cells, self.sizes)], "cell int, parts int")  # PIVOTS + 1 rows
        blocks = asked.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("blocks")).join(F.broadcast(parts), "cell")
        deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = asked.join(F.broadcast(blocks), "cell").withColumn("block", deal("query", "blocks")).select("cell", "block", spread("parts").alias("part"), "query", "q")
        right = rows.join(F.broadcast(blocks), "cell").withColumn("part", deal("id", "parts")).select("cell", spread("blocks").alias("block"), "part", "id", "v", "least")
        kinds = dict(asked.dtypes) | dict(rows.dtypes)
        by = ["cell", "block", "part"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_best(k), f"query {kinds['query']}, id {kinds['id']}, score double")

    def first(self, queries: DataFrame) -> DataFrame:
        kind = dict(queries.dtypes)["query"]
        return self._asked(queries).mapInArrow(_bounds(self.pivots, self.cells, self.radii, True), f"query {kind}, q array<double>, cell int")

    def _asked(self, queries: DataFrame) -> DataFrame:
        fit = queries.where(_usable(F.col("q"))).where(F.size("q") == self.pivots.shape[1])
        return fit.select("query", F.col("q").cast("array<double>").alias("q"))

    def rest(self, queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
        """``(query, q, cell)`` of the cells besides the nearest that may hold something as good as the k-th find."""
        order = Window.partitionBy("query").orderBy(F.desc("score"))
        floor = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).where(F.col("r") == k).select("query", F.col("score").alias("floor"))
        kind = dict(queries.dtypes)["query"]
        return self._asked(queries).join(floor, "query", "left").mapInArrow(_bounds(self.pivots, self.cells, self.radii, False), f"query {kind}, q array<double>, cell int")

    def search(self, queries: DataFrame, k: int, where: Column | None = None, least: Column | None = None) -> DataFrame:
        """The k most similar of ``queries(query, q)`` by cosine, ``(query, id, score, rank)`` from rank 0, ties of nine digits to the smaller id.

        ``where`` is about the further columns: rows that fail it are no candidates. ``least``, of further columns too, is
        the score that a row must reach to be one.
        """
        kinds = dict(queries.dtypes) | dict(self.rows.dtypes)
        if not len(self.cells):
            return queries.sparkSession.createDataFrame([], f"query {kinds['query']}, id {kinds['id']}, score double, rank int")
        rows = (self.rows if where is None else self.rows.where(where)).select("cell", "id", "v", (F.lit(-2.0) if least is None else least).alias("least"))
        begun = keep(self._meet(keep(self.first(queries), "cells-first"), rows, k), "cells-found")
        more = self._meet(keep(self.rest(queries, begun, k), "cells-rest"), rows, k)
        order = Window.partitionBy("query").orderBy(F.desc(F.round("score", DIGITS)), F.asc("id"))
        both = begun.unionByName(more).withColumn("rank", F.row_number().over(order))
        return both.where(F.col("rank") <= k).select("query", "id", "score", (F.col("rank") - 1).alias("rank"))
