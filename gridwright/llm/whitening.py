"""Embedding whitening: covariances by polarisation, in exact integers, and what they give by ``eigh``.

The covariance of two dimensions follows from three variances: ``2 cov(i, j) = var(i + j) - var(i) - var(j)``. So one scan
over the fit list, which has each distinct vector once, adds up exact squares of the centred values ``n * x - S`` of each
dimension and of each sum of two dimensions. Tasks send d(d + 1) / 2 integers each, which are summed by (i, j) on
executors; the driver gets d(d + 1) / 2 numbers, assembles the matrix and calls ``eigh``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import keep

SCALE = 256
COMPONENTS = 4
LIMB = 20  # bits; products of two limbs of up to 2^20 rows add up in 63 bits
ROWS = 2048  # rows whose pair sums are squared at once
LOW = 60  # sums travel as high and low parts
LARGEST = float(1 << 40)  # larger entries are no embedding's: a row with one takes no part


def integers(c: Column) -> Column:
    """``floor(SCALE * entry)`` of every entry, null for a vector that takes no part: null, with null or non-finite entries or ones beyond LARGEST."""
    wide = F.transform(c, lambda x: x.cast("double") * SCALE)
    fit = F.forall(wide, lambda x: F.coalesce(F.abs(x) < LARGEST * SCALE, F.lit(False)))  # NaN is larger than all numbers
    return F.when(c.isNotNull() & fit, F.transform(wide, lambda x: F.floor(x) + F.lit(0).cast("long")))


def square_sums(e: np.ndarray) -> list[int]:
    """Exact sums of squares of the columns of an integer matrix, by limbs of LIMB bits."""
    if not e.size:
        return [0] * e.shape[1]
    if e.dtype == object:
        return [int(x) for x in (e * e).sum(axis=0)]
    limbs, rest = [], e
    while True:
        small = int(np.abs(rest).max()) < 1 << LIMB
        limbs.append(rest if small else rest & ((1 << LIMB) - 1))
        if small:
            break
        rest = rest >> LIMB
    out = [0] * e.shape[1]
    for i, a in enumerate(limbs):
        for j in range(i, len(limbs)):
            weight = (1 if i == j else 2) << (LIMB * (i + j))
            for c, s in enumerate(np.einsum("rc,rc->c", a, limbs[j]).tolist()):
                out[c] += weight * s
    return out


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - S``; as Python integers where 63 bits might not hold the sum of two."""
    if (int(np.abs(x).max(initial=0)) + 1) * n * 4 >= 1 << 62:
        return x.astype(object) * n - sums
    return x * n - sums.astype(np.int64)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _squares(d: int, n: int, sums: list[int]):
    """(i, j, high, low) of what a task has: sums of squares of dimension i (j = i) and of i + j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        own = np.array(sums, object)
        for b in batches:
            for a in range(0, b.num_rows, ROWS):
                y = centred(_matrix(b.column(0).slice(a, ROWS), d), n, own)
                for i in range(d):
                    pairs = y[:, i:] + y[:, i : i + 1]
                    pairs[:, 0] = y[:, i]
                    got = square_sums(pairs)
                    total[i] = [s + t for s, t in zip(total[i], got)] if i in total else got
        cells = [(i, i + k, v) for i, row in total.items() for k, v in enumerate(row)]
        cols = ([c[0] for c in cells], [c[1] for c in cells], [c[2] >> LOW for c in cells], [c[2] & ((1 << LOW) - 1) for c in cells])
        kinds = (pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["i", "j", "high", "low"])

    return run


@dataclass
class Whitening:
    """``n`` distinct vectors with sums ``sums``; ``covariance``, and its first components with their eigenvalues, by falling ones."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    components: np.ndarray  # a column each
    eigenvalues: np.ndarray
    trace: float

    def apply(self, rows: DataFrame, x_col: str) -> DataFrame:
        """``rows`` without ``x_col`` but with ``whitened``, an array of a value for each component (null where the eigenvalue is 0), and the exact ``deviation``."""
        names = [c for c in rows.columns if c != x_col]
        shape = ", ".join([*(f"c{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(names)), "whitened array<double>", "deviation decimal(38,0)"])
        d, n, sums = len(self.sums), self.n, self.sums
        usable = self.eigenvalues > 0
        by = self.components / np.where(usable, np.sqrt(np.where(usable, self.eigenvalues, 1.0)), np.nan) / n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.array(sums, object)
            for b in batches:
                y = centred(_matrix(b.column(0), d), n, own)
                w = y.astype(float) @ by
                lists = pa.ListArray.from_arrays(pa.array(range(0, w.size + 1, max(1, w.shape[1])) if w.size else [0] * (len(w) + 1), pa.int32()), pa.array(w.ravel(), pa.float64(), from_pandas=True))
                squares = square_sums(np.ascontiguousarray(y.T)) if len(y) else []
                yield pa.RecordBatch.from_arrays([*b.columns[1:], lists, pa.array(squares, pa.decimal128(38, 0))], [*b.schema.names[1:], "whitened", "deviation"])

        made = rows.select(F.col(f"`{x_col}`").alias("x"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).mapInArrow(run, shape)
        return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "whitened", "deviation")


def fit(distinct: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """From ``distinct(x array<bigint>)``, each vector once, all of ``d`` dimensions: two scans, no row is sent."""
    sums = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n")).collect()
    n, s = max((r.n for r in sums), default=0), [int(r.s) for r in sorted(sums, key=lambda r: r.i)]
    cells = distinct.mapInArrow(_squares(d, n, s), "i int, j int, high decimal(38,0), low long")
    found = cells.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(20,0)")).alias("low")).collect()
    square = {(r.i, r.j): (int(r.high) << LOW) + int(r.low) for r in found}
    v = np.zeros((d, d))
    for (i, j), q in square.items():  # integers over n^3 until here: the quotients are the nearest doubles
        v[i, j] = v[j, i] = q / n**3 if i == j else (q - square[i, i] - square[j, j]) / (2 * n**3)
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:components]
    kept = np.where(e[order] > e.max(initial=0) * d * np.finfo(float).eps, e[order], 0.0)
    return Whitening(n, s, v, u[:, order], kept, float(np.trace(v)))


def identity_error(done: DataFrame, k: int) -> float | None:
    """Largest absolute entry of the covariance of ``whitened``'s first ``k`` values minus the identity, by polarisation too."""
    if not k:
        return None
    w = [F.get("whitened", i) for i in range(k)]
    r = done.agg(*[F.var_pop(w[i] if i == j else w[i] + w[j]).alias(f"v{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    own = [r[f"v{i}_{i}"] for i in range(k)]
    return max(abs(own[i] - 1.0) if i == j else abs((r[f"v{i}_{j}"] - own[i] - own[j]) / 2) for i in range(k) for j in range(i, k))


def whitened(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vectors`` without the vector, a row for each component: ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Rows take part whose vector is not null, has no null or non-finite entries or ones beyond LARGEST, and is as long as
    most vectors are (of two lengths that are as common, the longer; empty vectors never). Repeated rows are fitted on
    once and all come back, with equal values, as do rows with null ids. Other columns are passed on; those of the names
    above are replaced. ``deviation`` is a decimal, as exact values may not fit in a long. Where an eigenvalue is 0, as
    with one distinct vector, ``whitened`` is null and ``identity_error`` leaves it out (null if none is left);
    ``explained`` is null without any variance. There are as many components as dimensions at most. No vector at all
    gives no rows.
    """
    made = {"component", "n", "deviation", "whitened", "explained", "identity_error"}
    names = [c for c in vectors.columns if c != vector_col and c not in made]
    rows = vectors.select(integers(F.col(f"`{vector_col}`")).alias("_x"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).where("size(_x) > 0")
    shape = ", ".join([*(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in names), "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"])
    lengths = rows.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], shape)
    rows = rows.where(F.size("_x") == lengths.d)
    distinct = keep(rows.select(F.col("_x").alias("x")).distinct(), "distinct-vectors")
    model = fit(distinct, lengths.d, components)
    error = identity_error(model.apply(distinct, "x"), int((model.eigenvalues > 0).sum()))
    share = F.array(*[F.lit(float(e / model.trace) if model.trace > 0 else None).cast("double") for e in model.eigenvalues])
    done = model.apply(rows, "_x")
    out = done.select(*[F.col(f"c{i}") for i in range(len(names))], "deviation", F.posexplode("whitened").alias("at", "w"))
    return out.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.col("w").alias("whitened"), F.get(share, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
