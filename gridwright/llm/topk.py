"""Exact top-k by inner product with M-trees: paged metric nodes, covering radii, parent distances, best-first search.

A vector x of a tree gets one more coordinate, sqrt(M^2 - |x|^2), with M the largest norm in that tree; a query gets a
0. Then the squared distance is |q|^2 + M^2 - 2 q.x, so the nearest have the highest products, and the triangle
inequality bounds these.

How it is distributed: vectors go to the nearest of a bounded number of pivots, and each pivot's vectors are one tree,
or several of bounded size, built by a task each. A query is searched in the tree nearest to it first. What it finds
there is a lower bound for its k-th score, and it is sent on only to trees whose root may hold something as good: the
roots, a row for each tree, meet the queries in pieces and blocks of bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm.common import keep, small

TREE = 4096  # vectors in a tree, about
PAGE = 128  # vectors in a leaf: one vectorised look at each
FANOUT = 8  # children of an inner node
QUERIES = 1024  # queries in a block, about
ROOTS = 1024  # roots in a piece, about
PIVOTS = 1024  # pivots that vectors are dealt to, at most,
PIVOT_CELLS = 1 << 20  # and their components in all: 8 MB


def _nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return ((pivots**2).sum(1)[None] - 2 * (x @ pivots.T)).argmin(1)


def _parts(x: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Rows dealt to FANOUT children at most, each to the nearest of as many of them."""
    pivots = x[rng.choice(rows, FANOUT, replace=False)]
    to = _nearest(x[rows], pivots)
    parts = [p for p in (rows[to == i] for i in range(FANOUT)) if len(p)]
    return parts if len(parts) > 1 else np.array_split(rows, FANOUT)  # equal vectors: any cut will do


def build_tree(pdf: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one tree, the root first: each with its parent, pivot, covering radius and distance to the parent's
    pivot; a leaf also with its vectors, by id, and their distances to its pivot."""
    ids = pdf["id"].to_numpy(np.int64)
    order = np.argsort(ids, kind="stable")
    ids, exact = ids[order], np.floor(np.stack(pdf["v"].to_numpy())[order].astype(np.float64))
    norms = (exact**2).sum(1)
    top = float(norms.max())
    x = np.concatenate([exact, np.sqrt(np.maximum(top - norms, 0))[:, None]], 1)
    rng, rows, todo = np.random.default_rng(7), [], [(np.arange(len(ids)), -1, None)]
    while todo:
        mine, parent, above = todo.pop()
        pivot = x[mine].mean(0)
        away = np.sqrt(((x[mine] - pivot) ** 2).sum(1))
        node, leaf = len(rows), len(mine) <= PAGE
        to_parent = float(np.sqrt(((pivot - above) ** 2).sum())) if above is not None else 0.0
        inside = (away.tolist(), ids[mine].tolist(), exact[mine].ravel().tolist()) if leaf else ([], [], [])
        rows.append((pdf["dim"].iloc[0], pdf["tree"].iloc[0], node, parent, top, pivot.tolist(), float(away.max()), to_parent, *inside))
        if not leaf:
            todo += [(np.sort(p), node, pivot) for p in _parts(x, mine, rng)]
    return pd.DataFrame(rows, columns=["dim", "tree", "node", "parent", "top", "pivot", "radius", "to_parent", "away", "ids", "members"])


NODE_SCHEMA = "dim int, tree long, node int, parent int, top double, pivot array<double>, radius double, to_parent double, away array<double>, ids array<long>, members array<double>"
FOUND_SCHEMA = "query_id long, h long, vec_id long, score long"


def _slack(qq: float | np.ndarray, top: float | np.ndarray):
    """What rounding may take from a bound on a score."""
    return 1e-9 * (qq + top) + 1e-6


class Tree:
    """The nodes of one tree as arrays."""

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values("node")
        dim = int(nodes["dim"].iloc[0])
        self.top = float(nodes["top"].iloc[0])
        self.pivots = np.stack([np.asarray(p, float) for p in nodes["pivot"]])
        self.radii, self.to_parent = nodes["radius"].to_numpy(float), nodes["to_parent"].to_numpy(float)
        parents = nodes["parent"].to_numpy(np.int64)
        self.children = [np.flatnonzero(parents == i) for i in range(len(nodes))]
        self.away = [np.asarray(a, float) for a in nodes["away"]]
        self.ids = [np.asarray(i, np.int64) for i in nodes["ids"]]
        self.exact = [np.asarray(m, float).reshape(len(i), dim) for i, m in zip(self.ids, nodes["members"])]
        self.big = max((float(np.abs(e).max(initial=0)) for e in self.exact), default=0.0) if dim else 0.0
        self.distances = 0

    def search(self, q: np.ndarray, own: int, k: int, floor: float = -np.inf) -> list[tuple[int, int]]:
        """The k best (score, vec_id) that score ``floor`` at least, higher score and then smaller id first, without id ``own``."""
        qq = float((q**2).sum())
        lifted = np.append(q, 0.0)
        half, slack = (qq + self.top) / 2, _slack(qq, self.top)
        wide = float(np.abs(q).max(initial=0)) * self.big * max(1, len(q)) >= 2**53
        whole = [int(x) for x in q] if wide else []
        best: list[tuple[int, int]] = []  # heap of (score, -id)
        least = lambda: max(floor, best[0][0]) if len(best) == k else floor
        d = float(np.sqrt(((lifted - self.pivots[0]) ** 2).sum()))
        self.distances += 1
        heap = [(max(0.0, d - self.radii[0]), 0, d)]  # no vector below the node is nearer; the node; its pivot's distance
        while heap:
            near, node, d = heapq.heappop(heap)
            if half - near * near / 2 + slack < least():
                break
            kids = self.children[node]
            if len(kids):
                # stored distances first: children that they rule out are not measured
                far = np.maximum(np.maximum(np.abs(d - self.to_parent[kids]) - self.radii[kids], near), 0.0)
                kids, far = (z[half - far * far / 2 + slack >= least()] for z in (kids, far))
                if len(kids):
                    away = np.sqrt(((self.pivots[kids] - lifted) ** 2).sum(1))
                    self.distances += len(kids)
                    for i, f, a in zip(kids.tolist(), np.maximum(far, away - self.radii[kids]).tolist(), away.tolist()):
                        heapq.heappush(heap, (f, i, a))
                continue
            gap = self.away[node] - d
            ok = (self.ids[node] != own) & (half - gap * gap / 2 + slack >= least())
            rows, ids = self.exact[node], self.ids[node]
            if not ok.all():
                rows, ids = rows[ok], ids[ok]
            self.distances += len(ids)
            scores = np.array([sum(int(a) * b for a, b in zip(row, whole)) for row in rows], dtype=object) if wide else rows @ q
            if len(best) == k:
                good = np.flatnonzero(scores >= least())
            else:  # ids ascend in a leaf, so a stable sort leaves the smaller one first
                good = np.argsort(-scores, kind="stable")[:k]
            for x in good.tolist():
                item = (int(scores[x]), -int(ids[x]))
                if item[0] < floor:
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(s, -v) for s, v in sorted(best, reverse=True)]


def _dealt(pivots: dict[int, np.ndarray]):
    """(dim, cell, id, v): the number of the nearest pivot of that length, 0 if there is none."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy()
            cells = np.zeros(b.num_rows, dtype=np.int32)
            for dim in np.unique(dims).tolist():
                if dim in pivots and dim:
                    at = np.flatnonzero(dims == dim)
                    cells[at] = _nearest(b.column(1).take(pa.array(at)).flatten().to_numpy().reshape(len(at), dim), pivots[dim])
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(cells), b.column(0), b.column(1)], ["dim", "cell", "id", "v"])

    return deal


def _planted(have: DataFrame) -> DataFrame:
    """``(dim, tree, id, v)``: each vector in the tree of its nearest pivot; a pivot with more than TREE vectors has several, dealt by row."""
    whole = have.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    most = max(1, min(PIVOTS, -(-whole.n // TREE), PIVOT_CELLS // max(1, whole.dim or 0)))
    pivots: dict[int, list] = {}
    for r in have.orderBy(F.xxhash64("id"), "id").limit(most).collect():  # bounded by PIVOTS and PIVOT_CELLS
        pivots.setdefault(r.dim, []).append(r.v)
    shape = "dim int, cell int, id long, v array<double>"
    dealt = keep(have.mapInArrow(_dealt({d: np.array(p, dtype=float).reshape(len(p), d) for d, p in pivots.items()}), shape), "dealt")
    trees = dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / TREE).cast("long").alias("trees"))
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(3)), F.col("trees"))
    return dealt.join(small(trees), ["dim", "cell"]).select("dim", F.xxhash64("cell", part).alias("tree"), "id", "v")


def _bounds(every: bool):
    """Queries against a piece of the roots: the nearest tree of each with its distance, or every other one that may hold a score of its floor."""

    def run(roots: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(roots) and len(queries):
            pivots, radii, tops, trees = np.stack(roots["pivot"].to_numpy()), roots["radius"].to_numpy(float), roots["top"].to_numpy(float), roots["tree"].to_numpy(np.int64)
            for own, h, v, floor, first in zip(queries["id"].tolist(), queries["h"].tolist(), queries["v"], queries["least"].tolist(), queries["first"].tolist()):
                q = np.floor(np.asarray(v, float))
                qq = float((q**2).sum())
                away = np.sqrt(((pivots - np.append(q, 0.0)) ** 2).sum(1))
                score = (qq + tops - np.maximum(0.0, away - radii) ** 2) / 2 + _slack(qq, tops)
                if every:
                    at = np.flatnonzero((score >= floor) & (trees != first))
                else:  # the tree whose pivot promises most
                    at = [int(np.argmax((qq + tops - away**2) / 2))]
                out += [(own, h, int(trees[i]), float((qq + tops[i] - away[i] ** 2) / 2), floor) for i in at]
        return pd.DataFrame(out, columns=["id", "h", "tree", "promise", "least"]).astype({"id": "int64", "h": "int64", "tree": "int64", "promise": "float64", "least": "float64"})

    return run


def _search(k: int):
    def run(nodes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(nodes) and len(queries):
            tree = Tree(nodes)
            for own, h, v, floor in zip(queries["id"].tolist(), queries["h"].tolist(), queries["v"], queries["least"].tolist()):
                out += [(own, h, vec, score) for score, vec in tree.search(np.floor(np.asarray(v, float)), own, k, floor)]
        return pd.DataFrame(out, columns=["query_id", "h", "vec_id", "score"]).astype({"query_id": "int64", "h": "int64", "vec_id": "int64", "score": "int64"})

    return run


def _block(n: int | Column, seed: int, *by: str) -> Column:
    return F.pmod(F.xxhash64(*by, F.lit(seed)), F.lit(n) if isinstance(n, int) else n)


def _every(n: int | Column) -> Column:
    last = F.lit(n - 1) if isinstance(n, int) else n - 1
    return F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))


class _Forest:
    """All trees, their roots, and the queries."""

    def __init__(self, have: DataFrame, asked: DataFrame, k: int):
        self.k, self.asked = k, asked
        self.nodes = keep(_planted(have).groupBy("dim", "tree").applyInPandas(build_tree, NODE_SCHEMA), "nodes")
        self.roots = keep(self.nodes.where("node = 0").select("dim", "tree", "top", "pivot", "radius"), "roots")
        self.pieces, self.blocks = max(1, -(-self.roots.count() // ROOTS)), max(1, -(-asked.count() // QUERIES))

    def bounds(self, queries: DataFrame, every: bool) -> DataFrame:
        """``queries(id, h, v, dim, least, first)`` -> (dim, id, h, tree, promise, least)."""
        shape = "id long, h long, tree long, promise double, least double"
        left = self.roots.withColumn("piece", _block(self.pieces, 11, "tree")).withColumn("block", _every(self.blocks)).groupBy("dim", "piece", "block")
        right = queries.withColumn("block", _block(self.blocks, 5, "id", "h")).withColumn("piece", _every(self.pieces)).groupBy("dim", "piece", "block")
        return left.cogroup(right).applyInPandas(_bounds(every), shape)

    def search(self, pairs: DataFrame) -> DataFrame:
        """``pairs(id, h, tree, least)`` -> what each query finds in each of its trees; a tree is copied once for each block of its queries."""
        pairs = keep(pairs, "pairs")
        blocks = pairs.groupBy("tree").agg(F.ceil(F.count("*") / QUERIES).cast("long").alias("blocks"))
        own = self.asked.join(pairs, ["id", "h"]).join(small(blocks), "tree").withColumn("block", _block(F.col("blocks"), 5, "id", "h"))
        left = self.nodes.join(small(blocks), "tree").withColumn("block", _every(F.col("blocks"))).drop("blocks").groupBy("dim", "tree", "block")
        right = own.select("dim", "tree", "block", "id", "h", "v", "least").groupBy("dim", "tree", "block")
        return left.cogroup(right).applyInPandas(_search(self.k), FOUND_SCHEMA)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k vectors with the highest integer inner product with each query, exactly.

    Each component x becomes floor(scale * x). Ties go to the smaller id; a query never finds its own id. Vectors that
    are null or hold a null or non-finite component take no part, on either side, nor do those with a null id; vectors
    of different lengths don't meet. Repeated rows are candidates as often as they are there. A repeated query id with
    equal vectors is one query, with different ones as many, each with its own ranks. Fewer than k candidates give fewer
    rows; empty tables give none. Other columns are ignored.
    """
    x = F.transform(F.col(f"`{vec_col}`"), lambda c: F.when(F.abs(c.cast("double") * scale) < 2.0**52, F.floor(c.cast("double") * scale).cast("double")).otherwise(c.cast("double") * scale))
    sound = ~F.exists(F.col(f"`{vec_col}`"), lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    clean = lambda df: df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`")).where(F.col("id").isNotNull() & F.col(f"`{vec_col}`").isNotNull() & sound).select("id", x.alias("v"), F.size(F.col(f"`{vec_col}`")).alias("dim"))
    asked = keep(clean(queries).withColumn("h", F.xxhash64("v")).distinct(), "asked")
    forest = _Forest(clean(vectors), asked, k)
    start = asked.withColumns({"least": F.lit(float("-inf")), "first": F.lit(0).cast("long")})
    nearest = forest.bounds(start, every=False).groupBy("id", "h").agg(F.max_by("tree", F.struct("promise", "tree")).alias("tree"))
    first = keep(nearest, "nearest")
    begun = keep(forest.search(first.withColumn("least", F.lit(float("-inf")))), "begun")
    floors = begun.groupBy(F.col("query_id").alias("id"), "h").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("score"))
    told = first.join(floors, ["id", "h"], "left").select("id", "h", F.when(F.col("n") >= k, F.col("score")).otherwise(F.lit(float("-inf"))).alias("least"), F.col("tree").alias("first"))
    rest = forest.search(forest.bounds(asked.join(told, ["id", "h"]), every=True))
    rank = F.row_number().over(Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id"))
    return begun.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
