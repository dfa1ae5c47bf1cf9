"""Dependency graphs of filings: mentions, cycles, order and schedule, as joins over an edge table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.text import let
from gridwright.sources.scratch import keep


NAMED = 10_000  # keys that are looked up where a text is read; with more of them all its word runs are joined


def mentions(texts: DataFrame, names: DataFrame, words: int = 5) -> DataFrame:
    """``texts(src, text)``, ``names(dst, name)`` -> distinct ``(src, dst)`` where the text has the name in it, in either case.

    A name's words but the first and the last (and the next ``words - 2`` of them at most) stand in the text between
    blanks, too, so texts and names meet on these: an equi-join instead of every text against every name. Only names of
    one or two words, which have no such key, are looked for in every text.
    """
    split = lambda c: F.split(F.lower(c), r"\s+")
    parts = split(F.trim("name"))
    inner = F.least(F.size(parts) - 2, F.lit(words - 2))
    keyed = names.where("trim(name) <> ''").select("dst", F.lower("name").alias("name"), F.when(inner > 0, F.array_join(F.slice(parts, F.lit(2), F.greatest(inner, F.lit(1))), " ")).alias("key"))
    keys = [r.key for r in keyed.where("key is not null").select("key").distinct().limit(NAMED + 1).collect()]
    lengths = range(1, words - 1) if len(keys) > NAMED else sorted({k.count(" ") + 1 for k in keys})
    known = (lambda g: g.isin(keys)) if len(keys) <= NAMED else (lambda g: F.lit(True))

    def grams(w: Column) -> Column:
        runs = [_runs(w, n, known) for n in lengths]
        return F.array_distinct(F.concat(*runs)) if runs else F.array().cast("array<string>")

    met = texts.select("src", F.explode(let(split(F.col("text")), grams)).alias("key")).join(keyed, "key").select("src", "dst", "name").distinct()
    long = texts.join(met, "src").where(F.lower("text").contains(F.col("name"))).select("src", "dst")
    short = keyed.where("key is null").select("dst", "name")
    if not short.isEmpty():
        long = long.unionByName(texts.join(short, F.lower("text").contains(F.col("name"))).select("src", "dst"))
    return long.where("src is distinct from dst").distinct()


def _runs(words: Column, n: int, known: Callable[[Column], Column]) -> Column:
    """The runs of n words that are known."""
    return F.filter(F.transform(words, lambda _, i: F.array_join(F.slice(words, i + 1, F.lit(n)), " ")), known)


def on_cycles(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """Nodes ``(node)`` that reach themselves, in at most ``longest`` steps if that is given. Pairs (start, end) are kept distinct at every step.

    Without ``longest`` nodes that can't be on a cycle, with no edge to or from the others left, go first, round by
    round; then pairs are added until none is new.
    """
    step = keep(edges.select("src", "dst").distinct(), "edges")
    if longest is None:
        step = _core(step)
    pairs = new = step
    done = 1
    while longest is None or done < longest:
        further = new.select(F.col("src").alias("start"), F.col("dst").alias("src")).join(step, "src").select(F.col("start").alias("src"), "dst").distinct()
        new = keep(further.join(pairs, ["src", "dst"], "left_anti"), "pairs")
        if new.isEmpty():
            break
        pairs = pairs.unionByName(new)
        done += 1
    return pairs.where("src = dst").select(F.col("src").alias("node")).distinct()


def _core(edges: DataFrame) -> DataFrame:
    """Edges that are left when those without one before them, or without one behind them, are taken away again and again."""
    n = edges.count()
    while n:
        starts, ends = edges.select(F.col("src").alias("dst")).distinct(), edges.select(F.col("dst").alias("src")).distinct()
        edges = keep(edges.join(starts, "dst", "left_semi").join(ends, "src", "left_semi").select("src", "dst"), "core")
        left = edges.count()
        if left == n:
            break
        n = left
    return edges


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, level)``: 0 for nodes that depend on none, else one more than the highest they depend on; -1 on or behind a cycle.

    Edges ``(src, dst)`` say that src depends on dst. Each round places the nodes all of whose dependencies are placed,
    until no node is left that can be; what a round leaves open is written, so that plans stay short at any depth.
    """
    open_edges = keep(edges.select("src", "dst").distinct(), "edges")
    left = keep(nodes.select("node").distinct(), "nodes")
    placed, level = [], 0
    while True:
        blocked = open_edges.select(F.col("src").alias("node")).distinct()
        ready = keep(left.join(blocked, "node", "left_anti").withColumn("level", F.lit(level)), "ready")
        if ready.isEmpty():
            break
        placed.append(ready)
        left = keep(left.join(ready, "node", "left_anti").select("node"), "nodes")
        open_edges = keep(open_edges.join(ready.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), "edges")
        level += 1
        if len(placed) == 20:
            placed = [keep(_union(placed), "placed")]
    return _union([*placed, left.withColumn("level", F.lit(-1))])


def priority_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(node, deadline, seen)``, ``edges(src, dst)`` -> ``(node, place, cyclic)``: of the nodes whose dependencies have been placed,
    the one with the earliest deadline comes next, at equal ones the first ``seen``, then the least ``node``. No deadline is the latest.

    Edges say that src depends on dst. Nodes on or behind a cycle come last, in the order in which they were seen. A node
    given twice counts with its earliest deadline; null nodes, and edges from or to nodes that are not given, count for nothing.

    No queue is kept. The latest of all nodes that others wait for is placed only when nothing else can be, so everything
    that doesn't depend on it stands before it and its dependents right behind it; the same holds again among those. So a node's
    place is that of its path: the latest node that it depends on (itself included), the latest of those between that one and itself, and so on
    down to itself. A node's path is the greatest of its dependencies' paths, less the steps that are earlier than the node, and the node.
    One join for each level of the graph finds the paths, and a sort of these is the order.
    """
    own = F.struct(F.col("deadline").isNull().alias("open"), "deadline", "seen", "node")
    given = nodes.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("deadline").isNull().alias("open"), "deadline", "seen")).alias("k")).select("node", "k.deadline", "k.seen")
    left = keep(given.select("node", own.alias("own")).withColumn("path", F.array_except(F.array("own"), F.array("own"))), "nodes")
    known = left.select("node")
    inside = edges.select("src", "dst").distinct().join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    waits = keep(inside.select("src", "dst"), "edges")
    placed = []
    while True:
        free = left.join(waits.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
        ready = keep(free.select("node", F.concat(F.filter("path", lambda x: x > F.col("own")), F.array("own")).alias("path")), "ready")
        if ready.isEmpty():
            break
        placed.append(ready)
        before = ready.select(F.col("node").alias("dst"), F.col("path").alias("through"))
        latest = waits.join(before, "dst").groupBy(F.col("src").alias("node")).agg(F.max("through").alias("through"))
        rest = left.join(ready.select("node"), "node", "left_anti").join(latest, "node", "left")
        left = keep(rest.select("node", "own", F.greatest("path", "through").alias("path")), "nodes")
        waits = keep(waits.join(before.select("dst"), "dst", "left_anti").select("src", "dst"), "edges")
        if len(placed) == 20:
            placed = [keep(_union(placed), "placed")]
    behind = left.select("node", F.array("own").alias("path"), F.struct(F.lit(True).alias("cyclic"), F.col("own.seen").alias("seen")).alias("last"))
    ahead = [p.select("node", "path", F.struct(F.lit(False).alias("cyclic"), F.lit(None).cast(nodes.schema["seen"].dataType).alias("seen")).alias("last")) for p in placed]
    return numbered(_union([*ahead, behind]), ["last", "path", "node"]).select("node", F.col("n").alias("place"), F.col("last.cyclic").alias("cyclic"))


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with ``n``, their gapless number from 1 in the order of ``by``, which must tell all rows apart.

    A sort over ranges, written; then each range numbers its own rows, behind the rows of the ranges before it. The driver
    sees a count for each range.
    """
    ranges = keep(rows.orderBy(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = sorted((r["_range"], r["count"]) for r in ranges.groupBy("_range").count().collect())
    ahead, total = [], 0
    for r, size in sizes:
        ahead += [F.lit(r), F.lit(total).cast("long")]
        total += size
    start = F.create_map(*ahead)[F.col("_range")] if ahead else F.lit(0).cast("long")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return ranges.withColumn("n", start + within).drop("_range")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def schedule(items: Column, start: Column) -> Column:
    """Ordered array<struct<id, deadline>> -> array<struct<id, day>>: a day after the one before, or its deadline if that is under three days off."""
    first = F.struct(start.alias("next"), F.array().cast("array<struct<id:bigint,day:date>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        day = F.when(x["deadline"] < F.date_add(acc["next"], 3), x["deadline"]).otherwise(acc["next"])
        return F.struct(F.date_add(day, 1).alias("next"), F.concat(acc["out"], F.array(F.struct(x["id"].cast("long").alias("id"), day.alias("day")))).alias("out"))

    return F.aggregate(items, first, step, lambda acc: acc["out"])


def node_status(on_cycle: Column, days_left: Column) -> Column:
    return F.when(on_cycle, "cycle").when(days_left < 7, "urgent").otherwise("ok")
