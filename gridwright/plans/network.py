"""Graph queries: documents that mention benchmark items, trade between nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.operators import graph
from gridwright.plans.registry import query
from gridwright.sources.files import table
from gridwright.sources.scratch import keep


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("src"), "text")
    names = table(spark, sf_dir, "benchmark").select((-F.col("item_id") - 1).alias("dst"), F.col("text").alias("name"))
    return graph.mentions(texts, names)


@query("SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) WHERE trim(b.text) <> ''")
def mention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir).select(F.col("src").alias("doc_id"), (-F.col("dst") - 1).alias("item_id"))


@query("SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(lower(d.text), lower(b.text)))")
def mention_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required items that no document has."""
    found = _mentions(spark, sf_dir).select((-F.col("dst") - 1).alias("item_id")).distinct()
    return table(spark, sf_dir, "benchmark").select("item_id").join(found, "item_id", "left_anti")


_EDGES = """
edges AS (
  SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE l_quantity >= 49 AND (s_nationkey < c_nationkey OR (s_nationkey * 7 + c_nationkey) % 11 = 0)
)"""


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select("l_orderkey", "l_suppkey")
    o, c, s = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    all_ = li.join(s, li.l_suppkey == s.s_suppkey).join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).distinct()
    return all_.where((F.col("src") < F.col("dst")) | ((F.col("src") * 7 + F.col("dst")) % 11 == 0))


@query("WITH RECURSIVE" + _EDGES + """,
reach(a, b, n) AS (SELECT src, dst, 1 FROM edges UNION SELECT a, dst, n + 1 FROM reach JOIN edges ON b = src WHERE n < 4)
SELECT DISTINCT a AS node FROM reach WHERE a = b""")
def nodes_in_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that trade leads back to in four steps or fewer."""
    return graph.on_cycles(_trade(spark, sf_dir), 4).select("node")


@query("WITH" + _EDGES + ", n AS (SELECT src AS node, dst FROM edges UNION ALL SELECT dst, src FROM edges) SELECT node, count(DISTINCT dst) AS partners FROM n GROUP BY node")
def trade_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _trade(spark, sf_dir)
    both = e.select(F.col("src").alias("node"), "dst").unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("dst")))
    return both.groupBy("node").agg(F.count_distinct("dst").alias("partners"))


@query("WITH RECURSIVE" + _EDGES + """,
nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
walk(node, here, n) AS (SELECT src, dst, 1 FROM edges UNION SELECT w.node, e.dst, w.n + 1 FROM walk w JOIN edges e ON e.src = w.here WHERE w.n <= (SELECT count(*) FROM nodes)),
deep AS (SELECT node, max(n) AS n FROM walk GROUP BY node)
SELECT node, CAST(CASE WHEN n IS NULL THEN 0 WHEN n > (SELECT count(*) FROM nodes) THEN -1 ELSE n END AS INTEGER) AS level FROM nodes LEFT JOIN deep USING (node)""")
def dependency_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by how far trade depends on others, -1 on or behind a cycle."""
    e = keep(_trade(spark, sf_dir), "trade")
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return graph.levels(nodes, e)


@query("WITH RECURSIVE" + _EDGES + """,
waits AS (SELECT src, dst FROM edges WHERE src < dst AND (src + dst) % 3 = 0 OR src < 5 AND dst < 5),
due AS (SELECT c_nationkey AS node, CAST(date_trunc('year', min(o_orderdate)) AS DATE) + CAST(count(*) % 4 AS INTEGER) AS deadline FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
nodes AS (
  SELECT n_nationkey AS node, row_number() OVER (ORDER BY deadline NULLS LAST, n_nationkey) AS key, coalesce((SELECT list(dst) FROM waits WHERE src = n_nationkey AND dst IN (SELECT n_nationkey FROM nation)), []) AS deps
  FROM nation LEFT JOIN due ON node = n_nationkey
), walk(k, done) AS (
  SELECT 0, CAST([] AS BIGINT[])
  UNION ALL
  SELECT w.k + 1, list_append(w.done, CAST(arg_min(n.node, n.key) AS BIGINT)) FROM walk w JOIN nodes n ON NOT list_contains(w.done, n.node) AND len(list_filter(n.deps, lambda d: NOT list_contains(w.done, d))) = 0 GROUP BY w.k, w.done
), best AS (SELECT k, done FROM walk ORDER BY k DESC LIMIT 1),
placed AS (SELECT unnest(done) AS node, unnest(range(1, k + 1)) AS place FROM best)
SELECT n.node, coalesce(place, (SELECT k FROM best) + row_number() OVER (PARTITION BY place IS NULL ORDER BY n.node)) AS place, place IS NULL AS cyclic FROM nodes n LEFT JOIN placed p ON p.node = n.node""")
def filing_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in the order of their deadlines, each behind those that its trade depends on; cyclic ones last."""
    o, c = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    due = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("node")).agg(F.date_add(F.trunc(F.min("o_orderdate"), "year"), (F.count("*") % 4).cast("int")).alias("deadline"))
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node")).join(due, "node", "left").select("node", "deadline", F.col("node").alias("seen"))
    waits = keep(_trade(spark, sf_dir).where("src < dst and (src + dst) % 3 = 0 or src < 5 and dst < 5"), "waits")
    return graph.priority_order(nodes, waits)


@query("""
WITH RECURSIVE o AS (
  SELECT o_custkey, o_orderkey AS id, CAST(o_orderdate AS DATE) AS deadline, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderdate) AS k,
    min(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey) AS start FROM orders
), fold(o_custkey, k, id, day) AS (
  SELECT o_custkey, k, id, CASE WHEN deadline < start + 3 THEN deadline ELSE start END FROM o WHERE k = 1
  UNION ALL
  SELECT o.o_custkey, o.k, o.id, CASE WHEN o.deadline < f.day + 4 THEN o.deadline ELSE f.day + 1 END FROM fold f JOIN o ON o.o_custkey = f.o_custkey AND o.k = f.k + 1
)
SELECT o_custkey, id, CAST(day AS DATE) AS day FROM fold""")
def schedule_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approval days of each customer's orders, one a day from the first on, or their deadline if it is near."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("deadline")))).alias("items"), F.min(F.to_date("o_orderdate")).alias("start"))
    days = o.select("o_custkey", F.explode(graph.schedule(F.col("items"), F.col("start"))).alias("x"))
    return days.select("o_custkey", F.col("x.id").alias("id"), F.col("x.day").alias("day"))
