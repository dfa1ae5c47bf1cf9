"""Fact, rule and reconciliation queries: line items stand for article facts, parts for assets, customers for staff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwright.functions import rules
from gridwright.functions.similarity import candidates, one_edit
from gridwright.operators import logs, reconcile, sheets
from gridwright.plans.registry import query
from gridwright.sources.files import table

_LONG = """
long AS (
  SELECT l_orderkey, l_linenumber, l_partkey AS article, year(l_shipdate) AS period, label, value
  FROM lineitem, LATERAL (VALUES ('quantity', l_quantity), ('price', l_extendedprice), ('discount', l_discount), ('tax', l_tax)) t(label, value) WHERE value <> 0
)"""


@query("WITH" + _LONG + " SELECT period, label, count(*) AS n, round(sum(value), 2) AS total, count(DISTINCT article) AS articles FROM long GROUP BY ALL")
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by year and label. Wide rows are summed up by article before each becomes one for a label, so distinct articles need no rows of their own."""
    wide = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
    fact = lambda c: F.when(F.col(c) != 0, F.col(c))
    sums = [f(fact(c)).alias(f"{label}_{what}") for label, c in wide.items() for what, f in (("n", F.count), ("total", F.sum))]
    by = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("period"), F.col("l_partkey").alias("article")).agg(*sums)
    each = by.select("period", "article", F.inline(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"{x}_n").alias("n"), F.col(f"{x}_total").alias("total")) for x in wide]))).where("n > 0")
    return each.groupBy("period", "label").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"), F.count("article").alias("articles"))


@query("""
SELECT article, period, pf, value FROM (
  SELECT l_partkey AS article, year(l_shipdate) AS period, l_returnflag AS pf, l_quantity AS value,
    row_number() OVER (PARTITION BY l_partkey, year(l_shipdate), l_returnflag ORDER BY CASE l_linestatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END, l_orderkey, l_linenumber, l_quantity) AS k FROM lineitem) WHERE k = 1""")
def priority_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact an article, year and label: by the rank of its status, then the first, then the smallest."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("article"), F.year("l_shipdate").alias("period"), F.col("l_returnflag").alias("pf"), F.col("l_quantity").alias("value"), "l_linestatus", "l_orderkey", "l_linenumber")
    first = F.min_by("value", F.struct(rules.rank_in(F.col("l_linestatus"), ["O", "F"]), "l_orderkey", "l_linenumber", "value"))
    return li.groupBy("article", "period", "pf").agg(first.alias("value"))


_SERIES = """
brand AS (
  SELECT p_brand AS article, year(l_shipdate) AS period, CASE l_linestatus WHEN 'F' THEN 'Факт' ELSE 'План' END AS pf, sum(l_extendedprice * (1 - l_discount)) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
)"""


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by brand, year and status; line items are summed up by part before they meet the parts."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.year("l_shipdate").alias("period"), "l_linestatus").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return li.join(part, li.l_partkey == part.p_partkey).groupBy(F.col("p_brand").alias("article"), "period", F.when(F.col("l_linestatus") == "F", "Факт").otherwise("План").alias("pf")).agg(F.sum("v").alias("value"))


@query("WITH" + _SERIES + " SELECT article, count(*) AS points, string_agg(period || '/' || pf, ',' ORDER BY period, pf) AS periods, round(sum(value), 4) AS total FROM brand GROUP BY article")
def article_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _brands(spark, sf_dir).groupBy("article").agg(F.array_sort(F.collect_list(F.struct("period", "pf"))).alias("s"), F.round(F.sum("value"), 4).alias("total"))
    label = F.array_join(F.transform("s", lambda x: F.concat_ws("/", x["period"].cast("string"), x["pf"])), ",")
    return s.select("article", F.size("s").cast("long").alias("points"), label.alias("periods"), "total")


@query("WITH" + _SERIES + """,
rank AS (SELECT *, CASE pf WHEN 'Факт' THEN 0 ELSE 2 END AS p FROM brand),
reg AS (SELECT article, value FROM rank WHERE period = 1998 QUALIFY row_number() OVER (PARTITION BY article ORDER BY p) = 1),
base AS (SELECT article, value FROM rank WHERE period < 1998 QUALIFY row_number() OVER (PARTITION BY article ORDER BY period DESC, p) = 1)
SELECT b.article, CASE WHEN r.value IS NULL OR b.value <= 0 THEN 'yellow' WHEN (r.value - b.value) / b.value * 100 > 15 THEN 'red' WHEN (r.value - b.value) / b.value * 100 > 5 THEN 'yellow' ELSE 'green' END AS color, round(b.value, 4) AS base, round(r.value, 4) AS value
FROM base b LEFT JOIN reg r USING (article)""")
def growth_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of the regulated year against the nearest earlier one, by the label that counts most."""
    s = _brands(spark, sf_dir).withColumn("p", rules.label_priority(F.col("pf")))
    reg, base = F.when(F.col("period") == 1998, F.col("value")), F.when(F.col("period") < 1998, F.col("value"))
    pick = s.groupBy("article").agg(F.min_by(reg, F.when(reg.isNotNull(), F.struct(F.lit(0), "p"))).alias("value"), F.min_by(base, F.when(base.isNotNull(), F.struct(-F.col("period"), F.col("p")))).alias("base"))
    return pick.where("base is not null").select("article", rules.growth_color(F.col("base"), F.col("value"), 5.0, 10.0).alias("color"), F.round("base", 4).alias("base"), F.round("value", 4).alias("value"))


@query("""
SELECT p_brand AS article, arg_min(unit, (-n, unit)) AS unit FROM (SELECT p_brand, l_returnflag AS unit, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) GROUP BY p_brand""")
def unit_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent unit of each article, the first of the alphabet on ties."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    n = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("m")).join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "l_returnflag").agg(F.sum("m").alias("n"))
    return n.groupBy(F.col("p_brand").alias("article")).agg(F.min_by("l_returnflag", F.struct(-F.col("n"), F.col("l_returnflag"))).alias("unit"))


_NATION = """
nat AS (SELECT n_name AS name, sum(l_extendedprice * (1 - l_discount)) AS amount, max(l_extendedprice) AS top FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name)"""


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"), F.max("l_extendedprice").alias("t"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("name")).agg(F.sum("v").alias("amount"), F.max("t").alias("top"))


@query("WITH" + _NATION + " SELECT name, round(top, 2) AS top, CAST(row_number() OVER (ORDER BY abs(top) DESC, name) AS INTEGER) AS rank FROM nat")
def article_rank_absmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).select("name", F.round("top", 2).alias("top"), F.row_number().over(Window.orderBy(F.desc(F.abs("top")), "name")).alias("rank"))


@query("WITH" + _NATION + """, r AS (SELECT name, amount, row_number() OVER (ORDER BY amount DESC, name) AS k FROM nat)
SELECT CASE WHEN k <= 7 THEN name ELSE 'other' END AS name, round(sum(amount), 4) AS amount, round(sum(amount) / (SELECT sum(amount) FROM nat), 4) AS share FROM r GROUP BY 1""")
def top7_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reconcile.top_and_rest(_nations(spark, sf_dir).select("name", "amount"), 7)
    return out.select("name", F.round("amount", 4).alias("amount"), F.round("share", 4).alias("share"))


@query("WITH" + _SERIES + " SELECT article, round(sum(value) FILTER (WHERE period = 1996), 4) AS y1996, round(sum(value) FILTER (WHERE period = 1997), 4) AS y1997, round(sum(value) FILTER (WHERE period = 1998), 4) AS y1998 FROM brand GROUP BY article")
def series_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _brands(spark, sf_dir).groupBy("article").pivot("period", [1996, 1997, 1998]).agg(F.round(F.sum("value"), 4))
    return wide.select("article", *[F.col(str(y)).alias(f"y{y}") for y in (1996, 1997, 1998)])


@query("""
SELECT n_name AS sheet, p_brand AS article, year(l_shipdate) AS period, CASE WHEN year(l_shipdate) < 1998 THEN 'Факт' ELSE 'План' END AS pf, round(sum(l_quantity), 2) AS value, 'тонн' AS unit
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL HAVING sum(l_quantity) <> 0""")
def sheet_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items laid out as a sheet of cells a nation (a title row, labels, years, brands below), and read back as facts.

    Years are moved forward by 20 in the sheets, as headers hold years from 2010 on."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey", F.year("l_shipdate").alias("y")).agg(F.sum("l_quantity").alias("q"))
    part, sup, nat = table(spark, sf_dir, "part").select("p_partkey", "p_brand"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    long = li.join(part, li.l_partkey == part.p_partkey).join(sup, li.l_suppkey == sup.s_suppkey).join(nat, sup.s_nationkey == nat.n_nationkey).groupBy("n_name", "p_brand", "y").agg(F.sum("q").alias("q"))
    r = F.dense_rank().over(Window.partitionBy("n_name").orderBy("p_brand")) + 3
    c = F.col("y") - 1990
    grid = long.withColumns({"r": r, "c": c})
    book = F.lit("book").alias("book")
    cell = lambda df, r, c, s: df.select(book, F.col("n_name").alias("sheet"), r.cast("int").alias("r"), c.cast("int").alias("c"), s.cast("string").alias("s")).distinct()
    cells = cell(grid, F.col("r"), F.col("c"), F.col("q"))
    for part_ in (cell(grid, F.col("r"), F.lit(1), F.col("p_brand")), cell(grid, F.col("r"), F.lit(2), F.lit("тонн")), cell(grid, F.lit(0), F.lit(1), F.lit("Наименование показателя")),
                  cell(grid, F.lit(2), F.col("c"), F.col("y") + 20), cell(grid, F.lit(1), F.col("c"), F.when(F.col("y") < 1998, "Факт ТСО").otherwise("План"))):
        cells = cells.unionByName(part_)
    out = sheets.deduplicated(sheets.cleaned(sheets.facts(cells)))
    return out.select("sheet", "article", (F.col("period") - 20).cast("long").alias("period"), "pf", F.round("value", 2).alias("value"), "unit")


@query("""
WITH f AS (SELECT n_name AS sheet, p_brand AS article, CASE WHEN p_size % 3 = 0 THEN '' ELSE l_returnflag END AS unit FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
SELECT sheet, count(DISTINCT article) AS articles, CAST(sum(CASE WHEN unit = '' THEN 1 ELSE 0 END) * 10 > 8 * count(*) AS BOOLEAN) AS tech_sheet, CAST(max(unit) AS VARCHAR) AS last_unit FROM f GROUP BY sheet""")
def article_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles of each nation's sheet, whether it looks technical, and its last unit."""
    part, sup, nat = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", F.year("l_shipdate").alias("period"))
    f = li.join(part, li.l_partkey == part.p_partkey).join(sup, li.l_suppkey == sup.s_suppkey).join(nat, sup.s_nationkey == nat.n_nationkey)
    f = f.select(F.col("n_name").alias("sheet"), F.col("p_brand").alias("article"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("l_returnflag")).alias("unit"))
    return f.groupBy("sheet").agg(F.count_distinct("article").alias("articles"), (F.count_if(F.col("unit") == "") * 10 > F.count("*") * 8).alias("tech_sheet"), F.max("unit").alias("last_unit"))




@query("""
WITH a AS (SELECT p_type AS name, sum(l_extendedprice) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type),
p AS (SELECT *, amount / sum(amount) OVER () * 100 AS percent, lower(name) AS low FROM a),
r AS (SELECT *, CASE WHEN contains(low, 'promo') THEN 70 WHEN contains(low, 'standard') OR contains(low, 'small') THEN 40 WHEN contains(low, 'econom') THEN 15 ELSE 50 END AS i,
  CASE WHEN contains(low, 'promo') THEN 30 WHEN contains(low, 'standard') OR contains(low, 'small') THEN 85 WHEN contains(low, 'econom') THEN 95 ELSE 50 END AS e FROM p)
SELECT name, CASE WHEN percent > 20 THEN least(100, i + 15) ELSE i END AS inclusion, CASE WHEN percent < 1 THEN greatest(0, e - 20) ELSE e END AS exclusion, round(percent, 3) AS percent FROM r""")
def article_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risks of part types by words in their names and their share of revenue."""
    return _risks(spark, sf_dir).select("name", "inclusion", "exclusion", F.round("percent", 3).alias("percent"))


def _risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("v"))
    a = li.join(part, li.l_partkey == part.p_partkey).groupBy(F.col("p_type").alias("name")).agg(F.sum("v").alias("amount"))
    whole = a.agg(F.sum("amount").alias("whole"))
    p = a.crossJoin(F.broadcast(whole)).withColumn("percent", F.try_divide("amount", "whole") * 100)
    branches = [(["promo"], 70, 30), (["standard", "small"], 40, 85), (["econom"], 15, 95)]
    i, e = rules.article_risk(F.col("name"), F.col("percent"), branches)
    return p.select("name", "amount", "percent", i.alias("inclusion"), e.alias("exclusion"))


@query("""
WITH a AS (SELECT p_type AS name, sum(l_extendedprice) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type),
p AS (SELECT *, amount / sum(amount) OVER () * 100 AS percent, lower(name) AS low FROM a),
r AS (SELECT *, CASE WHEN contains(low, 'promo') THEN 70 WHEN contains(low, 'standard') OR contains(low, 'small') THEN 40 WHEN contains(low, 'econom') THEN 15 ELSE 50 END AS i FROM p),
f AS (SELECT sum((CASE WHEN percent > 20 THEN least(100, i + 15) ELSE i END) * amount) / sum(amount) AS weighted FROM r)
SELECT round(weighted, 3) AS weighted, round(weighted * 0.7 + 20 * 0.3, 1) AS final, CASE WHEN weighted * 0.7 + 6 >= 70 THEN 'red' WHEN weighted * 0.7 + 6 >= 40 THEN 'yellow' ELSE 'green' END AS level FROM f""")
def application_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _risks(spark, sf_dir).agg(F.try_divide(F.sum(F.col("inclusion") * F.col("amount")), F.sum("amount")).alias("w"))
    final = F.col("w") * 0.7 + F.lit(100 - 80) * 0.3
    return w.select(F.round("w", 3).alias("weighted"), F.round(final, 1).alias("final"), rules.risk_level(final).alias("level"))


@query("""
WITH b AS (SELECT n_name AS name, n_regionkey, avg(s_acctbal) AS v FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL),
m AS (SELECT n_regionkey, avg(s_acctbal) AS mean FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT b.name, round(coalesce(v, mean), 2) AS value, round(mean, 2) AS mean, CASE WHEN coalesce(v, mean) > mean * 1.1 THEN 'more' WHEN coalesce(v, mean) < mean * 0.9 THEN 'less' ELSE 'equal' END AS verdict,
  CASE WHEN mean = 0 THEN 0.0 ELSE round((coalesce(v, mean) - mean) / mean * 100, 2) END AS deviation FROM b JOIN m USING (n_regionkey)""")
def peer_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean supplier balance of each nation against its region's; nations without suppliers count as the mean."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_acctbal")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    values = s.groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("value")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), "value")
    means = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.avg("s_acctbal").alias("mean"))
    benchmark = n.join(means, "n_regionkey").select(F.col("n_name").alias("name"), "mean")
    return reconcile.against_benchmark(values, benchmark).select("name", F.round("value", 2).alias("value"), F.round("mean", 2).alias("mean"), "verdict", "deviation")


@query("""
WITH a AS (SELECT c_nationkey AS position, count(*) AS actual FROM customer WHERE c_acctbal > 0 GROUP BY 1),
n AS (SELECT s_nationkey AS position, round(0.25 * count(*) * 20, 1) AS required FROM supplier GROUP BY 1),
j AS (SELECT coalesce(a.position, n.position) AS position, CAST(coalesce(actual, 0) AS DOUBLE) AS actual, coalesce(required, 0.0) AS required FROM a FULL JOIN n ON a.position = n.position)
SELECT position, actual, CAST(required AS DOUBLE) AS required, CAST(round(actual - required, 1) AS DOUBLE) AS deviation, CASE WHEN actual <= required THEN 'ok' WHEN (CASE WHEN required > 0 THEN round((actual - required) / required * 100, 1) ELSE 0 END) <= 25 THEN 'warn' ELSE 'over' END AS status FROM j""")
def staffing_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each nation as staff against a norm from its suppliers; nations of either side."""
    staff = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("position"))
    norms = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("position")).agg(F.round(F.count("*") * 0.25 * 20, 1).alias("norm"))
    return reconcile.staffing(staff, norms, 1.0).select("position", "actual", "required", "deviation", "status")


_GROUPS = {1: (1, 10), 2: (11, 20), 3: (21, 30), 4: (31, 40), 5: (41, 48)}
_ASSETS = "assets AS (SELECT p_partkey, p_retailprice AS cost, p_size AS life, 1 + (p_partkey % 5) AS grp FROM part)"
_FITS = "CASE grp WHEN 1 THEN life BETWEEN 1 AND 10 WHEN 2 THEN life BETWEEN 11 AND 20 WHEN 3 THEN life BETWEEN 21 AND 30 WHEN 4 THEN life BETWEEN 31 AND 40 ELSE life BETWEEN 41 AND 48 END"


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("cost"), F.col("p_size").alias("life"), (F.col("p_partkey") % 5 + 1).alias("grp"))


@query(f"WITH {_ASSETS} SELECT p_partkey, cost / life AS linear, cost * 2 / life AS declining, {_FITS} AS fits FROM assets")
def amort_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _assets(spark, sf_dir)
    return a.select("p_partkey", rules.depreciation(F.col("cost"), F.col("life"), digits=None).alias("linear"), rules.depreciation(F.col("cost"), F.col("life"), "declining", None).alias("declining"), rules.group_fits(F.col("grp"), F.col("life"), _GROUPS).alias("fits"))


@query(f"WITH {_ASSETS} SELECT grp, count(*) AS objects, count(*) FILTER (WHERE NOT {_FITS}) AS errors, round(sum(cost * 2 / life - cost / life), 2) AS deviation FROM assets GROUP BY GROUPING SETS ((grp), ())")
def amort_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects, errors and deviation of each group, and of all (a null group)."""
    a = _assets(spark, sf_dir).withColumns({"bad": ~rules.group_fits(F.col("grp"), F.col("life"), _GROUPS), "d": rules.depreciation(F.col("cost"), F.col("life"), "declining", None) - rules.depreciation(F.col("cost"), F.col("life"), digits=None)})
    return a.rollup("grp").agg(F.count("*").alias("objects"), F.count_if("bad").alias("errors"), F.round(F.sum("d"), 2).alias("deviation"))


@query("""
WITH r AS (SELECT l_orderkey AS key, min(CAST(l_shipdate AS DATE)) AS started, sum(l_extendedprice) AS cost FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT o_orderkey AS key, CASE WHEN r.key IS NULL THEN 'missing' WHEN o_totalprice > 0 AND abs(o_totalprice - r.cost) / o_totalprice > 0.1 THEN 'cost_differs' WHEN abs(date_diff('day', r.started, CAST(o_orderdate AS DATE))) > 30 THEN 'date_differs' ELSE 'matches' END AS status
FROM orders LEFT JOIN r ON o_orderkey = r.key""")
def registry_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against what their line items add up to, as a registry."""
    reg = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("key")).agg(F.min(F.to_date("l_shipdate")).alias("started"), F.sum("l_extendedprice").alias("cost"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.to_date("o_orderdate").alias("started"), F.col("o_totalprice").alias("cost"))
    return reconcile.registry_status(rows, reg).select("key", "status")


_INDICES = [(0, "promo", 1.05), (1, "standard", 1.08), (2, "econom", 0.98), (3, "small", 1.04)]


@query("""
WITH a AS (SELECT p_type AS name, sum(l_extendedprice) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type),
x(pos, title, factor) AS (VALUES (0, 'promo', 1.05), (1, 'standard', 1.08), (2, 'econom', 0.98), (3, 'small', 1.04)),
m AS (SELECT name, arg_min(factor, pos) AS factor FROM a, x WHERE contains(lower(name), title) OR contains(title, lower(name)) GROUP BY name),
f AS (SELECT name, amount, CASE WHEN m.factor IS NULL OR round(m.factor * 1.02, 3) = 1 THEN 1.05 ELSE CAST(round(m.factor * 1.02, 3) AS DOUBLE) END AS factor FROM a LEFT JOIN m USING (name))
SELECT name, round(CAST(factor AS DOUBLE), 4) AS factor, round(amount * factor, 5) AS forecast FROM f""")
def tariff_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by part type times the first index whose title fits its name."""
    a = _risks(spark, sf_dir).select("name", "amount")
    indices = spark.createDataFrame(_INDICES, "pos int, title string, factor double")
    out = reconcile.indexed(a, indices, 1.02)
    return out.select("name", F.round("factor", 4).alias("factor"), F.round("forecast", 5).alias("forecast"))


_MONTHS = "m AS (SELECT date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS y, count(*) AS x FROM orders GROUP BY 1)"


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by month. Whole parts are summed exactly and fractions beside them, so that the order of the rows can't be seen in a rounded sum."""
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg((F.sum(F.floor(price)) + F.sum(price - F.floor(price))).alias("y"), F.count("*").cast("double").alias("x"))


@query(f"WITH {_MONTHS} SELECT round(regr_slope(y, x), 2) AS slope, round(regr_intercept(y, x), 0) AS intercept, round(regr_r2(y, x), 4) AS r2, count(*) AS n FROM m")
def regression_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _months(spark, sf_dir)
    return m.agg(F.round(F.regr_slope("y", "x"), 2).alias("slope"), F.round(F.regr_intercept("y", "x"), 0).alias("intercept"), F.round(F.regr_r2("y", "x"), 4).alias("r2"), F.count("*").alias("n"))


# fsum: a plain sum of doubles depends on the order in which threads add them, and so the rounded interval
@query(f"WITH {_MONTHS.replace('sum(', 'fsum(')}, f AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM m), e AS (SELECT stddev_pop(y - (a * x + b)) AS s FROM m, f) SELECT strftime(month, '%Y-%m') AS month, round(a * x + b, 0) AS prediction, round(a * x + b - 1.96 * s, 0) AS low, round(a * x + b + 1.96 * s, 0) AS high FROM m, f, e")
def consumption_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly totals predicted by least squares, with the 95 per cent interval."""
    out, figures = reconcile.regression(_months(spark, sf_dir), "y", ["x"])
    low, high = reconcile.interval(F.col("prediction"), figures["spread"])
    return out.select(F.date_format("month", "yyyy-MM").alias("month"), F.round("prediction", 0).alias("prediction"), F.round(low, 0).alias("low"), F.round(high, 0).alias("high"))


@query("""
WITH m AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS y FROM orders GROUP BY 1, 2)
SELECT o_custkey AS custkey, count(*) AS months, round(sum(y), 2) AS total, round(max(y) / avg(y), 3) AS peak FROM m GROUP BY 1""")
def revenue_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("month")).agg(F.sum("o_totalprice").alias("y"))
    return m.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("months"), F.round(F.sum("y"), 2).alias("total"), F.round(F.max("y") / F.avg("y"), 3).alias("peak"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_type), 'promo') THEN 'agg' WHEN contains(lower(p_type), 'standard') THEN 'ref' WHEN p_size % 7 = 0 THEN 'zero' ELSE 'cost' END AS type FROM part")
def article_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type ladder, names made of part types so that they have the words it looks for."""
    name = F.when(F.lower("p_type").contains("promo"), F.concat(F.lit("Итого "), "p_type")).when(F.lower("p_type").contains("standard"), F.concat(F.lit("Тариф "), "p_type")).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", rules.article_type(name, F.col("p_size") % 7 != 0).alias("type"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'PAYROLL' WHEN 1 THEN 'REPAIRS' WHEN 2 THEN 'RENT' WHEN 3 THEN 'ENERGY' ELSE 'OTHER' END AS category FROM part")
def cost_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The taxonomy, each part's name having one category's word behind it."""
    words = F.array(*[F.lit(x) for x in (" Зарплата", " Ремонт оборудования", " Аренда", " Газ", " ???")])
    name = F.concat(F.lit("part "), F.element_at(words, (F.col("p_partkey") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", rules.cost_category(name).alias("category"))


@query("""
SELECT n_name AS nation, p_brand AS brand, round(q, 2) AS quantity, CAST(k AS INTEGER) AS rank FROM (
  SELECT n_name, p_brand, sum(l_quantity) AS q, row_number() OVER (PARTITION BY n_name ORDER BY sum(l_quantity) DESC, p_brand) AS k
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2) WHERE k <= 5""")
def top5_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    part, sup, nat = table(spark, sf_dir, "part").select("p_partkey", "p_brand"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    s = li.join(part, li.l_partkey == part.p_partkey).join(sup, li.l_suppkey == sup.s_suppkey).join(nat, sup.s_nationkey == nat.n_nationkey).groupBy(F.col("n_name").alias("nation"), F.col("p_brand").alias("brand")).agg(F.sum("q").alias("quantity"))
    return reconcile.top_by_group(s, ["nation"], [F.desc("quantity"), F.asc("brand")], 5).select("nation", "brand", F.round("quantity", 2).alias("quantity"), "rank")


@query("SELECT arg_min(p_name, p_partkey) AS name, min(p_partkey) AS first_key, round(sum(p_retailprice), 2) AS total FROM part GROUP BY lower(trim(p_name))")
def dedup_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with names that are equal but for case, summed up under the first spelling."""
    return table(spark, sf_dir, "part").groupBy(F.lower(F.trim("p_name")).alias("k")).agg(F.min_by("p_name", "p_partkey").alias("name"), F.min("p_partkey").alias("first_key"), F.round(F.sum("p_retailprice"), 2).alias("total")).drop("k")


@query("""
WITH a AS (SELECT s_nationkey AS k FROM supplier), b AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000)
SELECT 'both' AS side, k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'left' AS side, k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'any' AS side, k FROM (SELECT k FROM a UNION SELECT k FROM b)""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    b = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    side = lambda df, name: df.select(F.lit(name).alias("side"), "k")
    return side(a.intersect(b), "both").unionByName(side(a.subtract(b), "left")).unionByName(side(a.union(b).distinct(), "any"))


def _repeated(part: DataFrame, meet: Column) -> DataFrame:
    """``p_partkey`` of the parts before the last one whose name is equal or one edit apart, where ``meet`` holds of ``name`` and ``other``."""
    p = part.select("p_partkey", F.col("p_name").alias("name"))
    last = p.where("name is not null").groupBy("name").agg(F.max("p_partkey").alias("last"))
    best = one_edit(last.select("name")).where(meet).join(last.withColumnRenamed("name", "other"), "other").groupBy("name").agg(F.max("last").alias("last"))
    return p.join(best, "name").where("p_partkey < last").select("p_partkey")


@query("""
WITH p AS (SELECT p_partkey, p_name, left(p_name, 6) AS block FROM part)
SELECT DISTINCT a.p_partkey FROM p a JOIN p b ON a.block = b.block AND a.p_partkey < b.p_partkey WHERE levenshtein(a.p_name, b.p_name) <= 1""")
def near_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name a later part has but for one edit, within equal beginnings: distinct names meet, each with its last part. (The similarity ratio has a name of its own.)"""
    begins = lambda c: F.left(c, F.lit(6))
    return _repeated(table(spark, sf_dir, "part"), begins(F.col("name")) == begins(F.col("other"))).distinct()


@query("""
WITH n AS (SELECT p_name AS name, max(p_partkey) AS last FROM part WHERE p_name IS NOT NULL GROUP BY p_name),
b AS (SELECT a.name, max(b.last) AS last FROM n a JOIN n b ON levenshtein(a.name, b.name) <= 1 GROUP BY a.name)
SELECT p_partkey FROM part JOIN b ON p_name = name WHERE p_partkey < last""")
def repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name a later part has but for one edit, wherever that is: distinct names meet, each with its last part."""
    return _repeated(table(spark, sf_dir, "part"), F.lit(True))


@query("""
WITH n AS (SELECT DISTINCT p_name || ' ' || p_type AS name FROM part)
SELECT a.name, b.name AS other FROM n a JOIN n b ON a.name < b.name
WHERE 2 * least(length(a.name), length(b.name)) >= 0.749999999 * (length(a.name) + length(b.name)) AND levenshtein(lower(a.name), lower(b.name)) <= 0.250000001 * (length(a.name) + length(b.name))""")
def alike_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts that lengths and edits allow to be three quarters alike, met on their rarest bigrams."""
    names = table(spark, sf_dir, "part").select(F.lit(0).alias("key"), F.concat_ws(" ", "p_name", "p_type").alias("name")).distinct()
    return candidates(names, 0.75).where("name < other").select("name", "other")


@query("""
SELECT l_suppkey AS suppkey, round(avg((l_extendedprice + l_extendedprice * (1 - l_discount)) / 2), 2) AS mean_annual, round(avg(l_tax * l_extendedprice), 2) AS by_year, 0.0::DOUBLE AS without
FROM lineitem GROUP BY 1""")
def mean_amortization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean annual amount of each supplier's lines, by their columns: start and end, a year's, or none."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("suppkey"), F.col("l_extendedprice").alias("start"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("end"), (F.col("l_tax") * F.col("l_extendedprice")).alias("year"))
    mean = rules.mean_annual_amortization
    return lines.groupBy("suppkey").agg(F.round(mean(lines.columns), 2).alias("mean_annual"), F.round(mean(["year"]), 2).alias("by_year"), mean([]).alias("without"))
