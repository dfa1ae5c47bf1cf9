"""Registers, parsers and flows over the driver tables: customers, parts and orders stand for claims, articles and minutes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions import parsing
from gridwright.operators import chunking, flows, knowledge, matching, registers
from gridwright.operators.postings import SearchIndex
from gridwright.plans.registry import query
from gridwright.sources.files import table


@query("""
SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE (contains(lower(c_name), 'nation_1') OR contains(lower(c_mktsegment), 'nation_1') OR contains(lower(n_name), 'nation_1')) AND c_mktsegment = 'BUILDING'""")
def registry_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims by a part of their organisation, notes or any tag, of one status."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    tags = F.array("c_mktsegment", "n_name")
    return c.where(registers.any_has([F.col("c_name"), F.col("c_mktsegment")], [tags], "Nation_1") & registers.equals({"c_mktsegment": "BUILDING"})).select("c_custkey")


@query("SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red')) AND p_type = 'PROMO' AND contains(lower(p_brand), '#1')")
def document_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by a part of one of three fields, by type, and by a part of the region."""
    wanted = registers.any_has([F.col("p_name"), F.col("p_brand"), F.col("p_type")], [], " RED ")
    return table(spark, sf_dir, "part").where(wanted & registers.equals({"p_type": "PROMO", "p_size": None}) & registers.has(F.col("p_brand"), "#1")).select("p_partkey")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("category"), F.array("o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("spheres"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_orderdate >= DATE '1996-01-01' AND strftime(o_orderdate, '%Y-%m-%d') <= '1999-12-31'")
def law_change_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.law_changes(_changes(spark, sf_dir), "F", "1-URGENT", "1996-01-01", "1999-12-31").select("o_orderkey", "date")


@query("SELECT count(*) AS total, count_if(o_orderstatus = 'F') AS o_orderstatus_F, count_if(o_orderstatus = 'O') AS o_orderstatus_O, count_if(o_orderstatus = 'P') AS o_orderstatus_P FROM orders")
def law_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.counted(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P"])


_KINDS = "CASE p_type WHEN 'ECONOMY' THEN 'cost' WHEN 'SMALL' THEN 'zero' WHEN 'PROMO' THEN 'ref' WHEN 'MEDIUM' THEN 'agg' ELSE 'cost' END"


@query(f"""
WITH a AS (SELECT p_partkey, p_name AS name, {_KINDS} AS type, p_brand AS sheet, p_retailprice > 1000 AS has_value FROM part),
b AS (SELECT *, type = 'cost' AND has_value AS checked FROM a)
SELECT p_partkey, CASE WHEN contains(lower(name), 'red') AND sheet = 'Brand#17' THEN NOT checked ELSE checked END AS checked FROM b""")
def recheck_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles chosen by themselves, those without a value dropped, the choice inverted on one sheet and name."""
    kind = F.expr(_KINDS)
    a = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), kind.alias("type"), F.col("p_brand").alias("sheet"), F.lit(False).alias("tech_sheet"), (F.col("p_retailprice") > 1000).alias("has_value"), F.lit(False).alias("checked"))
    chosen = registers.rechecked(registers.rechecked(a, "auto"), "drop_empty")
    return registers.rechecked(chosen, "invert", registers.in_choice("red", sheet="Brand#17")).select("p_partkey", "checked")


_MINUTES = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'no date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS meeting_date, o_orderpriority AS meeting_name, 'Customer ' || o_custkey AS organization, o_orderstatus AS detail_level FROM orders"


def _minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.when(F.col("o_orderkey") % 7 == 0, F.lit("no date")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", day.alias("meeting_date"), F.col("o_orderpriority").alias("meeting_name"), F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("organization"), F.col("o_orderstatus").alias("detail_level"), F.length("o_orderpriority").alias("word_count"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("txt_size"), F.lit(None).cast("long").alias("docx_size"))


@query(f"""WITH m AS ({_MINUTES}) SELECT o_orderkey FROM m WHERE coalesce(TRY_CAST(meeting_date AS DATE), DATE '1970-01-01') BETWEEN DATE '1970-01-01' AND DATE '1997-06-30'
AND (contains(lower(meeting_name), 'urgent') OR contains(lower(organization), 'urgent')) AND detail_level IN ('F', 'O')""")
def minutes_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes in a range of dates, an unreadable date counting as the first day of 1970."""
    return registers.minutes(_minutes(spark, sf_dir), "1970-01-01", "1997-06-30", "urgent", ["F", "O"], "name").select("o_orderkey")


@query(f"""WITH m AS ({_MINUTES}) SELECT count(*) AS total, CAST(sum(length(meeting_name)) AS BIGINT) AS words, CAST(sum(CASE WHEN o_orderkey % 5 <> 0 THEN CAST(substr(organization, 10) AS BIGINT) ELSE 0 END) AS BIGINT) AS bytes,
min(TRY_CAST(meeting_date AS DATE)) AS first_day, max(TRY_CAST(meeting_date AS DATE)) AS last_day FROM m""")
def minutes_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.minutes_totals(_minutes(spark, sf_dir))


@query("""SELECT event_id FROM events WHERE contains(lower(event_type), 'c') AND contains('{"user_id":' || user_id || ',"kind":"' || event_type || '"}', '"user_id":4') AND strftime(ts, '%Y-%m-%d') LIKE '2024-01-0%'""")
def forecast_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts by article, by a name anywhere in their sources, by how their time stamp begins."""
    r = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("article"), F.struct("user_id", F.col("event_type").alias("kind")).alias("sources"), F.date_format("ts", "yyyy-MM-dd").alias("timestamp"))
    return registers.forecasts(r, "C", '"user_id":4', "2024-01-0").select("event_id")


@query("SELECT p_partkey FROM part WHERE p_size * 2 >= 40 AND p_size * 2 < 70")
def risk_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 2).alias("inclusion_risk"), F.col("p_retailprice").alias("amount"), F.col("p_size").alias("percent"))
    return registers.risk_list(a, "medium", "amount").select("p_partkey")


@query("""WITH e AS (SELECT coalesce(lang, 'other') AS category, len(string_split(text, chr(10))) AS v FROM documents), w AS (SELECT count(*) AS total, sum(coalesce(v, 0)) / greatest(count(*), 1) AS mean_variations FROM e)
SELECT category, count(*) AS n, any_value(total) AS total, round(any_value(mean_variations), 6) AS mean_variations FROM e, w GROUP BY category""")
def faq_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by category, and how many wordings one has on average: documents and their lines."""
    f = table(spark, sf_dir, "documents").select(F.col("lang").alias("category"), F.split("text", "\n").alias("variations"))
    return registers.faq_stats(f).withColumn("mean_variations", F.round("mean_variations", 6))


@query("WITH l AS (SELECT l_orderkey, l_extendedprice AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS k FROM lineitem) SELECT l_orderkey, round(sum(p), 2) AS amount FROM l WHERE k <= 3 GROUP BY l_orderkey")
def complaint_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of each order's first three lines."""
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_extendedprice").alias("amount")))).alias("a"))
    return a.select("l_orderkey", F.round(registers.first_amounts(F.col("a")), 2).alias("amount"))


@query("SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE o_orderkey % 7 <> 0")
def registry_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 7 == 0, F.lit("—")).otherwise(F.year("o_orderdate").cast("string")).alias("year"))
    return registers.years_in(y).select(F.col("year").cast("int").alias("year"))


@query("""SELECT count_if(event_type <> 'error') AS done, count_if(event_type = 'error') AS failed, CAST(sum(CASE WHEN event_type <> 'error' THEN user_id ELSE 0 END) AS BIGINT) AS chunks,
CAST(count_if(event_type <> 'error') AS BIGINT) AS pages, CAST(count_if(event_type = 'view') AS BIGINT) AS ocr_pages FROM events""")
def reindex_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda c: F.when(c, F.lit(1).cast("long"))
    return registers.index_totals(table(spark, sf_dir, "events").select((F.col("event_type") != "error").alias("ok"), F.col("user_id").cast("long").alias("chunks"), F.lit(1).cast("long").alias("pages"), one(F.col("event_type") == "view").alias("ocr_pages")))


FOLDERS = [("spam", ["pills", "casino"]), ("german", ["/de/"]), ("tracked", ["utm_", "ref="])]
TAGS = [("spam", ["pills", "spam"]), ("paged", ["page="]), ("english", ["/en/"])]


@query("""
WITH p AS (SELECT page_id, url, lower(url || ' ') AS u FROM pages)
SELECT page_id, CASE WHEN contains(u, 'pills') OR contains(u, 'casino') THEN 'spam' WHEN contains(u, '/de/') THEN 'german' WHEN contains(u, 'utm_') OR contains(u, 'ref=') THEN 'tracked' ELSE 'rest' END AS folder,
  concat_ws(',', CASE WHEN contains(u, 'pills') OR contains(u, 'spam') THEN 'spam' END, CASE WHEN contains(u, 'page=') THEN 'paged' END, CASE WHEN contains(u, '/en/') THEN 'english' END) AS tags,
  'URL_20240131_Орг_' || left(split_part(url, '.', 1), 30) || '.html' AS name FROM p""")
def file_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder, the tags and the new name of each page's address."""
    u = F.col("url")
    name = parsing.file_name(F.lit("URL"), F.lit("2024-01-31").cast("date"), F.lit(""), u, F.lit(".html"))
    return table(spark, sf_dir, "pages").select("page_id", parsing.folder_of(u, F.lit(None).cast("string"), FOLDERS, "rest").alias("folder"), F.array_join(parsing.tags_of(u, F.lit(""), TAGS), ",").alias("tags"), name.alias("name"))


@query(r"""
WITH t AS (SELECT a.conv_id, a.turn, lower(b.text) AS mine, lower(a.text) AS own FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
w AS (SELECT *, trim(mine) AS m, list_filter(regexp_split_to_array(trim(own), '\s+'), lambda x: length(x) > 4) AS ws FROM t)
SELECT conv_id, turn, CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda x: contains(m, x))) / len(ws) >= 0.4 OR contains(own, m) OR contains(m, own) ELSE m = own END AS is_right FROM w""")
def answer_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a turn says again what the one before it said."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("given"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", parsing.answer_is_right(F.col("given"), F.col("text")).alias("is_right"))


ROUTES = [("license", "law"), ("token", "security"), ("version", "releases")]


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'law' WHEN contains(lower(text), 'token') THEN 'security' WHEN contains(lower(text), 'version') THEN 'releases' END AS section FROM documents""")
def question_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", parsing.section_of(F.col("text"), ROUTES).alias("section"))


@query("""SELECT o_orderkey, round(greatest(0.0, 1 - 60 * (o_totalprice / 20000000)), 3) AS distance, round((1 - round(greatest(0.0, 1 - 60 * (o_totalprice / 20000000)), 3)) * 100, 1) AS relevance,
round(length(o_orderpriority) * o_custkey / 7 / 60, 4) AS minutes, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'unknown' END AS status FROM orders""")
def list_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a list of results shows: a distance, its relevance, minutes of work, a status by its code."""
    distance = parsing.pseudo_distance(F.col("o_totalprice") / 20000000)
    minutes = parsing.minutes_needed(F.length("o_orderpriority"), F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", distance.alias("distance"), parsing.relevance_percent(distance).alias("relevance"), F.round(minutes, 4).alias("minutes"), parsing.label_of(F.col("o_orderstatus"), {"F": "done", "O": "open"}, "unknown").alias("status"))


_KEPT = "lines AS (SELECT doc_id, trim(line) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE regexp_matches(line, '[^\\s]'))"


@query("WITH " + _KEPT + r" SELECT doc_id, CAST(i AS INTEGER) AS i, md5(regexp_replace(line, '^\s+|\s+$', '', 'g')) AS text_md5 FROM lines")
def numbered_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines as the answers of one batch, read back."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\s]"))
    answer = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("Документ "), (i + 1).cast("string"), F.lit(": "), x)), "\n")
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(parsing.numbered_answers(answer)).alias("m"))
    return each.select("doc_id", "m.i", F.md5("m.text").alias("text_md5"))


_SERIES = "SELECT p_brand AS brand, CAST(year(l_shipdate) AS INTEGER) AS year, CASE l_linestatus WHEN 'F' THEN 'Фак' ELSE 'Пла' END AS label, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line ``brand: year/label=value, …`` for each brand."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.year("l_shipdate").alias("year"), "l_linestatus").agg(F.sum("l_quantity").alias("q"))
    s = li.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    s = s.groupBy("p_brand", "year", F.when(F.col("l_linestatus") == "F", "Фак").otherwise("Пла").alias("label")).agg(F.sum("q").cast("long").alias("v"))
    part = F.concat(F.col("year").cast("string"), F.lit("/"), F.col("label"), F.lit("="), F.col("v").cast("string"))
    return s.groupBy(F.col("p_brand").alias("brand")).agg(F.concat_ws(", ", F.array_sort(F.collect_list(part))).alias("amounts"))


@query("SELECT brand, year, label, CAST(v AS DOUBLE) AS value FROM (" + _SERIES + ")")
def amount_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered series of amounts read back."""
    return _rendered(spark, sf_dir).select("brand", F.inline(parsing.amounts(F.col("amounts"))))


@query("SELECT brand AS name, count(*) AS amounts FROM (" + _SERIES + ") GROUP BY brand")
def articles_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rendered sheet, articles in either form, read back: each name with the number of its amounts."""
    full = F.concat(F.lit("★ "), F.col("brand"), F.lit("\n  "), F.replace(F.col("amounts"), F.lit(", "), F.lit("\n  ")), F.lit("\n"))
    short = F.concat(F.lit("  "), F.col("brand"), F.lit(": "), F.col("amounts"))
    sheet = _rendered(spark, sf_dir).withColumn("line", F.when(F.col("brand").endswith("1"), full).otherwise(short))
    text = sheet.groupBy(F.length("brand").alias("n")).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("t"))
    back = text.select(F.inline(parsing.rendered_articles(F.concat(F.lit("# Лист\n"), F.col("t")))))
    return back.select("name", F.size(parsing.amounts(F.col("amounts"))).cast("long").alias("amounts"))


@query("""SELECT doc_id, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE pos % 3 = 1 GROUP BY doc_id""")
def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line of a document made a table row, with rules between, and the rows found again."""
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("|"), x, F.lit("x|\n|---|:-:|"))).otherwise(F.concat(F.lit("."), x)))
    rows = parsing.table_lines(F.array_join(marked, "\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(rows).alias("r")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.char_length("r") - 3).alias("chars"))


@query("SELECT o_orderkey, md5('Order ' || o_orderkey || ' of ' || o_custkey || ': ' || o_orderpriority || '.') AS text_md5 FROM orders")
def complaint_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = parsing.filled(F.lit("Order {order} of {customer}: {what}.{nothing}"), {"order": F.col("o_orderkey"), "customer": F.col("o_custkey"), "what": F.col("o_orderpriority"), "nothing": F.lit(None).cast("string")})
    return table(spark, sf_dir, "orders").select("o_orderkey", F.md5(text).alias("text_md5"))


_MATCH = r"""
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
a AS (SELECT label AS article, lower((SELECT min(text) FROM benchmark b WHERE b.item_id = label)) AS name, v FROM v WHERE label IN (SELECT item_id FROM benchmark) QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
k AS (SELECT article, v, list_filter(regexp_split_to_array(left(name, 24), '[^\p{L}\p{N}_]+'), lambda w: length(w) > 3) AS keys FROM a),
s AS (SELECT article, doc_id AS doc, CASE WHEN len(list_filter(keys, lambda x: contains(lower(d.text), x))) > 0 THEN 1.0 ELSE coalesce(round(list_cosine_similarity(k.v, w.v), 3), 0.0) END AS similarity FROM documents d LEFT JOIN v w ON w.vec_id = d.doc_id, k),
r AS (SELECT *, row_number() OVER (PARTITION BY article ORDER BY similarity DESC, doc) - 1 AS rank FROM s WHERE similarity >= 0.1)
SELECT article, doc, similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank < 3"""


@query(_MATCH)
def article_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For an article of each label, named by a benchmark item, the three documents that fit best by keyword, else by vector."""
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy(F.col("label").alias("article")).agg(F.min_by("embedding", "vec_id").alias("v"))
    names = table(spark, sf_dir, "benchmark").groupBy(F.col("item_id").alias("article")).agg(F.left(F.lower(F.min("text")), F.lit(24)).alias("name"))
    articles = first.join(names, "article").withColumn("claim", F.lit(0))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text").join(e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("w")), "doc", "left")
    return matching.matched(articles, docs.withColumn("claim", F.lit(0)), 0.1).select("article", "doc", "similarity", "rank")


@query("""
WITH f AS (SELECT n_regionkey AS claim, n_nationkey AS article, CAST(year(o_orderdate) AS INTEGER) AS period, CASE o_orderstatus WHEN 'F' THEN 'Принято' WHEN 'O' THEN 'Предложение' ELSE 'План' END AS pf, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
y AS (SELECT claim, max(period) AS now FROM f GROUP BY claim),
o AS (SELECT f.claim, article, period = now AS is_now, value FROM f JOIN y ON f.claim = y.claim AND period IN (now, now - 1) QUALIFY row_number() OVER (PARTITION BY f.claim, article, period ORDER BY CASE pf WHEN 'Принято' THEN 0 WHEN 'Предложение' THEN 1 ELSE 3 END, value) = 1),
b AS (SELECT claim, article, max(CASE WHEN NOT is_now THEN value END) AS base, max(CASE WHEN is_now THEN value END) AS value FROM o GROUP BY ALL),
c AS (SELECT *, CASE WHEN base IS NULL OR base <= 0 THEN 'yellow' WHEN (value - base) / base * 100 > 15 THEN 'red' ELSE 'yellow' END AS color FROM b WHERE value IS NOT NULL)
SELECT claim, count(*) AS articles, count_if(color = 'red') AS red, round(sum(CASE WHEN color = 'red' THEN value ELSE 0 END), 2) AS red_sum, count_if(color = 'yellow') AS yellow, round(sum(CASE WHEN color = 'yellow' THEN value ELSE 0 END), 2) AS yellow_sum, count_if(color = 'green') AS green, round(sum(CASE WHEN color = 'green' THEN value ELSE 0 END), 2) AS green_sum
FROM c GROUP BY claim""")
def claim_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions' nations as articles of a claim, by growth in the last year, without any document as evidence."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("period"), "o_orderstatus").agg(F.sum("o_totalprice").alias("v"))
    c, n = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name")
    pf = F.when(F.col("o_orderstatus") == "F", "Принято").when(F.col("o_orderstatus") == "O", "Предложение").otherwise("План")
    f = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    f = f.groupBy(F.col("n_regionkey").alias("claim"), F.col("n_nationkey").alias("article"), F.col("n_name").alias("name"), "period", pf.alias("pf")).agg(F.sum("v").alias("value"))
    none = spark.createDataFrame([], "claim long, doc long, text string, w array<double>")
    vectors = spark.createDataFrame([], "claim long, article long, v array<double>")
    return flows.risk_summary(flows.article_risks(f, none, vectors))


@query("SELECT event_id FROM events WHERE floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(ts)) <= 604800")
def cache_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the last week, the newest event telling what time it is."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("at"))
    now = e.agg(F.max("at").alias("now"))  # one row
    return knowledge.fresh(e.crossJoin(F.broadcast(now)), F.col("now")).select("event_id")


@query("""
WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[а-яёa-z0-9]+') AS t FROM documents), p AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM t)
SELECT id, CAST(dl AS INTEGER) AS dl, count(DISTINCT term) AS terms, count(*) AS tf FROM p GROUP BY id, dl""")
def posting_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept postings of all documents, summed up by document."""
    p = SearchIndex.of(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")).postings()
    return p.groupBy("id", "dl").agg(F.count("*").alias("terms"), F.sum("tf").alias("tf"))


@query("""
SELECT conv_id, md5(first(text ORDER BY turn) || ' ' || coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE turn > 0), '')) AS text_md5 FROM conversations GROUP BY conv_id HAVING min(turn) = 0""")
def faq_entry_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as FAQ entries: the first turn the question, the others its variations."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t")).where(F.col("t")[0]["turn"] == 0)
    texts = F.transform("t", lambda x: x["text"])
    faq = c.select(F.col("conv_id").alias("id"), texts[0].alias("question"), F.slice(texts, F.lit(2), F.size(texts)).alias("variations"))
    return knowledge.faq_texts(faq).select(F.col("id").alias("conv_id"), F.md5("entry_text").alias("text_md5"))


@query("SELECT page_id FROM pages WHERE contains(lower(url), 'page=') OR contains('paged', 'page=') OR (contains(lower(url), 'pills') AND contains('spam', 'page='))")
def tag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("name"), parsing.tags_of(F.col("url"), F.lit(""), TAGS).alias("tags"))
    return knowledge.tagged_with(p, "PAGE=").select("page_id")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
p AS (SELECT doc_id, pos // 5 + 1 AS page, string_agg(line, chr(10) ORDER BY pos) AS t FROM l GROUP BY 1, 2)
SELECT doc_id, md5(left(string_agg(t, chr(10) ORDER BY page), 1500)) AS head_md5 FROM p WHERE page <= 2 GROUP BY doc_id ORDER BY doc_id LIMIT 100""")
def file_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heads of the first hundred files, as a claim's summary shows them: 1,500 characters of two pages."""
    pages = chunking.paginated(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), 5)
    return matching.heads(pages).select(F.col("doc").alias("doc_id"), F.md5("text").alias("head_md5"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)),
k AS (SELECT doc_id, trim(line) AS text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS idx FROM l WHERE length(trim(line)) >= 50)
SELECT 'base' AS collection, doc_id, CAST(idx AS INTEGER) AS idx, md5(text) AS text_md5 FROM k""")
def collection_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection rebuilt from the documents that are not left out of training."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    out = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("doc"))
    made = knowledge.collection(files, out, "base", "separator", separator="\n")
    return made.select("collection", F.col("doc").alias("doc_id"), "idx", F.md5("text").alias("text_md5"))


@query("""
WITH r AS (SELECT o_custkey AS file, o_orderkey AS pos, unnest([o_orderpriority, o_orderstatus]) AS name, unnest([0, 1]) AS i FROM orders)
SELECT file, name, CAST(arg_min(pos, pos * 2 + i) AS VARCHAR) AS number FROM r GROUP BY file, name""")
def document_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that answers list as JSON, each name once a file: an order's answer lists its priority and its status."""
    doc = lambda name: F.struct(name.alias("name"), F.col("o_orderkey").cast("string").alias("number"))
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(doc(F.col("o_orderpriority")), doc(F.col("o_orderstatus"))).alias("documents"))), F.lit("\n```"))
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("pos"), answer.alias("answer"))
    return knowledge.inventory(a).select("file", "name", "number")
