"""Log queries: events stand for append-only logs, conversations for histories, labels for ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwright.functions import rules
from gridwright.functions import text as tx
from gridwright.operators import logs
from gridwright.plans.registry import query
from gridwright.sources.files import table


@query("SELECT user_id, event_id, event_type, round(value, 4) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return logs.latest(ev, ["user_id"], F.struct("ts", "event_id")).select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))


@query("""
WITH l AS (SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, event_id FROM l WHERE event_type <> (SELECT min(event_type) FROM events)""")
def anti_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest versions, where one kind of event is a deletion."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    gone = ev.agg(F.min("event_type").alias("gone_type"))
    flagged = ev.crossJoin(F.broadcast(gone))
    return logs.latest(flagged, ["user_id"], F.struct("ts", "event_id"), F.col("event_type") == F.col("gone_type")).select("user_id", "event_id")


@query("""
SELECT event_id, user_id, 1 AS source FROM events WHERE NOT (event_id % 3 = 0) AND user_id NOT IN (SELECT user_id FROM events WHERE value > 100 AND event_type = (SELECT max(event_type) FROM events))
UNION ALL SELECT event_id, user_id, 2 AS source FROM events WHERE event_id % 3 = 0""")
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store without what is deleted by user, and new rows added under their key."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    last = ev.agg(F.max("event_type").alias("t"))
    gone = ev.crossJoin(F.broadcast(last)).where("value > 100 and event_type = t").select("user_id")
    store = logs.without(ev, gone, ["user_id"]).select("event_id", "user_id", F.lit(1).alias("source"))
    return logs.upserted(store, ev.where("event_id % 3 = 0").select("event_id", "user_id", F.lit(2).alias("source")), ["event_id"])


_DECISION = "CASE event_type WHEN (SELECT min(event_type) FROM events) THEN 'negative' WHEN (SELECT max(event_type) FROM events) THEN 'positive' ELSE 'neutral' END"


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "props")
    ends = ev.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    d = F.when(F.col("event_type") == F.col("lo"), "negative").when(F.col("event_type") == F.col("hi"), "positive").otherwise("neutral")
    return ev.crossJoin(F.broadcast(ends)).select(F.col("user_id").alias("file"), d.alias("decision"), F.col("event_id").alias("pos"), F.col("props").alias("quote"))


@query(f"""
WITH v AS (SELECT user_id AS file, {_DECISION} AS decision, event_id AS pos, props AS quote FROM events),
c AS (SELECT file, decision, count(*) AS n, min(pos) AS first, arg_min(quote, pos) AS quote FROM v GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER (PARTITION BY file) AS chunks, row_number() OVER (PARTITION BY file ORDER BY n DESC, first) AS k FROM c)
SELECT file, decision, quote, CAST(chunks AS BIGINT) AS chunks FROM w WHERE k = 1""")
def vote_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.majority(_votes(spark, sf_dir)).select("file", "decision", "quote", "chunks")


@query(f"""
WITH v AS (SELECT user_id AS file, {_DECISION} AS decision FROM events),
c AS (SELECT file, count(*) FILTER (WHERE decision = 'positive') AS p, count(*) FILTER (WHERE decision = 'negative') AS n FROM v GROUP BY 1)
SELECT file, CASE WHEN p + n > 0 THEN round(p / (p + n * 1.5) * 100, 1) ELSE 50.0 END AS approval, CASE WHEN p + n >= 5 THEN 'high' WHEN p + n >= 1 THEN 'medium' ELSE 'low' END AS confidence FROM c""")
def approval_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _votes(spark, sf_dir).groupBy("file").agg(F.count_if(F.col("decision") == "positive").alias("p"), F.count_if(F.col("decision") == "negative").alias("n"))
    return c.select("file", rules.approval_percent(F.col("p"), F.col("n")).alias("approval"), rules.confidence(F.col("p") + F.col("n")).alias("confidence"))


@query(f"""
WITH v AS (SELECT event_id, user_id, {_DECISION} AS decision FROM events), o AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'positive' ELSE 'negative' END AS decision FROM customer)
SELECT event_id, CASE WHEN v.decision = 'neutral' AND o.decision IS NOT NULL THEN o.decision ELSE v.decision END AS decision FROM v LEFT JOIN o ON user_id = c_custkey""")
def override_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neutral decisions replaced by an expert's, where there is one."""
    v = _votes(spark, sf_dir).select(F.col("pos").alias("event_id"), "file", "decision")
    o = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, "positive").otherwise("negative").alias("expert"))
    return v.join(o, v.file == o.c_custkey, "left").select("event_id", F.when((F.col("decision") == "neutral") & F.col("expert").isNotNull(), F.col("expert")).otherwise(F.col("decision")).alias("decision"))


@query("""
SELECT d.lang AS category, count(*) AS total, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS rating_2, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS rating_5, count(*) FILTER (WHERE toxic = 1) AS rating_1,
  round(avg(CASE WHEN toxic = 1 THEN 1 WHEN quality = 1 THEN 5 ELSE 2 END), 2) AS mean_rating, count(*) FILTER (WHERE length(trim(text)) > 2000) AS with_comment
FROM documents d JOIN labels l USING (doc_id) GROUP BY d.lang""")
def feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rated(spark, sf_dir)
    return r.groupBy("category").agg(F.count("*").alias("total"), *[F.count_if(F.col("rating") == i).alias(f"rating_{i}") for i in (2, 5, 1)], F.round(F.avg("rating"), 2).alias("mean_rating"), F.count_if(F.col("long")).alias("with_comment"))


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"), "source", (F.char_length(F.trim("text")) > 2000).alias("long"))
    rating = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 5).otherwise(2)
    return d.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("rating", rating)


@query("""
SELECT source, count(*) FILTER (WHERE r = 1) AS bad, count(*) FILTER (WHERE r = 2) AS poor, count(*) FILTER (WHERE r = 5) AS good FROM (
  SELECT source, CASE WHEN toxic = 1 THEN 1 WHEN quality = 1 THEN 5 ELSE 2 END AS r FROM documents JOIN labels USING (doc_id)) GROUP BY source""")
def rating_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _rated(spark, sf_dir).groupBy("source").pivot("rating", [1, 2, 5]).count()
    return p.select("source", *[F.coalesce(str(i), F.lit(0)).alias(n) for i, n in ((1, "bad"), (2, "poor"), (5, "good"))])


@query("""
SELECT category, doc_id FROM (SELECT d.lang AS category, doc_id, row_number() OVER (PARTITION BY d.lang ORDER BY doc_id DESC) AS k FROM documents d JOIN labels USING (doc_id) WHERE toxic = 1) WHERE k <= 10""")
def newest_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten newest badly rated answers of each category."""
    bad = _rated(spark, sf_dir).where("rating = 1")
    return bad.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("doc_id")))).where("k <= 10").select("category", "doc_id")


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS total, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS most FROM events GROUP BY 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(p).alias("total"), F.max(p).alias("most"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING), 6) AS mean10 FROM events")
def rolling_mean_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean10"))


@query("""
WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)
SELECT user_id, max(n) AS longest, count(*) AS runs, count(*) FILTER (WHERE n >= 3) AS stopped FROM (SELECT user_id, event_type, g, count(*) AS n FROM r GROUP BY ALL) GROUP BY user_id""")
def repeat_run_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one kind of event of each user, and how many are long enough to stop."""
    runs = logs.runs(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type")
    return runs.groupBy("user_id").agg(F.max("length").alias("longest"), F.count("*").alias("runs"), F.count_if(F.col("length") >= 3).alias("stopped"))


@query("""
WITH c AS (SELECT conv_id, arg_min(text, turn) AS query, string_agg(text, ' ' ORDER BY turn) AS everything, count(*) AS turns FROM conversations GROUP BY 1)
SELECT conv_id, turns, contains(lower(query), 'the') AS in_question FROM c WHERE contains(lower(everything), 'the') AND contains(lower(everything), 'ing')""")
def history_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in which all words occur, follow-ups included, and whether the first question has the first of them."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    everything = F.array_join(F.transform("t", lambda x: x["text"]), " ")
    return c.where(tx.contains_all(everything, "the ing")).select("conv_id", F.size("t").cast("long").alias("turns"), F.lower("query").contains("the").alias("in_question"))


@query("SELECT role, count(*) AS total, count(DISTINCT conv_id) AS conversations, count(*) FILTER (WHERE turn > 1) AS clarifications, min(conv_id) AS oldest FROM conversations GROUP BY role")
def history_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("total"), F.count_distinct("conv_id").alias("conversations"), F.count_if(F.col("turn") > 1).alias("clarifications"), F.min("conv_id").alias("oldest"))


@query("SELECT lang, source, count(*) AS chunks, min(doc_id) AS first_id, round(avg(n_chars), 2) AS mean_chars, sum(n_chars) AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk counts and lengths by kind, by file, and in all."""
    d = table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "n_chars")
    return d.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("chunks"), F.min("doc_id").alias("first_id"), F.round(F.avg("n_chars"), 2).alias("mean_chars"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('en', 'de') AND n_chars > 500 ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 50")
def list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of fifty, longest documents first."""
    d = table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "de") & (F.col("n_chars") > 500)).select("doc_id", "lang", "n_chars")
    return logs.page(d, [F.desc("n_chars"), F.asc("doc_id")], 2, 50)


@query("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures that the streaming form gives by window (an extension)."""
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "events").groupBy(hour.alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""
WITH c AS (SELECT conv_id, turn, text, turn % 3 = 2 AS broken, turn = 0 AND conv_id % 2 = 0 AS asked FROM conversations)
SELECT CASE WHEN broken THEN NULL ELSE conv_id * 100 + turn END AS id, md5(coalesce(text, '')) AS text_md5, CASE WHEN NOT broken AND asked THEN 2 ELSE 0 END AS clarifications, broken FROM c""")
def log_amended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a log with malformed lines, clarifications set in some records: every other line is there as it was."""
    c = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    record = F.to_json(F.struct((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text"))
    lines = c.select(F.when(F.col("turn") % 3 == 2, F.concat(F.lit("{broken "), F.hex("text"))).otherwise(record).alias("line"))
    two = F.array(F.struct(F.lit("q").alias("query")), F.struct(F.lit("r").alias("query")))
    updates = c.where("turn = 0 and conv_id % 2 = 0").select((F.col("conv_id") * 100 + F.col("turn")).alias("key"), two.alias("value"))
    done = logs.amended(lines, updates, "clarifications")
    broken = F.col("line").startswith("{broken ")
    r = F.from_json("line", "id long, text string, clarifications array<struct<query:string>>")
    text = F.when(broken, F.unhex(F.substring("line", 9, 1 << 30)).cast("string")).otherwise(r["text"])
    return done.select(F.when(~broken, r["id"]).alias("id"), F.md5(text).alias("text_md5"), F.when(broken, 0).otherwise(F.coalesce(F.size(r["clarifications"]), F.lit(0))).alias("clarifications"), broken.alias("broken"))
