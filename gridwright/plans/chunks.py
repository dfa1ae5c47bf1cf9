"""Text queries: pages, separators, overlaps, checks and cleaning over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions import rules
from gridwright.functions import text as tx
from gridwright.operators import chunking, scorers
from gridwright.plans.registry import query
from gridwright.sources.files import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")


_LINES = "lines AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"


@query(rf"""WITH {_LINES}, p AS (SELECT doc, pos // 5 + 1 AS page, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines GROUP BY 1, 2)
SELECT doc, CAST(page AS INTEGER) AS page, md5(text) AS text_md5, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS word_count FROM p""")
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of five lines (eighty are the default) with their word counts."""
    return chunking.paginated(_docs(spark, sf_dir), 5).select("doc", "page", F.md5("text").alias("text_md5"), "word_count")


@query(rf"WITH {_LINES} SELECT doc, CAST(pos AS INTEGER) AS pos, md5(trim(line)) AS text_md5 FROM lines WHERE length(trim(line)) >= 50")
def separator_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.by_separator(_docs(spark, sf_dir), "\n").select("doc", "pos", F.md5("text").alias("text_md5"))


@query(rf"""WITH {_LINES}, t AS (SELECT doc, pos, trim(line) AS text FROM lines WHERE length(trim(line)) >= 50)
SELECT doc, CAST(pos AS INTEGER) AS pos, md5(coalesce(right(lag(text) OVER (PARTITION BY doc ORDER BY pos), 30), '') || text) AS text_md5 FROM t""")
def overlap_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = chunking.overlapped(chunking.by_separator(_docs(spark, sf_dir), "\n"), 30)
    return cut.select("doc", "pos", F.md5("text").alias("text_md5"))


@query(r"""
WITH w AS (SELECT doc_id AS doc, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w, text FROM documents)
SELECT doc FROM w WHERE length(trim(text)) < 20 OR (len(w) > 10 AND len(list_filter(range(1, len(w) - 9), lambda i: len(list_distinct(w[i:i + 9])) <= 2)) > 0)""")
def repeat_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts too short or with ten words on end of which two at most differ."""
    return _docs(spark, sf_dir).where(tx.repeats_itself(F.col("text"))).select("doc")


@query(r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '(?s)<script>.*?</script>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS text_md5 FROM pages")
def think_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged blocks removed, script elements standing for a model's thoughts."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.without_blocks(F.col("html"), "script")).alias("text_md5"))


@query("SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[а-яёa-z0-9]+')) AS term FROM documents) GROUP BY term HAVING count(DISTINCT doc_id) >= 20")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of at least twenty documents, with document and collection frequencies."""
    t = _docs(spark, sf_dir).select("doc", F.explode(tx.tokens(F.col("text"))).alias("term")).groupBy("doc", "term").count()
    return t.groupBy("term").agg(F.count("*").alias("df"), F.sum("count").alias("cf")).where("df >= 20")


@query(r"SELECT doc_id AS doc, CAST(len(list_filter(list_transform(regexp_extract_all(text, '\d+[.,]?\d*'), lambda x: TRY_CAST(replace(x, ',', '.') AS DOUBLE)), lambda x: x > 0)) AS INTEGER) AS n FROM documents")
def numbers_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc", F.size(tx.numbers(F.col("text"))).alias("n"))


@query(r"""SELECT doc_id AS doc, CASE WHEN length(text) <= 12000 THEN 1 ELSE CAST(ceil(length(text) / 6000) AS INTEGER) END AS chunks, length(text) <= 12000 AS direct FROM documents""")
def summary_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pieces a map-reduce summary of each document takes."""
    from gridwright.functions.rules import summarise_plan

    plan = summarise_plan(F.char_length("text"))
    return _docs(spark, sf_dir).select("doc", plan["chunks"].alias("chunks"), (plan["levels"] == 1).alias("direct"))


@query(r"SELECT page_id, CASE WHEN length(html) < 1024 THEN length(html) || ' B' WHEN length(html) < 1048576 THEN printf('%.1f KB', length(html) / 1024) ELSE printf('%.1f MB', length(html) / 1048576) END AS size_label FROM pages")
def size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.size_label(F.char_length("html")).alias("size_label"))


def _cut(spark: SparkSession, sf_dir: str, mode: str, size: int, overlap: int = 0) -> DataFrame:
    cut = chunking.chunked(_docs(spark, sf_dir), mode, size, overlap, 1)
    return cut.groupBy("doc").agg(F.count("*").alias("parts"), F.sum(F.char_length("piece")).alias("chars"), F.max(F.char_length("piece")).alias("longest"))


@query()
def sentence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir, "structural", 1000)


def _first(text: str, signs: str = ".!?") -> str:
    """The first place of any of the signs, null without one."""
    return "least(" + ", ".join(f"nullif(instr({text}, '{c}'), 0)" for c in signs) + ")"


# positions are followed one cut at a time: ``at`` is where a piece begins, ``until`` where it ends
_FOLLOWED = """
WITH RECURSIVE d AS (SELECT doc_id AS doc, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
cut(doc, at_, until_) AS (
  SELECT doc, 0, {end0} FROM (SELECT d.*, 0 AS a FROM d) d
  UNION ALL
  SELECT doc, a, {end0} FROM (SELECT d.*, {next} AS a FROM cut c JOIN d ON d.doc = c.doc WHERE c.until_ < d.n) d
)
SELECT doc, count(*) AS parts, CAST(sum(length(piece)) AS BIGINT) AS chars, max(length(piece)) AS longest FROM (
  SELECT d.doc, CASE WHEN d.n <= {whole} THEN text ELSE regexp_replace(substr(text, at_ + 1, until_ - at_), '^\\s+|\\s+$', '', 'g') END AS piece FROM cut JOIN d ON cut.doc = d.doc) WHERE length(piece) > 0 GROUP BY doc"""

_FIXED_END = f"""CASE WHEN a + 1000 >= n THEN n ELSE coalesce(a + 1001 - {_first("reverse(substr(text, a + 751, 250))")}, a + 1000 + {_first("substr(text, a + 1001)")},
    a + 1001 - nullif(instr(reverse(substr(text, a + 751, 250)), ' '), 0), a + 1000 + nullif(instr(substr(text, a + 1001), ' '), 0), a + 1000) END"""
_WINDOW_END = """CASE WHEN a + 6000 >= n THEN n ELSE a + 6001 - coalesce(nullif(instr(reverse(substr(text, a + 4501, 1500)), chr(10) || chr(10)), 0),
    nullif(instr(reverse(substr(text, a + 4501, 1500)), ' .'), 0), nullif(instr(reverse(substr(text, a + 4501, 1500)), ' '), 0), 1) END"""


@query(_FOLLOWED.format(end0=_FIXED_END, next="greatest(c.until_ - 100, c.until_ - 999, c.at_ + 1)", whole=-1))
def fixed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir, "fixed", 1000, 100)


@query(_FOLLOWED.format(end0=_WINDOW_END, next="greatest(c.at_ + 3000, c.until_ - 300)", whole=6000))
def window_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir, "window", 6000, 300)


@query()
def recursive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir, "recursive", 500)


@query()
def legal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as legal texts, each second line made a numbered point."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 2 == 1, F.concat(((i + 1) / 2).cast("int").cast("string"), F.lit(". Пункт "), x)).otherwise(x))
    docs = _docs(spark, sf_dir).select("doc", F.array_join(lines, "\n").alias("text"))
    cut = chunking.legal_chunks(docs, 1500)
    return cut.groupBy("doc").agg(F.count("*").alias("parts"), F.count_distinct("article").alias("articles"), F.sum(F.char_length("piece")).alias("chars"))


@query(rf"""WITH {_LINES}, b AS (SELECT doc, pos, line, sum(CASE WHEN pos % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS block FROM lines)
SELECT doc, CAST(block AS BIGINT) AS block, length(string_agg(CASE WHEN pos % 3 = 0 THEN '### ' || (pos // 3 + 1) || ' ' ELSE '' END || line, chr(10) ORDER BY pos)) AS chars FROM b GROUP BY 1, 2""")
def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line made a heading, and the text cut at the headings."""
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("### "), ((i / 3).cast("int") + 1).cast("string"), F.lit(" "), x)).otherwise(x))
    rows = chunking.lines(_docs(spark, sf_dir).select("doc", F.array_join(marked, "\n").alias("text")))
    cut = chunking.joined(chunking.blocks(rows, F.col("line").rlike(r"^### \d+ ")), ["doc", "block"])
    return cut.select("doc", "block", F.char_length("text").cast("long").alias("chars"))


def _within_budget(levels: int) -> str:
    """SQL of summaries within a budget that need so many levels of putting together at most."""
    size = lambda t: f"CAST(ceil(length({t}) / 4) AS BIGINT)"
    ctes = [f"""p AS (SELECT doc_id AS doc, text, unnest(range(greatest((length(text) + 999) // 1000, 1))) AS part FROM documents),
q AS (SELECT doc, part, substr(text, part * 1000 + 1, 1000) AS piece FROM p),
w AS (SELECT doc, string_agg(piece, chr(10) ORDER BY part) AS t FROM q GROUP BY doc),
m1 AS (SELECT doc, part, left(piece, 200) AS s, {size('piece')} AS read, 0 AS calls, 0 AS largest FROM q JOIN w USING (doc) WHERE length(t) > 2000)"""]
    ends = [f"SELECT doc, left(t, 200) AS s, 1 AS levels, 1 AS calls, {size('t')} AS largest FROM w WHERE length(t) <= 2000"]
    for k in range(1, levels + 1):
        ctes.append(f"""
e{k} AS (SELECT doc, list(s ORDER BY part) AS l, max(calls) + count(*) AS calls, greatest(max(largest), max(read)) AS largest FROM m{k} GROUP BY doc),
h{k} AS (SELECT doc, list_transform(l, lambda x, i: '=== {'Часть' if k == 1 else 'Блок'} ' || i || '/' || len(l) || ' ===' || chr(10) || x) AS l, calls, largest FROM e{k}),
g{k} AS (SELECT *, list_reduce(list_transform(l, lambda x: {{'o': CAST([] AS BIGINT[]), 'u': {size("x || '  '")}}}),
  lambda a, x: CASE WHEN len(a.o) = 0 OR a.u + x.u > 300 THEN {{'o': list_append(a.o, coalesce(a.o[-1], -1) + 1), 'u': x.u}} ELSE {{'o': list_append(a.o, a.o[-1]), 'u': a.u + x.u}} END,
  {{'o': CAST([] AS BIGINT[]), 'u': CAST(0 AS BIGINT)}}).o AS g FROM h{k}),
u{k} AS (SELECT *, unnest(range(list_max(g) + 1)) AS part FROM g{k}),
n{k} AS (SELECT doc, part, array_to_string(list_filter(l, lambda x, i: g[i] = part), chr(10) || chr(10)) AS t, calls, largest, list_max(g) AS final FROM u{k}),
m{k + 1} AS (SELECT doc, part, left(t, 200) AS s, {size('t')} AS read, calls, largest FROM n{k} WHERE final > 0)""")
        ends.append(f"SELECT doc, left(t, 200), {k + 1}, calls + 1, greatest(largest, {size('t')}) FROM n{k} WHERE final = 0")
    return f"WITH {','.join(ctes)} SELECT doc, md5(s) AS summary_md5, CAST(levels AS INTEGER) AS levels, CAST(calls AS BIGINT) AS calls, CAST(largest AS BIGINT) AS largest FROM ({' UNION ALL '.join(ends)})"


@query(_within_budget(6))
def budget_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document summarised in calls of 300 tokens at most, with answers of 50, by the stand-in that gives a text's beginning."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.char_length("text") / 1000).cast("int") - 1, F.lit(0)))
    parts = _docs(spark, sf_dir).select("doc", F.posexplode(F.transform(starts, lambda i: F.substring("text", i * 1000 + 1, F.lit(1000)))).alias("part", "piece"))
    made = scorers.summarised_within(parts, "head", budget=300, out=50, direct=500)
    return made.select("doc", F.md5("summary").alias("summary_md5"), "levels", "calls", "largest")


@query("""
WITH s AS (SELECT source, lang, sum(length(text)) AS n FROM documents GROUP BY 1, 2),
a AS (SELECT *, CAST(least(greatest(1, (n // 4) // 33), 3000) AS BIGINT) AS piece FROM s),
b AS (SELECT *, greatest(1, CAST(ceil(n / (piece * 4)) AS BIGINT)) AS pieces FROM a),
c AS (SELECT *, CASE WHEN pieces > 33 THEN CAST(ceil(pieces / 3) AS BIGINT) ELSE 0 END AS blocks FROM b),
d AS (SELECT *, greatest(piece + 800, greatest(CASE WHEN pieces > 33 THEN blocks ELSE pieces END * 600 + 1000, piece + 800) + 4000) AS need FROM c)
SELECT source, lang, piece * 4 AS piece_chars, pieces, CAST(CASE WHEN pieces > 33 THEN 3 ELSE 2 END AS INTEGER) AS levels, blocks, CAST((need + 999) // 1000 * 1000 AS BIGINT) AS context,
  round((pieces * 35 + blocks * 60 + 300) / 60, 1) AS minutes FROM d""")
def context_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a summary of all the texts of each source and language would take."""
    n = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.sum(F.char_length("text")).alias("n"))
    return n.select("source", "lang", rules.context_plan(F.col("n")).alias("p")).select("source", "lang", "p.*")
