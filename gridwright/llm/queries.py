"""The corpus operators applied to the whole driver tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm import decontamination, pii, secrets, toxicity
from gridwright.llm.common import table
from gridwright.llm.divergence import source_divergence
from gridwright.llm.line_dedup import dedup_lines
from gridwright.llm.lm import lm_scores
from gridwright.llm.mixing import Mix
from gridwright.llm.ngram_join import ngram_jaccard_components
from gridwright.llm.sharding import shard
from gridwright.llm.topk import top_k
from gridwright.llm.urls import judge
from gridwright.llm.whitening import whitened

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query()
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document at 3-word shingles and similarity 0.9."""
    return ngram_jaccard_components(table(spark, sf_dir, "documents"), k=3, similarity="0.9")


@query()
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base kinds and what their contexts discover."""
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


@query(
    r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.line, k.pos, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key AND length(k.key) >= 40
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 40 characters that at least 5 documents share stay in the largest doc_id only."""
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base kinds and random-looking tokens."""
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.find_secrets(docs, secrets.train(secrets.with_random(secrets.labelled(docs)))))


@query()
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose bytes are as equal as groups of equal texts allow."""
    done = shard(table(spark, sf_dir, "documents"), 24)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query()
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by weights 1, 2, 3 takes of each document."""
    rows = Mix(table(spark, sf_dir, "documents")).rows
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


#: The rules that the query is given.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query()
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL: the longest rule's, else that of trees trained on the URLs that rules judge."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "blocked_share")


@query(
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
)
def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 vectors with the highest integer inner product with each whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from the labels outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    scored = model.score(docs.select("doc_id", "text"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query()
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, each with its best window."""
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document by word counts and by a recurrent network, learnt outside the held-out seventh."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


@query(
    r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), t AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), counts AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT DISTINCT lang, source FROM d
), totals AS (
  SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0)::HUGEINT + 2 * (SELECT count(*) FROM kept k WHERE k.lang = g.lang) AS n FROM groups g
), whole AS (
  SELECT lang, sum(n)::HUGEINT + 2 * count(*) AS n FROM kept GROUP BY lang
), p AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // t.n AS p, 1 + 1000000000 * (k.n + 2) // w.n AS q
  FROM totals t JOIN kept k USING (lang) JOIN whole w USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every
QUALIFY part = 'pair' OR rank <= 10"""
)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each two sources of a language lie apart in their terms, and each source's most telling terms."""
    return source_divergence(table(spark, sf_dir, "documents"))


@query()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's first four whitened components, by covariances from exact variances of dimensions and their sums."""
    done = whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return done.withColumn("deviation", F.col("deviation").try_cast("long"))
