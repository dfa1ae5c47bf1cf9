"""A kept inverted index: ranked, skipping and positional search that never reads the texts.

What is kept for a corpus lies in a folder of its version, a hash of all ids and texts: ``postings`` in segments, by bucket
of the term's hash and sorted by term, so that a search reads the row groups of its terms only; ``terms`` with document
counts and what bounds a term's score; and a row of totals, written last. Texts that change give another version, so a
stale index is never read. Documents that are new to an index become a segment more of the next version.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwright.functions.text import tokens
from gridwright.sources.scratch import keep, shared_dir

K1, B, FLOOR = 1.5, 0.75, 0.25
BUCKETS, SLOTS = 16, 4  # folders of a segment, and parts at least that a folder's documents are dealt to, so that a frequent word's postings are split
SORTED_BYTES = 4 << 20  # of texts whose postings a task sorts, about
FORMAT = 2  # of what is written: an index of another one is not read
PUSHED = 2_000  # terms that are pushed into the scan by name; beyond them the join alone selects
SLACK = 1e-5  # scores are ranked by six digits, so what is this close below the k-th is not skipped
_POSTING = "term string, id {id}, row long, dl int, tf int, places array<int>"


def version_of(docs: DataFrame) -> DataFrame:
    """One row ``(n, version)`` that changes with any id or text: the key under which an index is kept."""
    hashed = docs.select(F.xxhash64("id", "text").alias("h")).select("h", F.xxhash64("h").alias("g"))
    sums = [F.coalesce(F.sum(F.pmod(c, F.lit(1 << 40))), F.lit(0)) for c in ("h", "g")]
    return hashed.agg(F.count("*").alias("n"), F.concat_ws("-", *[F.hex(s) for s in sums]).alias("version"))


def bucket(term: Column) -> Column:
    return (F.crc32(term) % BUCKETS).cast("int")


def _share(tf: Column, dl: Column, mean: float) -> Column:
    """The part of BM25 that grows with a term's count and falls with the document's length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def _path(docs: DataFrame, version: str) -> str:
    return f"{shared_dir(docs.sparkSession)}/gridwright/search-{FORMAT}/{docs.schema['id'].dataType.simpleString()}-{version}"


class SearchIndex:
    """An index that is there. ``of`` opens or builds the one of a corpus ``docs(id, text)``, ``extended`` that of a grown one.

    Null texts are empty. Rows of one id are found as one, with the sum of their scores. A corpus without rows or words
    finds nothing; queries without words, or with words that no text has, neither.
    """

    def __init__(self, spark: SparkSession, path: str, n: int, words: int, mean_idf: float, segments: list[str], id_type: str, built: bool):
        self.spark, self.path, self.n, self.words, self.mean_idf, self.segments, self.built = spark, path, n, words, mean_idf, segments, built
        self.id_type, self.mean_length = id_type, words / n if n and words else 1.0

    # Opening and building

    @staticmethod
    def of(docs: DataFrame) -> SearchIndex:
        """The index of these texts: the kept one, or a new one. Without texts that changed, one scan that only hashes."""
        v = version_of(docs.select("id", "text")).first()
        path = _path(docs, f"{v.n}-{v.version}")
        return _opened(docs, path) or _built(docs, path, v.n, None)

    def extended(self, docs: DataFrame) -> SearchIndex:
        """The index of ``docs``, all of a corpus that has grown: only new documents are tokenised. If one is gone or changed, all are."""
        v = version_of(docs.select("id", "text")).first()
        path = _path(docs, f"{v.n}-{v.version}")
        found = _opened(docs, path)
        if found:
            return found
        known = self.spark.read.parquet(f"{self.path}/docs")
        now = docs.select("id", "text", F.xxhash64("id", "text").alias("h"))
        # Counts of (id, hash): repeated rows are told apart by how often they are there.
        a, b = now.groupBy("id", "h").agg(F.count("*").alias("now")), known.groupBy("id", "h").agg(F.count("*").alias("then"))
        both = a.join(b, a.id.eqNullSafe(b.id) & (a.h == b.h), "full").select(F.coalesce(a.h, b.h).alias("h"), F.coalesce("now", F.lit(0)).alias("now"), F.coalesce("then", F.lit(0)).alias("then"))
        if both.where("then <> 0 and then <> now").limit(1).count():
            return _built(docs, path, v.n, None)
        return _built(now.join(known.select("h").distinct(), "h", "left_anti"), path, v.n, self)

    def postings(self) -> DataFrame:
        """``(term, id, row, dl, tf, places, bucket, segment)``; ``segment`` and ``row`` tell texts of one id apart."""
        parts = [self.spark.read.schema(f"{_POSTING.format(id=self.id_type)}, bucket int").parquet(f"{s}/postings").withColumn("segment", F.lit(i)) for i, s in enumerate(self.segments)]
        return functools.reduce(DataFrame.unionByName, parts)

    def terms(self) -> DataFrame:
        """``(term, df, tf_most, dl_least)``: what a term's weight and the bound of its score follow from."""
        return self.spark.read.schema("term string, df long, tf_most int, dl_least int, bucket int").parquet(f"{self.path}/terms")

    # Searching

    def _asked(self, queries: DataFrame) -> tuple[DataFrame, list[str] | None]:
        """``(query, term, w, most)`` of the terms that the corpus has, and their names if they are few enough to be pushed down.

        ``w`` is how often a query has the term times its idf, a negative one replaced by FLOOR times the vocabulary's mean.
        """
        own = queries.select("query", F.explode(tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
        rows = own.limit(PUSHED + 1).collect()
        few = sorted({r.term for r in rows}) if len(rows) <= PUSHED else None
        own = self.spark.createDataFrame(rows, own.schema) if few is not None else own
        raw = F.log(self.n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        idf = F.when(raw >= 0, raw).otherwise(F.lit(FLOOR * self.mean_idf))
        known = _named(self.terms(), few).select("term", "df", idf.alias("idf"), _share(F.col("tf_most"), F.col("dl_least"), self.mean_length).alias("share"))
        out = own.join(known, "term").select("query", "term", "df", (F.col("times") * F.col("idf")).alias("w"), (F.col("times") * F.col("idf") * F.col("share")).alias("most"))
        return self._held(out, few, "weights"), few

    def _held(self, rows: DataFrame, few: list[str] | None, what: str) -> DataFrame:
        """Rows of which there is one for each query and term at most, worked out once: here if these are few, else in a table."""
        return keep(rows, what) if few is None else F.broadcast(self.spark.createDataFrame(rows.collect(), rows.schema))

    def _parts(self, asked: DataFrame, names: list[str] | None) -> DataFrame:
        share = _share(F.col("tf"), F.col("dl"), self.mean_length)
        return _named(self.postings(), names).select("term", "id", share.alias("share")).join(asked, "term").select("query", "id", (F.col("w") * F.col("share")).alias("part"))

    def scores(self, queries: DataFrame) -> DataFrame:
        """``queries(query, text)`` -> ``(query, id, score)`` of every document with a BM25 score other than 0, for any number of queries."""
        asked, names = self._asked(queries)
        return self._parts(asked.select("query", "term", "w"), names).groupBy("query", "id").agg(F.sum("part").alias("score")).where("score <> 0")

    def candidates(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, list[str] | None]:
        """(weights, ``(query, id)`` that may be among the k best, names): what ``top`` scores.

        Seeds are a query's rarest terms, until they have 4 k documents together; the k-th best score by seeds alone is a
        floor under the k-th best. A query's terms are needed while what the rest can add at most reaches the floor;
        documents without a needed term can't, nor can those whose needed terms and all the rest's most don't.
        """
        asked, names = self._asked(queries)
        rare = Window.partitionBy("query").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
        seeds = asked.withColumn("before", F.coalesce(F.sum("df").over(rare), F.lit(0))).where(F.col("before") < 4 * k)
        by_seed = self._parts(seeds.select("query", "term", "w"), names).groupBy("query", "id").agg(F.sum("part").alias("score"))
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        floor = by_seed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).where(F.col("r") == k).select("query", (F.col("score") - SLACK).alias("floor"))
        # A negative weight (the vocabulary's mean idf is negative in tiny corpora) leaves no floor.
        sound = asked.groupBy("query").agg(F.min("w").alias("least")).where("least >= 0").select("query")
        floor = self._held(floor.join(sound, "query"), names, "floors")
        upward = Window.partitionBy("query").orderBy("most", F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        marked = asked.join(floor, "query", "left").withColumn("reach", F.sum("most").over(upward))
        marked = marked.withColumn("needed", F.col("floor").isNull() | (F.col("reach") >= F.col("floor")))
        rest = marked.groupBy("query").agg(F.first("floor").alias("floor"), F.coalesce(F.sum(F.when(~F.col("needed"), F.col("most"))), F.lit(0.0)).alias("rest"))
        by_needed = self._parts(marked.where("needed").select("query", "term", "w"), names).groupBy("query", "id").agg(F.sum("part").alias("score"))
        able = by_needed.join(rest, "query").where("floor is null or score + rest >= floor").select("query", "id")
        return asked, able, names

    def top(self, queries: DataFrame, k: int) -> DataFrame:
        """The k best of each query, ``(query, id, score, rank)`` from rank 0, ties of six digits to the smaller id; exact."""
        asked, able, names = self.candidates(queries, k)
        parts = self._parts(asked.select("query", "term", "w"), names)
        fit = parts.join(able, parts.query.eqNullSafe(able.query) & parts.id.eqNullSafe(able.id), "left_semi")
        scored = fit.groupBy("query", "id").agg(F.sum("part").alias("score")).where("score <> 0")
        order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 6)), F.asc("id"))
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)

    def phrases(self, phrases: DataFrame) -> DataFrame:
        """``phrases(query, text)`` -> ``(query, id, hits, first)``: how often a text has the words of a phrase one behind the other, and at which token first.

        A join of places: a phrase's i-th word at place p means a begin at p - i, and a begin that all words agree on is a hit.
        """
        words = keep(phrases.select("query", F.posexplode(tokens(F.coalesce("text", F.lit("")))).alias("i", "term")), "phrases")
        names = [r.term for r in words.select("term").distinct().limit(PUSHED + 1).collect()]
        size = words.groupBy("query").agg(F.count("*").alias("size"))
        at = _named(self.postings(), names if len(names) <= PUSHED else None).select("term", "id", "segment", "row", "places").join(words, "term")
        text = ["query", "id", "segment", "row"]
        begins = at.select(*text, F.explode(F.transform("places", lambda p: p - F.col("i"))).alias("begin")).groupBy(*text, "begin").agg(F.count("*").alias("n"))
        return begins.join(size, "query").where("n = size").groupBy("query", "id").agg(F.count("*").alias("hits"), F.min("begin").alias("first"))


def _named(rows: DataFrame, names: list[str] | None) -> DataFrame:
    """Rows of these terms only, by bucket (folders) and by name (row groups)."""
    if names is None:
        return rows
    buckets = sorted({r[0] for r in rows.sparkSession.createDataFrame([(x,) for x in names], "t string").select(bucket(F.col("t"))).collect()}) if names else []
    return rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(names)) if names else rows.limit(0)


def _opened(docs: DataFrame, path: str) -> SearchIndex | None:
    try:
        r = docs.sparkSession.read.schema("n long, words long, mean_idf double, segments array<string>").parquet(f"{path}/totals").first()
    except AnalysisException:
        return None
    return SearchIndex(docs.sparkSession, path, r.n, r.words, r.mean_idf, list(r.segments), docs.schema["id"].dataType.simpleString(), False) if r else None


def _by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(row, id, t)`` with a text's tokens -> a row for each text and bucket: its terms, their counts, and the places of all one behind the other.

    Tokens are sorted by text, bucket and term in columns, never one by one.
    """
    for whole in batches:
        for a in range(0, whole.num_rows, 512):
            row, id_, t = whole.slice(a, 512).columns
            n, coded = t.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), t.flatten().dictionary_encode()
            text = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            buckets = np.array([zlib.crc32(w.encode()) % BUCKETS for w in coded.dictionary.to_pylist()], np.int64)
            group = text * BUCKETS + buckets[codes]
            order = np.lexsort([codes, group])  # stable, so places stay in order
            g, c = group[order], codes[order]
            rows = np.flatnonzero(np.diff(g, prepend=-1))  # first tokens of a text and bucket
            terms = np.flatnonzero((np.diff(g, prepend=-1) != 0) | (np.diff(c, prepend=-1) != 0))  # and of a term in it
            cut = np.append(np.searchsorted(terms, rows), len(terms))
            lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
            of = g[rows] // BUCKETS
            begins = terms - np.repeat(rows, np.diff(cut))
            yield pa.RecordBatch.from_arrays([
                pa.array(g[rows] % BUCKETS, pa.int32()), id_.take(pa.array(of)), row.take(pa.array(of)), pa.array(n[of], pa.int32()), lists(cut, coded.dictionary.take(pa.array(c[terms]))),
                lists(cut, pa.array(np.diff(np.append(terms, len(g))), pa.int32())), lists(cut, pa.array(begins, pa.int32())), lists(np.append(rows, len(g)), pa.array(place[order], pa.int32())),
            ], ["bucket", "id", "row", "dl", "terms", "tfs", "begins", "flat"])


def _slots(size: int) -> int:
    """Parts that a bucket's documents are dealt to, by all texts' bytes."""
    return max(SLOTS, -(-size // (SORTED_BYTES * BUCKETS)))


def _built(docs: DataFrame, path: str, n: int, before: SearchIndex | None) -> SearchIndex:
    """Write the segment of ``docs``, all there are or those new since ``before``, then terms, then totals."""
    spark, id_type = docs.sparkSession, docs.schema["id"].dataType.simpleString()
    segment = f"{path}/segment-{uuid.uuid4().hex}"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "id", tokens(F.coalesce("text", F.lit(""))).alias("t"))
    packed = rows.mapInArrow(_by_term, f"bucket int, id {id_type}, row long, dl int, terms array<string>, tfs array<int>, begins array<int>, flat array<int>")
    slots = _slots(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    # The only shuffle: a row for each document and bucket. Parts are as many as the texts need, so that what a task sorts doesn't grow with them.
    dealt = packed.repartition(BUCKETS * slots, "bucket", F.pmod(F.xxhash64("row"), F.lit(slots)))
    each = dealt.select("bucket", "id", "row", "dl", "flat", F.explode(F.arrays_zip("terms", "tfs", "begins")).alias("x"))
    posting = each.select(F.col("x.terms").alias("term"), "id", "row", "dl", F.col("x.tfs").alias("tf"), F.slice("flat", F.col("x.begins") + 1, F.col("x.tfs")).alias("places"), "bucket")
    posting.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{segment}/postings")
    docs.select("id", F.xxhash64("id", "text").alias("h")).write.parquet(f"{segment}/docs")
    segments = [*(before.segments if before else []), segment]
    kept = SearchIndex(spark, path, n, 0, 0.0, segments, id_type, True)
    new = spark.read.schema(f"{_POSTING.format(id=id_type)}, bucket int").parquet(f"{segment}/postings").groupBy("term").agg(F.count("*").alias("df"), F.max("tf").alias("tf_most"), F.min("dl").alias("dl_least"))
    if before:
        new = new.unionByName(before.terms().drop("bucket")).groupBy("term").agg(F.sum("df").alias("df"), F.max("tf_most").alias("tf_most"), F.min("dl_least").alias("dl_least"))
    terms = new.withColumn("bucket", bucket(F.col("term")))
    terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    spark.read.parquet(*[f"{s}/docs" for s in segments]).write.mode("overwrite").parquet(f"{path}/docs")
    raw = F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = kept.terms().agg(F.coalesce(F.avg(raw), F.lit(0.0)).alias("mean")).first().mean
    words = kept.postings().agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words")).first().words
    spark.createDataFrame([(n, words, mean, segments)], "n long, words long, mean_idf double, segments array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
    return SearchIndex(spark, path, n, words, mean, segments, id_type, True)


def shown(found: DataFrame, phrases: DataFrame, docs: DataFrame, before: int = 100, behind: int = 200) -> DataFrame:
    """``found(query, id, …)`` of ``SearchIndex.phrases`` with ``context``: the text about the first hit, the hit upper-cased; only found texts are read."""
    gap = "[^а-яёa-z0-9]+"
    asked = phrases.select("query", F.concat(F.lit("(?iu)(?<![а-яёa-z0-9])"), F.array_join(tokens(F.col("text")), gap), F.lit("(?![а-яёa-z0-9])")).alias("pattern"))
    rows = found.join(asked, "query").join(docs.select("id", "text"), "id")
    at, hit = F.regexp_instr("text", F.col("pattern")), F.call_function("regexp_extract", F.col("text"), F.col("pattern"), F.lit(0))
    rows = rows.withColumns({"at": at, "hit": hit})
    start = F.greatest(F.col("at") - before, F.lit(1))
    context = F.concat(F.substr("text", start, F.col("at") - start), F.upper("hit"), F.substr("text", F.col("at") + F.char_length("hit"), F.lit(behind)))
    return rows.withColumn("context", context).drop("pattern", "at", "hit", "text")
