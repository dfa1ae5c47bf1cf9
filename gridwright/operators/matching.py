"""Documents and files for each article: by keywords, else by vectors, the best few."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.operators.retrieval import top

FLOOR, BEST = 0.60, 3
GRAM = 4  # characters that a text and a keyword must share first: no keyword has fewer
FEW = 100_000  # keywords that are broadcast at most
ARTICLES, DOCUMENTS = 1024, 4096  # rows of a block
# Words of articles' names that tell nothing about documents.
COMMON_WORDS = ["расходы", "затраты", "оплата", "труда", "итого", "прочие", "всего", "общие", "иные", "прочих"]


def keywords(name: Column) -> Column:
    """Words of more than three characters that are not common to all articles, lower-cased."""
    return F.filter(F.split(F.lower(name), r"(?U)\W+"), lambda w: (F.char_length(w) > 3) & ~w.isin(COMMON_WORDS))


def _by_keyword(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """``(claim, article, doc)`` of documents that have a keyword in their text: they share its first characters, and then it is looked for."""
    words = asked.select("claim", "article", F.explode(F.array_distinct("keys")).alias("key")).withColumn("gram", F.left("key", F.lit(GRAM)))
    words = F.broadcast(words) if words.limit(FEW + 1).count() <= FEW else words
    grams = F.regexp_extract_all(F.col("text"), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
    may = documents.select("claim", "doc", F.explode(F.array_distinct(grams)).alias("gram")).join(words, ["claim", "gram"])
    may = may.groupBy("claim", "doc").agg(F.collect_set(F.struct("article", "key")).alias("may"))  # keywords of one claim's articles
    held = documents.join(may, ["claim", "doc"]).select("claim", "doc", F.explode(F.filter("may", lambda m: F.col("text").contains(m["key"]))).alias("m"))
    return held.select("claim", F.col("m.article").alias("article"), "doc")


def _vectors(column: pa.ChunkedArray, d: int) -> np.ndarray:
    """Rows of length 1; vectors that are missing, of another width or with missing entries are zero."""
    rows = np.zeros((len(column), d))
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == d and None not in v:
            rows[i] = v
    norm = np.linalg.norm(rows, axis=1)
    return rows / np.where(norm > 0, norm, 1.0)[:, None]


def _nearest(floor: float, k: int):
    """The k documents of a block that are most similar to each article of a block, from ``floor`` on, ties to the lesser document."""

    def run(articles: pa.Table, documents: pa.Table) -> pa.Table:
        claim, article, doc, scores = [], [], [], []
        if articles.num_rows and documents.num_rows:
            documents = documents.take(pa.compute.sort_indices(documents["doc"]))
            code = documents["doc"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            width = np.array([len(v) if v is not None else 0 for v in articles["v"].to_pylist()])
            for d in np.unique(width):
                own = np.flatnonzero(width == d)
                near = _vectors(articles["v"].take(pa.array(own)), d) @ _vectors(documents["w"], d).T
                near = np.floor(np.maximum.reduceat(near, begins, axis=1) * 1000 + 0.5) / 1000
                for i, row in zip(own.tolist(), near):
                    at = np.arange(len(row)) if len(row) <= k else np.flatnonzero(row >= np.partition(row, -k)[-k])
                    at = at[row[at] >= floor]
                    at = at[np.argsort(-row[at], kind="stable")][:k]
                    article += [i] * len(at)
                    doc += begins[at].tolist()
                    scores += row[at].tolist()
        own, found = pa.array(article, pa.int64()), pa.array(doc, pa.int64())
        return pa.table([articles["claim"].take(own), articles["article"].take(own), documents["doc"].take(found), pa.array(scores, pa.float64())], names=["claim", "article", "doc", "similarity"])

    return run


def _by_vector(asked: DataFrame, documents: DataFrame, floor: float, k: int) -> DataFrame:
    """``(claim, article, doc, similarity)`` by cosine, k of each block at most: a claim's articles and documents meet in blocks of bounded size."""
    n = lambda rows, size, name: rows.groupBy("claim").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    blocks = n(asked, ARTICLES, "blocks").join(n(documents, DOCUMENTS, "parts"), "claim")
    deal = lambda key, of: F.pmod(F.xxhash64(key), F.col(of)).cast("int")
    spread = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = asked.join(blocks, "claim").select("claim", deal("article", "blocks").alias("block"), spread("parts").alias("part"), "article", "v")
    right = documents.join(blocks, "claim").select("claim", spread("blocks").alias("block"), deal("doc", "parts").alias("part"), "doc", "w")
    kinds = dict(asked.dtypes) | dict(documents.dtypes)
    by = ["claim", "block", "part"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_nearest(floor, k), f"claim {kinds['claim']}, article {kinds['article']}, doc {kinds['doc']}, similarity double")


def matched(articles: DataFrame, documents: DataFrame, floor: float = FLOOR, best: int = BEST) -> DataFrame:
    """``articles(claim, article, name, v)``, ``documents(claim, doc, text, w)`` -> ``(claim, article, doc, similarity, rank)``.

    A document that has one of the article's keywords in its text, in either case, has similarity 1, another one the
    cosine of the vectors (missing ones, ones of another width or length 0: 0), rounded to three digits. Those of
    ``floor`` or more count, the ``best`` of an article by similarity, then by document. Articles meet the documents of
    their own claim only. Rows of one claim and article, or of one claim and document, are one: any text, the most
    similar vector.

    An article's ``best`` are among those with a keyword and as many and ``best - 1`` others by vector: fewer than
    ``best`` with a keyword can be among the latter, else vectors don't matter.
    """
    asked = articles.select("claim", "article", keywords(F.col("name")).alias("keys"), "v")
    kept = documents.select("claim", "doc", F.lower("text").alias("text"), "w")
    lexical = _by_keyword(asked, kept).withColumn("similarity", F.lit(1.0)).where(F.lit(floor <= 1.0))
    vectors = _by_vector(asked, kept, floor, 2 * best - 1)
    scored = lexical.unionByName(vectors).groupBy("claim", "article", "doc").agg(F.max("similarity").alias("similarity"))
    return top(scored, best, ["claim", "article"], [F.desc("similarity"), F.asc("doc")])


def matched_files(articles: DataFrame, files: DataFrame, score: Column, floor: float = FLOOR, best: int = BEST) -> DataFrame:
    """As ``matched``, over the heads of files; where an article has several candidates they are ordered anew by ``score``, an
    expression over ``name`` and ``text``."""
    found = matched(articles, files, floor, best).drop("rank")
    both = found.join(articles.select("claim", "article", "name"), ["claim", "article"]).join(files.select("claim", "doc", "text"), ["claim", "doc"])
    scored = both.select("claim", "article", "doc", "similarity", score.alias("rerank_score"))
    return top(scored, best, ["claim", "article"], [F.desc("rerank_score"), F.desc("similarity"), F.asc("doc")])


def heads(pages: DataFrame, n_pages: int = 2, chars: int = 1500, files: int = 100) -> DataFrame:
    """``pages(doc, page, text)`` -> ``(doc, text)``: the first characters of the first pages of the first files by name; this is what is asked for, not a sample."""
    first = pages.where(F.col("page") <= n_pages).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return first.select("doc", F.left(F.array_join(F.transform("p", lambda x: x["text"]), "\n"), F.lit(chars)).alias("text")).orderBy("doc").limit(files)
