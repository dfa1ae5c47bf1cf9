"""The knowledge base behind questions: its chunks, postings, FAQ and cached answers, and the prompts over it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.text import tokens
from gridwright.operators import logs, scorers
from gridwright.operators.chunking import chunked

TTL = 604_800  # seconds that an answer is good for


def fresh(cache: DataFrame, now: Column, seconds: int = TTL) -> DataFrame:
    """``cache(key, answer, at)`` less the answers that are too old."""
    return cache.where(F.unix_timestamp(now) - F.unix_timestamp("at") <= seconds)


def prefixed(text: Column, kind: str) -> Column:
    """A text as an embedding model wants it: marked as a query or a passage."""
    return F.concat(F.lit({"query": "query: ", "passage": "passage: "}[kind]), F.coalesce(text, F.lit("")))


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """Stands in for an embedding: counts of tokens by hash, of length 1, so that texts with the same words are near each other."""
    place = F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(place, lambda p: p == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(counts, lambda x: x / norm)).otherwise(counts)


def faq_texts(faq: DataFrame) -> DataFrame:
    """``faq(id, question, variations, …)`` with the ``entry_text`` that is searched: the question and its variations."""
    return faq.withColumn("entry_text", F.concat_ws(" ", "question", F.array_join(F.coalesce("variations", F.array().cast("array<string>")), " ")))


def faq_added(faq: DataFrame, question: str, answer: str) -> DataFrame:
    """``faq(id, question, answer)`` with an entry more, numbered after the highest ``faq_N``."""
    number = F.coalesce(F.max(F.regexp_extract("id", r"^faq_(\d+)$", 1).try_cast("int")), F.lit(0)) + 1
    new = faq.agg(F.concat(F.lit("faq_"), F.lpad(number.cast("string"), 3, "0")).alias("id")).withColumns({"question": F.lit(question), "answer": F.lit(answer)})
    return faq.select("id", "question", "answer").unionByName(new)


def sampled(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows in random order, the same for the same seed and rows: the n smallest of a seeded hash of the whole row."""
    return rows.withColumn("_h", F.xxhash64(F.lit(seed), F.to_json(F.struct(*rows.columns)))).orderBy("_h", *rows.columns).limit(n).drop("_h")


def tagged_with(files: DataFrame, wanted: str) -> DataFrame:
    """``files(category, name, tags)`` that have a part in their name or in any tag, in either case."""
    low = wanted.lower()
    return files.where(F.lower("name").contains(low) | F.exists("tags", lambda t: F.lower(t).contains(low)))


def collection(files: DataFrame, excluded: DataFrame, name: str, mode: str = "structural", size: int = 1000, overlap: int = 0, separator: str = "&&") -> DataFrame:
    """``files(doc, text)`` but the excluded ``(doc)`` as ``(collection, doc, idx, text)``: what replaces the collection's partition.

    Parts are numbered gaplessly in their order, and a document without a part is not in the collection.
    """
    cut = chunked(logs.without(files, excluded, ["doc"]).select("doc", "text"), mode, size, overlap, separator=separator)
    per_doc = cut.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("part", "piece"))).alias("p"))
    return per_doc.select(F.lit(name).alias("collection"), "doc", F.posexplode("p").alias("idx", "x")).select("collection", "doc", "idx", F.col("x.piece").alias("text"))


DOCUMENTS = "documents array<struct<name:string,number:string,articles:string,details:string>>"


def inventory(answers: DataFrame) -> DataFrame:
    """``answers(file, pos, answer)`` -> ``(file, name, number, articles, details)``: the documents that answers list as JSON, each name once a file, the first."""
    each = answers.select("file", "pos", F.posexplode(scorers.json_answer(F.col("answer"), DOCUMENTS)["documents"]).alias("i", "d")).select("file", "pos", "i", "d.*")
    named = each.where(F.trim(F.coalesce("name", F.lit(""))) != "")
    return logs.first_of(named, [F.col("file"), F.lower(F.trim("name"))], [F.col("pos"), F.col("i")]).select("file", "name", "number", "articles", "details")


def batches(files: DataFrame, size: int = 10) -> DataFrame:
    """``files(claim, file, text)`` -> ``(claim, batch, files, prompt)``: so many files in a prompt, numbered as the answer must number them."""
    listed = files.groupBy("claim").agg(F.array_sort(F.collect_list(F.struct("file", "text"))).alias("f"))
    cut = listed.select("claim", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("f") - 1) / size).cast("int")), lambda i: F.slice("f", i * size + 1, size))).alias("batch", "f"))
    body = F.array_join(F.transform("f", lambda x, i: F.concat(F.lit("Документ "), (i + 1).cast("string"), F.lit(" ("), x["file"], F.lit("):\n"), F.coalesce(x["text"], F.lit("")))), "\n\n")
    return cut.select("claim", "batch", F.transform("f", lambda x: x["file"]).alias("files"), body.alias("prompt"))


def claim_summary(heads: DataFrame, groups: DataFrame, model: Callable[[Column], Column]) -> DataFrame:
    """``heads(claim, file, text)``, ``groups(claim, category, articles, total)`` -> ``(claim, summary)`` by a scorer over both."""
    files = heads.groupBy("claim").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "text"))), lambda x: F.concat(x["file"], F.lit(": "), F.coalesce(x["text"], F.lit("")))), "\n").alias("files"))
    sums = groups.groupBy("claim").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", "articles", "total"))), lambda x: F.concat(x["category"], F.lit(" "), x["articles"].cast("string"), F.lit(" "), x["total"].cast("string"))), "\n").alias("sums"))
    both = files.join(sums, "claim", "full")
    return both.select("claim", model(F.concat_ws("\n\n", "files", "sums")).alias("summary"))


def position(question: Column, context: Column, model: Callable[[Column], Column], most: int = 12_000) -> Column:
    """An answer on courts' or a regulator's position, from the first ``most`` characters of a given context; null without one."""
    asked = scorers.prompt("Вопрос: {q}\nМатериалы:\n{c}", q=question, c=F.left(context, F.lit(most)))
    return F.when(F.coalesce(F.trim(context), F.lit("")) != "", model(asked))
