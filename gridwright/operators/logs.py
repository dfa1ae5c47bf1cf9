"""Append-only logs: latest versions, deletions, votes, ratings, search, running figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: list[str], order: Column, deleted: Column | None = None) -> DataFrame:
    """The last version of each key; keys whose last version is a deletion are gone. ``max_by`` pre-aggregates."""
    cols = [c for c in log.columns if c not in key]
    flagged = log.withColumn("_gone", deleted if deleted is not None else F.lit(False))
    last = flagged.groupBy(*key).agg(F.max_by(F.struct(*cols, "_gone"), order).alias("r"))
    return last.where(~F.col("r._gone")).select(*key, *[F.col(f"r.{c}").alias(c) for c in cols])


def first_of(rows: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def majority(votes: DataFrame) -> DataFrame:
    """``votes(file, decision, pos, quote)`` -> each file's most frequent decision (the one seen first on ties), its first quote, and the counts."""
    by = votes.groupBy("file", "decision").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.min_by("quote", "pos").alias("quote"))
    return by.groupBy("file").agg(
        F.max_by(F.struct("decision", "quote"), F.struct("n", -F.col("first"))).alias("w"), F.sum("n").alias("chunks"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("decision", "n")))).alias("counts"),
    ).select("file", F.col("w.decision").alias("decision"), F.col("w.quote").alias("quote"), "chunks", "counts")


def runs(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Lengths of the runs of equal values of each key, in order: ``(key, run, value, length)``."""
    w = Window.partitionBy(key).orderBy(*order)
    fresh = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    numbered = events.withColumn("run", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "run").agg(F.first(value).alias(value), F.count("*").alias("length"))


def ratings(rated: DataFrame, comment_chars: int = 20, stock: list[str] | None = None) -> DataFrame:
    """``rated(rating, comment)`` -> counts by rating 1 to 5, their mean, and how many left a comment of their own."""
    own = (F.char_length(F.trim("comment")) > comment_chars) & ~F.trim("comment").isin(stock or [])
    counts = [F.count_if(F.col("rating") == r).alias(f"rating_{r}") for r in range(1, 6)]
    return rated.agg(F.count("*").alias("total"), *counts, F.round(F.avg("rating"), 2).alias("mean_rating"), F.count_if(own).alias("with_comment"))


def upserted(store: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``store`` with the rows of ``new``, which replace those of equal keys."""
    return store.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def without(store: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return store.join(gone.select(*key).distinct(), key, "left_anti")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """The page of so many rows, counted from 1."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def amended(lines: DataFrame, updates: DataFrame, field: str, key: str = "id") -> DataFrame:
    """``lines(line)`` of a JSON-lines log with ``field`` set in the records that ``updates(key, value)`` names, the rest of each record kept.

    Lines that are no JSON object, or that no update names, come back as they are, to the letter; blank ones are left out.
    A null value takes the field away. Several updates of one key: the last in the order of their values as JSON.
    """
    value = F.max(F.to_json(F.struct("value"))).alias("json")
    last = updates.where("key is not null").groupBy(F.col("key").cast("string").alias("key")).agg(value)
    parsed = lines.where(F.trim("line") != "").withColumns({"_v": F.try_parse_json("line"), "_k": F.get_json_object("line", f"$.{key}")})
    met = parsed.join(last, parsed._k == last.key, "left")
    others = F.map_filter(F.try_variant_get("_v", "$", "map<string,variant>"), lambda k, _: k != field)
    new = F.try_variant_get(F.parse_json("json"), "$.value", "variant")
    record = F.when(new.isNull(), others).otherwise(F.map_concat(others, F.create_map(F.lit(field), new)))
    return met.select(F.when(F.col("json").isNotNull() & others.isNotNull(), F.to_json(record)).otherwise(F.col("line")).alias("line"))


def unlisted(lines: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """``lines(line)`` without the records whose key is in ``gone(key)``; malformed lines stay."""
    named = lines.withColumn("_k", F.get_json_object("line", f"$.{key}"))
    ids = gone.select(F.col("key").cast("string").alias("key")).where("key is not null").distinct()
    return named.join(ids, named._k == ids.key, "left_anti").select("line")
