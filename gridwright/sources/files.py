"""Readers: tables, folders of texts in unknown encodings, logs, forms."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def listed(spark: SparkSession, folder: str, extensions: list[str], recursive: bool = True) -> DataFrame:
    """``(path, name, extension, length, modified)`` of files with an allowed extension, none of whose folders begins with 0 or _."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    below = F.split(F.substring_index("path", folder.rstrip("/") + "/", -1), "/")
    named = found.select("path", F.element_at(below, -1).alias("name"), F.lower(F.element_at(F.split("path", r"\."), -1)).alias("extension"), "length", F.col("modificationTime").alias("modified"), below.alias("below"))
    return named.where(F.col("extension").isin(extensions) & ~F.exists("below", lambda p: p.rlike("^[0_]"))).drop("below")


_HIGH = bytes(range(128, 256))
_BYTES, _LETTERS = _HIGH.decode("latin-1"), _HIGH.decode("cp1251", "replace")


def _cyrillic(latin: Column) -> Column:
    """Text whose bytes were read as one Latin character each, in the Cyrillic code page, which Spark's readers don't offer."""
    return F.translate(latin, _BYTES, _LETTERS)


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 if they are valid, else the Cyrillic code page (in which nearly every byte means something)."""
    cyrillic = _cyrillic(F.decode(content, "iso-8859-1"))
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(cyrillic)
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def texts(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("txt", "md")) -> DataFrame:
    """``(doc, text)`` of the text files in a folder, whole."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ok = F.lower(F.element_at(F.split("path", r"\."), -1)).isin(list(extensions))
    return found.where(ok).select(F.element_at(F.split("path", "/"), -1).alias("doc"), decoded(F.col("content")).alias("text"))


def raw_lines(docs: DataFrame, least: int = 5, most: int = 500) -> DataFrame:
    """``(doc, pos, raw_text, numbers)`` of every line with ``least`` characters or more."""
    from gridwright.functions.text import numbers

    each = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.char_length(F.trim("line")) >= least)
    return each.select("doc", "pos", F.left(F.trim("line"), F.lit(most)).alias("raw_text"), numbers(F.col("line")).alias("numbers"))


def log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log to be looked at; malformed lines are left out, so it is no base for a rewrite (``log_lines`` is)."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """The ``line``s of a JSON-lines log as they are, malformed ones too: what an update reads and writes back."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def csv_table(spark: SparkSession, path: str, encoding: str = "windows-1251", separator: str = ";") -> DataFrame:
    """A CSV with a header; all columns text. The encoding is windows-1251 or one of Spark's."""
    cyrillic = encoding == "windows-1251"
    rows = spark.read.option("header", "true").option("sep", separator).option("encoding", "iso-8859-1" if cyrillic else encoding).csv(path)
    if not cyrillic:
        return rows
    return rows.select(*[_cyrillic(F.col(f"`{c}`")).alias(c.translate(str.maketrans(_BYTES, _LETTERS))) for c in rows.columns])


def csv_guessed(spark: SparkSession, path: str, separators: str = ";,\t") -> DataFrame:
    """A CSV with a header, read as UTF-8 if its first lines are valid so, else in the Cyrillic code page; the separator is the
    first that the header line has. The head alone is looked at; the table itself is read by tasks."""
    raw = spark.read.text(path).limit(100)
    head = raw.agg(F.make_valid_utf8(F.first("value")).alias("first"), F.bool_and(F.is_valid_utf8("value")).alias("utf8")).first()
    line = head.first or ""
    return csv_table(spark, path, "utf-8" if head.utf8 in (True, None) else "windows-1251", next((x for x in separators if x in line), separators[0]))


FILING = "header struct<inn:string,kpp:string,organization_name:string>, application struct<activity_sphere:string,revenue:struct<total:double,articles:array<struct<code:string,name:string,amount:double>>>>"


def filing_articles(filings: DataFrame, col: str = "json") -> DataFrame:
    """``(inn, sphere, total, code, name, amount)`` of filings in JSON; a null amount is 0."""
    f = filings.select(F.from_json(col, FILING).alias("f"))
    each = f.select("f.header.inn", F.col("f.application.activity_sphere").alias("sphere"), F.col("f.application.revenue.total").alias("total"), F.explode("f.application.revenue.articles").alias("a"))
    return each.select("inn", "sphere", "total", "a.code", "a.name", F.coalesce("a.amount", F.lit(0.0)).alias("amount"))


def filing_errors(inn: Column, organization: Column, articles: Column) -> Column:
    """What is wrong with a filing, as an array of messages."""
    return F.array_compact(F.array(
        F.when(~F.coalesce(inn.rlike(r"^(\d{10}|\d{12})$"), F.lit(False)), F.lit("inn")), F.when(F.coalesce(F.trim(organization), F.lit("")) == "", F.lit("organization")), F.when(F.coalesce(F.size(articles), F.lit(0)) <= 0, F.lit("articles"))))
