"""Registers of claims, documents, law changes, minutes and forecasts: filters, bulk edits and counters.

Filters are Column expressions, so that several combine into one scan; an empty or missing choice leaves rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has(text: Column, wanted: str | None) -> Column:
    """Whether a text has what is looked for in it, in either case; a null text has nothing, an empty wish is met by all."""
    found = (wanted or "").strip().lower()
    return F.coalesce(F.lower(text).contains(found), F.lit(False)) if found else F.lit(True)


def any_has(texts: list[Column], tags: list[Column], wanted: str | None) -> Column:
    """Whether one of the texts, or a member of one of the arrays, has the wanted part."""
    if not (wanted or "").strip():
        return F.lit(True)
    out = F.lit(False)
    for t in texts:
        out = out | has(t, wanted)
    for a in tags:
        out = out | F.coalesce(F.exists(a, lambda x: has(x, wanted)), F.lit(False))
    return out


def equals(values: dict[str, object]) -> Column:
    """AND of equalities; those without a wanted value are left out."""
    out = F.lit(True)
    for name, v in values.items():
        if v is not None:
            out = out & F.coalesce(F.col(name) == v, F.lit(False))
    return out


def law_changes(changes: DataFrame, sphere: str | None = None, category: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """``changes(date, category, spheres, …)`` of a sphere and category in a range of dates, newest first."""
    ok = F.lit(True)
    if sphere:
        ok = ok & F.coalesce(F.array_contains("spheres", sphere), F.lit(False))
    day = F.coalesce("date", F.lit(""))
    for bound, test in ((since, day >= (since or "")), (until, day <= (until or ""))):
        ok = ok & test if bound else ok
    return changes.where(ok & equals({"category": category})).orderBy(F.desc("date"))


def counted(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One row: all rows, and how many have each of some values."""
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col(column) == v).alias(f"{column}_{v}") for v in values])


def day_of(text: Column) -> Column:
    """The date that a text begins with; 1 January 1970 for anything else."""
    return F.coalesce(F.left(text, F.lit(10)).try_cast("date"), F.lit("1970-01-01").cast("date"))


def minutes(protocols: DataFrame, since: str, until: str, wanted: str | None = None, details: list[str] | None = None, order: str = "newest") -> DataFrame:
    """``protocols(meeting_date, meeting_name, organization, detail_level, …)`` in a range of dates, ``order`` newest, oldest or name."""
    day = day_of(F.col("meeting_date"))
    ok = day.between(F.lit(since).cast("date"), F.lit(until).cast("date")) & any_has([F.col("meeting_name"), F.col("organization")], [], wanted)
    if details:
        ok = ok & F.col("detail_level").isin(details)
    by = {"newest": [F.desc(day)], "oldest": [F.asc(day)], "name": [F.lower("meeting_name")]}[order]
    return protocols.where(ok).orderBy(*by)


def minutes_totals(protocols: DataFrame) -> DataFrame:
    """One row: number, words and bytes (missing ones count 0), the first and the last sound date."""
    day = F.left("meeting_date", F.lit(10)).try_cast("date")
    return protocols.agg(F.count("*").alias("total"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"), F.coalesce(F.sum(F.coalesce("txt_size", F.lit(0)) + F.coalesce("docx_size", F.lit(0))), F.lit(0)).alias("bytes"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def forecasts(records: DataFrame, article: str | None = None, organisation: str | None = None, begins: str | None = None) -> DataFrame:
    """``records(article, sources, timestamp, …)``: by article, by a name anywhere in the sources as JSON, by how the time stamp begins."""
    ok = has(F.col("article"), article) & has(F.to_json("sources"), organisation)
    return records.where(ok & F.coalesce(F.col("timestamp").startswith(begins), F.lit(False)) if begins else ok)


RISKS = {"high": (70, 101), "medium": (40, 70), "low": (0, 40)}


def risk_list(articles: DataFrame, level: str | None = None, order: str = "risk") -> DataFrame:
    """``articles(name, inclusion_risk, amount, percent)`` of one risk level, the greatest first by risk, amount or percent."""
    column = {"risk": "inclusion_risk", "amount": "amount", "percent": "percent"}[order]
    low, high = RISKS[level] if level else (None, None)
    return (articles.where((F.col("inclusion_risk") >= low) & (F.col("inclusion_risk") < high)) if level else articles).orderBy(F.desc(column))


def in_choice(wanted: str | None = None, kind: str | None = None, sheet: str | None = None) -> Column:
    """Articles that a choice by name, type and sheet shows."""
    return has(F.col("name"), wanted) & equals({"type": kind, "sheet": sheet})


def rechecked(articles: DataFrame, action: str, chosen: Column | None = None) -> DataFrame:
    """``articles(name, type, sheet, tech_sheet, has_value, checked)`` after a bulk edit: auto, drop_kinds, drop_empty, set, clear or invert (the last three of the chosen rows)."""
    old, chosen = F.col("checked"), F.lit(True) if chosen is None else chosen
    new = {
        "auto": (F.col("type") == "cost") & ~F.coalesce("tech_sheet", F.lit(False)),
        "drop_kinds": old & ~F.col("type").isin("zero", "ref", "agg"),
        "drop_empty": old & F.col("has_value"),
        "set": old | chosen, "clear": old & ~chosen, "invert": F.when(chosen, ~old).otherwise(old),
    }[action]
    return articles.withColumn("checked", new)


def faq_stats(faq: DataFrame) -> DataFrame:
    """``faq(category, variations)`` -> ``(category, n, total, mean_variations)``, a missing category being other."""
    each = faq.groupBy(F.coalesce("category", F.lit("other")).alias("category")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.greatest(F.size("variations"), F.lit(0)), F.lit(0))).alias("v"))
    whole = each.agg(F.sum("n").alias("total"), (F.sum("v") / F.greatest(F.sum("n"), F.lit(1))).alias("mean_variations"))
    return each.select("category", "n").crossJoin(F.broadcast(whole))  # one row


def first_amounts(articles: Column, n: int = 3) -> Column:
    """Sum of the amounts of the first n of array<struct<…, amount>>."""
    return F.aggregate(F.slice(articles, 1, n), F.lit(0.0), lambda s, a: s + F.coalesce(a["amount"].cast("double"), F.lit(0.0)))


def years_in(rows: DataFrame, column: str = "year", placeholder: str = "—") -> DataFrame:
    return rows.where(F.col(column).isNotNull() & (F.trim(F.col(column).cast("string")) != placeholder) & (F.trim(F.col(column).cast("string")) != "")).select(column).distinct().orderBy(column)


def index_totals(results: DataFrame) -> DataFrame:
    """``results(ok, chunks, pages, ocr_pages)`` -> one row of sums over what succeeded, and how much failed."""
    good = lambda c: F.coalesce(F.sum(F.when(F.col("ok"), F.coalesce(c, F.lit(0)))), F.lit(0))
    return results.agg(F.count_if("ok").alias("done"), F.count_if(~F.col("ok")).alias("failed"), good("chunks").alias("chunks"), good("pages").alias("pages"), good("ocr_pages").alias("ocr_pages"))
