"""Writers: partitioned stores with upsert, append logs, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Write rows so that the partitions they belong to are replaced and others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def delete_partition(spark: SparkSession, path: str, by: str, value: str) -> DataFrame:
    """The store without one partition, as a frame; rewriting it is the caller's choice."""
    return spark.read.parquet(path).where(F.col(by) != value)


def append_log(rows: DataFrame, path: str, per_file: int = 1000) -> None:
    """Append rows to a JSON-lines log, so many lines a file."""
    rows.write.mode("append").option("maxRecordsPerFile", per_file).json(path)


def rewrite_log(lines: DataFrame, path: str, per_file: int = 1000) -> None:
    """Write ``lines(line)`` as a log of so many lines a file, to a folder other than the one they are read from."""
    lines.select("line").write.mode("overwrite").option("maxRecordsPerFile", per_file).text(path)


def export_csv(rows: DataFrame, path: str) -> None:
    """Semicolon-separated text with a header."""
    rows.write.mode("overwrite").option("header", "true").option("sep", ";").csv(path)


def export_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """A report of several tables, each in a folder of its own."""
    for name, rows in sheets.items():
        export_csv(rows, f"{path}/{name}")


def filing_documents(articles: DataFrame) -> DataFrame:
    """``(inn, organization, sphere, code, name, amount)`` -> one JSON document a filing, its total the sum of the amounts, null counted as 0."""
    a = F.struct("code", "name", F.coalesce("amount", F.lit(0.0)).alias("amount"))
    each = articles.groupBy("inn", "organization", "sphere").agg(F.array_sort(F.collect_list(a)).alias("articles"), F.sum(F.coalesce("amount", F.lit(0.0))).alias("total"))
    doc = F.struct(F.struct("inn", F.col("organization").alias("organization_name")).alias("header"), F.struct(F.col("sphere").alias("activity_sphere"), F.struct("total", "articles").alias("revenue")).alias("application"))
    return each.select("inn", F.to_json(doc).alias("json"))
