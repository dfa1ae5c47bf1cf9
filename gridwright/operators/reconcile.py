"""Joins of two sides that should agree: registries, staffing, peers, forecasts; and regression."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions import rules
from gridwright.operators.retrieval import stated
from gridwright.sources.scratch import keep


def registry_status(rows: DataFrame, registry: DataFrame, days: int = 30, share: float = 0.1) -> DataFrame:
    """``rows(key, started, cost)`` against ``registry(key, started, cost)``: missing, cost_differs, date_differs or matches.

    The first registry row of a key counts; a difference in cost is told before one in date.
    """
    one = registry.groupBy("key").agg(F.min_by(F.struct("started", "cost"), F.struct("started", "cost")).alias("g"))
    met = rows.join(one, "key", "left")
    off = F.abs(F.datediff("started", F.col("g.started"))) > days
    dear = (F.col("cost") > 0) & (F.abs(F.col("cost") - F.col("g.cost")) / F.col("cost") > share)
    return met.withColumn("status", F.when(F.col("g").isNull(), "missing").when(dear, "cost_differs").when(off, "date_differs").otherwise("matches")).drop("g")


def by_number_or_name(rows: DataFrame, registry: DataFrame, chars: int = 20) -> DataFrame:
    """``rows(id, number, name)`` with ``reg_id`` of ``registry(reg_id, number, name)``: by equal numbers, else the first whose
    name has the beginning of the row's name in it. The second join is for rows without a number match only, against words of
    the registry names that are as long as that beginning, so it stays an equi-join."""
    numbered = registry.where("trim(number) <> ''").groupBy(F.trim("number").alias("n")).agg(F.min("reg_id").alias("by_number"))
    met = rows.join(numbered, F.trim(rows.number) == F.col("n"), "left").drop("n")
    part = F.left(F.lower(F.trim("name")), F.lit(chars))
    asked = met.where("by_number is null and trim(name) <> ''").select("id", part.alias("part"))
    low = F.lower(F.trim("name"))
    lengths = [r[0] for r in asked.select(F.char_length("part").alias("n")).distinct().collect()]  # chars values at most
    found = None
    for n in lengths:
        grams = registry.where(F.char_length(low) >= n).select("reg_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(low) - n + 1), lambda i: F.substr(low, i, F.lit(n))))).alias("part"))
        hit = asked.join(grams, "part").groupBy("id").agg(F.min("reg_id").alias("by_name"))
        found = hit if found is None else found.unionByName(hit)
    out = met if found is None else met.join(found, "id", "left")
    return out.withColumn("reg_id", F.coalesce("by_number", *(["by_name"] if found is not None else []))).select(*rows.columns, "reg_id")


def staffing(actual: DataFrame, norms: DataFrame, scale: float) -> DataFrame:
    """``actual(position)`` one row a person, ``norms(position, norm)`` -> headcount against norm of every position of either side."""
    count = actual.groupBy("position").agg(F.count("*").cast("double").alias("actual"))
    both = count.join(norms.select("position", rules.staffing_norm(F.col("norm"), F.lit(scale)).alias("required")), "position", "full").na.fill(0.0, ["actual", "required"])
    return both.withColumns({"deviation": F.round(F.col("actual") - F.col("required"), 1), "status": rules.staffing_status(F.col("actual"), F.col("required"))})


def against_benchmark(values: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``benchmark(name, mean)`` with ``values(name, value)``; a missing value counts as the mean."""
    met = benchmark.join(values, "name", "left").withColumn("value", F.coalesce("value", "mean"))
    return met.withColumns({"verdict": rules.compared(F.col("value"), F.col("mean")), "deviation": rules.deviation_percent(F.col("value"), F.col("mean"))})


def indexed(articles: DataFrame, indices: DataFrame, multiplier: float, default: float = 1.05, legacy: bool = True) -> DataFrame:
    """``articles(name, amount)`` forecast by the first index ``(pos, title, factor)`` whose title contains the name or is in it.

    Without one, and (``legacy``) with a factor of exactly 1, the default holds. Indices are a short literal table.
    """
    names = articles.select("name").distinct()
    a, b = F.lower("name"), F.lower("title")
    hits = names.join(stated(indices), a.contains(b) | b.contains(a)).groupBy("name").agg(F.min_by("factor", "pos").alias("factor"))
    found = F.round(F.col("factor") * multiplier, 3)
    factor = F.when(found.isNull() | ((found == 1.0) & F.lit(legacy)), F.lit(default)).otherwise(found)
    return articles.join(hits, "name", "left").withColumn("factor", factor).withColumn("forecast", F.col("amount") * F.col("factor"))


def top_and_rest(amounts: DataFrame, k: int, rest: str = "other") -> DataFrame:
    """``amounts(name, amount)``: the k largest and the sum of the rest, with their shares, null where all add up to 0."""
    order = F.row_number().over(Window.orderBy(F.desc("amount"), F.asc("name")))
    best = amounts.orderBy(F.desc("amount"), F.asc("name")).limit(k).withColumn("rank", order).select("name", "rank")
    named = amounts.join(F.broadcast(best), "name", "left").withColumn("name", F.when(F.col("rank").isNull(), rest).otherwise(F.col("name")))
    whole = amounts.agg(F.sum("amount").alias("whole"))
    return named.groupBy("name").agg(F.sum("amount").alias("amount")).crossJoin(F.broadcast(whole)).select("name", "amount", F.try_divide("amount", "whole").alias("share"))


def top_by_group(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def regression(rows: DataFrame, target: str, features: list[str]) -> tuple[DataFrame, dict]:
    """Least squares on the rows without missing values; predictions, and r2, rmse, mape (None with a zero target) and the residuals' spread.

    The rows are worked out once, other columns stay with them, and are fitted about their means: squares of values far
    from 0 would lose the digits that tell them apart.
    """
    used = [target, *features]
    clean = keep(rows.withColumns({c: F.col(c).try_cast("double") for c in used}).dropna(subset=used), "regression")
    mean = clean.agg(*[F.avg(c).alias(c) for c in used]).first().asDict()
    about = clean.withColumns({f"_about_{c}": F.col(c) - F.lit(mean[c]) for c in used})
    data = VectorAssembler(inputCols=[f"_about_{c}" for c in features], outputCol="_features").transform(about)
    model = LinearRegression(featuresCol="_features", labelCol=f"_about_{target}", predictionCol="_prediction", solver="normal").fit(data)
    out = model.transform(data).withColumn("prediction", F.col("_prediction") + F.lit(mean[target])).select(*clean.columns, "prediction")
    miss = out.agg(F.avg(F.abs((F.col(target) - F.col("prediction")) / F.nullif(F.col(target), F.lit(0.0)))).alias("mape"), F.count_if(F.col(target) == 0).alias("zeros"), F.stddev_pop(F.col(target) - F.col("prediction")).alias("spread")).first()
    intercept = mean[target] + model.intercept - sum(b * mean[c] for b, c in zip(model.coefficients, features))
    figures = {"intercept": intercept, "coefficients": list(model.coefficients), "r2": model.summary.r2, "rmse": model.summary.rootMeanSquaredError, "mape": None if miss.zeros else miss.mape, "spread": miss.spread}
    return out, figures


def interval(prediction: Column, spread: float) -> tuple[Column, Column]:
    """The 95 per cent interval about a prediction."""
    return prediction - 1.96 * spread, prediction + 1.96 * spread


def future_months(last: Column, n: int) -> Column:
    """The ends of the n months behind a date."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.last_day(F.add_months(last, i)))
