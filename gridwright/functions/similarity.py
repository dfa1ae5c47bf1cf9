"""Name similarity as matching blocks give it: twice the matched characters over all characters.

Pairs of names that are alike are found by a filter and a check: names share a bigram among each one's rarest (how many
of them must be looked at follows from the ratio asked for), lengths and edits allow the ratio, and only what is left is
compared block by block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def blocks_ratio(a: str, b: str) -> float:
    """2 M / T: M are the characters of the longest common block, of the longest ones to its left and right, and so on.

    Of blocks as long as each other the first in ``a`` counts, then the first in ``b``. In a ``b`` of 200 characters or
    more a block is not begun by characters that make up over a hundredth of it, only widened by them.
    """
    if not a and not b:
        return 1.0
    often = {c for c, n in Counter(b).items() if n > len(b) // 100 + 1} if len(b) >= 200 else set()
    places: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        if c not in often:
            places.setdefault(c, []).append(j)
    matched, open_ = 0, [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        i0, j0, size, ends = a0, b0, 0, {}
        for i in range(a0, a1):
            now = {}
            for j in places.get(a[i], ()):
                if b0 <= j < b1:
                    now[j] = n = ends.get(j - 1, 0) + 1
                    if n > size:
                        i0, j0, size = i - n + 1, j - n + 1, n
            ends = now
        while i0 > a0 and j0 > b0 and a[i0 - 1] == b[j0 - 1]:
            i0, j0, size = i0 - 1, j0 - 1, size + 1
        while i0 + size < a1 and j0 + size < b1 and a[i0 + size] == b[j0 + size]:
            size += 1
        if size:
            matched += size
            open_ += [(a0, i0, b0, j0), (i0 + size, a1, j0 + size, b1)]
    return 2.0 * matched / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def name_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """0 to 1 for two names, in either case; 0 if one is missing. Compared whole."""
    for a, b in pairs:
        yield pd.Series([0.0 if x is None or y is None else blocks_ratio(x.lower(), y.lower()) for x, y in zip(a, b)], dtype=float)


def allowed(a: str, b: str, least: float) -> Column:
    """What a ratio of ``least`` needs: matched characters stand in one order in both names, so that few edits lead from one to the other. JVM-side."""
    a, b = F.lower(a), F.lower(b)
    n = F.char_length(a) + F.char_length(b)
    return (2 * F.least(F.char_length(a), F.char_length(b)) >= F.lit(least - 1e-9) * n) & (F.levenshtein(a, b) <= F.lit(1 - least + 1e-9) * n)


def _spoilt(n: Column, e: float) -> Column:
    """How many of its bigrams a name of n characters may lack in one that is alike, ``e`` being 1 less the ratio.

    u unmatched characters spoil two bigrams each, w characters put in between one each, and u + w are at most e times
    all characters, that is u (1 + e) + w (1 - e) <= 2 e n.
    """
    room = n * (2 * e) + 1e-9
    each = F.transform(F.sequence(F.lit(0), F.floor(room / (1 + e)).cast("int")), lambda u: 2 * u + F.floor((room - u * (1 + e)) / (1 - e)).cast("int"))
    return F.array_max(each)


def candidates(names: DataFrame, least: float) -> DataFrame:
    """``names(key, name)``, distinct -> ``(key, name, other)`` of names of one key, both ways and with itself, that ``allowed`` lets pass; none is missed.

    Null names have no partner. For ratios so low that short names may share no bigram, those meet on characters.
    """
    e = 1.0 - least
    rows = names.where("name is not null").withColumn("low", F.lower("name")).withColumn("n", F.char_length("low"))
    at = F.sequence(F.lit(1), F.col("n") - 1)
    grams = F.when(F.col("n") > 1, F.transform(at, lambda i: F.substr("low", i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    # The k-th time that a name has a bigram is an item of its own, so that names are sets.
    each = rows.select("key", "name", "n", F.posexplode(grams).alias("i", "g"))
    nth = F.row_number().over(Window.partitionBy("key", "name", "g").orderBy("i"))
    items = each.withColumn("g", F.concat("g", F.lit("|"), nth.cast("string")))
    often = items.groupBy("g").agg(F.count("*").alias("often"))
    order = F.row_number().over(Window.partitionBy("key", "name").orderBy("often", "g"))
    rarest = items.join(often, "g").withColumn("r", order).where(F.col("r") <= _spoilt(F.col("n"), e) + 1).select("key", "name", "g")
    # Equal names meet in any case, and names that may have spoilt all bigrams with theirs.
    whole = rows.select("key", "name", F.concat(F.lit("="), "low").alias("g"))
    reach = (2.0 - least) / least
    lost = [n for n in range(1, 64) if max(2 * u + int((2 * e * n + 1e-9 - u * (1 + e)) / (1 - e)) for u in range(int((2 * e * n + 1e-9) / (1 + e)) + 1)) >= max(1, n - 1)]
    keys = rarest.unionByName(whole)
    if lost:  # names of any length, if long ones may lose all as well
        short = rows if lost[-1] == 63 else rows.where(F.col("n") <= int(lost[-1] * reach + 1e-9))
        keys = keys.unionByName(short.select("key", "name", F.explode(F.array_distinct(F.split("low", ""))).alias("g")))
    keys = keys.withColumn("n", F.char_length(F.lower("name")))
    other = keys.select("key", F.col("name").alias("other"), "g", F.col("n").alias("m"))
    near = 2 * F.least("n", "m") >= F.lit(least - 1e-9) * (F.col("n") + F.col("m"))
    return keys.join(other, ["key", "g"]).where(near).select("key", "name", "other").distinct().where(allowed("name", "other", least))


def without_repeats(items: DataFrame, similar: float = 0.85, same: float = 0.95) -> DataFrame:
    """``items(id, name, amount)`` without those that a later item repeats: names alike and amounts equal, or names nearly equal.

    Names are compared once each, however often they are there, and within an amount where that is asked for. Items
    without a name repeat none; items without an amount have none equal.
    """
    def found(key: Column, least: float) -> DataFrame:
        own = items.select("id", "name", key.alias("key")).where("key is not null and name is not null").groupBy("key", "name").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        later = own.select("key", F.col("name").alias("other"), F.col("last").alias("last2"))
        pairs = candidates(own.select("key", "name"), least).join(own.select("key", "name", "first"), ["key", "name"]).join(later, ["key", "other"]).where("first < last2")
        return pairs.where(name_ratio("name", "other") >= least).groupBy("key", "name").agg(F.max("last2").alias("last2"))

    equal = items.select("id", "name", F.col("amount").alias("key")).join(found(F.col("amount"), similar), ["key", "name"]).where("id < last2").select("id")
    nearly = items.select("id", "name").join(found(F.lit(0), same).drop("key"), "name").where("id < last2").select("id")
    return items.join(equal.union(nearly).distinct(), "id", "left_anti")


def one_edit(names: DataFrame) -> DataFrame:
    """``names(name)``, distinct -> ``(name, other)`` of all pairs, both ways, that are equal or one edit apart.

    Such names share a variant, being the name or the name less one character; an equi-join on variants finds them, at
    any place of the edit, and the distance is checked. Null names are left out.
    """
    gaps = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("name"), F.lit(1))), lambda i: F.concat(F.left("name", i - 1), F.substr("name", i + 1)))
    variants = names.where("name is not null").select("name", F.explode(F.array_distinct(F.concat(F.array("name"), gaps))).alias("variant"))
    other = variants.select(F.col("name").alias("other"), "variant")
    return variants.join(other, "variant").where(F.levenshtein("name", "other") <= 1).select("name", "other").distinct()
