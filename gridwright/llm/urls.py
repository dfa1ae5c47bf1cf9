"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the URLs that no rule fits."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import ascii_lower, keep, small
from gridwright.llm.spans import let

TRAIN_ROWS = 20_000  # labelled rows that a model is fitted on, at most about
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "https", "has_fragment", "suffix_share", "suffix_blocked", "start_blocked"]
FOLDS = 5  # for the statistics of labelled URLs: each is told what the other folds say
WIDE_ROWS = 20_000  # of the statistics' some three hundred bytes: what is broadcast stays under some 6 MB
#: (verdict, rule); a rule is a host and a path prefix.
Rule = tuple[str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty if the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*+", 0)), F.regexp_extract(rest, "^[^/?#]*+([^?#]*+)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none fits. A rule fits its host and all subdomains, if the path starts as it does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, r in sorted(rules, key=lambda x: len(x[1])):
        h, slash, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.char_length(text)

    def total(cs: Column) -> Column:
        each = F.transform(F.array_distinct(cs), lambda c: F.size(F.filter(cs, lambda x: x == c)) / n)
        return F.aggregate(each, F.lit(0.0), lambda a, p: a - p * F.log(p) / math.log(2))

    return F.when(n > 0, let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), total)).otherwise(F.lit(0.0))


def lexical(df: DataFrame) -> DataFrame:
    """``df(url, host, path)`` with lexical features, the ``suffix`` (last two labels) of its host and the ``start`` (first part) of its path."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.char_length(url), F.lit(1))
    count = lambda c, chars: F.char_length(c) - F.char_length(F.translate(c, chars, ""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    return df.withColumns({
        "length": F.char_length(url).cast("double"), "host_length": F.char_length("host").cast("double"), "path_length": F.char_length("path").cast("double"),
        "depth": count(F.col("path"), "/").cast("double"), "labels": F.size(labels).cast("double"), "digit_ratio": count(url, "0123456789") / n, "entropy": _entropy(url),
        "parameters": F.when(query == "", 0).otherwise(1 + count(query, "&")).cast("double"), "hyphens": count(F.col("host"), "-").cast("double"),
        "https": url.startswith("https:").cast("double"), "has_fragment": url.contains("#").cast("double"),
        "suffix": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), "."), "start": F.regexp_extract("path", "^/?[^/]*+", 0),
    })


def judge(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, url_col: str = "url") -> DataFrame:
    """The rows of ``pages`` with ``host``, ``path``, ``rule`` (null if none fits), ``verdict`` (allow or block) and ``blocked_share``.

    ``labelled(url, blocked)`` trains the trees; without it the rows that a rule judges are the labelled URLs. Equal URLs
    count once; at most about TRAIN_ROWS of them are used, chosen by a hash of the URL. Suffix statistics are counted
    over all pages: the suffix's share of all URLs, and how many of its labelled URLs are blocked, and of those with the
    same start of the path as well, drawn to the overall rate by one count. The trees are fitted on statistics that
    leave the URL's own fold out, and judge with those of all folds.

    A null URL, or one without ``://``, has an empty host and path and is judged by the model like others. Repeated rows
    come back as often as they are there. If the labels are of one kind only, or there are none, no trees can be
    fitted: the verdict is then allow, or block if all labels say so. An empty table gives an empty result. Other
    columns are passed on, those named like new ones replaced.
    """
    new = ["host", "path", "rule", "verdict", "blocked_share"]
    names = [c for c in pages.columns if c not in new]

    plain = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{url_col}`").cast("string").alias("url"))
    all_ = _read(plain)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    all_ = all_.withColumns({"rule": rule, "told": verdict})
    told = all_.withColumn("label", F.when(F.col("told").isNotNull(), (F.col("told") == "block").cast("double")))
    if labelled is not None:
        own = _read(labelled.select(F.col("url").cast("string"), F.col("blocked").cast("double").alias("label"))).where("label is not null")
        told = told.withColumn("label", F.lit(None).cast("double")).select("url", "suffix", "start", "label").unionByName(own.select("url", "suffix", "start", "label"))
    stats = Statistics(told, counted_pages=labelled is None)
    if 0 < stats.blocked < stats.labelled:
        known = (all_.where("told is not null").withColumn("label", (F.col("told") == "block").cast("double")) if labelled is None else own)
        out = fit(known, stats).transform(stats.put(all_, held_out=False))
        out = out.withColumn("blocked_share", F.get(vector_to_array(F.col("probability")), F.lit(1)))
    else:
        out = all_.withColumn("blocked_share", F.lit(1.0 if stats.labelled and stats.blocked == stats.labelled else 0.0))
    said = F.coalesce("told", F.when(F.col("blocked_share") > 0.5, "block").otherwise("allow"))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "host", "path", "rule", said.alias("verdict"), "blocked_share")


def _read(df: DataFrame) -> DataFrame:
    """``df(url)`` with host, path and lexical features."""
    host, path = host_and_path(F.col("url"))
    return lexical(df.withColumns({"host": host, "path": path}))


class Statistics:
    """How many URLs a suffix has, and how many of its labelled URLs, and of those with a start of path, are blocked, by fold.

    One scan counts them, pre-aggregated, into a table of a few numbers for each suffix, start and fold; everything
    else comes from that table.
    """

    def __init__(self, told: DataFrame, counted_pages: bool = True):
        fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int").alias("fold")
        counts = told.groupBy("suffix", "start", fold).agg(F.count("*").alias("urls"), F.count("label").alias("n"), F.sum("label").alias("b"))
        counts = keep(counts.withColumns({"b": F.coalesce("b", F.lit(0.0)), "urls": F.col("urls") if counted_pages else F.col("urls") - F.col("n")}), "url-counts")
        whole = counts.agg(F.sum("urls").alias("urls"), F.sum("n").alias("n"), F.sum("b").alias("b")).first()
        self.urls, self.labelled, self.blocked = whole.urls or 0, whole.n or 0, whole.b or 0.0
        self.rate = self.blocked / self.labelled if self.labelled else 0.0
        self.by_suffix, self.by_start = self._summed(counts, ["suffix"]), self._summed(counts, ["suffix", "start"])

    def _summed(self, counts: DataFrame, keys: list[str]) -> DataFrame:
        """One row for each key: numbers of all folds, and of each fold in maps."""
        each = counts.groupBy(*keys, "fold").agg(F.sum("urls").alias("urls"), F.sum("n").alias("n"), F.sum("b").alias("b"))
        folds = F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "b"))))  # FOLDS entries at most
        return keep(each.groupBy(*keys).agg(F.sum("urls").alias("urls"), F.sum("n").alias("n"), F.sum("b").alias("b"), folds.alias("folds")), "url-statistics")

    def put(self, df: DataFrame, held_out: bool) -> DataFrame:
        """``df`` with suffix_share, suffix_blocked and start_blocked; ``held_out`` leaves each URL's own fold out of the last two."""

        def blocked(n: Column, b: Column, folds: Column, rate) -> Column:
            if held_out:
                mine = folds[F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")]
                n, b = n - F.coalesce(mine["n"], F.lit(0)), b - F.coalesce(mine["b"], F.lit(0.0))
            return (F.coalesce(b, F.lit(0.0)) + rate) / (F.coalesce(n, F.lit(0)) + 1)

        suffix = self.by_suffix.select("suffix", F.struct("urls", "n", "b", "folds").alias("s"))
        start = self.by_start.select("suffix", "start", F.struct("n", "b", "folds").alias("t"))
        both = df.join(small(suffix, most=WIDE_ROWS), "suffix", "left").join(small(start, most=WIDE_ROWS), ["suffix", "start"], "left")
        rate = F.lit(self.rate)
        both = both.withColumns({"suffix_share": F.coalesce(F.col("s.urls") / max(self.urls, 1), F.lit(0.0)), "suffix_blocked": blocked(F.col("s.n"), F.col("s.b"), F.col("s.folds"), rate)})
        return both.withColumn("start_blocked", blocked(F.col("t.n"), F.col("t.b"), F.col("t.folds"), F.col("suffix_blocked"))).drop("s", "t")


def fit(known: DataFrame, stats: Statistics) -> PipelineModel:
    """Gradient-boosted trees on FEATURES for ``label`` 0 or 1, from TRAIN_ROWS of the distinct labelled URLs at most about."""
    share = min(1.0, TRAIN_ROWS / max(1, stats.labelled))
    some = known.where(F.pmod(F.xxhash64("url", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    once = some.groupBy("url").agg(F.max("label").alias("label"))
    sample = keep(stats.put(_read(once), held_out=True).select("label", *FEATURES), "url-sample")
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[vectors, GBTClassifier(labelCol="label", maxIter=10, maxDepth=4, stepSize=0.3, seed=7)]).fit(sample.coalesce(4))
