"""Secret scans: base patterns, and tokens that a character Markov model of random strings explains better than one of identifiers."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm.common import keep
from gridwright.llm.spans import joined, kind_of, let, matches, overlaps

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
_VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?(.*)$"""
#: Tokens that the models judge, and the characters that they know (1-based; 0 is a token's begin).
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
SHORTEST = 16
ORDINARY = r"(?<![A-Za-z0-9+/_=-])(?:[A-Za-z_-]{8,}+|[A-Za-z_-]{6,}+[0-9]{1,4}|[0-9][0-9_-]{7,}+)(?![A-Za-z0-9+/_=-])"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
SIDE = len(ALPHABET) + 1
BACKOFF = 20.0  # counts by which a row of transitions is drawn to the characters' own shares
FLOOR = 0.05  # part of those that is dealt equally
MARGIN = 0.3  # mean log-likelihood ratio a character that a secret needs at least
DRAWN = 3_000  # strings drawn at random beside the labelled ones, at least


def _index(token: Column) -> Column:
    """0 for the begin, then the place of each character in ALPHABET."""
    return F.concat(F.array(F.lit(0)), F.transform(F.regexp_extract_all(token, F.lit("(?s)."), F.lit(0)), lambda c: F.position(c, F.lit(ALPHABET)).cast("int")))


def base_matches(text: Column) -> dict[str, Column]:
    return {
        "assign": F.filter(matches(text, ASSIGN), lambda m: F.char_length(F.regexp_extract(m["hit"], _VALUE, 1)) >= 6),
        "access": F.filter(matches(text, ACCESS), lambda m: F.char_length(m["hit"]) >= 20),
        "hex": matches(text, HEX),
    }


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(token, random)`` from all documents: values of base secrets, and ordinary tokens outside them.

    Ordinary are words and identifiers of letters (in either case), such with a short number at their end, and numbers
    with or without dashes. Equal tokens count once, so how often a text is there, or how files are split, changes
    nothing. Null and empty texts give no tokens, an empty table an empty result.
    """
    own = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    base = base_matches(F.col("text"))
    secret = F.concat(F.transform(base["assign"], lambda m: F.regexp_extract(m["hit"], _VALUE, 1)), F.transform(base["access"], lambda m: m["hit"]), F.transform(base["hex"], lambda m: m["hit"]))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = F.regexp_extract_all(rest, F.lit(ORDINARY), F.lit(0))
    marked = lambda tokens, random: F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("token"), F.lit(random).alias("random")))
    return own.select(F.explode(F.concat(marked(secret, True), marked(ordinary, False))).alias("x")).select("x.*").distinct()


def random_strings(spark: SparkSession, n: int = DRAWN) -> DataFrame:
    """``(token, random)``: n strings known to be random, of the alphabets of base 64 and base 32, from digests of running numbers.

    They tell the model of secrets in alphabets that the corpus' own labelled ones happen not to use.
    """
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    plain = F.regexp_replace(F.base64(digest), "[^A-Za-z0-9]", "")
    token = F.when(F.col("id") % 3 == 0, F.base64(digest)).when(F.col("id") % 3 == 1, plain).otherwise(F.translate(F.upper(plain), "01", "AZ"))
    return spark.range(n).select(F.left(token, 24 + (F.col("id") % 17).cast("int")).alias("token"), F.lit(True).alias("random"))


def with_random(labels: DataFrame) -> DataFrame:
    """Labelled tokens and as many drawn strings as there are random ones among them, DRAWN at least: in a large corpus, too, these count as much as its own."""
    kept = keep(labels, "secret-labels")
    return kept.unionByName(random_strings(labels.sparkSession, max(DRAWN, kept.where("random").count())))


@dataclass(frozen=True)
class SecretModel:
    """``ratios``: log P(b|a, random) - log P(b|a, ordinary), SIDE x SIDE; tokens whose mean is above ``threshold`` are secrets."""

    ratios: list[float]
    threshold: float


def _given(counts: list[int]) -> list[float]:
    """log P(b|a) from SIDE x SIDE counts: each row is drawn to the characters' own shares by BACKOFF counts, those to equal shares by FLOOR."""
    single = [sum(counts[b::SIDE]) for b in range(SIDE)]
    whole = sum(single)
    share = [(1 - FLOOR) * x / whole + FLOOR / SIDE if whole else 1 / SIDE for x in single]
    out = []
    for a in range(SIDE):
        row = counts[a * SIDE : a * SIDE + SIDE]
        out += [math.log((c + BACKOFF * s) / (sum(row) + BACKOFF)) for c, s in zip(row, share)]
    return out


def train(samples: DataFrame) -> SecretModel:
    """A model from labelled ``(token, random)``: transitions from three quarters of the tokens, the threshold from the rest.

    Transitions are counted on the executors; SIDE * SIDE * 2 counts at most reach the driver. The threshold lets pass
    one in a thousand of the ordinary tokens held out that are long enough to be judged, counted in steps of a thousandth,
    and is MARGIN at least. A null token counts for nothing. Without samples of both labels nothing is told apart: no token passes.
    """
    kept = keep(samples.where("token is not null").select("token", "random", (F.pmod(F.xxhash64("token"), F.lit(4)) == 0).alias("held")), "secret-samples")
    path = kept.where("not held").select("random", _index(F.col("token")).alias("x"))
    steps = path.select("random", F.explode(F.zip_with(F.slice("x", F.lit(1), F.size("x") - 1), F.slice("x", F.lit(2), F.size("x") - 1), lambda a, b: a * SIDE + b)).alias("ab"))
    counts: dict[bool, list[int]] = {True: [0] * SIDE * SIDE, False: [0] * SIDE * SIDE}
    for random, ab, n in steps.groupBy("random", "ab").count().collect():
        counts[random][ab] += n
    ratios = [round(x - y, 5) for x, y in zip(_given(counts[True]), _given(counts[False]))]
    if not any(counts[True]) or not any(counts[False]):
        return SecretModel(ratios, math.inf)
    judged = kept.where(F.col("held") & ~F.col("random") & (F.char_length("token") >= SHORTEST))
    steps = sorted(judged.groupBy(F.floor(ratio(F.col("token"), ratios) * 1000).alias("at")).count().collect(), reverse=True)  # ratios are bounded, and so are the rows
    most, passed = sum(r["count"] for r in steps) // 1000, 0
    for at, n in steps:
        passed += n
        if passed > most:
            return SecretModel(ratios, max(MARGIN, (at + 1) / 1000))
    return SecretModel(ratios, MARGIN)


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's characters: above 0, the random model explains it better."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    walk = lambda t: F.aggregate(F.sequence(F.lit(1), F.size(t) - 1), F.lit(0.0), lambda s, i: s + F.get(table, t[i - 1] * SIDE + t[i]))
    return F.when(F.char_length(token) > 0, let(_index(token), walk) / F.char_length(token)).otherwise(F.lit(0.0))


def find_secrets(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: ``id_col``, ``base`` and ``added``, array<struct<start, k, end>>, k an index into KINDS.

    ``added`` are tokens of 16 characters or more whose mean log-likelihood ratio is above the model's threshold and that overlap no
    base span. Positions are code points, the end exclusive. One projection: no shuffle at all.

    A null text counts as empty: no spans. Rows come back as often as they are there, with null or repeated ids too.
    Other columns are ignored, whatever their names. An empty table gives an empty result. Texts are taken whole.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    base = base_matches(F.col("text"))
    found = own.select("id", F.concat(*[kind_of(c, i) for i, c in enumerate(base.values())]).alias("base"), matches(F.col("text"), TOKEN).alias("tokens"))
    free = F.filter("tokens", lambda m: ~overlaps(F.col("base"), m) & (ratio(m["hit"], model.ratios) > model.threshold))
    return found.select(F.col("id").alias(id_col), "base", kind_of(free, 3).alias("added"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    of = lambda i: F.size(F.filter("base", lambda s: s["k"] == i)).cast("long")
    counts = [of(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return found.select(F.col(f"`{id_col}`"), *counts, F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"),
                        joined(F.concat("base", "added"), KINDS).alias("spans"), F.size("added").cast("long").alias("n_added"))
