"""PII: base patterns by regular expression, and identifiers that bootstrapped contexts discover.

Base spans seed a graph of instances (texts of spans) and lexical patterns (the words around them). Patterns get a
confidence in a kind from the instances of that kind, instances one from their patterns. Instances that pass become seeds of the next round. Everything is DataFrame operations on
the table of (pattern, instance) edges, which has the identifier-shaped tokens only, not the words of the corpus. Tokens
that overlap a base span are none: they are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import ascii_lower, keep, small
from gridwright.llm.spans import joined, kind_of, let, matches, overlaps

KINDS = ["email", "ip", "card", "phone"]
# Possessive loops and starts at a run's begin (or where the last match ended) keep long runs linear; matches are the same.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Candidates for discovery, the leftmost and of these the first alternative: addresses with their signs spelt out, groups
# of digits with blanks, dots, dashes or brackets between them, and single words with a digit or an at-sign.
_AT = r"[\[({]\x20?(?i:at)\x20?[\])}]"
_DOT = r"(?:[\[({]\x20?(?i:dot)\x20?[\])}]|\.)"
SPELT = rf"(?<![A-Za-z0-9@._+/-])[A-Za-z0-9][A-Za-z0-9._-]*+\x20?{_AT}\x20?[A-Za-z0-9-]++(?:\x20?{_DOT}\x20?[A-Za-z0-9-]++)++"
GROUPS = r"(?<![A-Za-z0-9@._+/-])\(?[0-9]++\)?(?:[\x20./-]\(?[0-9]++\)?)++(?![A-Za-z0-9@_+/-])"
WORD = r"(?<![A-Za-z0-9@._+/-])[A-Za-z._+/-]*+[0-9@][A-Za-z0-9@._+/-]*+"
TOKEN = f"{SPELT}|{GROUPS}|{WORD}"
AROUND = 64  # characters of context on either side: of a longer word the nearest ones are its pattern
MIN_TOKEN = 5
MIN_SEEDS = 5  # distinct seeds of one kind that a pattern needs
UNKNOWN = 0.1  # of a seed: what an instance of no known kind weighs against a pattern
PATTERN_CONFIDENCE = 0.7
INSTANCE_CONFIDENCE = 0.8
ROUNDS = 3


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    from_right = F.transform(F.split(F.reverse(d), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    parts = F.transform(from_right, lambda x, i: F.when(i % 2 == 0, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0)))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_matches(text: Column, around: int = 0) -> dict[str, Column]:
    """Matches of each base kind that pass its check."""
    n = lambda m: F.length(_digits(m["hit"]))
    part = r"0*+(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9]|)"
    ip_ok = rf"^{part}(?:\.{part}){{3}}$"
    return {
        "email": matches(text, EMAIL, around),
        "ip": F.filter(matches(text, IP, around), lambda m: m["hit"].rlike(ip_ok)),
        "card": F.filter(matches(text, CARD, around), lambda m: let(_digits(m["hit"]), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False)))),
        "phone": F.filter(matches(text, PHONE, around), lambda m: n(m).between(10, 15)),
    }


def _patterns(m: Column) -> Column:
    """Lexical patterns of a span: the two words before it, the two behind it, and one of either side. One word alone tells too little."""
    fold = lambda c: F.regexp_replace(ascii_lower(c), "[0-9]", "9")
    before, behind = F.split(F.btrim(fold(m["left"])), r"[\x20\x09-\x0D]+"), F.split(F.btrim(fold(m["right"])), r"[\x20\x09-\x0D]+")
    word, next_word = F.element_at(before, -1), behind[0]
    found = F.array(F.when((word != "") & (next_word != ""), F.concat(F.lit("m:"), word, F.lit(" "), next_word)),
                    F.when(F.size(before) > 1, F.concat(F.lit("l:"), F.element_at(before, -2), F.lit(" "), word)),
                    F.when(F.size(behind) > 1, F.concat(F.lit("r:"), next_word, F.lit(" "), behind[1])))
    return F.array_compact(found)


def _fits(inst: Column, kind: Column) -> Column:
    """Whether an instance has what an identifier of a kind has at least: an at-sign, groups of digits, or so many digits."""
    n = F.length(_digits(inst))
    return F.when(kind == "email", inst.contains("@") | inst.rlike(_AT)).when(kind == "ip", inst.rlike(r"^[0-9A-Fa-f]+([.:][0-9A-Fa-f]*){3,}$")).when(kind == "card", n.between(12, 19)).otherwise(n.between(6, 15))


def discover(instances: DataFrame) -> DataFrame:
    """``instances(inst, kind, pats)``, kind null for candidates -> ``(inst, kind, confidence)`` of those that the graph accepts.

    Equal instances count once, whatever the number of copies of their documents; edges are made distinct before any
    join. A pattern's confidence in a kind is the weight of that kind's instances over that of all known ones and UNKNOWN
    times those that are of no known kind: contexts of ordinary prose have all kinds in them and are told from those of
    one. It needs MIN_SEEDS distinct instances of the kind. An instance is accepted if the noisy-or of its patterns
    reaches INSTANCE_CONFIDENCE and its shape fits the kind.
    """
    edges = keep(instances.select("inst", "kind", F.explode("pats").alias("pat")).distinct(), "pii-edges")
    whole = keep(edges.groupBy("pat").agg((F.count_distinct("inst") - F.count("kind")).alias("unknown"), F.count("kind").alias("seeds")).where(F.col("seeds") >= MIN_SEEDS).select("pat", "unknown"), "pii-patterns")
    live = keep(edges.join(small(whole.select("pat")), "pat", "left_semi"), "pii-live")
    seeds, asked = live.where("kind is not null").select("pat", "inst", "kind", F.lit(1.0).alias("w")), live.where("kind is null").select("pat", "inst")
    found = None
    for _ in range(ROUNDS):
        known = seeds if found is None else seeds.unionByName(asked.join(small(found), "inst").select("pat", "inst", "kind", F.col("confidence").alias("w")))
        votes = keep(known.groupBy("pat", "kind").agg(F.sum("w").alias("w"), F.count("*").alias("n"), F.count_if(F.col("w") < 1).alias("new")), "pii-votes")
        sums = votes.groupBy("pat").agg(F.sum("w").alias("all"), F.sum("new").alias("told")).join(whole, "pat")
        against = F.col("all") + UNKNOWN * F.greatest(F.col("unknown") - F.col("told"), F.lit(0))
        rated = votes.where(F.col("n") >= MIN_SEEDS).join(small(sums), "pat").select("pat", "kind", F.least(F.col("w") / against, F.lit(0.99)).alias("p"))
        rated = keep(rated.where(F.col("p") >= PATTERN_CONFIDENCE), "pii-rated")
        noisy = asked.join(small(rated), "pat").groupBy("inst", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("p"))))).alias("confidence"))
        best = noisy.where(_fits(F.col("inst"), F.col("kind"))).groupBy("inst").agg(F.max(F.struct("confidence", "kind")).alias("b")).select("inst", "b.kind", "b.confidence")
        found = keep(best.where(F.col("confidence") >= INSTANCE_CONFIDENCE), "pii-found")
    return found


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: ``id_col``, ``base`` and ``added``, both array<struct<start, k, end>>, k an index into KINDS.

    ``base`` has what the base patterns find and their checks pass; ``added`` what the contexts discover, never
    overlapping a base span. Positions are code points, the end exclusive.

    A null text counts as empty: no spans. Repeated rows come back as often as they are there; ids may be null or
    repeated, as rows are told apart by a number of their own. Other columns are ignored, whatever their names. An
    empty table gives an empty result. Texts are taken whole.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    found = docs.select(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("rid"), text.alias("text"))
    found = found.select("id", "rid", *[c.alias(k) for k, c in base_matches(F.col("text"), AROUND).items()],
                         F.filter(matches(F.col("text"), TOKEN, AROUND), lambda m: m["end"] - m["start"] >= MIN_TOKEN).alias("tokens"))
    base = F.concat(*[kind_of(F.col(k), i) for i, k in enumerate(KINDS)])
    found = found.select("id", "rid", *KINDS, base.alias("base"), "tokens")
    found = found.withColumn("tokens", F.filter("tokens", lambda m: ~overlaps(F.col("base"), m)))
    slim = lambda c, kind: F.transform(c, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["hit"].alias("inst"), kind.alias("kind"), _patterns(m).alias("pats")))
    seen = keep(found.select("id", "rid", "base", F.concat(*[slim(F.col(k), F.lit(k)) for k in KINDS]).alias("seeds"), slim(F.col("tokens"), F.lit(None).cast("string")).alias("tokens")), "pii")
    each = seen.select(F.explode(F.concat("seeds", "tokens")).alias("s")).select("s.inst", "s.kind", "s.pats")
    accepted = discover(each)
    spots = seen.select("rid", F.explode("tokens").alias("s")).select("rid", "s.start", "s.end", "s.inst").join(small(accepted), "inst")
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    added = keep(spots.groupBy("rid").agg(F.collect_list(F.struct("start", number.alias("k"), "end")).alias("added")), "pii-added")
    both = seen.select("id", "rid", "base").join(small(added), "rid", "left")
    return both.select(F.col("id").alias(id_col), "base", F.coalesce("added", F.array().cast("array<struct<start:int,k:int,end:int>>")).alias("added"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the hash of the base spans and all spans as text."""
    of = lambda i: F.size(F.filter("base", lambda s: s["k"] == i)).cast("long")
    counts = [of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(F.col(f"`{id_col}`"), *counts, F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"),
                        joined(F.concat("base", "added"), KINDS).alias("spans"), F.size("added").cast("long").alias("n_added"))
