"""Model calls behind named scorers, and the dataflows around them: cached answers, map-reduce summaries, classification.

A scorer takes a column of prompts and gives a column of texts. Models are registered by name; without one the
deterministic stand-ins here serve tests and plans. An error is a null with a message beside it, never a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.text import digest, first_match, repeats_itself, without_blocks
from gridwright.sources.scratch import keep

HEADING = 40  # characters of the line above a part, at most
SCORERS: dict[str, Callable[[Column], Column]] = {}


def scorer(name: str) -> Callable[[Callable[[Column], Column]], Callable[[Column], Column]]:
    """Register a scorer under a name; a later one of that name takes its place."""
    def put(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
        SCORERS[name] = f
        return f

    return put


@scorer("first_sentences")
def first_sentences(prompt: Column) -> Column:
    """Stands in for a summary: the first two sentences."""
    return F.array_join(F.slice(F.split(F.trim(prompt), r"(?<=[.!?])\s+"), 1, 2), " ")


@scorer("head")
def head(prompt: Column) -> Column:
    """Stands in for a summary: the first 200 characters."""
    return F.left(prompt, F.lit(200))


@scorer("echo")
def echo(prompt: Column) -> Column:
    return prompt


def prompt(template: str, **parts: Column) -> Column:
    """A template with its ``{placeholders}`` filled."""
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def missing_placeholders(template: Column, required: list[str]) -> Column:
    return F.filter(F.lit(required), lambda p: ~template.contains(F.concat(F.lit("{"), p, F.lit("}"))))


def answered(questions: DataFrame, cache: DataFrame, model: str, name: str = "first_sentences") -> DataFrame:
    """``questions(query, sources, prompt)`` with ``answer`` and ``cached``: from ``cache(key, answer)`` where it has a sound one, else by the scorer.

    Only misses meet the model. Thought blocks are removed; an answer that repeats itself is null, with an error.
    """
    keyed = questions.withColumn("key", digest(F.col("query"), F.col("sources"), model))
    sound = cache.where(~repeats_itself(F.col("answer"))).groupBy("key").agg(F.max("answer").alias("known"))
    met = keyed.join(sound, "key", "left")
    hits = met.where("known is not null").withColumns({"answer": F.col("known"), "cached": F.lit(True)})
    misses = met.where("known is null").withColumns({"answer": without_blocks(SCORERS[name](F.col("prompt"))), "cached": F.lit(False)})
    both = hits.unionByName(misses).drop("known")
    bad = F.coalesce(repeats_itself(F.col("answer")), F.lit(True)) & ~F.col("cached")
    return both.withColumn("error", F.when(bad, F.lit("unusable answer"))).withColumn("answer", F.when(~bad, F.col("answer")))


def summarised(parts: DataFrame, group: int = 10, name: str = "first_sentences") -> DataFrame:
    """``parts(doc, part, piece)`` -> one summary a document: each piece, groups of them in order, then all groups."""
    mapped = parts.select("doc", "part", SCORERS[name](F.col("piece")).alias("s"))
    inorder = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", c))), lambda x: x[c]), "\n\n")
    grouped = mapped.groupBy("doc", (F.col("part") / group).cast("int").alias("g")).agg(SCORERS[name](inorder("s")).alias("s")).withColumnRenamed("g", "part")
    return grouped.groupBy("doc").agg(F.when(F.count("*") > 1, SCORERS[name](inorder("s"))).otherwise(F.max("s")).alias("summary"))


def packed(sizes: Column, budget: int) -> Column:
    """Ordered array of sizes -> array of group numbers from 0: each item goes to the group before it while that stays within the budget.

    An item above the budget is a group of its own. A null array gives null, an empty one an empty one.
    """
    first = F.struct(F.lit(-1).alias("g"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def put(acc: Column, size: Column) -> Column:
        new = (acc["g"] < 0) | (acc["used"] + size > budget)
        g = F.when(new, acc["g"] + 1).otherwise(acc["g"])
        return F.struct(g.alias("g"), F.when(new, size).otherwise(acc["used"] + size).cast("long").alias("used"), F.concat(acc["out"], F.array(g)).alias("out"))

    return F.aggregate(sizes, first, put, lambda acc: acc["out"])


def summarised_within(parts: DataFrame, name: str = "first_sentences", budget: int = 20_000, out: int = 600, direct: int = 6_000, per: int = 4) -> DataFrame:
    """``parts(doc, part, piece)`` -> ``(doc, summary, levels, calls, largest)``: pieces are summarised, then packed in order into calls within a budget of tokens, until one is left.

    A token is ``per`` characters. A document whose pieces, joined, are within ``direct`` tokens takes one call. Answers are cut at ``out`` tokens, as a
    model's own limit does; ``budget`` must hold two of them with their headings, so that every level has at most half the calls of the
    one before (but for one call) and no call of any level reads more than ``largest``, which is within the budget, unless ``direct`` or a piece is above it.
    Pieces of null count as empty, a document without pieces isn't there; a scorer that answers null gives a null summary.
    """
    if budget < 2 * (out - (-HEADING // per)):
        raise ValueError("the budget must hold two answers")
    tokens = lambda c: F.ceil(F.char_length(c) / per).cast("long")
    call = lambda c: F.left(SCORERS[name](c), F.lit(out * per))
    inorder = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("part", c))), lambda x: x[c])
    whole = parts.select("doc", "part", F.coalesce("piece", F.lit("")).alias("piece"))
    sized = keep(whole.join(whole.groupBy("doc").agg(F.sum(F.char_length("piece") + 1).alias("chars")), "doc"), "pieces")
    short = F.col("chars") - 1 <= direct * per
    one = sized.where(short).groupBy("doc").agg(F.array_join(inorder("piece"), "\n").alias("t"))
    done = [one.select("doc", call(F.col("t")).alias("summary"), F.lit(1).alias("levels"), F.lit(1).cast("long").alias("calls"), tokens(F.col("t")).alias("largest"))]
    made = sized.where(~short).select("doc", "part", call(F.col("piece")).alias("s"), tokens(F.col("piece")).alias("read"))
    level, word = 1, "Часть"
    past = {"calls": F.lit(0).cast("long"), "largest": F.lit(0).cast("long")}
    while True:
        each = made.groupBy("doc").agg(inorder("s").alias("s"), (F.first(past["calls"]) + F.count("*")).alias("calls"), F.greatest(F.first(past["largest"]), F.max("read")).alias("largest"))
        headed = F.transform("s", lambda x, i: F.concat(F.lit(f"=== {word} "), (i + 1).cast("string"), F.lit("/"), F.size("s").cast("string"), F.lit(" ===\n"), F.coalesce(x, F.lit(""))))
        rows = keep(each.withColumn("s", headed).withColumn("g", packed(F.transform("s", lambda x: tokens(F.concat(x, F.lit("\n\n")))), budget)), "level")
        joined = lambda g: F.array_join(F.transform(F.filter(F.arrays_zip("s", "g"), lambda x: x["g"] == g), lambda x: x["s"]), "\n\n")
        last = rows.where(F.array_max("g") == 0).withColumn("t", F.array_join("s", "\n\n"))
        done.append(last.select("doc", call(F.col("t")).alias("summary"), F.lit(level + 1).alias("levels"), (F.col("calls") + 1).alias("calls"), F.greatest("largest", tokens(F.col("t"))).alias("largest")))
        more = rows.where(F.array_max("g") > 0)
        if more.isEmpty():
            break
        cut = more.select("doc", "calls", "largest", F.posexplode(F.transform(F.sequence(F.lit(0), F.array_max("g")), joined)).alias("part", "t"))
        made = cut.select("doc", "part", call(F.col("t")).alias("s"), tokens(F.col("t")).alias("read"), F.col("calls").alias("before"), F.col("largest").alias("most"))
        past = {"calls": F.col("before"), "largest": F.col("most")}
        level, word = level + 1, "Блок"
    whole_ = done[0]
    for d in done[1:]:
        whole_ = whole_.unionByName(d)
    return whole_


def verdict_lines(text: Column, names: list[str]) -> Column:
    """map of ``NAME: value`` lines of an answer, the first of each name."""
    found = [F.regexp_extract(text, rf"(?im)^\W*{n}\s*:\s*(.+)$", 1) for n in names]
    return F.map_from_arrays(F.lit(names), F.array(*[F.when(x != "", F.trim(x)) for x in found]))


def json_answer(text: Column, schema: str) -> Column:
    """An answer's JSON, out of its code fence if it has one; null if there is none."""
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(bare != "", bare), schema, {"mode": "PERMISSIVE"})


# Words that tell a decision where an answer has no JSON.
DECISION_WORDS = [("positive", ["positive", "принят", "согласен"]), ("negative", ["negative", "отклон", "отказ"])]


def decision(text: Column) -> Column:
    """An answer's decision: its JSON's, else by the words in it, else neutral."""
    told = json_answer(text, "decision string")["decision"]
    return F.coalesce(F.when(told.isin("positive", "negative", "neutral"), told), first_match(text, DECISION_WORDS, "neutral"))
