"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents, shuffled by hash, form a stream of words that is cut into blocks of equal size. Slot k of the
schedule belongs to the source into whose share of [0, 1) the k-th golden-ratio point falls; its rank among the slots of
that source is the block it takes, epoch after epoch. Ranks are counted in chunks of the schedule and added up, so a
source with most of the slots is no single task's work. Slots join blocks on (source, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm.common import keep, small

GOLDEN = 0.6180339887498949
BUCKETS = 512  # of a source's documents: positions are summed up by bucket, then within it
CHUNK = 1 << 14  # slots whose ranks one task counts
BLOCK_WORDS = 4096  # at most


def words(text: Column) -> Column:
    """Number of runs of characters other than space and 09-0D; 0 for null."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(text.isNull() | (inner == ""), F.lit(0)).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(sizes: list[int], weights: list[float], cap: float = 3.0) -> list[float]:
    """Shares of the sum of ``sizes`` by weight; none above ``cap`` times its size, the excess reshared by weight."""
    out, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / w > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return out


class Mix:
    """The mix of ``docs``: ``rows`` (one for each input row, with its taken words), ``pieces`` (what each slot holds) and ``plan`` (one tuple for each source).

    Sources are ordered by code point, null last, and weigh ``weights`` in turn. Every source's words taken equal its
    rounded target: the schedule gives each about its share of the slots, the last slot is cut short, and a slot or
    two that the points leave missing follow at the end. No word is taken more than ``cap`` times. The order is a hash
    of id and text, so reruns agree.

    A null text has no words and is never taken, nor is one without words; a source without words has the target 0.
    Null is a source like others. Sources are some thousands at most: each is a term of the schedule's expression.
    Repeated rows are rows of their own. Null ids are allowed. Other columns are ignored.
    An empty table gives empty results. The names and sizes of sources pass through the driver, documents don't.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0):
        spark = docs.sparkSession
        text = F.col(f"`{text_col}`").cast("string")
        hashed = F.xxhash64(F.col(f"`{id_col}`"), text, F.lit(20))
        own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), words(text).alias("size"), hashed.alias("h"), F.xxhash64(text).alias("text_hash"))
        own = keep(own.withColumn("rid", F.monotonically_increasing_id()), "mix-rows")
        found = own.groupBy("source").agg(F.sum("size").alias("size")).collect()
        found = sorted(found, key=lambda r: (r.source is None, (r.source or "").encode()))
        sizes = [r.size for r in found]
        goals = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], cap)
        total = sum(sizes)
        block = max(1, min(BLOCK_WORDS, total // max(1, 256 * len(found))))
        self.block, self.plan, rows = block, [], []
        for i, (r, goal) in enumerate(zip(found, goals)):
            whole = min(round(goal), int(cap * r.size))
            epochs, rest = divmod(whole, r.size) if r.size else (0, 0)
            blocks = -(-r.size // block)
            slots = epochs * blocks + -(-rest // block)
            last = (rest - 1) % block + 1 if rest else ((r.size - 1) % block + 1 if slots else 0)
            self.plan.append((r.source, r.size, goal, slots))
            rows.append((i, r.source, r.size, float(goal), blocks, slots, last))
        shape = "s int, source string, source_size long, target double, blocks long, slots long, last long"
        sources = spark.createDataFrame(rows, shape)  # one row for each source
        facts = F.broadcast(sources)

        placed = own.join(facts.select("s", "source"), own.source.eqNullSafe(sources.source)).select("rid", "id", "s", "size", "h", "text_hash", F.pmod("h", F.lit(BUCKETS)).alias("bucket"))
        sums = placed.groupBy("s", "bucket").agg(F.sum("size").alias("w"))
        before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        first = sums.select("s", "bucket", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"))
        inside = Window.partitionBy("s", "bucket").orderBy("h", "id", "size", "rid").rowsBetween(Window.unboundedPreceding, -1)
        start = F.col("w0") + F.coalesce(F.sum("size").over(inside), F.lit(0))
        placed = keep(placed.join(small(first, len(found) * BUCKETS), ["s", "bucket"]).select("rid", "id", "s", "size", "text_hash", start.alias("start")), "mix-stream")

        slots = self._schedule(spark, rows, facts)
        spans = placed.where("size > 0").select("rid", "id", "s", "start", (F.col("start") + F.col("size")).alias("end"))
        spans = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
        a, b = F.greatest("start", "from"), F.least("end", "to")
        self.pieces = spans.join(slots, ["s", "block"]).where(b > a).select("slot", "s", "epoch", "rid", "id", (a - F.col("start")).alias("first_word"), (b - F.col("start")).alias("end_word"))
        taken = self.pieces.groupBy("rid").agg(F.sum(F.col("end_word") - F.col("first_word")).alias("taken"))
        self.rows = placed.join(taken, "rid", "left").join(facts.select("s", "source", "source_size", "target"), "s").select(
            "rid", "id", "source", "text_hash", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def _schedule(self, spark, rows: list, facts: DataFrame) -> DataFrame:
        """``(slot, s, epoch, block, from, to)``: the words ``from`` to ``to`` of the stream of source ``s``."""
        n = sum(r[5] for r in rows)
        shares, cut = [], 0
        for r in rows:
            cut += r[5]
            shares.append(cut / max(1, n))
        u = F.col("id") * GOLDEN % 1.0
        bounds = F.lit(0)
        for c in shares[:-1]:
            bounds = bounds + (u >= c).cast("int")
        points = spark.range(n).select(F.col("id").alias("slot"), bounds.alias("s"), F.floor(F.col("id") / CHUNK).alias("chunk"))
        counts = keep(points.groupBy("s", "chunk").count(), "mix-counts")
        earlier = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("s", "chunk", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("n0"))
        within = F.row_number().over(Window.partitionBy("s", "chunk").orderBy("slot")) - 1
        ranked = points.withColumn("r", within).join(small(offsets, len(rows) * (n // CHUNK + 1)), ["s", "chunk"]).select("slot", "s", (F.col("n0") + F.col("r")).alias("rank"))
        got = {r.s: r.n for r in counts.groupBy("s").agg(F.sum("count").alias("n")).collect()}
        missing = [(r[0], got.get(r[0], 0), r[5]) for r in rows if got.get(r[0], 0) < r[5]]
        if missing:
            more = spark.createDataFrame(missing, "s int, a long, b long").select("s", F.explode(F.sequence("a", F.col("b") - 1)).alias("rank"))
            ranked = ranked.unionByName(more.select((F.lit(n) + F.col("rank")).alias("slot"), "s", "rank"))
        slot = ranked.join(facts.select("s", "blocks", "slots", "last", "source_size"), "s").where("rank < slots")
        begin = (F.col("rank") % F.col("blocks")) * self.block
        until = F.when(F.col("rank") == F.col("slots") - 1, begin + F.col("last")).otherwise(F.least(begin + self.block, F.col("source_size")))
        return slot.select("slot", "s", F.floor(F.col("rank") / F.col("blocks")).alias("epoch"), (F.col("rank") % F.col("blocks")).alias("block"), begin.alias("from"), until.alias("to"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it: its taken words over its size, rounded to the nearest whole number (0 at a half or less).

    Columns are those of ``docs``. Rows that agree in id, source and text are one document whose repetitions add up. Edge
    cases are those of Mix; documents without words, which no mix can take, are passed on once.
    """
    mix = Mix(docs, id_col, text_col, source_col, weights, cap)
    # two hashes of id, source and the text's hash: rows of one id and source would need texts of one hash to be taken for each other
    key = lambda i, s, h: [F.xxhash64(F.lit(seed), F.coalesce(i.cast("string"), F.lit("\0")), F.coalesce(s, F.lit("\0")), h).alias(f"_k{seed}") for seed in (1, 2)]
    times = F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.col("taken") / F.col("size") - 0.5)).cast("int")
    counts = mix.rows.select(*key(F.col("id"), F.col("source"), F.col("text_hash")), times.alias("t")).groupBy("_k1", "_k2").agg(F.sum("t").cast("int").alias("_times")).where("_times > 0")
    names = docs.columns
    text = F.col(f"`{text_col}`").cast("string")
    row = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], *key(F.col(f"`{id_col}`"), F.col(f"`{source_col}`").cast("string"), F.xxhash64(text))).dropDuplicates(["_k1", "_k2"])
    out = row.join(counts, ["_k1", "_k2"]).withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
