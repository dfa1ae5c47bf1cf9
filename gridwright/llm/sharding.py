"""Sharding: minimax contiguous partition of ordered atomic groups (equal texts) into a given number of shards.

Groups are put in an order that depends on their text only. Group sizes are summed up along that order on the
executors: totals of 4096 hash buckets, then sums within a bucket. The smallest feasible capacity is found by binary
search, each capacity being checked greedily (fill a shard as far as the capacity goes, then the next). The driver sees
the sums through a bounded summary only: the least and the largest sum in each of BINS bins. Where a greedy step falls
inside a bin, it is bounded from both sides, and the bins that matter are looked at again, divided finer, until the
capacity and the cuts are exact. So no group list ever reaches the driver, and each round is one aggregate.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm.common import keep

BUCKETS = 4096
SALTS = 256  # a group's rows are numbered in so many parts, each on its own
BINS = 1 << 16


class Sums:
    """What the driver knows of a sorted set of sums: the least and the largest member of each bin."""

    def __init__(self, ends: DataFrame, total: int):
        self.ends, self.total = ends, total
        self.bins: list[tuple[int, int]] = []  # least and largest member of each bin that has any
        self.look([(0, total)])

    def look(self, windows: list[tuple[int, int]]) -> None:
        """Divide the windows into BINS bins and ask for each bin's members."""
        width = max(1, -(-sum(b - a for a, b in windows) // BINS))
        first, case, within = 0, None, None
        for a, b in windows:
            here = (F.col("end") > a) & (F.col("end") <= b)
            number = F.floor((F.col("end") - a - 1) / width) + first if width > 1 else F.col("end") - a - 1 + first
            case = F.when(here, number) if case is None else case.when(here, number)
            within = here if within is None else within | here
            first += -(-(b - a) // width)
        got = self.ends.where(within).groupBy(case.cast("long").alias("n")).agg(F.min("end").alias("lo"), F.max("end").alias("hi")).collect()
        new = [(r.lo, r.hi) for r in got]
        old = [x for x in self.bins if not any(a < x[1] <= b for a, b in windows)]
        self.bins = sorted(old + new)
        self.largest = [x[1] for x in self.bins]

    def floor(self, t: int) -> tuple[int, int]:
        """Bounds of the largest sum that is t at most; 0 if there is none."""
        i = bisect_left(self.largest, t)
        if i < len(self.bins) and self.bins[i][1] == t:
            return t, t
        if i < len(self.bins) and self.bins[i][0] <= t:
            return (t, t) if self.bins[i][0] == t else (self.bins[i][0], t)
        at = self.largest[i - 1] if i else 0
        return at, at

    def ceil(self, t: int) -> tuple[int, int]:
        """Bounds of the smallest sum that is t at least."""
        if t <= 0:
            return 0, 0
        i = bisect_left(self.largest, t)
        least, largest = self.bins[i]
        return (least, least) if t <= least else (largest, largest) if t == largest else (t, largest)

    def inside(self, a: int, b: int) -> list[tuple[int, int]]:
        """One window from the first to the last bin with more than one member that meets [a, b], if there is any."""
        i = max(0, bisect_left(self.largest, a))
        found = []
        while i < len(self.bins) and self.bins[i][0] <= b:
            if self.bins[i][0] < self.bins[i][1] and self.bins[i][1] >= a:
                found.append(self.bins[i])
            i += 1
        return [(found[0][0] - 1, found[-1][1])] if found else []

    def refine(self, windows: set[tuple[int, int]]) -> None:
        """Look at the windows again, overlapping ones as one: of their bins the leading ones, as many as leave the first at most half its width."""
        merged: list[tuple[int, int]] = []
        for a, b in sorted(windows):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        assert merged, "the bins are exact, but the search isn't"
        lo, hi = self.bins[bisect_right(self.largest, merged[0][0])]
        room, taken = BINS * max(1, (hi - lo) // 2), []
        for a, b in merged:
            if b - a > room:  # up to the last bin that ends in the room
                b = max(a, self.largest[bisect_right(self.largest, a + room) - 1])
            if b > a:
                taken.append((a, b))
            room -= b - a
        self.look(taken)


def minimax_cuts(ends: DataFrame, total: int, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity with which greedy filling takes ``shards`` shards at most, and the sums at which to cut.

    ``ends(end)`` has the running sums of the group sizes. Among the partitions of that capacity the cuts are those
    nearest below equal parts.
    """
    if not total or shards < 2:
        return total, [total] * max(0, shards - 1)
    sums = Sums(ends, total)

    def fill(c: int, side: int) -> list[int]:
        at, out = 0, []
        for _ in range(shards):
            at = total if at + c >= total else sums.floor(at + c)[side]
            out.append(at)
        return out

    def least(side: int) -> int:
        a, b = -(-total // shards) - 1, total
        while b - a > 1:
            m = (a + b) // 2
            a, b = (a, m) if fill(m, side)[-1] == total else (m, b)
        return b

    while True:
        high, low = least(0), least(1)
        if high == low:
            # cuts: as near below equal parts as what must fit behind allows
            unsure, need = set(), [total]
            for _ in range(shards - 1):
                lo, hi = sums.ceil(need[-1] - high)
                if lo != hi:
                    unsure.update(sums.inside(need[-1] - high, need[-1] - high))
                need.append(hi)
            need = need[::-1][: shards - 1] if len(need) == shards else need
            cuts, at = [], 0
            for k in range(1, shards):
                t = min(total, at + high, max(total * k // shards, need[k - 1]))
                lo, hi = sums.floor(t)
                if lo != hi:
                    unsure.update(sums.inside(t, t))
                at = max(at, lo)
                cuts.append(at)
            if not unsure:
                return high, cuts
            windows = unsure
        else:
            a, b = fill(low, 0), fill(high, 1)
            windows = {w for x, y in zip(a, b) for w in sums.inside(x, y + 1)} | {w for x, y in zip([0, *a], [0, *b]) for w in sums.inside(x + low, y + high)}
        sums.refine(windows)


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """The rows of ``docs`` with ``size``, ``text_crc32``, ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    A row's size is the UTF-8 bytes of its text plus ``overhead``. Rows with equal texts are one atomic group and share
    a shard. Groups larger than an equal part of what is left get a shard of their own; over the others, in the order
    of their hashes, the largest shard is as small as any contiguous partition allows. Within a group rows are numbered
    in parts by a hash of their id, so that a group with a third of all rows is spread over many tasks; the law is
    ``bytes``. Which rows share a shard doesn't depend on their order or partitioning.

    Rows of one text whose ids are null or equal are numbered by one task.

    A null text has no bytes and the checksum of the empty text; null texts are a group of their own. Repeated rows and
    null ids count as rows. Columns of the input that have one of the new names are replaced. An empty table stays
    empty; with fewer groups than shards some shards are empty.
    """
    names = [c for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot")]
    text = F.col(f"`{text_col}`").cast("string")
    row = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{id_col}`").alias("_id"),
                      F.coalesce(F.unhex(F.md5(text)), F.lit(b"")).alias("_key"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("size"),
                      F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"))
    row = row.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    parts = row.groupBy("_key", "_salt").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    parts = keep(parts.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)).cast("int")), "shard-parts")
    groups = parts.groupBy("_key").agg(F.sum("bytes").alias("bytes"))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone, left, open_shards = [], total, shards
    for key, size in groups.orderBy(F.desc("bytes"), "_key").limit(shards).collect():  # one for each shard at most
        if open_shards > 1 and size * open_shards > left:
            alone.append(bytes(key))
            left, open_shards = left - size, open_shards - 1
        else:
            break
    own = F.lit(-1)
    for i, key in enumerate(alone):
        own = F.when(F.col("_key") == F.lit(key), i).otherwise(own)
    parts = parts.withColumn("_own", own)

    others = F.when(F.col("_own") < 0, F.col("bytes")).otherwise(0)
    totals = parts.groupBy("_bucket").agg(F.sum(others).alias("b"), F.sum("n").alias("r"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows, whatever the input
    offsets = totals.select("_bucket", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    in_bucket = Window.partitionBy("_bucket").orderBy("_key")
    summed = parts.join(F.broadcast(offsets), "_bucket").withColumn("end", F.col("b0") + F.sum(others).over(in_bucket))
    placed = keep(summed.select("_key", "_salt", "_bucket", "_own", "n", "end"), "shard-sums")
    _, cuts = minimax_cuts(placed.where("_own < 0").select("end"), left, open_shards)
    at = F.lit(len(alone))
    for c in cuts:
        at = at + (F.col("end") > c).cast("int")
    placed = placed.withColumn("shard", F.when(F.col("_own") >= 0, F.col("_own")).otherwise(at))

    # slots: rows before, by shard and bucket (a table of bounded size), then within them
    each = placed.groupBy("shard", "_bucket").agg(F.sum("n").alias("r"))
    by_shard = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = keep(each.select("shard", "_bucket", F.coalesce(F.sum("r").over(by_shard), F.lit(0)).alias("r0")), "shard-rows")
    inside = Window.partitionBy("shard", "_bucket").orderBy("_key", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    start = placed.join(F.broadcast(first), ["shard", "_bucket"]).select("_key", "_salt", "shard", (F.col("r0") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("_first"))
    start = keep(start, "shard-starts")
    number = F.row_number().over(Window.partitionBy("_key", "_salt").orderBy("_id")) - 1
    out = row.withColumn("_number", number).join(start, ["_key", "_salt"])
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("_first") + F.col("_number")).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write each shard to its own folder ``shard=N``, rows by slot within each file; a shard's rows are spread over tasks by slot.

    Rows are written as they are, null ids and texts too; a shard without rows has no folder, and an empty table writes none.
    """
    spread = sharded.repartition(F.col("shard"), F.floor(F.col("slot") / 1_000_000))
    spread.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
