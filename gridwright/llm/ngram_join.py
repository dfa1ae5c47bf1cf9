"""N-gram Jaccard join: near-duplicate classes of texts by an exact similarity join of their word-shingle sets.

How it runs:

1. One scan turns each text into its set of distinct word shingles and keeps the set's size, a key of 128 bits and the
   tokens of step 2. Texts with equal sets are one ``node``, however many copies there are.
2. Candidates come from prefixes. Shingles are in one global order, that of their hashes. If two sets of sizes a and b
   have o shingles in common, the first l of these are among the first a - o + l of the one and b - o + l of the other.
   As o is at least the similarity times either size, each set sends its first ``prefix`` shingles (tokens), and similar
   sets share ``reach`` of them at least. An aggregate by token keeps the least and the largest node; no list of a
   token's members is ever built. Tokens with two nodes set bits of a bitmap, with which a second pass over the tokens
   drops every set that has fewer of them than a similar partner would need: a shared passage or a common phrase does
   not make a candidate. Sets that are left are read once more from the texts, one row for each, and travel as hashes.
3. Each remaining token's members are compared with the member that has most copies, if the two meet often enough: the
   candidates of a pivot are stored in a trie (chunks of bounded size) and the pivot's set walks it. Links give components.
4. What is still undecided are pairs in different components, so only tokens whose members lie in several components
   count, and only sets that have enough of those, each with its rarest ones. They are taken together by pivot and cut into blocks. A trie of one
   block is probed with the sets of another. Pairs already connected are skipped, so a group of thousands of near copies
   costs its size, not its square, unless its members really are unconnected.

Hashes have 64 bits: sets of some hundred shingles would need a collision among their own shingles to be misjudged.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm.common import keep, short_batches, shuffle_partitions, small
from gridwright.llm.components import components
from gridwright.llm.shingles import U64, Words, set_key, sets_of, slices
from gridwright.llm.trie import PrefixTrie

CHUNK = 128  # sets in a trie: bounds a task's memory
BITMAP_BITS = 1 << 28
NO_ID = -1 << 62  # stands for a null id where ids are compared


def reach(n: int, num: int, den: int) -> int:
    """Tokens that a set of n shingles shares with each similar set that is no smaller."""
    return max(1, min(n * (den - num) // den, n * num // den))


def prefix(n: int, num: int, den: int) -> int:
    """First shingles that a set of n sends as its tokens."""
    return n * (den - num) // den + reach(n, num, den)


def least(n: int, num: int, den: int) -> int:
    """Tokens that a set of n shares with any similar set, the smallest one included."""
    return reach(-(-n * num // den), num, den)


def _rows(k: int, num: int, den: int):
    """id, size of the set, its key (128 bits) and its tokens for every text; columns behind the text are passed on."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for i, j, data, offsets in slices(batch.column(1)):
                sizes, first, second, tokens = [], [], [], []
                for s in sets_of(Words(data, offsets), k):
                    key = set_key(s)
                    sizes.append(len(s))
                    first.append(key[0])
                    second.append(key[1])
                    tokens.append(s[: prefix(len(s), num, den)].view(np.int64))
                ends = np.cumsum([0, *map(len, tokens)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64)))
                part = batch.slice(at + i, j - i)
                made = [part.column(0), *part.columns[2:], pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(made, [batch.schema.names[0], *batch.schema.names[2:], "n", "a", "b", "tokens"])

    return scan


class Bits:
    """A bitmap of keys by their low bits, for skipping what can't be wanted; a wrong hit costs time, never a result.

    It has some eight bits a key and at most BITMAP_BITS (32 MB), whatever the input: executors get it by broadcast and
    build it, so that the driver holds the one array of bytes. Beyond that size it fills up, and what it lets through
    is sorted out by the joins that follow in any case.
    """

    def __init__(self, keys: DataFrame):
        n = keys.count()
        bits = 1 << 16
        while bits < min(8 * n, BITMAP_BITS):
            bits <<= 1
        self.bits, self.empty = bits, n == 0
        key = F.col(keys.columns[0])
        words = keys.groupBy(F.shiftright(key.bitwiseAND(F.lit(bits - 1)), 6).cast("int").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast(`{keys.columns[0]}` & 63 as int)))").alias("m"))
        made = None if self.empty else words.repartition(1).mapInArrow(_packed(bits), "bits binary").first()
        self.shared = keys.sparkSession.sparkContext.broadcast(bytes(made[0]) if made else bytes(bits >> 3))

    def test(self):
        """The function that a task tests keys with."""
        at, mask = np.frombuffer(self.shared.value, dtype=U64), U64(self.bits - 1)

        def has(keys: np.ndarray) -> np.ndarray:
            low = keys.view(U64) & mask
            return (at[(low >> U64(6)).astype(np.int64)] >> (low & U64(63))) & U64(1) == 1

        return has


def _packed(bits: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(bits >> 6, dtype=np.int64)
        for b in batches:
            out[b.column(0).to_numpy()] = b.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["bits"])

    return pack


def _members(shared: Bits, num: int, den: int):
    """(token, node, need) of the tokens that ``shared`` may have, for sets that have ``need`` of them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = shared.test()
        for b in batches:
            sizes, lists = b.column(1).to_pylist(), b.column(2)
            token = lists.flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            hit = has(token)
            token, row = token[hit], row[hit]
            need = np.array([least(n, num, den) for n in sizes], dtype=np.int64)
            enough = np.bincount(row, minlength=b.num_rows) >= need
            token, row = token[enough[row]], row[enough[row]]
            yield pa.RecordBatch.from_arrays([pa.array(token), b.column(0).take(pa.array(row)), pa.array(need[row])], ["token", "node", "need"])

    return scan


def _wanted_sets(wanted: Bits, k: int):
    """(a, b, id, set) of the rows whose key and id ``wanted`` may have."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = wanted.test()
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            for i, j, data, offsets in slices(batch.column(1)):
                sets = list(sets_of(Words(data, offsets), k))
                keys = np.array([set_key(s) for s in sets], dtype=np.int64).reshape(len(sets), 2)
                hit = np.flatnonzero(has(keys[:, 0] ^ ids[i:j]))
                made = [pa.array(keys[hit, 0]), pa.array(keys[hit, 1]), pa.array(ids[i:j][hit]), pa.array([sets[x].tobytes() for x in hit], pa.binary())]
                yield pa.RecordBatch.from_arrays(made, ["a", "b", "id", "set"])

    return scan


def _open(members: DataFrame) -> DataFrame:
    """Of ``members(token, node, need, comp)`` the tokens that lie in several components, of nodes that have ``need`` of them.

    Two similar sets in different components share at least ``need`` tokens of either, and each of these lies in both
    components: no such pair is lost. A second round uses what the first one dropped.
    """
    for _ in range(2):
        several = members.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
        shared = keep(members.join(several, "token", "left_semi"), "shared")
        enough = shared.groupBy("node").agg(F.count("*").alias("has"), F.min("need").alias("need")).where("has >= need").select("node")
        members = keep(shared.join(small(enough), "node", "left_semi").select("token", "node", "need", "comp"), "members")
    return members


def _rarest(members: DataFrame) -> DataFrame:
    """Each node's tokens but the ``need - 1`` that most members have.

    Of the tokens that two similar sets share the rarest has ``need - 1`` more common ones above it in both, so both keep it.
    """
    freq = members.groupBy("token").agg(F.count("*").alias("freq"))
    mine = Window.partitionBy("node")
    placed = members.join(freq, "token").withColumn("at", F.row_number().over(mine.orderBy("freq", "token"))).withColumn("has", F.count("*").over(mine))
    return keep(placed.where("at <= has - need + 1").select("token", "node", "need", "comp"), "rarest")


class _Units:
    """Rows (unit, side, node, comp, set), sorted by unit and side, cut into units: side 0 probes, side 1 is stored."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []
        for b in batches:
            units, sides, nodes, comps = (b.column(i).to_pylist() for i in range(4))
            for u, side, node, comp, s in zip(units, sides, nodes, comps, b.column(4)):
                if u != now:
                    out += self.links(rows)
                    now, rows = u, []
                rows.append((side, node, comp, np.frombuffer(s.as_buffer(), dtype=U64)))
            if len(out) > 1000:
                yield self.batch(out)
                out = []
        yield self.batch(out + self.links(rows))

    @staticmethod
    def batch(links: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    def links(self, rows: list) -> list[tuple[int, int]]:
        """A link for each pair of components that the unit shows to be connected, not for each similar pair."""
        stored = list({r[1]: r for r in rows if r[0] == 1}.values())
        probes = list({r[1]: r for r in rows if r[0] == 0}.values())
        if not stored or not probes:
            return []
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        trie, out = PrefixTrie([r[3] for r in stored]), []
        for _, node, comp, s in probes:
            for i, _ in trie.probe(s, self.num, self.den, lambda i, c=comp: find(stored[i][2]) == find(c)):
                a, b = find(comp), find(stored[i][2])
                if a != b:
                    up[max(a, b)] = min(a, b)
                    out.append((node, stored[i][1]))
        return out


def _verify(units: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``units(unit, side, node, comp)`` -> links found by the tries."""
    spark = units.sparkSession
    rows = units.join(sets, "node").select("unit", "side", "node", "comp", "set")
    dealt = rows.repartition(shuffle_partitions(spark), "unit").sortWithinPartitions("unit", "side")
    return keep(dealt.mapInArrow(_Units(num, den), "a long, b long"), "links")


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: Fraction | str = "0.8") -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``n_shingles`` (size of its set), ``component_id``.

    Words are runs of characters other than space and 09-0D; A-Z count as a-z. A set has the distinct shingles of ``k``
    words, or the whole sequence if the text has fewer words. Two rows are linked if the Jaccard similarity of their
    sets is at least ``similarity``; ``component_id`` is the smallest id among all rows reachable by links, itself
    included.

    Null or empty texts and texts without words have the empty set, are linked with nothing and are their own
    component. Repeated rows come back as often as they are there. Rows with a null id count like others, but no
    component is named after one: if all its ids are null, so is ``component_id``. Other columns are ignored, whatever
    their names. An empty table gives an empty result. Texts are taken whole at any length.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows, named = _components(own, k, similarity)
    out = rows.where("n > 0").join(small(named), "node").select("id", "n", "named")
    lone = rows.where("n = 0").select("id", "n", F.col("id").alias("named"))
    return out.unionByName(lone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("named").alias("component_id"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: Fraction | str = "0.8") -> DataFrame:
    """``docs`` with one row of each component (see ngram_jaccard_components): of those with its smallest id, the same in every run.

    Rows are told apart by id and shingle set, so that equal ids in different components stay apart. Rows without words
    or without an id stay. All columns must be orderable.
    """
    names, slim = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    key, text = slim[names.index(id_col)], slim[names.index(text_col)]
    own = docs.select(*[F.col(f"`{c}`").alias(s) for s, c in zip(slim, names)])
    own = own.withColumns({"id": F.col(key).cast("long"), "h": F.xxhash64(text), "g": F.xxhash64(text, F.lit(1))})
    rows, named = _components(own.select("id", F.col(text).cast("string").alias("text"), "h", "g"), k, similarity)
    mine = keep(rows.where("n > 0 and id is not null").groupBy("id", "h", "g", "node").count().join(named.select("node", "comp"), "node"), "mine")
    stays = mine.groupBy("comp").agg(F.min(F.struct("id", "node", "h", "g")).alias("first"), F.count("*").alias("several")).where("several > 1")
    gone = keep(mine.join(small(stays), "comp").where(F.struct("id", "node", "h", "g") != F.col("first")).select("id", "h", "g"), "gone")
    again = keep(mine.where("count > 1").select("id", "h", "g").join(small(gone), ["id", "h", "g"], "left_anti"), "again")
    marked = gone.unionByName(again)
    out = own.where("id is null").select(*slim).unionByName(own.where("id is not null").join(small(marked), ["id", "h", "g"], "left_anti").select(*slim))
    if not again.isEmpty():
        out = out.unionByName(own.join(small(again), ["id", "h", "g"], "left_semi").groupBy("id", "h", "g").agg(F.min(F.struct(*slim)).alias("row")).select("row.*"))
    return out.select(*[F.col(s).alias(c) for s, c in zip(slim, names)])


def _components(docs: DataFrame, k: int, similarity: Fraction | str) -> tuple[DataFrame, DataFrame]:
    """Of ``docs(id, text, ...)``: (id, ..., n, node) of every row, and (node, comp, named) of every set: its component and the smallest id in that."""
    short_batches(docs.sparkSession)
    ratio = Fraction(similarity)
    num, den = ratio.numerator, ratio.denominator
    extra = [f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[2:]]
    scanned = keep(docs.mapInArrow(_rows(k, num, den), ", ".join(["id long", *extra, "n long", "a long", "b long", "tokens array<long>"])), "rows")
    keys = keep(scanned.where("n > 0").groupBy("a", "b").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "keys")
    node = _node(keys)
    rows = scanned.withColumn("node", node)
    classes = keys.withColumn("node", node)

    each = rows.where("n > 0").select("node", F.explode("tokens").alias("token"))
    ends = each.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    shared = Bits(keep(ends.where("lo <> hi").select("token"), "shared"))
    links = None
    if not shared.empty:
        again = rows.where("n > 0").select("node", "n", "tokens").mapInArrow(_members(shared, num, den), "token long, node long, need long")
        members = _open(keep(again.distinct().withColumn("comp", F.col("node")), "members"))
        if not members.isEmpty():
            links = _links(docs, members, classes, k, num, den)
    named = classes.select("node", F.col("node").alias("comp"), F.col("id").alias("named"))
    if links is not None:
        labels = components(links)
        of = classes.join(labels, "node", "left").select("node", "id", F.coalesce("comp", "node").alias("comp"))
        named = of.join(of.groupBy("comp").agg(F.min("id").alias("named")), "comp").select("node", "comp", "named")
    return rows.drop("tokens", "a", "b"), keep(named, "named")


def _node(keys: DataFrame) -> Column:
    """The number of a set: the first half of its key, or where several sets share that (some in 10^11), a hash of both halves."""
    twice = [r.a for r in keys.groupBy("a").agg(F.min("b").alias("x"), F.max("b").alias("y")).where("x <> y").select("a").collect()]
    return F.when(F.col("a").isin(twice), F.xxhash64("a", "b")).otherwise(F.col("a")) if twice else F.col("a")


def _sets(docs: DataFrame, nodes: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """``(node, set)`` of each of ``nodes``, from a second scan that sends on one row of each set: the one with its class's id."""
    wanted = keep(classes.join(nodes.distinct(), "node", "left_semi").select("node", "a", "b", F.coalesce("id", F.lit(NO_ID)).alias("id")), "wanted")
    bits = Bits(wanted.select(F.col("a").bitwiseXOR(F.col("id")).alias("key")))
    found = docs.select("id", "text").mapInArrow(_wanted_sets(bits, k), "a long, b long, id long, set binary").dropDuplicates(["a", "b", "id"])
    return found.join(small(wanted), ["a", "b", "id"]).select("node", "set")


def _links(docs: DataFrame, members: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    sets = keep(_sets(docs, members.select("node"), classes, k), "sets")
    # 1. every member of a token with the one that has most copies, if they meet in half as many tokens as similar sets share
    ranked = members.join(classes.select("node", "copies"), "node")
    pivots = keep(ranked.groupBy("token").agg(F.max(F.struct("copies", "node"))["node"].alias("pivot")), "pivots")
    meet = members.join(pivots, "token").where("node <> pivot").groupBy("pivot", "node").agg(F.count("*").alias("has"), F.min("need").alias("need"))
    pairs = keep(meet.where("2 * has >= need").select("pivot", "node"), "pairs")
    chunks = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    chunks = keep(chunks, "chunks")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks").cast("long"))
    stored = pairs.join(chunks, "pivot").select(F.xxhash64("pivot", chunk).alias("unit"), F.lit(1).alias("side"), "node", F.col("node").alias("comp"))
    probes = chunks.select(F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c"), F.col("pivot").alias("node")).select(
        F.xxhash64("node", F.col("c").cast("long")).alias("unit"), F.lit(0).alias("side"), "node", F.col("node").alias("comp"))
    links = _verify(probes.unionByName(stored), sets, num, den)
    # 2. what can still be linked across components
    labels = components(links)
    placed = keep(members.drop("comp").join(labels, "node", "left").select("token", "node", "need", F.coalesce("comp", "node").alias("comp")), "placed")
    left = _rarest(_open(placed))
    if left.isEmpty():
        return links
    # tokens of one pivot have mostly the same members: together they are one group, in which each member is once
    inside = keep(left.join(pivots, "token").select("pivot", "node", "comp").distinct(), "inside")
    parts = inside.groupBy("pivot", "comp").agg(F.count("*").alias("size"))
    main = parts.groupBy("pivot").agg(F.max(F.struct("size", "comp"))["comp"].alias("main"), F.sum("size").alias("total"), F.max("size").alias("most"))
    block = lambda c: F.pmod(F.xxhash64("node", F.lit(7)), c)
    whole, rest = F.ceil(F.col("total") / CHUNK), F.ceil(F.greatest(F.col("total") - F.col("most"), F.lit(1)) / CHUNK)
    shaped = keep(main.where("total > most").select("pivot", "main", whole.cast("long").alias("blocks"), rest.cast("long").alias("probes")), "main")
    dealt = keep(inside.join(shaped, "pivot"), "dealt")
    unit = lambda i, j: F.xxhash64(F.col("pivot"), i, j).alias("unit")
    kept = dealt.select("pivot", "node", "comp", block(F.col("blocks")).alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("probes") - 1)).alias("i"))
    asked = dealt.where("comp <> main").select("pivot", "node", "comp", block(F.col("probes")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"))
    units = kept.select(unit(F.col("i"), F.col("j")), F.lit(1).alias("side"), "node", "comp").unionByName(
        asked.select(unit(F.col("i"), F.col("j")), F.lit(0).alias("side"), "node", "comp"))
    more = _verify(units, sets, num, den)
    return links.unionByName(more)
