"""Benchmark decontamination: item-sized windows of documents, compared with the items by weighted shingles.

Items come in blocks of bounded size; a block's index is broadcast and every document meets it in its own task, so
no document is shuffled. Weights are counted over all items first, so blocks change no result. The similarity of a window and an item is the weight of the shingles they share, over the larger of
their two weights. It reaches SIMILARITY only if the shared weight is that part of the item's weight, which gives two
filters that lose nothing: a document meets the items of which all its distinct shingles together hold enough, and of
its windows those are verified whose shared shingles, repeats counted, weigh enough.

The items that a document can hold by the first filter are looked up by the SimHash fingerprints of its windows in
multi-index Hamming blocks (``ItemIndex.within``); the nearest window of each is verified. A few windows of similarity
0.8 lie outside the radius, so the second filter then finds what fingerprints left out, and nothing is lost.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import short_batches
from gridwright.llm.shingles import IS_PUNCT, U64, Words, shingle_hashes, slices

K = 5  # words in a shingle
SIMILARITY = 0.8
RADIUS = 19
BLOCKS = 4
ITEM_BLOCK = 1_000  # items in an index
WINDOWS = 4_096  # starts of windows whose fingerprints are made at once
BLOCK_BYTES = 8 << 20  # of their text: an index is broadcast, and so bounded

_SLACK = 1e-12  # of sums, by rounding
_BITS = 64 // BLOCKS
_MASK = (1 << _BITS) - 1


def _masks(bits: int) -> np.ndarray:
    """All _BITS-bit values with ``bits`` bits set at most."""
    return np.array([sum(1 << b for b in c) for n in range(bits + 1) for c in itertools.combinations(range(_BITS), n)], dtype=np.int64)


def _signs(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """n x 64: plus or minus the weight, in whole millionths, by each bit; so sums that are 0 are 0 in any order."""
    bits = (hashes[:, None] >> np.arange(64, dtype=U64)[None]) & U64(1)
    whole = np.rint(weights * 1e6).astype(np.int64)[:, None]
    return np.where(bits == 1, whole, -whole)


def _pack(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(U64) << np.arange(64, dtype=U64)[None]).sum(1, dtype=U64)


def item_words(texts: list[str]) -> list[np.ndarray]:
    out = []
    for i, j, data, offsets in slices(pa.array(texts, pa.string())):
        w = Words(data, offsets, IS_PUNCT)
        out += [w.hashes[w.first[t] : w.first[t + 1]] for t in range(j - i)]
    return out


class ItemIndex:
    """Items with their weighted shingles, fingerprints, and block tables.

    A shingle weighs log(1 + items / items that have it): one that many items share tells little. Shingles that no item
    has weigh like those that one has. Items are those of the whole benchmark if ``shared`` has its counts (see
    ``_shared``), else the given ones.
    """

    def __init__(self, ids: list, texts: list[str], shared: tuple[int, np.ndarray, np.ndarray] | None = None):
        words = item_words(texts)
        live = [i for i, w in enumerate(words) if len(w)]
        self.ids = [ids[i] for i in live]
        self.length = np.array([len(words[i]) for i in live], dtype=np.int64)
        self.shingles = [np.unique(shingle_hashes(words[i], K)) for i in live]
        self.known, count = np.unique(np.concatenate(self.shingles) if live else np.zeros(0, U64), return_counts=True)
        n, self.common, count = (len(live), self.known[count > 1], count[count > 1]) if shared is None else shared
        self.common_weight = np.array([math.log(1 + n / c) for c in count.tolist()])
        self.plain = math.log(1 + max(1, n))
        self.weight = np.array([self.weigh(s).sum() for s in self.shingles])
        self.own = [np.searchsorted(self.known, s) for s in self.shingles]  # places in known
        having = np.concatenate(self.own) if live else np.zeros(0, np.int64)
        self.holders = np.repeat(np.arange(len(live)), [len(s) for s in self.own])[np.argsort(having, kind="stable")]
        self.held = np.searchsorted(np.sort(having), np.arange(len(self.known) + 1))  # known shingle x: holders[held[x] : held[x + 1]]

    def weigh(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.full(len(hashes), self.plain)
        at = np.minimum(np.searchsorted(self.common, hashes), len(self.common) - 1)
        return np.where(self.common[at] == hashes, self.common_weight[at], self.plain)

    @functools.cached_property
    def prints(self) -> np.ndarray:
        """The items' fingerprints: 64 signs of the summed weights of their shingles."""
        return np.concatenate([_pack(_signs(s, self.weigh(s)).sum(0)[None]) for s in self.shingles]) if self.ids else np.zeros(0, U64)

    @functools.cached_property
    def tables(self) -> list[np.ndarray]:
        """For each block, by its value, a row of bits: items with a block value within RADIUS // BLOCKS bits."""
        near, out = _masks(RADIUS // BLOCKS), []
        for b in range(BLOCKS):
            t = np.zeros((1 << _BITS, -(-len(self.ids) // 8)), dtype=np.uint8)
            for i, p in enumerate(((self.prints >> U64(b * _BITS)) & U64(_MASK)).astype(np.int64)):
                t[near ^ p, i >> 3] |= 1 << (i & 7)
            out.append(t)
        return out

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs of fingerprints within RADIUS bits."""
        hit = self.tables[0][(prints & U64(_MASK)).astype(np.int64)].copy()
        for b in range(1, BLOCKS):
            hit |= self.tables[b][((prints >> U64(b * _BITS)) & U64(_MASK)).astype(np.int64)]
        w, i = np.nonzero(np.unpackbits(hit, axis=1, count=len(self.ids), bitorder="little"))
        d = np.bitwise_count(prints[w] ^ self.prints[i])
        return w[d <= RADIUS], i[d <= RADIUS]

    def leaks(self, words: np.ndarray, one: bool = False) -> list[tuple[int, int, int, float]]:
        """(item, first word, end word, similarity) of each item's best window in a text of these words, the first of equals.

        Fingerprints propose a window for each item, which is verified; the exact bound then looks at the windows that
        may be better, and for items of which no window was near enough. ``one``: any item will do, if there is one.
        """
        n, out, later = len(words), [], []
        if not n or not self.ids:
            return []
        for k in np.unique(np.minimum(K, self.length)).tolist():
            if n < k:
                continue
            h = shingle_hashes(words, k)
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            hit = np.flatnonzero(self.known[at] == h)
            places = hit[np.argsort(at[hit], kind="stable")]  # of known shingles, by shingle and then in order
            there = at[places]
            able = [i for i in self._reached(np.unique(there)) if min(K, self.length[i]) == k]
            found = self.proposed(h, n, k, able, hit)
            if one and found:
                i, (similarity, start) = next(iter(found.items()))
                return [(i, -start, min(int(self.length[i]) - start, n), similarity)]  # start is negative
            later += [(h, n, k, i, places, there, found.get(i, (0.0, 0))) for i in able]
        for x in later:
            best = self._best(*x)
            if best is not None:
                out.append(best)
                if one:
                    break
        return sorted(out)

    def proposed(self, h: np.ndarray, n: int, k: int, able: list[int], hit: np.ndarray) -> dict[int, tuple[float, int]]:
        """{item: (similarity, -start)} of the nearest window to an item by fingerprints, within RADIUS bits, that is similar indeed.

        Windows are as long as one of the items ``able`` and hold a known shingle (places ``hit``). A window's fingerprint is that of its
        shingles, repeats counted, from running sums of their signs over pieces of bounded length.
        """
        near: dict[int, list[tuple[int, int]]] = {}
        has = np.concatenate([[0], np.cumsum(np.bincount(hit, minlength=len(h)))])
        for size in sorted({int(self.length[i]) for i in able}):
            span, last = min(size, n) - k + 1, max(0, n - size)
            starts = np.flatnonzero(has[span : span + last + 1] > has[: last + 1])
            mine = [i for i in able if self.length[i] == size]
            while len(starts):
                low = int(starts[0])
                now, starts = np.split(starts, [np.searchsorted(starts, low + WINDOWS)])
                piece = h[low : int(now[-1]) + span]
                sums = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(_signs(piece, self.weigh(piece)), axis=0)])
                prints = _pack(sums[now - low + span] - sums[now - low])
                w, i = self.within(prints)
                far = np.bitwise_count(prints[w] ^ self.prints[i])
                for item in mine:
                    of = i == item
                    near.setdefault(item, []).extend(zip(far[of].tolist(), now[w[of]].tolist()))
        found = {}
        for item, windows in near.items():
            span = min(int(self.length[item]), n) - k + 1
            tried = ((self._similarity(h[start : start + span], item), -start) for _, start in sorted(windows))
            first = next((x for x in tried if x[0] >= SIMILARITY), None)
            if first:
                found[item] = first
        return found

    def _similarity(self, window: np.ndarray, i: int) -> float:
        """The exact weighted similarity of a window's shingles and an item's."""
        mine = np.unique(window)
        both = mine[np.isin(mine, self.shingles[i], assume_unique=True)]
        return float(self.weigh(both).sum() / max(self.weigh(mine).sum(), float(self.weight[i])))

    def _reached(self, mine: np.ndarray) -> list[int]:
        """Items of whose weight these known shingles hold enough."""
        counts = self.held[mine + 1] - self.held[mine]
        if not counts.sum():
            return []
        at = np.repeat(self.held[mine] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        shared = np.bincount(self.holders[at], np.repeat(self.weigh(self.known[mine]), counts), len(self.ids))
        return np.flatnonzero(shared >= SIMILARITY * self.weight * (1 - _SLACK)).tolist()

    def _best(self, h: np.ndarray, n: int, k: int, i: int, places: np.ndarray, there: np.ndarray, best: tuple[float, int]) -> tuple[int, int, int, float] | None:
        """The best window by the exact bound; ``best`` is (similarity, -start) of one that is known, or (0, 0)."""
        size, weight = int(self.length[i]), float(self.weight[i])
        span, last = min(size, n) - k + 1, max(0, n - size)
        low, high = np.searchsorted(there, self.own[i]), np.searchsorted(there, self.own[i], side="right")
        p = np.sort(np.concatenate([places[a:b] for a, b in zip(low.tolist(), high.tolist())]))
        # windows that hold a shared shingle: the union of the starts in reach of each
        a, b = np.maximum(0, p - span + 1), np.minimum(p, last)
        new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1] + 1]))
        ends = np.append(new[1:], len(p)) - 1
        starts = np.concatenate([np.arange(x, y + 1) for x, y in zip(a[new].tolist(), b[ends].tolist())])
        sums = np.concatenate([[0.0], np.cumsum(self.weigh(h[p]))])
        most = sums[np.searchsorted(p, starts + span)] - sums[np.searchsorted(p, starts)]
        most = most / weight + _SLACK * (1 + sums[-1] / weight)
        starts, most = starts[most >= SIMILARITY], most[most >= SIMILARITY]
        for x in np.argsort(-most, kind="stable").tolist():
            start = int(starts[x])
            if most[x] < best[0]:
                break
            if best[0] >= 1 and start > -best[1]:
                continue
            s = self._similarity(h[start : start + span], i)
            if s >= SIMILARITY:
                best = max(best, (s, -start))
        return (i, -best[1], min(size - best[1], n), best[0]) if best[0] else None


def _scan(block, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(*block.value, shared.value)
        for batch in batches:
            found: list[list] = [[], [], [], [], []]
            row = 0
            for i, j, data, offsets in slices(batch.column(1)):
                w = Words(data, offsets, IS_PUNCT)
                hit = _documents_with(index, w)
                for t in hit:
                    for item, a, b, s in index.leaks(w.hashes[w.first[t] : w.first[t + 1]]):
                        for x, v in zip(found, (row + int(t), index.ids[item], a, b, s)):
                            x.append(v)
                row += j - i
            rows = batch.column(0).take(pa.array(found[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, pa.array(found[1], pa.int64()), pa.array(found[2], pa.int32()), pa.array(found[3], pa.int32()), pa.array(found[4], pa.float64())], ["rid", "item_id", "first_word", "end_word", "similarity"])

    return run


def _documents_with(index: ItemIndex, w: Words) -> np.ndarray:
    """Texts of a slice that hold a shingle of any item."""
    n, at = len(w.hashes), []
    if not n or not len(index.known):
        return np.zeros(0, dtype=np.int64)
    for k in {K, *index.length[index.length < K].tolist()}:
        if n >= k:
            h = shingle_hashes(w.hashes, k)
            p = np.flatnonzero(index.known[np.minimum(np.searchsorted(index.known, h), len(index.known) - 1)] == h)
            at.append(np.searchsorted(w.first, p, side="right") - 1)
    return np.unique(np.concatenate(at)) if at else np.zeros(0, dtype=np.int64)


def _own(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return items.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.lower(F.col(f"`{text_col}`").cast("string")).alias("t")).where("t is not null")


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each item, and a null for each item with words."""
    for batch in batches:
        for i, j, data, offsets in slices(batch.column(0)):
            w = Words(data, offsets, IS_PUNCT)
            sets = [np.unique(shingle_hashes(w.hashes[w.first[t] : w.first[t + 1]], K)).view(np.int64) for t in range(j - i)]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([*map(pa.array, sets), pa.nulls(sum(len(x) > 0 for x in sets), pa.int64())])], ["h"])


def _shared(items: DataFrame, id_col: str, text_col: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Of the whole benchmark: the number of items with words, the shingles that several have, sorted, and how many have each."""
    short_batches(items.sparkSession)
    got = _own(items, id_col, text_col).select("t").mapInArrow(_shingles, "h long").groupBy("h").agg(F.count("*").alias("n"))
    got = got.where("n > 1 or h is null").select(F.coalesce("h", F.lit(0)).alias("h"), "n", F.col("h").isNull().alias("items")).toPandas()
    total, many = got[got["items"]], got[~got["items"]]
    h, n = many["h"].to_numpy().astype(np.int64).view(U64), many["n"].to_numpy().astype(np.int64)
    order = np.argsort(h)
    return int(total["n"].sum()), h[order], n[order]


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    """The items, a block of bounded size at a time."""
    short_batches(items.sparkSession)
    ids, texts, held = [], [], 0
    own = _own(items, id_col, text_col)
    for i, t in own.toLocalIterator():
        if ids and (len(ids) == ITEM_BLOCK or held + len(t) > BLOCK_BYTES):
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(i)
        texts.append(t)
        held += len(t)
    if ids:
        yield ids, texts


LEAKS = "rid long, item_id long, first_word int, end_word int, similarity double"


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``id_col, item_id, first_word, end_word, similarity``: each benchmark item that a document holds, with its best window.

    Words are runs of letters and digits, in either case. A window has as many words as the item; shingles have K words, or
    all of an item with fewer. Weighted similarity of SIMILARITY or more is a leak. Documents without leaks give no
    rows.

    Null or empty texts hold nothing; null or wordless items are left out. Repeated documents or items give repeated
    rows; ids may be null. Other columns are ignored, whatever their names. Empty tables give an empty result. Texts
    are taken whole at any length.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("rid"), F.lower(F.col(f"`{text_col}`").cast("string")).alias("text"))
    shape = LEAKS.replace("rid long", f"rid {rows.schema['rid'].dataType.simpleString()}")
    out, shared = None, spark.sparkContext.broadcast(_shared(items, item_id_col, item_text_col))
    for block in _blocks(items, item_id_col, item_text_col):
        part = rows.mapInArrow(_scan(spark.sparkContext.broadcast(block), shared), shape)
        out = part if out is None else out.unionByName(part)
    out = spark.createDataFrame([], shape) if out is None else out
    return out.withColumnRenamed("rid", id_col)


def _clean(block, shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(*block.value, shared.value)
        for batch in batches:
            leaky = set()
            row = 0
            for i, j, data, offsets in slices(batch.column(len(names) - 1)):
                w = Words(data, offsets, IS_PUNCT)
                leaky.update(row + int(t) for t in _documents_with(index, w) if index.leaks(w.hashes[w.first[t] : w.first[t + 1]], one=True))
                row += j - i
            stay = pa.array([r not in leaky for r in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(stay) for c in batch.columns], names)

    return run


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; see find_leaks. One scan for each block of items, no shuffle."""
    names = docs.columns
    slim = [f"c{i}" for i in range(len(names))]
    shape = ", ".join([*(f"{s} {docs.schema[c].dataType.simpleString()}" for s, c in zip(slim, names)), "low string"])
    out = docs.select(*[F.col(f"`{c}`").alias(s) for s, c in zip(slim, names)], F.lower(F.col(f"`{text_col}`").cast("string")).alias("low"))
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(_shared(items, item_id_col, item_text_col))
    for block in _blocks(items, item_id_col, item_text_col):
        out = out.mapInArrow(_clean(context.broadcast(block), shared, [*slim, "low"]), shape)
    return out.select(*[F.col(s).alias(c) for s, c in zip(slim, names)])
