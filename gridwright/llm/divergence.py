"""Source divergence audit: how far the term counts of each two sources of a language lie apart, by run-length columns.

Counts are pre-aggregated by (language, source, term) in each task. A language's kept terms are dealt to blocks of terms
with about the same count, so that equal counts meet, and each block is one matrix of terms by sources of bounded size.
In a block terms are sorted column by column, columns with few different counts first (the order that run-length encoding
is known to like), each column is run-length encoded, and for two sources the run boundaries are intersected: on a piece
where both counts stay the same, ``f`` is worked out once and multiplied by the piece's length. Sums over blocks are the
pairs' values; the best terms of a source are the best of its blocks' best.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm.common import keep, short_batches
from gridwright.llm.shingles import pieces

CELLS = 1 << 21  # terms times sources of a block, about
LEAST_DOCS = 10
SCALE = 1_000_000_000
BEST = 10
#: A-Z lower-cased, other ASCII characters but a-z are blanks, all of UTF-8 beyond ASCII stays.
_TO = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of what comes in, pre-aggregated."""
    n: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in n.items():
            within, k = docs[lang, source], len(own)
            cols = [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(list(own), pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(list(own.values()), pa.int64()), pa.array([within[t] for t in own], pa.int64())], ["lang", "source", "term", "n", "docs"])
        n.clear(), docs.clear()

    held = 0
    for b in (p for whole in batches for p in pieces(whole)):
        for text, lang, source in zip(*(c.to_pylist() for c in b.columns)):
            terms = text.translate(_TO).split()
            own = n.setdefault((lang, source), Counter())
            held -= len(own)
            own.update(terms)
            held += len(own)
            docs.setdefault((lang, source), Counter()).update(set(terms))
            if held > 1_000_000:
                yield from out()
                held = 0
    yield from out()


def _probabilities(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """p of each count, exact: Python integers, one for each distinct count."""
    distinct, at = np.unique(counts, return_inverse=True)
    return np.array([1 + SCALE * (int(c) + 2) // (n + 2 * v) for c in distinct], np.int64)[at]


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)). Both are at most SCALE + 1, so the square fits in 63 bits."""
    d = p - q
    return d * d // (p + q)


def runs(column: np.ndarray) -> np.ndarray:
    """First places of the runs of equal neighbours."""
    return np.concatenate([[0], np.flatnonzero(np.diff(column)) + 1])


def pair_sum(p: np.ndarray, at_p: np.ndarray, q: np.ndarray, at_q: np.ndarray, length: int) -> int:
    """Sum of ``divergence`` over two run-length columns of ``length`` places: values and first places of their runs."""
    cuts = np.union1d(at_p, at_q)
    left, right = p[np.searchsorted(at_p, cuts, side="right") - 1], q[np.searchsorted(at_q, cuts, side="right") - 1]
    return int((divergence(left, right) * np.diff(cuts, append=length)).sum())


_BLOCK = "lang string, source string, part string, item string, value long"


def _block(terms: pa.Table, groups: pa.Table) -> pa.Table:
    """Partial pair sums (source before item) and the best terms of each source in a block of one language.

    ``terms(lang, block, term, n, entries)`` with (source, count) entries and the language's count, and
    ``groups(lang, block, source, n, v)`` with each source's total, the language's under a null source.
    """
    out: list[tuple] = []
    if terms.num_rows and groups.num_rows:
        lang, v = terms["lang"][0].as_py(), groups["v"][0].as_py()
        totals = dict(zip(groups["source"].to_pylist(), groups["n"].to_pylist()))
        whole = totals.pop(None)
        names = sorted(totals)
        index = {s: i for i, s in enumerate(names)}
        entries = terms["entries"].combine_chunks()
        entries = entries.combine_chunks() if isinstance(entries, pa.ChunkedArray) else entries
        row = np.repeat(np.arange(terms.num_rows), entries.value_lengths().to_numpy())
        flat = entries.flatten()
        col = np.array([index[s] for s in flat.field("source").to_pylist()], np.int64)
        counts = np.zeros((len(names), terms.num_rows), np.int64)
        counts[col, row] = flat.field("n").to_numpy()
        # Equal counts are brought together, column after column, columns with few different counts first.
        by = sorted(range(len(names)), key=lambda i: (len(np.unique(counts[i])), i), reverse=True)
        order = np.lexsort([counts[i] for i in by])
        counts = counts[:, order]
        starts = [runs(c) for c in counts]
        values = [_probabilities(c[s], totals[names[i]], v) for i, (c, s) in enumerate(zip(counts, starts))]
        length = terms.num_rows
        for i, a in enumerate(names):
            for j in range(i + 1, len(names)):
                out.append((lang, a, "pair", names[j], pair_sum(values[i], starts[i], values[j], starts[j], length)))
        words = terms["term"].to_pylist()
        q = _probabilities(terms["n"].to_numpy()[order], whole, v)
        for i, a in enumerate(names):
            p = np.repeat(values[i], np.diff(starts[i], append=length))
            at = np.flatnonzero((counts[i] > 0) & (p > q))
            f = divergence(p[at], q[at])
            if len(at) > BEST:  # ties with the last of the best stay, bytes of the term decide below
                least = np.partition(f, -BEST)[-BEST]
                at, f = at[f >= least], f[f >= least]
            best = sorted((-int(x), words[order[k]].encode()) for x, k in zip(f, at))[:BEST]
            out.extend((lang, a, "term", t.decode(), -x) for x, t in best)
    cols = list(zip(*out)) if out else [[]] * 5
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["lang", "source", "part", "item", "value"])


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): how far a source lies from the others, and its most telling terms.

    Part ``pair`` has every other source of the language with the sum of ``f`` over all kept terms, part ``term`` the up to
    ten terms that the source has relatively more often than its language. Counts and sums are exact.

    A null text, language or source is an empty one. Every row is a document, whatever its id, so repeated rows count as
    often as they are there; other columns are not read. A source without terms is compared as any other, with counts
    of 0; languages without kept terms have pairs of value 0; a language with one source has no pairs. Texts are read
    whole at any length. An empty table gives no rows.
    """
    short_batches(docs.sparkSession)
    read = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    units = read.select(F.col("text").cast("binary").alias("text"), "lang", "source").mapInArrow(_units, "lang string, source string, term string, n long, docs long")
    # One shuffle, by term, serves both groupings.
    counts = units.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("entries"))
    kept = keep(by_term.where(F.col("docs") >= LEAST_DOCS).select("lang", "term", "n", "entries", F.floor(F.log2("n")).cast("int").alias("level")), "divergence-kept")

    sums = kept.select("lang", F.explode("entries").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("n"))
    sources = keep(read.select("lang", "source").distinct(), "divergence-sources")
    per_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("all"))
    of_lang = sources.groupBy("lang").agg(F.count("*").alias("sources")).join(per_lang, "lang", "left").select("lang", "sources", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("all", F.lit(0)).alias("all"))
    groups = sources.join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")).unionByName(of_lang.select("lang", F.lit(None).cast("string").alias("source"), F.col("all").alias("n")))
    groups = keep(groups.join(of_lang.select("lang", "v"), "lang"), "divergence-groups")

    # Terms of one level are dealt to so many blocks that a block's matrix has about CELLS cells.
    parts = kept.groupBy("lang", "level").agg(F.count("*").alias("terms")).join(of_lang.select("lang", "sources"), "lang").select("lang", "level", F.ceil(F.col("terms") * F.col("sources") / CELLS).cast("int").alias("parts"))
    name = F.concat_ws("-", "level", "part")
    blocks = kept.join(parts, ["lang", "level"]).withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts"))).select("lang", name.alias("block"), "term", "n", "entries")
    named = parts.select("lang", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "level").select("lang", name.alias("block"))
    all_groups = groups.join(named, "lang").select("lang", "block", "source", "n", "v")
    found = keep(blocks.groupBy("lang", "block").cogroup(all_groups.groupBy("lang", "block")).applyInArrow(_block, _BLOCK), "divergence-blocks")

    half = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    whole = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    asked = groups.where("source is not null").select("lang", "source")
    every = asked.join(asked.withColumnRenamed("source", "item"), "lang").where("source <> item")
    pairs = every.join(whole, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)
