"""Toxicity: a weighted lexicon, learnt from labelled documents, matched by Aho-Corasick on folded text.

Folding maps homoglyphs and digits that stand for letters to one letter each, character by character, and everything
that is neither letter nor digit to a blank. Lexicon terms are whole words and word beginnings; their weights are log
odds between toxic and other documents. Exception phrases (a term with the word before or behind it, seen in documents
without the label only) take a match back. What is left is summed up, normalised by length, and a logistic curve fitted
on the same labelled sample gives the score.
"""

from __future__ import annotations

import itertools
import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import keep, short_batches, small
from gridwright.llm.shingles import mix, pieces, shingle_sets

TRAIN_ROWS = 20_000  # labelled documents that the lexicon and the curve are fitted on, at most about
MIN_G = 15.0  # likelihood ratio (G) by which a term's documents must differ from all in their share of toxic ones; chance gives as much once in 10,000 terms
MIN_ODDS = 3.2
MIN_PHRASE = 3  # documents without the label that an exception phrase needs
STEMS = range(4, 9)  # letters of the word beginnings that may become terms

# Letters that look like a Latin one, by the letter they look like.
HOMOGLYPHS = {
    "a": "аαａ", "b": "ЬВ", "c": "сϲ", "d": "ԁ", "e": "еε", "g": "ɡ", "h": "һ", "i": "іιı", "j": "ј", "k": "κк", "m": "м", "n": "ո",
    "o": "оο", "p": "рρ", "s": "ѕ", "t": "тτ", "u": "υ", "v": "ν", "w": "ԝ", "x": "хχ", "y": "уγ",
}
# Digits and signs that are written for letters. One, l and i are one letter.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "l": "i"}
_INVISIBLE = "­​‌‍⁠﻿"


class _Fold(dict):
    """Table for str.translate, filled as characters come."""

    def __init__(self):
        super().__init__({ord(x): a for a, all_ in HOMOGLYPHS.items() for x in all_})
        self.update({ord(x): a for x, a in DIGITS.items()})
        self.update(dict.fromkeys(map(ord, _INVISIBLE), ""))
        self.update({0xFF41 + i: DIGITS.get(chr(97 + i), chr(97 + i)) for i in range(26)})

    def __missing__(self, c: int) -> str:
        x = chr(c)
        self[c] = out = x if x.isalnum() else " "
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """Folded text: words of letters between blanks, with a blank at both ends."""
    return f" {text.lower().translate(_FOLD)} "


class Lexicon:
    """Terms with weights and exception phrases in one automaton."""

    def __init__(self, terms: dict[str, float], phrases: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for t, w in terms.items():
            self.automaton.add_word(t, (len(t), w))
        for p in phrases:
            self.automaton.add_word(p, (len(p), 0.0))
        self.size = len(terms) + len(phrases)
        if self.size:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> tuple[dict[int, float], list[tuple[int, int]]]:
        """The strongest term that begins at each place, and the ranges of exception phrases."""
        terms: dict[int, float] = {}
        ranges = []
        if self.size:
            for end, (n, w) in self.automaton.iter(folded):
                if w:
                    at = end - n + 1
                    terms[at] = max(w, terms.get(at, 0.0))
                else:
                    ranges.append((end - n + 1, end))
        return terms, ranges

    def features(self, text: str) -> list[float]:
        """Summed weights after exceptions, their density by length, the number of hits, the strongest hit."""
        folded = fold(text)
        terms, ranges = self.hits(folded)
        if ranges:
            ranges.sort()
            ends = list(itertools.accumulate((b for _, b in ranges), max))  # the farthest end of all ranges that begin so far
            begins = [a for a, _ in ranges]
            terms = {at: w for at, w in terms.items() if not (n := bisect_right(begins, at)) or at >= ends[n - 1]}
        n = max(1, folded.count(" ") - 1)
        total = sum(terms.values())
        return [math.log1p(total), total / math.sqrt(n), math.log1p(len(terms)), max(terms.values(), default=0.0), min(1.0, len(terms) * 100 / n)]


N_FEATURES = 5


def _terms(words: set[str]) -> set[str]:
    """Whole words and word beginnings, with the blanks that mark a word's ends."""
    out = {f" {w} " for w in words}
    for w in words:
        out.update(f" {w[:n]}" for n in STEMS if n <= len(w))
    return out


def _counted(batches: Iterator[pa.RecordBatch], units) -> Iterator[pa.RecordBatch]:
    """Documents with each unit, by label, pre-aggregated: (unit, toxic, other)."""
    toxic, other = Counter(), Counter()

    def out() -> pa.RecordBatch:
        keys = list(toxic.keys() | other.keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([other[k] for k in keys], pa.int64())], ["unit", "toxic", "other"])

    for b in (p for whole in batches for p in pieces(whole)):
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            (toxic if label else other).update(units(fold(text or "")))
            if len(toxic) + len(other) > 500_000:
                yield out()
                toxic.clear(), other.clear()
    yield out()


def _word_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _counted(batches, lambda folded: _terms(set(folded.split())))


def _cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the least shingle hash of their text: near copies mostly share it."""
    for b in batches:
        least = [int(mix(s).min().astype(np.int64)) if len(s) else None for s in shingle_sets(b.column(0), 5)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(least, pa.int64())], ["text", "label", "cluster"])


def learn(labelled: DataFrame) -> tuple[dict[str, float], list[str]]:
    """Terms with weights and exception phrases from ``labelled(text, label)``.

    Of documents with the same least shingle hash one counts, so that a text with many near copies has one vote. Every
    term and phrase that tells enough is taken; their number is bounded by the words of the sample, TRAIN_ROWS documents.
    """
    one_each = labelled.mapInArrow(_cluster, "text string, label int, cluster long").where("cluster is not null").groupBy("cluster").agg(F.max(F.struct("label", "text")).alias("m"))
    sample = keep(one_each.select("m.text", "m.label"), "toxic-sample")
    sums = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    yes, no = sums.get(1, 0), sums.get(0, 0)
    if not yes or not no:
        return {}, []
    counts = sample.mapInArrow(_word_units, "unit string, toxic long, other long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (yes + 1.0)) - F.log((F.col("other") + 0.5) / (no + 1.0))
    seen = F.col("toxic") + F.col("other")
    part = lambda c, n: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) * (yes + no) / (seen * n))).otherwise(0.0)
    strong = counts.withColumn("odds", odds).where((2 * (part("toxic", yes) + part("other", no)) >= MIN_G) & (F.col("odds") >= MIN_ODDS))
    terms: dict[str, float] = {}
    for r in strong.orderBy(F.desc(F.col("toxic") * F.col("odds")), "unit").collect():  # a longer term adds nothing to a beginning of it that is about as telling
        if not any(terms.get(r.unit[:n], -1.0) >= r.odds - 1.0 for n in range(4, len(r.unit))):
            terms[r.unit] = round(r.odds, 6)
    phrases = sample.mapInArrow(_phrase_units(terms), "unit string, toxic long, other long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    found = phrases.where(f"toxic = 0 and other >= {MIN_PHRASE}").orderBy("unit").collect()
    return terms, [r.unit for r in found]


def _phrase_units(terms: dict[str, float]):
    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms, [])

        def around(folded: str) -> set[str]:
            out = set()
            for at in lexicon.hits(folded)[0]:
                end = folded.find(" ", at + 1)
                before = folded.rfind(" ", 0, at)
                behind = folded.find(" ", end + 1)
                if before >= 0 and at - before > 1:
                    out.add(folded[before : end + 1])
                if behind > end + 1:
                    out.add(folded[at : behind + 1])
            return out

        yield from _counted(batches, around)

    return units


def _features(terms: dict[str, float], phrases: list[str], weights: list[float] | None = None):
    """Columns of the input after the text, and the features, or with weights the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms, phrases)
        for b in (p for whole in batches for p in pieces(whole)):
            x = [lexicon.features(t or "") for t in b.column(0).to_pylist()]
            if weights is None:
                made = pa.array(x, pa.list_(pa.float64()))
            else:
                z = np.array(x, dtype=float).reshape(len(x), N_FEATURES) @ np.array(weights[1:]) + weights[0]
                made = pa.array(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], made], [*b.schema.names[1:], "made"])

    return run


class ToxicityModel:
    """Lexicon, exception phrases and the curve: ``score(docs)`` applies them."""

    def __init__(self, terms: dict[str, float], phrases: list[str], weights: list[float]):
        self.terms, self.phrases, self.weights = terms, phrases, weights

    def score(self, docs: DataFrame, text_col: str = "text", score_col: str = "score") -> DataFrame:
        """``docs`` with ``score_col`` (0 to 1) added; a column of that name is replaced. No shuffle.

        Null and empty texts score as a text without hits. Rows come back as often as they are there; other columns are
        passed on, whatever their names. An empty table stays empty. Texts are matched whole, at any length.
        """
        names = [c for c in docs.columns if c != score_col]
        rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("t"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
        shape = ", ".join([*(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names)), "made double"])
        made = rows.mapInArrow(_features(self.terms, self.phrases, self.weights), shape)
        return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("made").alias(score_col))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit a model on the labelled documents whose crc32(id) mod 3 isn't 1, on about TRAIN_ROWS of them at most.

    Rows with a null label or id are left out; an id with several labels is toxic if one of them says so. Without
    documents of both kinds the model scores every text by the share of toxic labels, 0 if there are none.
    """
    short_batches(docs.sparkSession)
    own = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label is not null and _id is not null")
    own = own.where(F.crc32(F.col("_id").cast("string")) % 3 != 1).groupBy("_id").agg(F.max("label").alias("label"))
    n = own.count()
    share = min(1.0, TRAIN_ROWS / max(1, n))
    own = own.where(F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sample = keep(texts.join(small(own), "_id").select("text", (F.col("label") > 0).cast("int").alias("label")), "toxic-labelled")
    terms, phrases = learn(sample)
    sums = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    yes, no = sums.get(1, 0), sums.get(0, 0)
    if not yes or not no:
        base = yes / (yes + no) if yes + no else 0.0
        return ToxicityModel({}, [], [40.0 if base else -40.0, *[0.0] * N_FEATURES])
    x = sample.mapInArrow(_features(terms, phrases), "label int, made array<double>").select("label", array_to_vector("made").alias("features"))
    fit = LogisticRegression(labelCol="label", regParam=0.001, maxIter=50).fit(x)
    return ToxicityModel(terms, phrases, [float(fit.intercept), *map(float, fit.coefficients)])
