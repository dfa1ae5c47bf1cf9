"""Positions of regular-expression matches in whole texts, as Column expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0), lambda a, x: a + x)


def _sum_before(sizes: Column, blocks: Column, i: Column) -> Column:
    b = (i / _BLOCK).cast("int")
    return _total(F.slice(blocks, F.lit(1), b)) + _total(F.slice(sizes, b * _BLOCK + 1, i % _BLOCK))


def matches(text: Column, pattern: str, around: int = 0) -> Column:
    """array<struct<start int, end int, hit string, left string, right string>> of the leftmost non-overlapping matches.

    Positions count code points from 0, the end is exclusive. ``left`` and ``right`` have up to ``around`` characters
    between this match and its neighbours. The match sizes are summed in blocks, so that a text with very many matches
    costs little more than its length. A pattern must not match the empty string. A null text has no matches.
    """

    def place(z: Column) -> Column:
        sizes = F.zip_with(z["rest"], z["hits"], lambda r, h: F.char_length(r) + F.coalesce(F.char_length(h), F.lit(0)))

        def sums(q: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), ((F.size(q) - 1) / _BLOCK).cast("int")), lambda b: _total(F.slice(q, b * _BLOCK + 1, F.lit(_BLOCK))))
            return let(blocks, lambda bl: F.transform(z["hits"], lambda h, i: let(
                _sum_before(q, bl, i) + F.char_length(z["rest"][i]),
                lambda s: F.struct(s.alias("start"), (s + F.char_length(h)).alias("end"), h.alias("hit"), *(
                    (F.right(z["rest"][i], F.lit(around)).alias("left"), F.left(z["rest"][i + 1], F.lit(around)).alias("right")) if around else ())))))

        return let(sizes, sums)

    both = F.struct(F.split(text, pattern, -1).alias("rest"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    kind = "array<struct<start:int,end:int,hit:string" + (",left:string,right:string" if around else "") + ">>"
    none = F.array().cast(kind)
    return F.when(text.rlike(pattern), let(both, place)).otherwise(none).cast(kind)


def joined(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of array<struct<start, k, end>>, by start, then kind, joined by commas; k counts ``kinds`` from 0."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["k"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def kind_of(found: Column, k: int) -> Column:
    """Matches of one kind as array<struct<start, k, end>>."""
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("k"), m["end"].alias("end")))


def overlaps(spans: Column, s: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
