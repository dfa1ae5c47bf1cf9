"""Names that are alike: block ratios and the filtered join against all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from gridwright.functions.similarity import blocks_ratio, candidates, name_ratio, without_repeats


def some_names(seed, n, letters="абвг eё"):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        if out and r.random() < 0.6:  # an edited copy
            x = list(r.choice(out))
            for _ in range(r.randint(1, 3)):
                at = r.randint(0, len(x))
                x[at : at + r.randint(0, 1)] = r.choice([[], [r.choice(letters)]])
            out.append("".join(x))
        else:
            out.append("".join(r.choices(letters, k=r.randint(0, 24))))
    return out


def ratio(a, b):
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def test_ratio_is_that_of_matching_blocks():
    names = some_names(1, 60) + ["", "a", "ab" * 150, "ba" * 140 + "xyz", "q" * 250]
    for a in names:
        for b in names:
            assert blocks_ratio(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)


@pytest.mark.parametrize("least", [0.95, 0.85, 0.7, 0.6])
def test_no_pair_is_missed_and_none_is_nested(spark, least):
    names = sorted({*some_names(2, 150), *some_names(3, 60, "ab"), "A", "a", "AB", "ab", "ac", "abc", ""})
    df = spark.createDataFrame([(k, x) for x in names for k in (0, 1)] + [(0, None)], "key int, name string")
    found = candidates(df, least)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {(r.name, r.other) for r in found.where(name_ratio("name", "other") >= least).where("key = 1").collect()}
    assert got == {(a, b) for a in names for b in names if ratio(a, b) >= least}


def test_repeats_with_a_hot_amount(spark):
    r = random.Random(9)
    rows = [(i, x, r.choice([0, 0, 0, 5, None])) for i, x in enumerate(some_names(4, 160))] + [(900, None, 0), (901, "абв", 0), (902, None, 0)]
    gone = {a for a, x, m in rows for b, y, n in rows if a < b and x is not None and y is not None and (ratio(x, y) >= 0.95 or ratio(x, y) >= 0.85 and m is not None and m == n)}
    got = without_repeats(spark.createDataFrame(rows, "id int, name string, amount int"))
    assert {x.id for x in got.collect()} == {a for a, _, _ in rows} - gone
    assert without_repeats(got.limit(0)).count() == 0


def test_near_names_meet_once_each_not_part_by_part(spark, tmp_path):
    """60,000 parts of four names: 1.8e9 pairs of parts, sixteen of names."""
    import time

    from gridwright.plans.facts import near_names

    names = ["small bolt", "small bolts", "small belt", "fmall bolt"]
    spark.range(60_000).selectExpr("id AS p_partkey", f"element_at(array({', '.join(map(repr, names))}), CAST(if(id < 59999, id % 3, 3) AS INT) + 1) AS p_name").write.parquet(f"{tmp_path}/part.parquet")
    start = time.monotonic()
    got = near_names(spark, str(tmp_path))
    assert got.count() == got.distinct().count() == 59_998  # the last part of its beginning and the one that begins otherwise have none
    assert time.monotonic() - start < 60
