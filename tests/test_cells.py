"""The cell index: the same as comparing everything, with fewer distances where vectors lie in clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.operators import cells
from gridwright.operators.cells import CellIndex
from gridwright.operators.retrieval import expanded, faq_by_vector, nearest

VECTORS = "id long, v array<double>, label int"


def brute(rows, queries, k, fits=lambda r: True):
    out = {}
    for q, x in queries:
        x = np.array(x, float)
        scored = []
        for r in rows:
            if fits(r):
                y = np.array(r[1], float)
                n = np.linalg.norm(x) * np.linalg.norm(y)
                scored.append((-round(float(x @ y / n) if n else 0.0, 9), r[0]))
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query, r["rank"])):
        out.setdefault(r.query, []).append(r.id)
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 8)) * 10
    v = [(int(i), (centres[i % 30] + rng.normal(size=8) * 0.2).tolist(), int(i % 3)) for i in range(900)]
    v += [(1000 + i, v[7][1], 1) for i in range(450)]  # one vector a third of all times
    return [*v, (5000, [0.0] * 8, 0), (5001, [0.0] * 8, 2)]


def test_equal_to_all_pairs_and_fewer_distances(spark, clustered, monkeypatch):
    monkeypatch.setattr(cells, "ROWS", 64), monkeypatch.setattr(cells, "ASKED", 16)  # several blocks
    queries = [(i, clustered[i][1]) for i in range(0, 900, 20)] + [(-1, [0.0] * 8), (-2, [1.0] * 8)]
    df, asked = spark.createDataFrame(clustered, VECTORS), spark.createDataFrame(queries, "query long, q array<double>")
    index = CellIndex.of(df)
    assert index.built and not CellIndex.of(df).built
    for k in (1, 7):
        assert found(index.search(asked, k)) == brute(clustered, queries, k)
    filtered = found(index.search(asked, 5, F.col("label") == 2))
    assert filtered == brute(clustered, queries, 5, lambda r: r[2] == 2)
    # What is compared: the nearest cells, and those that the floors leave.
    many = asked.where("query >= 0")
    first = index.first(many)
    size = dict(zip(index.cells.tolist(), index.sizes.tolist()))
    rest = index.rest(many, index._meet(first, index.rows.select("cell", "id", "v", F.lit(-2.0).alias("least")), 7), 7)
    compared = sum(size[r.cell] for r in first.unionByName(rest).collect())
    print(f"{compared} of {45 * len(clustered)} distances")
    assert compared < 0.4 * 45 * len(clustered)


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 0), (2, None, 0), (3, [1.0, None], 0), (4, [nan, 1.0], 0), (5, [1.0, 2.0, 3.0], 0), (6, [], 0), (7, [0.0, 2.0], 0), (7, [0.0, 2.0], 0)]
    df = spark.createDataFrame(rows, VECTORS)
    asked = spark.createDataFrame([(0, [2.0, 1.0]), (1, None), (2, [1.0]), (3, [0.0, 0.0])], "query int, q array<double>")
    assert found(nearest(df, asked, 9)) == {0: [1, 7, 7], 3: [1, 7, 7]}
    assert nearest(df.limit(0), asked, 3).count() == 0 and nearest(df, asked.limit(0), 3).count() == 0
    assert nearest(df, asked, 3, F.lit(False)).count() == 0


def test_any_number_of_queries(spark):
    df = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i)], 0) for i in range(60)], VECTORS)
    asked = spark.range(25_000).select(F.col("id").alias("query"), F.array((F.col("id") % 5).cast("double"), F.lit(1.0), (F.col("id") % 60).cast("double")).alias("q"))
    got = nearest(df, asked, 1)
    assert got.count() == 25_000 and got.where("id <> query % 60").count() == 0
    faq = df.select(F.col("id").alias("entry"), "v", F.when(F.col("id") == 3, None).otherwise(F.lit(0.999)).alias("threshold"))
    best = {r.query: r.entry for r in faq_by_vector(asked.where("query < 60"), faq).collect()}
    assert best.get(3) != 3 and all(best[i] == i for i in range(10, 60))


def test_expanded_by_runs_of_tokens(spark):
    synonyms = spark.createDataFrame([(0, "тариф", "ставка"), (1, "горячая вода", "ГВС"), (2, "вода", "жидкость"), (3, "...", "x"), (4, "кот", "пёс")], "pos int, word string, other string")
    queries = spark.createDataFrame([(0, "Тариф на горячая вода"), (1, "водавода который"), (2, ""), (3, None)], "query int, text string")
    got = sorted((r.query, r.variant, r.text) for r in expanded(queries, synonyms, 5).collect() if r.variant)
    assert got == [(0, 1, "ставка на горячая вода"), (0, 2, "Тариф на ГВС"), (0, 3, "Тариф на горячая жидкость")]
    plan = expanded(queries, synonyms)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert expanded(queries, synonyms.limit(0)).count() == 4
