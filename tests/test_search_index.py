"""The kept inverted index: equal to brute force, never stale, extended by what is new, skipping what can't rank."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridwright.operators import postings
from gridwright.operators.postings import SearchIndex, shown

ID_TEXT = "id long, text string"


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weight = [1 / (i + 1) for i in range(60)]
    rows = [(i, " ".join(r.choices(words, weight, k=r.randint(0, 25)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "... !"), (n + 3, rows[0][1]), (n + 4, rows[0][1]), (n + 5, "w0 " * 4000)]


def brute(rows, query):
    toks = {i: (t or "").lower().replace(".", " ").replace("!", " ").split() for i, t in rows}
    n, mean = len(rows), sum(map(len, toks.values())) / len(rows)
    df = Counter(w for t in toks.values() for w in set(t))
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    out = {}
    for i, t in toks.items():
        tf = Counter(t)
        s = sum((raw[w] if raw[w] >= 0 else floor) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in query.split() if w in tf)
        if s:
            out[i] = s
    return out


def test_scores_and_the_k_best_equal_brute_force(spark):
    rows = corpus(1, 300)
    asked = ["w3", "w0 w1 w2", "w5 w5 w40", "w59 w0", "w30 w41 w2 w0 w7", "absent", "", "w7 absent w7"]
    docs = spark.createDataFrame(rows, ID_TEXT)
    queries = spark.createDataFrame([*enumerate(asked), (99, None)], "query int, text string")
    index = SearchIndex.of(docs)
    scored = {(r.query, r.id): r.score for r in index.scores(queries).collect()}
    want = {(q, i): s for q, a in enumerate(asked) for i, s in brute(rows, a).items()}
    assert scored.keys() == want.keys() and all(math.isclose(scored[k], want[k], rel_tol=1e-9) for k in want)
    best = sorted((r.query, r["rank"], r.id) for r in index.top(queries, 5).collect())
    assert best == sorted((q, k, i) for q, a in enumerate(asked) for k, (i, _) in enumerate(sorted(brute(rows, a).items(), key=lambda x: (-round(x[1], 6), x[0]))[:5]))
    # Of a rare and a frequent word only documents with the rare one can be among the best.
    weights, able, _ = index.candidates(queries.where("query = 3"), 1)
    assert able.count() < weights.agg(F.max("df")).first()[0]


def test_many_queries_go_through_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 50} w{i % 7} x{i}") for i in range(200)], ID_TEXT)
    many = spark.range(25_000).select(F.col("id").alias("query"), F.concat(F.lit("x"), (F.col("id") % 200).cast("string"), F.lit(" no"), F.col("id").cast("string")).alias("text"))
    got = SearchIndex.of(docs).top(many, 1)
    assert got.count() == 25_000 and got.where("id <> query % 200").count() == 0


def test_a_changed_text_is_another_index_and_new_texts_extend_one(spark):
    rows = corpus(2, 40)
    first = SearchIndex.of(spark.createDataFrame(rows, ID_TEXT))
    assert first.built and not SearchIndex.of(spark.createDataFrame(rows[::-1], ID_TEXT)).built
    changed = [(0, "w9 w9 fresh"), *rows[1:]]
    other = SearchIndex.of(spark.createDataFrame(changed, ID_TEXT))
    ask = spark.createDataFrame([(0, "w9 fresh")], "query int, text string")
    assert other.built and {r.id: round(r.score, 9) for r in other.scores(ask).collect()} == {i: round(s, 9) for i, s in brute(changed, "w9 fresh").items()}
    grown = [*rows, (500, "fresh w1"), (501, None)]
    more = first.extended(spark.createDataFrame(grown, ID_TEXT))
    assert len(more.segments) == 2 and more.segments[0] == first.segments[0] and more.n == len(grown)
    assert spark.read.parquet(f"{more.segments[1]}/docs").count() == 2
    for q in ("fresh", "w1 w2", "w0"):
        got = more.scores(spark.createDataFrame([(0, q)], "query int, text string")).collect()
        assert {r.id: round(r.score, 9) for r in got} == {i: round(s, 9) for i, s in brute(grown, q).items()}
    assert len(more.extended(spark.createDataFrame(grown[1:], ID_TEXT)).segments) == 1  # one is gone: built anew
    assert len(first.extended(spark.createDataFrame(changed, ID_TEXT)).segments) == 1


def test_phrases_by_places(spark):
    rows = [(1, "The cat sat on the MAT, on the mat"), (2, "the mat on the cat"), (3, "on\nthe-mat"), (4, None), (5, "onthe mat"), (6, "x " * 300 + "On the mat" + " y" * 300)]
    docs = spark.createDataFrame(rows, ID_TEXT)
    asked = spark.createDataFrame([(0, "On the mat"), (1, "the"), (2, "mat mat"), (3, "")], "query int, text string")
    found = SearchIndex.of(docs).phrases(asked)
    assert {(r.query, r.id): (r.hits, r.first) for r in found.collect()} == {(0, 1): (2, 3), (0, 3): (1, 0), (0, 6): (1, 300), (1, 1): (3, 0), (1, 2): (2, 0), (1, 3): (1, 1), (1, 6): (1, 301)}
    context = {r.id: r.context for r in shown(found.where("query = 0"), asked, docs).collect()}
    assert context[1] == "The cat sat ON THE MAT, on the mat" and context[3] == "ON\nTHE-MAT"
    assert context[6] == ("x " * 300)[-100:] + "ON THE MAT" + (" y" * 300)[:200]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a b"), (None, "a"), (7, "c")]])
def test_small_corpora(spark, rows):
    index = SearchIndex.of(spark.createDataFrame(rows, ID_TEXT))
    ask = spark.createDataFrame([(0, "a c"), (1, "b")], "query int, text string")
    assert {r.query for r in index.top(ask, 3).collect()} == {r.query for r in index.scores(ask).collect()} == ({0, 1} if len(rows) == 3 else set())
    assert index.phrases(ask).count() == (1 if len(rows) == 3 else 0)  # b; a and c never stand together


def test_pushed_terms_or_not_give_the_same(spark, monkeypatch):
    rows = corpus(5, 80)
    docs, ask = spark.createDataFrame(rows, ID_TEXT), spark.createDataFrame([(0, "w1 w30"), (1, "w2 w2 w0")], "query int, text string")
    one = sorted(map(tuple, SearchIndex.of(docs).top(ask, 4).collect()))
    monkeypatch.setattr(postings, "PUSHED", 1)
    assert sorted((q, i, round(s, 9), k) for q, i, s, k in map(tuple, SearchIndex.of(docs).top(ask, 4).collect())) == sorted((q, i, round(s, 9), k) for q, i, s, k in one)


def test_what_a_task_sorts_does_not_grow_with_the_texts(spark):
    from gridwright.operators import postings

    assert postings._slots(0) == postings.SLOTS
    for gb in (1, 6, 30):
        slots = postings._slots(gb << 30)
        assert (gb << 30) / (slots * postings.BUCKETS) <= postings.SORTED_BYTES
