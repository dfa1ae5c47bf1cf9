"""Toxicity: folding, the automaton, held-out accuracy and odd rows."""

import random

from pyspark.sql import functions as F

from gridwright.llm import toxicity
from gridwright.llm.queries import op1_toxicity


def test_fold_undoes_disguise():
    assert toxicity.fold("1D10T") == toxicity.fold("Idiot") == toxicity.fold("іdіоt") == toxicity.fold("ｉｄｉｏｔ") == toxicity.fold("id​iot")
    assert toxicity.fold("l0ser!") == " ioser  "


def test_hits_and_exceptions():
    lex = toxicity.Lexicon({" scum": 2.0, " scumbag ": 3.0, " moron ": 1.0}, [" pond scum "])
    terms, ranges = lex.hits(toxicity.fold("a scumbag, pond scum and oxymoron"))
    assert sorted(terms.values()) == [2.0, 3.0] and len(ranges) == 1
    assert lex.features("pond scum")[2] == 0.0 and lex.features("")[0] == 0.0 and lex.features("pond scum, scum")[2] > 0


def made(spark, n=900):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            words[2] = rng.choice(["zounder", "z0under", "ZOUNDER", "kriptic", "kr1ptic"])
        elif i % 75 == 1:
            words[1:3] = ["never", "zounder"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_terms_and_exceptions(spark):
    docs, labels = made(spark)
    model = toxicity.train(docs, labels)
    assert any(t.startswith(" zoun") for t in model.terms) and " never zounder " in model.phrases
    got = model.score(docs).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).select("score", "toxic").collect()
    right = sum((r.score >= 0.7) == (r.toxic == 1) for r in got)
    assert len(got) > 150 and right >= 0.97 * len(got)


def test_odd_rows(spark):
    docs, labels = made(spark, 200)
    model = toxicity.train(docs, labels.union(labels).union(spark.createDataFrame([(None, 1), (3, None), (10**9, 1)], labels.schema)))
    odd = spark.createDataFrame([(1, None, 5.0, "x"), (1, None, 5.0, "x"), (None, "", 1.0, None), (2, "zounder " * 50000, 1.0, "y")], "doc_id long, text string, score double, t string")
    rows = model.score(odd).collect()
    assert len(rows) == 4 and rows[0] == rows[1] and all(0 <= r.score <= 1 for r in rows) and rows[0].score == rows[2].score < 0.5 < rows[3].score
    assert model.score(odd.limit(0)).collect() == []
    empty = toxicity.train(docs.limit(0), labels)
    assert {r.score for r in empty.score(odd).collect()} < {0.0} | {r.score for r in empty.score(odd).collect()} and max(r.score for r in empty.score(odd).collect()) < 1e-6
    assert min(r.score for r in toxicity.train(docs, labels.withColumn("toxic", F.lit(1))).score(odd).collect()) > 0.99


def test_query_on_held_out_rows(spark):
    """Misses are documents whose only telling words few other toxic ones have: words of two toxic and no clean documents find two more of 18 at sf0.01, with 14 false alarms."""
    for sf, least in (("sf0.01", 0.75), ("sf0.1", 0.9)):
        got = op1_toxicity(spark, f"/root/testdata/{sf}")
        assert got.columns == ["doc_id", "held_out", "score", "predicted"]
        rows = got.join(spark.read.parquet(f"/root/testdata/{sf}/labels.parquet"), "doc_id").where("held_out").collect()
        wrong = sum(r.predicted == 1 and r.toxic == 0 for r in rows)
        hit, toxic = sum(r.predicted == 1 and r.toxic == 1 for r in rows), sum(r.toxic for r in rows)
        print("held out", sf, hit, "of", toxic, "false alarms", wrong, "of", len(rows) - toxic)
        assert wrong <= 2 and hit >= least * toxic


def test_many_exceptions_in_one_long_text():
    lex = toxicity.Lexicon({" scum ": 2.0}, [" pond scum ", " scum pond "])
    text = toxicity.fold("pond scum pond x " * 30000 + "scum")
    import time

    began = time.perf_counter()
    assert lex.features(text)[3] == 2.0 and time.perf_counter() - began < 5
