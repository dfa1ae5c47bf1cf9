"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter

import corpus_pipeline as p
from gridwright.llm import decontamination, toxicity
from tests.llm.test_near_copies import brute


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in p.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    at = docs
    for name, stage in p.STAGES:
        out = stage(spark, at, sf).cache()
        before, after = Counter(r.doc_id for r in at.collect()), Counter(r.doc_id for r in out.collect())
        if name != "sharding":
            assert out.columns == docs.columns
        if name == "toxicity":
            model = toxicity.train(at, spark.read.parquet(f"{sf}/labels.parquet"))
            assert after == Counter(r.doc_id for r in model.score(at).collect() if r.score < p.TOXIC)
        if name == "near_duplicates":
            kept = [eval(x) for x in brute([(r.doc_id, r.text) for r in at.collect()], 5, "0.8")]
            assert after == Counter(i for i, _, c in kept if i == c)
        if name == "decontamination":
            leaky = {r.doc_id for r in decontamination.find_leaks(at, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert {r.doc_id for r in at.collect() if any(i in r.text for i in items)} <= leaky
            assert after == Counter({i: n for i, n in before.items() if i not in leaky})
        if name == "mixing":
            assert set(after) <= set(before) and max(after.values()) <= 3
        if name == "sharding":
            assert after == before and {"shard", "slot", "size"} <= set(out.columns)
        at = out


def test_odd_rows_pass_through(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, "en", "s", None), (3, "some words that are quite alone here", "en", "s", 5), (3, "some words that are quite alone here", "en", "s", 5), (4, "w " * 200000, "en", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    out = p.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} >= {None, 1, 2, 4} and len({(r.shard, r.slot) for r in out}) == len(out)
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).collect() == []


def test_equal_ids_of_different_texts_stay(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (7, a + " more"), (3, b + " more"), (9, c), (9, c + " more"), (9, c), (None, a), (8, ""), (8, " \t\r\n"), (8, None), (6, "é")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = p.drop_near_copies(spark, docs, "")
    got = [(r.doc_id, r.text) for r in out.collect()]
    nine = [x for x in got if x[0] == 9]
    assert out.columns == docs.columns and len(nine) == 1 and nine[0][1] in (c, c + " more")
    want = [(5, a), (3, b + " more"), (None, a), (8, ""), (8, " \t\r\n"), (8, None), (6, "é")]
    assert sorted(map(str, got)) == sorted(map(str, want + nine))
    same = spark.createDataFrame([(5, a, "en", "s", 0), (5, b, "en", "s", 0)], docs.schema)
    assert {r.text for r in p.drop_near_copies(spark, same, "").collect()} == {a, b}
