"""Order of filings by deadline, summaries by budget, answers with a time to live, texts of Word files."""

import io
import json
import random
import time
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from gridwright.functions import rules
from gridwright.operators import graph, scorers
from gridwright.sources import word
from gridwright.streaming import logs


def queued(nodes, edges):
    """Node after node: the least (deadline, seen, node) of those whose dependencies are all placed; then the others as seen."""
    key = {n: (d is None, d or 0, s, n) for n, d, s in nodes}
    deps = {n: {b for a, b in edges if a == n and b in key} for n in key}
    out = []
    while ready := [n for n in key if n not in out and deps[n] <= set(out)]:
        out.append(min(ready, key=key.get))
    return out, sorted(set(key) - set(out), key=lambda n: (key[n][2], n))


def test_priority_order_is_that_of_a_queue(spark):
    rng = random.Random(5)
    for size, many, back in ((1, 0, 0), (12, 20, 0), (30, 45, 1), (30, 120, 0), (25, 30, 4)):
        nodes = [(n, rng.choice([None, 1, 2, 3, 4, 9]), rng.randrange(size)) for n in range(size)]
        at = rng.sample(range(size), size)
        pairs = [sorted(rng.sample(at, 2), key=at.index) for _ in range(many)] if size > 1 else []
        edges = [(b, a) for a, b in pairs] + [tuple(rng.sample(range(size), 2)) for _ in range(back)] + [(0, 999), (999, 0)] * (size > 12)
        placed, cyclic = queued(nodes, edges)
        got = graph.priority_order(spark.createDataFrame(nodes, "node int, deadline int, seen int"), spark.createDataFrame(edges + edges[:3], "src int, dst int")).orderBy("place").collect()
        assert [r.node for r in got] == placed + cyclic and [r.place for r in got] == list(range(1, size + 1))
        assert [r.node for r in got if r.cyclic] == cyclic


def test_priority_order_of_odd_input(spark):
    nodes = spark.createDataFrame([("b", None, 1), ("a", 5, 2), ("a", 3, 9), ("c", 1, 3), (None, 0, 0)], "node string, deadline int, seen int")
    edges = spark.createDataFrame([("c", "b"), ("a", "a"), (None, "c"), ("c", None)], "src string, dst string")
    assert [(r.node, r.place, r.cyclic) for r in graph.priority_order(nodes, edges).orderBy("place").collect()] == [("b", 1, False), ("c", 2, False), ("a", 3, True)]
    assert graph.priority_order(nodes.limit(0), edges).count() == 0


def test_packed(spark):
    rng = random.Random(7)
    for _ in range(5):
        sizes, budget = [rng.randrange(1, 40) for _ in range(rng.randrange(0, 30))], 50
        want, used = [], 0
        for x in sizes:
            new = not want or used + x > budget
            want.append((want[-1] + 1 if want else 0) if new else want[-1])
            used = x if new else used + x
        assert spark.range(1).select(scorers.packed(F.lit(sizes).cast("array<long>"), budget)).first()[0] == want
    assert spark.range(1).select(scorers.packed(F.array(F.lit(9), F.lit(1), F.lit(1)).cast("array<long>"), 3)).first()[0] == [0, 1, 1]


def test_summaries_keep_to_the_budget(spark):
    rows = [("long", i, f"{i:03d} " + "x" * (50 + i)) for i in range(90)] + [("short", 0, "one"), ("short", 1, None), ("empty", 0, "")]
    got = {r.doc: r for r in scorers.summarised_within(spark.createDataFrame(rows, "doc string, part int, piece string"), "echo", budget=60, out=20, direct=30).collect()}
    assert got["short"].summary == "one\n" and got["short"].calls == got["short"].levels == 1 and got["empty"].summary == ""
    long = got["long"]
    assert long.largest <= 60 and len(long.summary) <= 80 and long.summary.startswith("=== Блок 1/2 ===\n") and long.levels > 4 and long.calls > 90 + 45
    with pytest.raises(ValueError):
        scorers.summarised_within(spark.createDataFrame(rows, "doc string, part int, piece string"), budget=30, out=20)
    assert scorers.summarised_within(spark.createDataFrame([], "doc string, part int, piece string")).count() == 0


def test_mean_amortization_of_odd_rows(spark):
    t = spark.createDataFrame([(1.0, 3.0, 9.0), (None, 5.0, 11.0)], "start double, end double, year double")
    mean = rules.mean_annual_amortization
    assert t.agg(mean(t.columns)).first()[0] == 2.0 and t.agg(mean(["year"])).first()[0] == 10.0 and t.agg(mean(["x"])).first()[0] == 0.0
    assert t.limit(0).agg(mean(t.columns)).first()[0] is None
    assert rules.context_plan(F.lit(None).cast("int")) is not None and spark.range(1).select(rules.context_plan(F.lit(None).cast("int"))["pieces"]).first()[0] == 1


def test_answers_expire_in_the_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    made = tmp_path / "made"
    made.mkdir()

    def answer(prompt):
        if prompt == "bad":
            return "no no no"
        (made / uuid.uuid4().hex).write_text(prompt)
        return f"an answer to {prompt} that is long enough"

    known = spark.createDataFrame([("old", "an old answer, too old to be given", 0.0), ("new", "a known answer that is still fresh", time.time())], "key string, answer string, at double").withColumn("at", F.timestamp_seconds("at"))

    (tmp_path / "in").mkdir()
    questions = logs.log_stream(spark, str(tmp_path / "in"), "key string, request int, prompt string")
    stream = logs.answered_stream(questions, answer, 20, known).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start(str(tmp_path / "out"))

    def ask(rows):
        lines = [json.dumps(dict(zip(("key", "request", "prompt"), r))) for r in rows]
        part = tmp_path / uuid.uuid4().hex
        part.write_text("\n".join(lines))
        part.rename(tmp_path / "in" / f"{part.name}.json")
        until = time.time() + 60
        while time.time() < until and stream.isActive:
            time.sleep(0.5)
            if (tmp_path / "out" / "_spark_metadata").exists():
                got = {r.request: r for r in spark.read.schema("key string, request int, answer string, cached boolean, error string").parquet(str(tmp_path / "out")).collect()}
                if all(r[1] in got for r in rows):
                    return [(got[r[1]].cached, got[r[1]].answer, got[r[1]].error) for r in rows]
        raise AssertionError(stream.exception())

    text = "an answer to {} that is long enough".format
    try:
        began = time.time()
        first = ask([("a", 1, "p"), ("a", 2, "p"), ("bad", 3, "bad"), ("old", 4, "o"), ("new", 5, "n")])
        assert sorted(x[0] for x in first[:2]) == [False, True] and first[0][1] == first[1][1] == text("p")
        assert first[2] == (False, None, "unusable answer") and first[3] == (False, text("o"), None)
        assert first[4] == (True, "a known answer that is still fresh", None) or time.time() - began > 15
        answered = time.time()
        second = ask([("a", 6, "p"), ("bad", 7, "bad")])
        assert second[0] == (True, text("p"), None) or time.time() - answered > 15
        assert second[1] == (False, None, "unusable answer")
        time.sleep(21)
        assert ask([("a", 8, "p")]) == [(False, text("p"), None)]
    finally:
        stream.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(f.read_text() for f in made.iterdir()).count("p") >= 2


def docx(*parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{word.W[1:-1]}"><w:body>{"".join(parts)}</w:body></w:document>')
    return out.getvalue()


def test_texts_of_word_files(spark, tmp_path):
    p = lambda *t: "<w:p>" + "".join(f"<w:r><w:t>{x}</w:t></w:r>" for x in t) + "</w:p>"
    cell = lambda t, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{p(t)}</w:tc>"
    table = f'<w:tbl><w:tr>{cell("a", "<w:vMerge w:val=%srestart%s/>" % (chr(34), chr(34)))}{cell(" b ")}{cell("c")}</w:tr><w:tr>{cell("", "<w:vMerge/>")}{cell("wide", "<w:gridSpan w:val=%s2%s/>" % (chr(34), chr(34)))}</w:tr></w:tbl>'
    whole = docx(p("Первая ", "строка"), p(" "), table, '<w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t><w:br/><w:t>&lt;z&gt;</w:t></w:r></w:p>')
    (tmp_path / "in").mkdir()
    for name, content in {"a.docx": whole, "in/B.DOCX": docx(), "torn.docx": whole[:60], "text.docx": b"no archive", "empty.docx": b"", "old.doc": b"x"}.items():
        (tmp_path / name).write_bytes(content)
    with zipfile.ZipFile(tmp_path / "other.docx", "w") as z:
        z.writestr("x", "y")
    got = {r.doc: (r.text, r.error) for r in word.word_texts(spark, str(tmp_path)).collect()}
    assert got["a.docx"] == ("Первая строка\nx\ty\n<z>\na | b | c\na | wide | wide", None) and got["B.DOCX"] == ("", None)
    assert got["old.doc"] == (None, "unsupported") and got["other.docx"] == (None, "broken: KeyError")
    assert all(got[n] == (None, "broken: BadZipFile") for n in ("torn.docx", "text.docx")) and len(got) == 6
