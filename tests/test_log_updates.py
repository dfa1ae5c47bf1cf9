"""Rewriting a log loses nothing: malformed lines, unknown fields and records that no update names stay."""

import json

from gridwright.operators.logs import amended, unlisted
from gridwright.sources import files, sinks


def test_nothing_is_lost(spark, tmp_path):
    lines = ['{"id": "a", "x": {"deep": [1, 2.50, null]}, "clarifications": [], "n": 5, "s": "5"}', '{"id": "b", "y": "ж\\"q"}', "{broken", '{"no": "id"}', "[1, 2]", '{"id": 7, "z": true}', "", "   "]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "one.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    read = files.log_lines(spark, str(tmp_path / "log"))
    updates = spark.createDataFrame([("a", [("q1", ["f1"])]), ("7", [("q2", []), ("q3", ["f2", "f3"])]), ("zz", []), (None, [])], "key string, value array<struct<query:string,sources:array<string>>>")
    sinks.rewrite_log(amended(read, updates, "clarifications"), str(tmp_path / "new"))
    got = [r.line for r in files.log_lines(spark, str(tmp_path / "new")).collect()]
    assert {x for x in lines[1:5]} <= set(got) and len(got) == 6
    by = {json.loads(x)["id"]: json.loads(x) for x in got if x.startswith('{"') and "id" in json.loads(x)}
    assert by["a"] == {"id": "a", "x": {"deep": [1, 2.5, None]}, "n": 5, "s": "5", "clarifications": [{"query": "q1", "sources": ["f1"]}]}
    assert by[7] == {"id": 7, "z": True, "clarifications": [{"query": "q2", "sources": []}, {"query": "q3", "sources": ["f2", "f3"]}]}
    left = [r.line for r in unlisted(read, updates.select("key")).collect()]
    assert left == [x for x in lines if not x.startswith(('{"id": "a"', '{"id": 7'))]
    assert amended(read.limit(0), updates, "clarifications").count() == 0 and amended(read, updates.limit(0), "c").count() == 6
