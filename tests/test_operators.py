"""Operators on small hand-made rows."""

import json

from pyspark.sql import functions as F

from gridwright.functions import rules
from gridwright.functions import text as tx
from gridwright.functions.similarity import without_repeats
from gridwright.operators import chunking, graph, logs, reconcile, retrieval, scorers, sheets
from gridwright.sources import files, sinks
from gridwright.streaming import logs as stream


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_numbers_and_years(spark):
    rows = [("1 234,5",), ("12 345.75",), ("-7",), ("1,2,3",), ("abc",), (None,), ("",)]
    assert [x[0] for x in values(spark, rows, "s string", tx.number(F.col("s")))] == [1234.5, 12345.75, -7.0, None, None, None, None]
    rows = [("2024",), ("2024.0",), (" 2010 ",), ("2009",), ("20244",), (None,)]
    assert [x[0] for x in values(spark, rows, "s string", tx.year_of_cell(F.col("s")))] == [2024, 2024, 2010, None, None, None]
    assert values(spark, [("a 1 и 2,5 и 0",)], "s string", tx.numbers(F.col("s"))) == [([1.0, 2.5],)]


def test_text_helpers(spark):
    one = lambda text, c: values(spark, [(text,)], "s string", c)[0][0]
    s = F.col("s")
    assert one("Привет, Мир 12 größe", tx.tokens(s)) == ["привет", "мир", "12", "gr", "e"]
    assert one("<think>a\nb</think>x\n\n\n\ny ", tx.without_blocks(s)) == "x\n\ny"
    assert one("Щука и ёж №5", tx.slug(s)) == "shchuka-i-yozh-5"
    assert one("aXaxAx", tx.occurrences(s, "axa")) == [1, 3] and one("Tariff tariff", tx.highlighted(s, "tariff")) == "**Tariff** **tariff**"
    assert one("№ 12-э от 2024-03-05", tx.file_date(s)) == "05.03.2024" and one("a_05-03-2024.txt", tx.file_date(s)) == "05.03.2024" and one("x", tx.file_date(s)) == ""
    assert tuple(one("Tomsk_heat_2023-2024_OAO_Teplo_indexation.txt", tx.file_attributes(s, ["indexation", "ebt"]))) == ("Tomsk", "heat", "2023-2024", "indexation", "OAO_Teplo")
    assert one("Решение суда.pdf", tx.doc_type(s)) == "court" and one("x.pdf", tx.doc_type(s)) == "unknown"
    assert [one(t, tx.repeats_itself(s)) for t in ("short", "a b " * 10, " ".join(f"w{i}" for i in range(10)), " ".join(f"w{i}" for i in range(30)))] == [True, True, False, False]
    assert [one(t, tx.size_label(F.char_length(s) * 600)) for t in ("a", "aa", "a" * 2000)] == ["600 B", "1.2 KB", "1.1 MB"]
    assert one("🔥 Тепло", tx.without_emoji(s)) == "Тепло"


def test_rules(spark):
    names = [("Итого расходы",), ("Тариф на газ",), ("Зарплата АУП",), ("Ремонт",), (None,)]
    got = values(spark, names, "n string", rules.article_type(F.col("n"), F.lit(True)), rules.cost_category(F.col("n")))
    assert [g[0] for g in got[:4]] == ["agg", "ref", "cost", "cost"] and got[2][1] == "PAYROLL" and got[4][1] == "UNKNOWN"
    i, e = rules.article_risk(F.col("n"), F.col("p"))
    assert values(spark, [("Ремонт сетей", 25.0), ("Зарплата", 0.5), ("Вздор", 5.0), ("Топливо", 25.0)], "n string, p double", i, e) == [(85, 30), (40, 65), (50, 50), (30, 95)]
    rows = [(100.0, 105.0), (100.0, 115.0), (100.0, 115.1), (0.0, 5.0), (None, 1.0)]
    assert [x[0] for x in values(spark, rows, "b double, v double", rules.growth_color(F.col("b"), F.col("v"), 5.0, 10.0))] == ["green", "yellow", "red", "yellow", "yellow"]
    assert values(spark, [(5, 0), (0, 0), (1, 2)], "p int, n int", rules.approval_percent(F.col("p"), F.col("n")), rules.confidence(F.col("p") + F.col("n"))) == [(100.0, "high"), (50.0, "low"), (25.0, "medium")]
    said = [("negative", "Это совпадение позиции"), ("positive", "регулятор отклонил"), ("negative", "ничего"), ("neutral", "не совпадает")]
    assert [x[0] for x in values(spark, said, "d string, r string", rules.reconciled(F.col("d"), F.col("r")))] == ["positive", "negative", "negative", "neutral"]
    text = "• **Заявлено:** 10 тыс.\nПринято экспертами: 7 тыс.;\nОБОСНОВАНИЕ: нет"
    assert tuple(values(spark, [(text,)], "s string", rules.decision_fields(F.col("s")))[0][0]) == ("10 тыс", "7 тыс", None, "нет")
    pf = [("Утверждено на 2016",), ("Факт ТСО",), ("x" * 40,), (None,), ("План организации",)]
    assert [x[0] for x in values(spark, pf, "s string", rules.plan_fact(F.col("s")))] == ["Принято", "Факт", "x" * 30, "", "Предложение"]


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "green apple apple"), (3, "blue sky"), (4, None)], "id int, text string")
    got = {(r.query, r.id): r.score for r in retrieval.bm25(docs, spark.createDataFrame([(0, "sky"), (1, "apple apple")], "query int, text string")).collect()}
    assert got[0, 3] > 0 and (0, 1) not in got
    a = spark.createDataFrame([(0, 1, 0), (0, 2, 1)], "query int, id int, rank int")
    b = spark.createDataFrame([(0, 2, 0), (0, 3, 1)], "query int, id int, rank int")
    fused = {r.id: round(r.score, 6) for r in retrieval.fuse(a, b).collect()}
    assert fused == {1: round(1 / 61, 6), 2: round(1 / 62 + 1 / 61, 6), 3: round(1 / 62, 6)}
    syn = spark.createDataFrame([(0, "тариф", "цена"), (1, "вода", "водоснабжение"), (2, "тариф", "ставка")], "pos int, word string, other string")
    out = retrieval.expanded(spark.createDataFrame([(0, "Тариф на воду и тариф")], "query int, text string"), syn).orderBy("variant").collect()
    assert [r.text for r in out] == ["Тариф на воду и тариф", "цена на воду и цена", "ставка на воду и ставка"]
    spheres = [(["heat"],), ([],), (["water", "heat"],), (["tko"],)]
    assert [x[0] for x in values(spark, spheres, "s array<string>", retrieval.sphere_matches(F.col("s"), ["heat"]))] == [True, True, True, False]


def test_legal_chunks(spark):
    text = "\n".join(["КонсультантПлюс", "Глава 1. Общие положения", "Статья 1. Предмет", "1. Первый пункт статьи, довольно длинный для блока, " + "слово " * 20, "а) подпункт первый", "б) подпункт второй", "----", "2. Второй пункт. " + "текст " * 30, "Статья 2. Другое", "1. Пункт. " + "т " * 60])
    got = chunking.legal_chunks(spark.createDataFrame([("d", text), ("plain", "Одна фраза. Вторая фраза.")], "doc string, text string"), 600).orderBy("doc", "chunk", "part").collect()
    d = [r for r in got if r.doc == "d"]
    assert any("а) подпункт" in r.piece and "б) подпункт" in r.piece and "Первый пункт" in r.piece for r in d) and not any("онсультант" in r.piece or "----" in r.piece for r in d)
    assert {r.section for r in d} == {"Глава 1. Общие положения"} and [r.piece for r in got if r.doc == "plain"] == ["Одна фраза. Вторая фраза."]


def test_protocols(spark):
    text = "Регион: Томск\nГод: 2024\nПОДРОБНЫЙ ПЕРЕСКАЗ\n-----\n### 5 РАСХОДЫ\nобщие слова о расходах предприятия за год\n### 5.2 \"Электроэнергия\" [tag: энергия]\nзаявлено сто, принято девяносто рублей\n### 6 ПУСТО\nДанные отсутствуют.\nРАСПОЗНАННЫЙ ТЕКСТ\n-----\nocr"
    docs = spark.createDataFrame([("p", text)], "doc string, text string")
    got = chunking.protocol_articles(docs, 10).orderBy("block").collect()
    assert [(r.kind, r.section_num, r.article_num, r.article_name, r.tag) for r in got][:2] == [("section", "5", None, None, None), ("article", "5", "5.2", "Электроэнергия", "энергия")]
    assert values(spark, [(text,)], "s string", chunking.requisites(F.col("s")))[0][0] == {"Регион": "Томск", "Год": "2024"}
    assert [r.num for r in chunking.expertise_sections(docs).orderBy("block").collect()] == ["5", "5.2", "ocr"]
    assert {r.doc for r in chunking.chunked(docs.union(spark.createDataFrame([("q", "Без разметки, но с текстом. " * 5)], docs.schema)), "protocol_articles", 1000, 0, 10).collect()} == {"p", "q"}


def test_greedy_chunkers():
    assert chunking.packed_sentences("A b. C d. " + "x" * 30, 12) == ["x" * 12, "x" * 12, "x" * 6, "A b. C d."]
    assert chunking.packed_sentences("Раз и т.д. дальше. Два.", 100) == ["Раз и т.д. дальше. Два."] and chunking.packed_sentences("", 5) == []
    text = "Слово раз два. " * 40
    for parts in (chunking.fixed_parts(text, 100, 10), chunking.window_parts(text, 100, 10), chunking.recursive_parts(text, 100)):
        assert len(parts) > 4 and all(parts) and text.split()[-1] in parts[-1]
    assert all(len(p) <= 100 for p in chunking.recursive_parts(text, 100)) and chunking.window_parts("ab", 10, 2) == ["ab"] and chunking.fixed_parts("", 5) == []
    table = "h\n" + "\n".join(f"row {i}" for i in range(20))
    assert all(p.startswith("h\n") and len(p) <= 40 for p in chunking.table_parts(table, 40))


def test_sheets(spark):
    grid = [["Наименование показателя", "Ед. изм.", "2023", "2024", "Комментарии"], ["", "", "Факт ТСО", "Утверждено", ""], ["Зарплата персонала", "тыс. руб.", "10", "1 200,5", "long note"], ["Топливо всего", "Гкал", "0", "7", ""], ["1.2", "шт", "5", "5", ""], ["M4202", "", "3", "3", ""]]
    rows = [("b", "s1", r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row) if v] + [("b", "Инструкция", 0, 0, "2023"), ("b", "s2", 0, 0, "no years here")]
    cells = spark.createDataFrame(rows, "book string, sheet string, r int, c int, s string")
    got = sheets.facts(cells).orderBy("article", "period").collect()
    assert [(r.article, r.period, r.pf, r.value, r.unit) for r in got] == [("Зарплата персонала", 2023, "Факт", 10.0, "тыс. руб."), ("Зарплата персонала", 2024, "Принято", 1200.5, "тыс. руб."), ("Топливо всего", 2024, "Принято", 7.0, "Гкал")]
    arts = {r.article: r for r in sheets.articles(sheets.facts(cells)).collect()}
    assert arts["Зарплата персонала"].checked and arts["Топливо всего"].type == "agg" and not arts["Топливо всего"].checked
    assert sheets.range_total(cells, 2, 2, 4).first().value == 15.0 and sheets.is_template_book(cells).first().template is False
    texts = spark.createDataFrame([("b", "t", 0, 1, "Утверждено приказом от 12.12.2013 № 5"), ("b", "t", 1, 1, "на 2016 год"), ("b", "t", 0, 2, "Факт"), ("b", "t", 0, 3, "План 2017-2018")], cells.schema)
    assert [(r.c, r.year, r.pf) for r in sheets.header_text_columns(texts).orderBy("c").collect()] == [(1, 2016, "Принято"), (2, 2016, "Факт"), (3, 2018, "План")]


def test_logs(spark):
    log = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", False), (2, 1, "c", False), (2, 2, "c", True)], "id int, pos int, v string, gone boolean")
    assert [(r.id, r.v) for r in logs.latest(log, ["id"], F.col("pos"), F.col("gone")).collect()] == [(1, "b")]
    votes = spark.createDataFrame([("f", "positive", 2, "q2"), ("f", "negative", 1, "q1"), ("f", "neutral", 3, "q3")], "file string, decision string, pos int, quote string")
    assert logs.majority(votes).first().decision == "negative"
    runs = spark.createDataFrame([(1, i, v) for i, v in enumerate("aabbb")] + [(1, 9, None), (1, 10, None)], "k int, i int, v string")
    assert [(r.v, r.length) for r in logs.runs(runs, "k", ["i"], "v").orderBy("run").collect()] == [("a", 2), ("b", 3), (None, 2)]
    rated = spark.createDataFrame([(5, "x" * 30), (1, "ok"), (3, None)], "rating int, comment string")
    r = logs.ratings(rated).first()
    assert (r.total, r.rating_5, r.mean_rating, r.with_comment) == (3, 1, 3.0, 1)


def test_reconcile(spark):
    rows = spark.createDataFrame([(1, "A1", "Pump station North"), (2, "", "Boiler"), (3, "zz", "None such")], "id int, number string, name string")
    reg = spark.createDataFrame([(10, "A1", "other"), (11, "B", "old boiler house"), (12, "B", "boiler two")], "reg_id int, number string, name string")
    assert {r.id: r.reg_id for r in reconcile.by_number_or_name(rows, reg).collect()} == {1: 10, 2: 11, 3: None}
    staff = reconcile.staffing(spark.createDataFrame([("a",)] * 6 + [("b",)], "position string"), spark.createDataFrame([("a", 0.04), ("c", 2.0)], "position string, norm double"), 100.0)
    assert {r.position: (r.required, r.status) for r in staff.collect()} == {"a": (4.0, "over"), "b": (0.0, "warn"), "c": (2.0, "ok")}
    _, fit = reconcile.regression(spark.createDataFrame([(float(2 * i + 1), float(i), "x") for i in range(1, 6)] + [(None, 1.0, "y")], "y double, a double, s string"), "y", ["a"])
    assert abs(fit["coefficients"][0] - 2) < 1e-6 and fit["r2"] > 0.999 and fit["spread"] < 1e-6
    items = spark.createDataFrame([(1, "Ремонт сетей", 5.0), (2, "Ремонт сети", 5.0), (3, "Топливо", 5.0)], "id int, name string, amount double")
    assert {r.id for r in without_repeats(items).collect()} == {2, 3}


def test_graph(spark):
    texts = spark.createDataFrame([(1, "we depend on Big Northern Heat and Power Company here"), (2, "see ООО Тепло for it"), (3, "nobody")], "src long, text string")
    names = spark.createDataFrame([(10, "big northern heat and power company"), (11, "ООО Тепло"), (12, ""), (3, "nobody")], "dst long, name string")
    assert sorted(map(tuple, graph.mentions(texts, names).collect())) == [(1, 10), (2, 11)]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6)], "src long, dst long")
    assert {r.node for r in graph.on_cycles(edges).collect()} == {1, 2, 3}
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node long")
    assert {r.node: r.level for r in graph.levels(nodes, edges).collect()} == {1: -1, 2: -1, 3: -1, 4: -1, 5: 1, 6: 0, 7: 0}
    got = values(spark, [(1,)], "x int", graph.schedule(F.expr("array(named_struct('id', 1, 'deadline', date'2024-01-02'), named_struct('id', 2, 'deadline', cast(null as date)), named_struct('id', 3, 'deadline', date'2025-01-01'))"), F.expr("date'2024-01-01'")))
    assert [str(x.day) for x in got[0][0]] == ["2024-01-02", "2024-01-03", "2024-01-04"]


def test_files(spark, tmp_path):
    (tmp_path / "in" / "_skip").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_bytes("привет мир\r\nстрока 12".encode("cp1251"))
    (tmp_path / "in" / "b.txt").write_bytes("﻿привет".encode())
    (tmp_path / "in" / "_skip" / "c.txt").write_text("x")
    (tmp_path / "in" / "d.bin").write_text("x")
    got = {r.doc: r.text for r in files.texts(spark, str(tmp_path / "in")).collect()}
    assert got["a.txt"] == "привет мир\nстрока 12" and got["b.txt"] == "привет"
    assert {r.name for r in files.listed(spark, str(tmp_path / "in"), ["txt"]).collect()} == {"a.txt", "b.txt"}
    raw = files.raw_lines(spark.createDataFrame([("a", "стр\nстрока 12 и 3,5")], "doc string, text string")).collect()
    assert [(r.pos, r.numbers) for r in raw] == [(1, [12.0, 3.5])]
    (tmp_path / "log.jsonl").write_text('{"id": 1}\nbroken\n{"id": 2}\n')
    assert [r.id for r in files.log(spark, str(tmp_path / "log.jsonl"), "id int").collect()] == [1, 2]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, f string")
    sinks.replace_partitions(rows, str(tmp_path / "s"), "f")
    sinks.replace_partitions(spark.createDataFrame([(9, "a")], "id int, f string"), str(tmp_path / "s"), "f")
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [2, 9]
    assert [r.id for r in sinks.delete_partition(spark, str(tmp_path / "s"), "f", "a").collect()] == [2]
    sinks.append_log(rows, str(tmp_path / "l"))
    sinks.append_log(rows, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 4
    arts = spark.createDataFrame([("77", "o", "heat", "1", "x", 5.0), ("77", "o", "heat", "2", "y", None)], "inn string, organization string, sphere string, code string, name string, amount double")
    doc = sinks.filing_documents(arts)
    assert json.loads(doc.first().json)["application"]["revenue"]["total"] == 5.0
    assert sorted(r.amount for r in files.filing_articles(doc).collect()) == [0.0, 5.0]
    bad = values(spark, [("123", "", None), ("1234567890", "o", ["x"])], "i string, o string, a array<string>", files.filing_errors(F.col("i"), F.col("o"), F.col("a")))
    assert [x[0] for x in bad] == [["inn", "organization", "articles"], []]
    sinks.export_sheets({"detail": rows}, str(tmp_path / "x"))
    assert files.csv_table(spark, str(tmp_path / "x" / "detail"), "utf-8").count() == 2


def test_scorers(spark):
    q = spark.createDataFrame([("a", ["s"], "Первое длинное предложение ответа. Второе предложение здесь. Третье."), ("b", ["s"], "x")], "query string, sources array<string>, prompt string")
    empty = spark.createDataFrame([], "key string, answer string")
    got = {r.query: r for r in scorers.answered(q, empty, "m").collect()}
    assert got["a"].answer.endswith("здесь.") and got["b"].error and got["b"].answer is None
    cache = scorers.answered(q, empty, "m").where("answer is not null").select("key", "answer")
    assert {r.query: r.cached for r in scorers.answered(q, cache, "m").collect()} == {"a": True, "b": False}
    parts = spark.createDataFrame([("d", i, f"Кусок {i}. Ещё. И ещё.") for i in range(12)], "doc string, part int, piece string")
    assert scorers.summarised(parts, 5).first().summary == "Кусок 0. Ещё."
    answers = [('```json\n{"decision": "negative"}\n```',), ("Расходы приняты",), ("...",)]
    assert [x[0] for x in values(spark, answers, "s string", scorers.decision(F.col("s")))] == ["negative", "positive", "neutral"]
    assert values(spark, [("{a} and b",)], "s string", scorers.missing_placeholders(F.col("s"), ["a", "b"]))[0][0] == ["b"]


def test_streams(spark, tmp_path):
    assert stream.visible("ab<thi", False) == ("ab", "<thi", False) and stream.visible("<think>x</think>y", False) == ("y", "", False)
    src = tmp_path / "deltas"
    deltas = ["Hi <th", "ink>secret", " more</thi", "nk> there"] + ["la"] * 25
    spark.createDataFrame([("r", i, d) for i, d in enumerate(deltas)], "request string, seq long, delta string").coalesce(1).write.json(str(src))
    s = stream.without_thoughts(stream.log_stream(spark, str(src), "request string, seq long, delta string"))
    q = s.writeStream.format("memory").queryName("shown").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.table("shown").orderBy("seq").collect()
    assert "".join(r.shown for r in out) == "Hi  there" + "la" * 20 and out[-1].stopped
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").write.json(str(tmp_path / "ev"))
    w = stream.counts_by_window(stream.log_stream(spark, str(tmp_path / "ev"), "ts timestamp, event_type string, value double"))
    q = w.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_repeats_with_other_beginnings(spark):
    name = "repair of the main heating line"
    rows = [(1, "x" + name[1:], 1.0), (2, name, 2.0), (3, name.upper(), 3.0), (4, "something else", 4.0), (5, None, 5.0), (6, None, 6.0), (7, "", 7.0), (8, "", 8.0)]
    items = spark.createDataFrame(rows, "id long, name string, amount double")
    assert sorted(r.id for r in without_repeats(items).collect()) == [3, 4, 5, 6, 8]


def test_size_labels_are_those_of_the_sql(spark, tmp_path):
    """Halves go to the even digit, a million characters are megabytes, and null has no label, on both sides."""
    import duckdb

    from gridwright.plans import load

    queries, sql = load()
    sizes = [0, 1023, 1024, *range(1280, 6000, 256), 1048575, 1048576, 1310720, 1363149, 3 << 20, None]
    rows = [(i, None if n is None else "x" * n) for i, n in enumerate(sizes)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = {r.page_id: r.size_label for r in queries["size_labels"](spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(sql["size_labels"]).fetchall())
    want = lambda n: f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1 << 20 else f"{n / (1 << 20):.1f} MB"
    assert got == {i: None if n is None else want(n) for i, n in enumerate(sizes)}


def test_regression_keeps_the_digits_of_large_amounts(spark):
    """Counts and sums as of months at a large scale, against exact fractions; equal points and other columns stay."""
    from fractions import Fraction

    xs = [112_000 + 37 * (i % 61) - 11 * (i % 7) for i in range(80)]
    ys = [1.7e10 + 151_000.25 * (x - 112_000) + 1e6 * ((i * 7919) % 101) for i, x in enumerate(xs)]
    points = [(i, float(x), y) for i, (x, y) in enumerate(zip(xs, ys))] + [(80, float(xs[0]), ys[0])]
    out, fit = reconcile.regression(spark.createDataFrame(points, "month int, x double, y double"), "y", ["x"])
    n, sx, sy = len(points), sum(Fraction(p[1]) for p in points), sum(Fraction(p[2]) for p in points)
    b = (n * sum(Fraction(p[1]) * Fraction(p[2]) for p in points) - sx * sy) / (n * sum(Fraction(p[1]) ** 2 for p in points) - sx * sx)
    a = (sy - b * sx) / n
    got = {r.month: r.prediction for r in out.collect()}
    assert len(got) == 81 and max(abs(Fraction(got[m]) - (a + b * Fraction(x))) for m, x, _ in points) < 1e-4
    assert abs(Fraction(fit["intercept"]) - a) < 1e-2


def test_wide_rows_are_summed_before_they_become_long(spark, tmp_path):
    """Zeros, nulls and a missing article, as the SQL counts them; no row is multiplied before the first sum."""
    import duckdb

    from gridwright.plans import load

    queries, sql = load()
    lines = [(1, 1, 7, 5.0, 0.0, 0.0, None), (1, 2, 7, 1.0, 2.0, 0.0, 0.5), (2, 1, None, 3.0, 0.0, None, 0.0), (3, 1, 8, 0.0, 4.0, 0.0, 0.0)]
    shape = "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    df = spark.createDataFrame(lines, shape).withColumn("l_shipdate", F.expr("timestamp_ntz'1995-03-01 00:00:00'"))
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    got = queries["wide_to_long"](spark, str(tmp_path))
    assert sorted(map(tuple, got.select("period", "label", "n", "total", "articles").collect())) == sorted(con.execute(sql["wide_to_long"]).fetchall())
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()


def test_legal_chunks_meet_without_joins(spark):
    docs = spark.createDataFrame([(1, "Глава 1. Общее\nСтатья 1. О чём\n1. Пункт А\nа) подпункт\nСтатья 2. Далее\n2. Пункт Б"), (2, None), (3, "без границ")], "doc int, text string")
    cut = chunking.legal_chunks(docs, 1500)
    assert "Join" not in cut._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc for r in cut.collect()} == {1, 3}


def test_python_gets_texts_in_short_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, 10_000)
        docs = spark.range(2_500).selectExpr("id AS doc", "repeat('слово. ', 400) AS text")
        cut = chunking.chunked(docs, "structural", 1000, 0, 1)
        assert int(spark.conf.get(key)) <= 1_000
        assert cut.groupBy("doc").count().groupBy("count").count().collect() == [(3, 2_500)]
    finally:
        spark.conf.set(key, before)
