"""Registers, parsers, matching, flows, whole books and plans, on small hand-made rows."""

import pytest
from pyspark.sql import functions as F

from gridwright.functions import parsing
from gridwright.functions.similarity import one_edit
from gridwright.operators import chunking, flows, graph, knowledge, matching, registers, retrieval, scorers, sheets
from gridwright.operators.postings import SearchIndex, version_of
from gridwright.sources import files


def one(spark, value, c, kind="string"):
    return spark.createDataFrame([(value,)], f"s {kind}").select(c).first()[0]


def test_parsers(spark):
    s = F.col("s")
    full = "2025 (Принято): 13 000,5 тыс.руб. | 2024 (Факт): 12 345 тыс.руб."
    assert [tuple(x) for x in one(spark, full, parsing.amounts(s))] == [(2024, "Факт", 12345.0), (2025, "Принято", 13000.5)]
    assert [tuple(x) for x in one(spark, "2025/При=13000, 2024/Фак=1.5", parsing.amounts(s))] == [(2024, "Фак", 1.5), (2025, "При", 13000.0)]
    assert one(spark, "nothing", parsing.amounts(s)) == []
    sheet = "# Лист\n★ Зарплата\n  2025 (Принято): 5 тыс.руб.\n  2026 (План): 6 тыс.руб.\n\n★ Пусто\n 2025 (Факт): 0 тыс.\n\nТопливо: 2025/При=7, 2026/Пре=0\nТопливо: 2025/При=8\nНоль: 2025/При=0\nx: 2025/При=1\n★ Конец\n2025 (Факт): 1 тыс."
    got = [tuple(x) for x in one(spark, sheet, parsing.rendered_articles(s))]
    assert got == [("Зарплата", "2025 (Принято): 5 тыс.руб. | 2026 (План): 6 тыс.руб."), ("Топливо", "2025/При=7, 2026/Пре=0"), ("Конец", "2025 (Факт): 1 тыс.")]
    assert len(one(spark, sheet, parsing.rendered_articles(s, nonzero=False))) == 5 and one(spark, None, parsing.rendered_articles(s)) == []
    answer = "Документ 1: про газ\nи воду\nдокумент 3 : лишнее Документ 2: да"
    assert [tuple(x) for x in one(spark, answer, parsing.answers_by_file(s, F.array(F.lit("a"), F.lit("b"))))] == [("a", "про газ и воду"), ("b", "да")]
    assert [tuple(x) for x in one(spark, "вздор", parsing.answers_by_file(s, F.array(F.lit("a"))))] == [("a", "вздор")]
    assert one(spark, "x\n| a | b |\n|---|:-:|\n| 1 | 2 |\ny | z", parsing.table_lines(s)) == ["| a | b |", "| 1 | 2 |"]
    right = F.lit("Тариф устанавливается который регулятором ежегодно")
    assert [one(spark, t, parsing.answer_is_right(s, right)) for t in ("тариф устанавливается", "ничего", "регулятором")] == [True, False, True]
    assert one(spark, "a b", parsing.answer_is_right(s, F.lit("A b"))) and one(spark, "F", parsing.label_of(s, {"F": "done"}, "?")) == "done" and one(spark, "X", parsing.label_of(s, {"F": "done"}, "?")) == "?"
    assert one(spark, 0.01, parsing.pseudo_distance(F.col("s")), "double") == 0.4 and one(spark, 0.5, parsing.pseudo_distance(F.col("s")), "double") == 0.0


def test_registers(spark):
    claims = spark.createDataFrame([(1, "Горгаз", None, ["вода"]), (2, None, "ГАЗ", None), (3, "x", "y", ["Газовик"]), (4, "x", "y", [])], "id int, org string, notes string, tags array<string>")
    found = claims.where(registers.any_has([F.col("org"), F.col("notes")], [F.col("tags")], " газ ")).collect()
    assert sorted(r.id for r in found) == [1, 2, 3] and claims.where(registers.any_has([], [], "")).count() == 4
    days = spark.createDataFrame([("2024-02-30", "b", "o", "d"), ("2024-03-01T10", "A", "o", "e"), (None, "c", "o", "d")], "meeting_date string, meeting_name string, organization string, detail_level string")
    assert [r.meeting_name for r in registers.minutes(days, "1970-01-01", "2024-12-31", order="name").collect()] == ["A", "b", "c"]
    assert [r.meeting_name for r in registers.minutes(days, "2024-01-01", "2024-12-31", "a", ["e"]).collect()] == ["A"]
    arts = spark.createDataFrame([("a", "cost", "s", True, True, True), ("b", "zero", "s", False, False, True), ("c", "cost", "t", False, True, False)], "name string, type string, sheet string, tech_sheet boolean, has_value boolean, checked boolean")
    state = lambda how, c=None: [r.checked for r in registers.rechecked(arts, how, c).collect()]
    assert state("auto") == [False, False, True] and state("drop_kinds") == [True, False, False] and state("drop_empty") == [True, False, False]
    assert state("invert", registers.in_choice(sheet="s")) == [False, False, False] and state("set", registers.in_choice("C")) == [True, True, True] and state("clear") == [False] * 3
    empty = arts.limit(0)
    assert registers.rechecked(empty, "auto").collect() == [] and registers.minutes_totals(days.limit(0).selectExpr("*", "1 word_count", "1 txt_size", "1 docx_size")).first().words == 0


def test_matches_are_those_of_all_pairs(spark, monkeypatch):
    """Several claims, small blocks, equal vectors, repeated rows, missing and other vectors: as if every pair were scored."""
    import random

    from gridwright.functions.vectors import cosine

    rng = random.Random(4)
    stems = ["топливо", "ремонт", "аренда", "связь", "охрана", "Услуги😀"]
    vector = lambda: rng.choice([None, [0.0, 0.0], [float(rng.randint(-2, 2)) for _ in range(2)], [float(rng.randint(1, 9)) for _ in range(2)]])
    arts = [(i % 3 if i else None, f"a{i}", rng.choice(["Прочие", None, f"Расходы на {rng.choice(stems)}", f"{rng.choice(stems)} и {rng.choice(stems)}"]), vector()) for i in range(40)]
    docs = [(rng.choice([0, 0, 0, 0, 1, 4, None]), rng.randint(0, 90), rng.choice([None, "", "x" * 500, f"акт {rng.choice(stems)}ный".upper(), f"договор-{rng.choice(stems)[:3]}"]), vector()) for _ in range(160)]
    articles = spark.createDataFrame(arts, "claim int, article string, name string, v array<double>")
    documents = spark.createDataFrame(docs + docs[:5], "claim int, doc long, text string, w array<double>")
    monkeypatch.setattr(matching, "ARTICLES", 5)
    monkeypatch.setattr(matching, "DOCUMENTS", 20)
    pairs = documents.alias("d").join(articles.alias("a"), "claim").withColumn("keys", matching.keywords(F.col("name")))
    hit = F.coalesce(F.exists("keys", lambda k: F.lower("text").contains(k)), F.lit(False))
    every = pairs.select("claim", "article", "doc", F.when(hit, 1.0).otherwise(F.coalesce(F.round(cosine(F.col("v"), F.col("w")), 3), F.lit(0.0))).alias("s")).groupBy("claim", "article", "doc").agg(F.max("s").alias("s")).collect()
    for floor, few in ((0.6, matching.FEW), (0.0, 0), (-1.0, matching.FEW)):
        monkeypatch.setattr(matching, "FEW", few)
        best = {}
        for r in sorted(every, key=lambda r: (-r.s, r.doc)):
            if r.s >= floor and len(best.setdefault((r.claim, r.article), [])) < 3:
                best[r.claim, r.article].append((r.doc, r.s))
        want = sorted((*k, n, *v) for k, own in best.items() for n, v in enumerate(own))
        found = matching.matched(articles, documents, floor)
        assert sorted((r.claim, r.article, r["rank"], r.doc, r.similarity) for r in found.collect()) == want and len(want) > 30
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert matching.matched(articles, documents.limit(0)).collect() == []


def test_matching_and_risks(spark):
    arts = spark.createDataFrame([(1, 1, "Расходы на топливо", [1.0, 0.0]), (1, 2, "Прочие", [0.0, 1.0]), (2, 3, "Топливо", None)], "claim int, article int, name string, v array<double>")
    docs = spark.createDataFrame([(1, 1, "Договор ТОПЛИВО", None), (1, 2, "акт", [1.0, 0.0]), (1, 3, "счёт", [0.6, 0.8]), (1, 4, None, [0.0, 1.0]), (1, 5, "акт", [1.0, 0.0]), (3, 6, "топливо", None)], "claim int, doc int, text string, w array<double>")
    got = sorted((r.article, r["rank"], r.doc, r.similarity) for r in matching.matched(arts, docs).collect())
    assert got == [(1, 0, 1, 1.0), (1, 1, 2, 1.0), (1, 2, 5, 1.0), (2, 0, 4, 1.0), (2, 1, 3, 0.8)]
    again = sorted((r.article, r["rank"], r.doc) for r in matching.matched_files(arts, docs, F.char_length("text")).collect())
    assert again[0] == (1, 0, 1) and matching.matched(arts.limit(0), docs).collect() == []
    facts = spark.createDataFrame([(1, 1, "топливо", 2024, "Факт", 100.0), (1, 1, "топливо", 2024, "Принято", 90.0), (1, 1, "топливо", 2025, "План", 94.0), (1, 2, "ремонт", 2025, "План", 10.0), (1, 9, "старое", 2024, "Факт", 1.0)], "claim int, article int, name string, period int, pf string, value double")
    got = {r.article: (r.base, r.value, r.color, r.evidence) for r in flows.article_risks(facts, docs, arts.select("claim", "article", "v")).collect()}
    assert got == {1: (90.0, 94.0, "green", 3), 2: (None, 10.0, "yellow", 2)}
    assert flows.risk_summary(flows.article_risks(facts, docs, arts.select("claim", "article", "v"))).first().articles == 2


def test_questions_and_forecasts(spark):
    docs = spark.createDataFrame([(1, "heat tariff rules"), (2, "water norms"), (3, "gas and more gas")], "id int, text string")
    faq = spark.createDataFrame([(0, "how is the tariff set today", "by decree")], "pos int, entry_text string, answer string")
    asked = spark.createDataFrame([(1, "how is the fee set"), (2, "gas norms"), (3, "zzz")], "query int, text string")
    cache = spark.createDataFrame([], "key string, answer string")
    got = {r.query: (r.kind, r.answer, r.section) for r in flows.asked(asked, faq, docs, cache, [("gas", "energy")]).collect()}
    assert got[1] == ("faq", "by decree", None) and got[2][0] == "answer" and got[2][2] == "energy" and got[3] == ("none", None, None)
    chunks = spark.createDataFrame([(1, "a", 0, "gas accepted"), (2, "a", 1, "gas accepted again"), (3, "b", 0, "gas refused"), (4, "c", 0, "water")], "id int, file string, pos int, text string")
    decide = lambda t: F.when(t.contains("accepted"), "positive").when(t.contains("refused"), "negative").otherwise("neutral")
    req = spark.createDataFrame([(1, "gas", "because"), (2, "nothing", None)], "request int, article string, justification string")
    got = {r.request: (r.files, r.positive, r.negative, r.approval, r.confidence) for r in flows.forecast(req, chunks, decide, lambda t: F.lit("ничего")).collect()}
    assert got == {1: (2, 1, 1, 40.0, "medium"), 2: (0, 0, 0, 50.0, "low")}
    bad = flows.answered_or_error(docs, F.lit(" "), "echo").first()
    assert bad.answer is None and bad.error == "no answer"
    kept, n = flows.normalised_revenue(spark.createDataFrame([(1, "a ", 2.0), (2, "a", 3.0)], "id int, name string, amount double"), F.trim, lambda d: d.dropDuplicates(["name"]))
    assert tuple(n.first())[:3] == (2, 1, 1) and scorers.SCORERS["echo"]


def book(name, sheets_):
    return [(name, s, r, c, str(v)) for s, rows in sheets_.items() for r, row in enumerate(rows) for c, v in enumerate(row) if v is not None]


def test_whole_books(spark):
    template = {"TECHSHEET": [["x", "y"], ["x", "y"], ["x", "y"]], "Смета": [["PJ_PF", None, "Факт", "План"], ["PJ_YEAR", "Наименование", 2024, 2025], [None, "Зарплата рабочих", 10, 12], [None, "Топливо и газ", 0, 7]]}
    free = {"Лист1": [["Наименование", "Факт ТСО за 2023 год", "План на 2024 год"], ["Аренда зданий", 3, 4], ["Ремонт сетей", 5, None]],
            "Лист2": [["Прочее", None, None], ["Наименование показателя", 2023, 2024], ["Страхование людей", 1, 2]], "Транспорт": [["Наименование", "Факт 2023"], ["Аренда", 1], ["Газ для печей", 2]]}
    cells = spark.createDataFrame(book("t", template) + book("f", free), "book string, sheet string, r int, c int, s string")
    long = sheets.parsed(cells)
    got = sorted((r.book, r.sheet, r.article, r.period, r.pf, r.value, r.format) for r in long.collect())
    assert got == [("f", "Лист1", "Аренда зданий", 2023, "Факт", 3.0, "free"), ("f", "Лист1", "Аренда зданий", 2024, "План", 4.0, "free"), ("f", "Лист1", "Ремонт сетей", 2023, "Факт", 5.0, "free"),
                   ("f", "Лист2", "Страхование людей", 2023, "", 1.0, "free"), ("f", "Лист2", "Страхование людей", 2024, "", 2.0, "free"),
                   ("t", "Смета", "Зарплата рабочих", 2024, "Факт", 10.0, "template"), ("t", "Смета", "Зарплата рабочих", 2025, "План", 12.0, "template"), ("t", "Смета", "Топливо и газ", 2025, "План", 7.0, "template")]
    counts = {r.book: (r.sheets, r.sheets_parsed, r.records, r.articles) for r in sheets.book_counts(cells, long).collect()}
    assert counts == {"f": (3, 2, 5, 3), "t": (2, 1, 3, 2)} and sheets.parsed(cells.limit(0)).collect() == []


@pytest.mark.parametrize("encoding,sep", [("cp1251", ";"), ("utf-8", ","), ("utf-8", ";")])
def test_guessed_csv(spark, tmp_path, encoding, sep):
    (tmp_path / "t.csv").write_bytes(f"имя{sep}сумма\nгаз{sep}5\n".encode(encoding))
    got = files.csv_guessed(spark, str(tmp_path / "t.csv"))
    assert got.columns == ["имя", "сумма"] and tuple(got.first()) == ("газ", "5")


def test_long_chains_and_cycles(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(70, 71), (71, 72), (72, 70), (75, 70), (72, 76), (80, 80)], "src int, dst int")
    nodes = chain.selectExpr("src node").union(chain.selectExpr("dst")).distinct()
    got = {r.node: r.level for r in graph.levels(nodes, chain).collect()}
    assert [got[i] for i in range(61)] == [60 - i for i in range(61)] and [got[i] for i in (70, 71, 72, 75, 76, 80)] == [-1, -1, -1, -1, 0, -1]
    ring = spark.createDataFrame([(i, (i + 1) % 12) for i in range(12)] + [(20, 0), (5, 30), (40, 40)], "src int, dst int")
    assert sorted(r.node for r in graph.on_cycles(ring).collect()) == [*range(12), 40] and graph.on_cycles(ring, 8).collect()[0].node == 40
    assert graph.on_cycles(ring.limit(0)).collect() == []


def test_top_keeps_k_rows_before_the_shuffle(spark):
    from gridwright.plans.search import batch_overlap_top, bm25_top, multi_variant_dedup, vector_top

    for query in (batch_overlap_top, bm25_top, multi_variant_dedup, vector_top):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        # a window over a constant key becomes a plain top k
        assert "WindowGroupLimit" in plan or "TakeOrderedAndProject" in plan, query.__name__


def test_shared_terms_are_counted_without_pairs(spark, monkeypatch):
    """In blocks of queries, with repeated ids, empty and null rows, as the pairs would be; no pair is grouped or sent."""
    from gridwright.operators import retrieval as rt
    from gridwright.plans.search import batch_overlap_top

    plan = batch_overlap_top(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    words = ["a", "b", "c", "d", "e", "ё", None]
    texts = [(i % 45 - 3, [words[(i * j + j) % 6] for j in range(i % 7)]) for i in range(60)] + [(90, None), (91, []), (92, [None, "a"])]
    asked = [(i % 13, [words[(i + 2 * j) % 6] for j in range(i % 4)]) for i in range(20)] + [(50, ["nowhere"]), (51, None)]
    pairs = {}
    for d, own in texts:
        for q, terms in asked:
            n = sum(t == u for t in own or [] for u in terms or [] if t is not None)
            pairs[q, d] = pairs.get((q, d), 0) + n
    want = []
    for q in {q for q, _ in asked}:
        ranked = sorted((-n, d) for (p, d), n in pairs.items() if p == q and n)
        want += [(q, d, -n, i) for i, (n, d) in enumerate(ranked[:3])]
    t = spark.createDataFrame(texts, "id int, terms array<string>").repartition(3)
    q = spark.createDataFrame(asked, "query long, terms array<string>")
    for terms, matches in ((100_000, 2_000_000), (7, 5)):
        monkeypatch.setattr(rt, "TERMS", terms)
        monkeypatch.setattr(rt, "MATCHES", matches)
        got = rt.most_shared(t, q, 3)
        assert got.schema["id"].dataType.simpleString() == "int" and sorted(map(tuple, got.collect())) == sorted(want)
        joined = lambda rows: [(i, " ".join(w for w in own or [] if w)) for i, own in rows]
        entries = [(i, text) for i, text in enumerate(x for _, x in joined(asked))]
        known = rt.faq_by_tokens(spark.createDataFrame([(str(i), x) for i, (_, x) in enumerate(joined(texts))], "question string, text string"), spark.createDataFrame(entries, "pos int, entry_text string"), 2, 2)
        hits = []
        for i, (_, x) in enumerate(joined(texts)):
            shared = [(str(i), p, len(set(x.split()) & set(e.split()))) for p, e in entries]
            hits += [h for h in shared if h[2] >= 2][:2]
        assert hits and sorted((r.question, r.pos, r.shared) for r in known.collect()) == sorted(hits)
        assert "MapInArrow" in known._jdf.queryExecution().optimizedPlan().toString()
    assert rt.most_shared(t, q.limit(0), 3).collect() == [] == rt.most_shared(t.limit(0), q, 3).collect()


def test_names_of_any_length_are_mentioned(spark):
    texts = spark.createDataFrame([(1, "the Red apple pie is on the big table here"), (2, "nothing"), (3, None), (4, "a red apple")], "src int, text string")
    names = spark.createDataFrame([(10, "red apple"), (11, "red apple pie"), (12, "apple pie is on the big table"), (13, " "), (14, "ing"), (1, "pie is on the")], "dst int, name string")
    got = sorted((r.src, r.dst) for r in graph.mentions(texts, names).collect())
    assert got == [(1, 10), (1, 11), (1, 12), (2, 14), (4, 10)]


def test_cuts_keep_the_whole_text(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").selectExpr("doc_id doc", "text").where("text is not null")
    whole = {r.doc: r.text for r in docs.collect()}
    bare = lambda t: "".join(t.split())
    for mode, size in (("fixed", 400), ("window", 900), ("recursive", 200)):
        parts = {}
        for r in chunking.chunked(docs, mode, size, 0, 1).collect():
            parts.setdefault(r.doc, []).append((r.part, r.piece))
        for doc, text in whole.items():
            mine = [p for _, p in sorted(parts.get(doc, []))]
            assert bare("".join(mine)) == bare(text), (mode, doc)
            if mode in ("window", "recursive"):
                assert all(len(p) <= size for p in mine)
            if mode == "recursive":  # greedy: no two neighbours would have fit together, unless a coarser separator parts them
                assert all(len(a) + len(b) + 1 > size or "\n" in text for a, b in zip(mine, mine[1:]))
    long = "word " * 100_000
    big = spark.createDataFrame([(1, long)], "doc int, text string")
    assert chunking.chunked(big, "fixed", 100, 0, 1).count() > chunking.MOST_CHUNKS and chunking.chunked(big, "fixed", 100, 0, 1, most=7).count() == 7


def test_knowledge(spark):
    docs = spark.createDataFrame([(1, "Газ и вода газ"), (2, None), (3, "")], "id int, text string")
    assert sorted((r.term, r.id, r.dl, r.tf, r.places) for r in SearchIndex.of(docs).postings().collect()) == [("вода", 1, 4, 1, [2]), ("газ", 1, 4, 2, [0, 3]), ("и", 1, 4, 1, [1])]
    assert version_of(docs).first() == version_of(docs.repartition(3)).first() != version_of(docs.where("id < 3")).first()
    faq = spark.createDataFrame([("faq_007", "q", "a"), ("other", "q2", "a2")], "id string, question string, answer string")
    assert sorted(r.id for r in knowledge.faq_added(faq, "new", "b").collect()) == ["faq_007", "faq_008", "other"] and knowledge.faq_added(faq.limit(0), "n", "b").first().id == "faq_001"
    five = knowledge.sampled(spark.range(100), 5, 7)
    assert sorted(five.collect()) == sorted(knowledge.sampled(spark.range(100).repartition(7), 5, 7).collect()) and five.count() == 5
    one_ = lambda t: spark.createDataFrame([(t,)], "s string").select(knowledge.hashed_vector(F.col("s")).alias("v")).first().v
    assert abs(sum(x * x for x in one_("a b c")) - 1) < 1e-9 and one_("a b") == one_("b a") and not any(one_(None)) and len(one_("x")) == 64
    files = spark.createDataFrame([(1, f"f{i:02}", f"text {i}") for i in range(12)], "claim int, file string, text string")
    b = {r.batch: (len(r.files), r.prompt[:22]) for r in knowledge.batches(files).collect()}
    assert b == {0: (10, "Документ 1 (f00):\ntext"), 1: (2, "Документ 1 (f10):\ntext")}
    groups = spark.createDataFrame([(1, "ENERGY", 2, 5.0), (2, "RENT", 1, 1.0)], "claim int, category string, articles int, total double")
    s = {r.claim: r.summary for r in knowledge.claim_summary(files.where("file = 'f00'"), groups, lambda c: c).collect()}
    assert s == {1: "f00: text 0\n\nENERGY 2 5.0", 2: "RENT 1 1.0"}
    asked = spark.createDataFrame([("q", "c" * 20), ("q", " "), ("q", None)], "q string, c string").select(knowledge.position(F.col("q"), F.col("c"), lambda p: p, 3).alias("a")).collect()
    assert asked[0].a.endswith("\nccc") and asked[1].a is None and asked[2].a is None
    assert spark.createDataFrame([(None,)], "s string").select(knowledge.prefixed(F.col("s"), "query")).first()[0] == "query: "


def test_names_one_edit_apart(spark):
    names = ["old plate", "cold plate", "old plat", "bold plate", "", "a", None, "xy", "yx"]
    got = sorted((r.name, r.other) for r in one_edit(spark.createDataFrame([(n,) for n in names], "name string")).collect())
    def near(a, b):
        return a == b or any(a[:i] + a[i + 1 :] == b for i in range(len(a))) or any(b[:i] + b[i + 1 :] == a for i in range(len(b))) or (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1)
    assert got == sorted((a, b) for a in names for b in names if a is not None and b is not None and near(a, b))


def test_sums_of_zero_have_no_shares(spark):
    facts = spark.createDataFrame([(1, a, f"статья {a}", y, "план", v) for a, y, v in (("1", 2024, 5.0), ("2", 2024, -5.0), ("1", 2023, 4.0))], "claim int, article string, name string, period int, pf string, value double")
    none = spark.createDataFrame([], "claim int, doc int, text string, w array<double>"), spark.createDataFrame([], "claim int, article string, v array<double>")
    assert sorted((r.article, r.value, r.inclusion_risk is not None) for r in flows.article_risks(facts, *none).collect()) == [("1", 5.0, True), ("2", -5.0, True)]
    from gridwright.operators.reconcile import top_and_rest

    assert {r.share for r in top_and_rest(spark.createDataFrame([("a", 5.0), ("b", -5.0)], "name string, amount double"), 1).collect()} == {None}
