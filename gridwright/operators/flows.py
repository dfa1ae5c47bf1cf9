"""The dataflows from questions, articles and lines to answers, risks and forecasts.

Each is one plan over a batch. Models stand behind named scorers; everything else is joins, windows and aggregates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions import rules
from gridwright.functions.parsing import section_of
from gridwright.operators import logs, retrieval, scorers
from gridwright.operators.matching import matched
from gridwright.operators.postings import SearchIndex

ANSWER_CHARS, CONTEXT_CHARS, QUESTION_CHARS = 2_000, 35_000, 400
#: What a scorer is: a column of prompts in, a column of answers out.
Scorer = Callable[[Column], Column]


def asked(questions: DataFrame, faq: DataFrame, docs: DataFrame, cache: DataFrame, routes: list[tuple[str, str]], k: int = 5, least: int = 3, model: str = "first_sentences", budget: int = 12_000) -> DataFrame:
    """``questions(query, text)`` -> ``(query, kind, answer, sources, section)``, kind being faq, answer or none.

    A question that shares ``least`` words with an entry of ``faq(pos, entry_text, answer)`` gets the first such entry's
    answer. The others search ``docs(id, text)``, and a scorer answers from the ``k`` best within a budget of characters,
    unless ``cache(key, answer)`` has it. Without a hit there is no answer. ``section`` is where the question's keywords lead.
    """
    known = retrieval.faq_by_tokens(questions.select(F.col("query").alias("question"), "text"), faq.select("pos", "entry_text"), least, 1)
    short = known.join(faq.select("pos", "answer"), "pos").select(F.col("question").alias("query"), F.lit("faq").alias("kind"), "answer", F.array().cast("array<string>").alias("sources"))
    open_ = questions.join(short.select("query"), "query", "left_anti")
    hits = SearchIndex.of(docs).top(open_, k)
    fitting = retrieval.within_budget(hits.join(docs, "id"), ["query"], [F.asc("rank")], F.char_length("text"), budget)
    context = fitting.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id"), "text"))).alias("s"))
    ready = open_.join(context, "query").select("query", F.transform("s", lambda x: x["id"]).alias("sources"), F.array_join(F.transform("s", lambda x: x["text"]), "\n\n").alias("prompt"))
    found = scorers.answered(ready, cache, model, model).select("query", F.lit("answer").alias("kind"), "answer", "sources")
    rest = open_.join(context.select("query"), "query", "left_anti").select("query", F.lit("none").alias("kind"), F.lit(None).cast("string").alias("answer"), F.array().cast("array<string>").alias("sources"))
    every = short.unionByName(found).unionByName(rest)
    return every.join(questions.select("query", section_of(F.col("text"), routes).alias("section")), "query")


def clarification(question: Column, previous: Column, sources: Column) -> Column:
    """The prompt of a follow-up question: the first characters of the previous answer, and new sources."""
    return scorers.prompt("Вопрос: {q}\nПредыдущий ответ: {p}\nИсточники:\n{s}", q=question, p=F.left(previous, F.lit(ANSWER_CHARS)), s=sources)


def answered_or_error(rows: DataFrame, prompt: Column, name: str) -> DataFrame:
    """``rows`` with ``answer`` and ``error``: a model's failure is a null with a message, never a text that looks like an answer."""
    made = rows.withColumn("answer", scorers.SCORERS[name](prompt))
    return made.withColumn("error", F.when(F.coalesce(F.trim("answer"), F.lit("")) == "", F.lit("no answer"))).withColumn("answer", F.when(F.col("error").isNull(), F.col("answer")))


def article_risks(facts: DataFrame, documents: DataFrame, vectors: DataFrame, target: float = 5.0, margin: float = 10.0, year: int = 0) -> DataFrame:
    """``facts(claim, article, name, period, pf, value)`` -> ``(claim, article, name, base, value, color, evidence, inclusion_risk, level)``.

    The regulated year is the claim's last one unless ``year`` is given; an article's base is its value of the year
    before, labels by rank. Growth gives a colour; an article without a document of ``documents(claim, doc, text, w)``
    that matches its name or its vector of ``vectors(claim, article, v)`` is at least yellow. Articles without a value
    in the regulated year are left out; where a claim's values add up to 0 no article has a share, and risks go by names alone.
    """
    years = facts.groupBy("claim").agg(F.max("period").alias("last")).select("claim", F.when(F.lit(year) > 0, F.lit(year)).otherwise(F.col("last")).alias("now"))
    first = F.min_by("value", F.struct(rules.rank_in(F.col("pf"), rules.PLAN_FACT_RANK), "value"))
    one = facts.join(years, "claim").where("period in (now, now - 1)").groupBy("claim", "article", "name", (F.col("period") == F.col("now")).alias("is_now")).agg(first.alias("value"))
    both = one.groupBy("claim", "article", "name").agg(F.max(F.when(~F.col("is_now"), F.col("value"))).alias("base"), F.max(F.when(F.col("is_now"), F.col("value"))).alias("value")).where("value is not null")
    found = matched(both.select("claim", "article", "name").join(vectors, ["claim", "article"], "left"), documents).groupBy("claim", "article").agg(F.count("*").alias("evidence"))
    grown = rules.growth_color(F.col("base"), F.col("value"), target, margin)
    whole = both.groupBy("claim").agg(F.sum("value").alias("whole"))
    out = both.join(found, ["claim", "article"], "left").join(whole, "claim").withColumn("evidence", F.coalesce("evidence", F.lit(0)))
    risk, _ = rules.article_risk(F.col("name"), F.try_divide(F.col("value"), F.col("whole")) * 100)
    color = F.when((grown == "green") & (F.col("evidence") == 0), F.lit("yellow")).otherwise(grown)
    return out.select("claim", "article", "name", "base", "value", color.alias("color"), "evidence", risk.alias("inclusion_risk"), rules.risk_level(risk).alias("level"))


def risk_summary(risks: DataFrame) -> DataFrame:
    """One row a claim: articles and their sum by colour."""
    each = [x for c in ("red", "yellow", "green") for x in (F.count_if(F.col("color") == c).alias(c), F.round(F.sum(F.when(F.col("color") == c, F.col("value")).otherwise(0.0)), 2).alias(f"{c}_sum"))]
    return risks.groupBy("claim").agg(F.count("*").alias("articles"), *each)


def classified(chunks: DataFrame, decide: Scorer, verify: Scorer) -> DataFrame:
    """``chunks(…, text)`` with ``decision`` and ``reason``: a first answer, and for decided chunks a second one that may turn it round."""
    first = chunks.withColumn("first", scorers.decision(decide(F.col("text"))))
    second = first.withColumn("reason", F.when(F.col("first") != "neutral", verify(F.col("text"))))
    return second.withColumn("decision", F.when(F.col("first") == "neutral", F.col("first")).otherwise(rules.reconciled(F.col("first"), F.col("reason")))).drop("first")


def forecast(requests: DataFrame, chunks: DataFrame, decide: Scorer, verify: Scorer, k: int = 30) -> DataFrame:
    """``requests(request, article, justification)`` over ``chunks(id, file, pos, text)`` -> ``(request, files, positive, negative, approval, confidence)``.

    The question is the article with the first characters of its justification. The best ``k`` chunks that fit the
    context are classified and verified, each file votes by majority, and the votes give the chance of approval.
    Requests without a hit have no votes.
    """
    queries = requests.select(F.col("request").alias("query"), F.concat_ws(" ", "article", F.left("justification", F.lit(QUESTION_CHARS))).alias("text"))
    hits = SearchIndex.of(chunks.select("id", "text")).top(queries, k)
    near = retrieval.within_budget(hits.join(chunks, "id"), ["query"], [F.asc("rank")], F.char_length("text"), CONTEXT_CHARS)
    told = classified(near.select("query", "file", "pos", "text"), decide, verify)
    votes = logs.majority(told.select(F.struct("query", "file").alias("file"), "decision", "pos", F.col("text").alias("quote")))
    count = lambda d: F.count_if(F.col("decision") == d)
    each = votes.groupBy(F.col("file.query").alias("request")).agg(F.count("*").alias("files"), count("positive").alias("positive"), count("negative").alias("negative"))
    out = requests.select("request").join(each, "request", "left").fillna(0, ["files", "positive", "negative"])
    return out.withColumns({"approval": rules.approval_percent(F.col("positive"), F.col("negative")), "confidence": rules.confidence(F.col("positive") + F.col("negative"))})


def normalised_revenue(lines: DataFrame, normalise: Scorer, repeats: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``lines(id, name, amount)`` -> (kept items with normal names, one row of counts: raw, kept, removed, total)."""
    named = lines.withColumn("name", normalise(F.col("name")))
    kept = repeats(named)
    n = named.agg(F.count("*").alias("raw")).crossJoin(F.broadcast(kept.agg(F.count("*").alias("kept"), F.round(F.sum("amount"), 2).alias("total"))))  # one row each
    return kept, n.select("raw", "kept", (F.col("raw") - F.col("kept")).alias("removed"), "total")
