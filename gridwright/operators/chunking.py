"""Chunkers: texts cut into pieces by lines, headings, separators, sentences or size.

Line-level chunkers are DataFrame plans: lines are exploded, a running count of boundary lines numbers the blocks, and
blocks are put together again in order; a document's lines meet in one group, which is as large as the document. Greedy
ones, where each cut depends on the one before, walk a text once in an Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.sources.scratch import short_batches

ROWS = 100  # of which the pieces are held at once
MOST_CHUNKS = 2000  # of one file, as the configuration has it

# What marks a line as a running title, and the signs that separator lines are made of.
JUNK = r"(?iu)консультантплюс|www\.consultant\.ru|документ предоставлен|дата сохранения|зарегистрировано в минюсте"
RULE_LINE = r"^[-–—_= *\t]+$"
# Lines that begin a block of a legal text, by the kind of the block.
LEGAL_KINDS = [
    ("chapter", r"^Глава\s+(\d+)[\s.]"), ("article", r"^Статья\s+(\d+(?:\.\d+)?)[.\s]"), ("section", r"^([IVX]+)\.\s+[А-ЯЁ]"),
    ("subpoint", r"^([а-яё])\)\s"), ("point", r"^(\d+(?:\(\d+\))?)\.\s+[А-ЯЁ(\"«]"), ("point", r"^(\d+\.\d+)\.\s+[А-ЯЁ(]"),
]
PROTOCOL_HEADING = r'^### (\d+)(?:\.(\d+))? "?([^"\n\[]+)"?(?:\s*\[tag:\s*([a-zа-яё_]*)\])?\s*$'
RETELLING, RECOGNISED = "ПОДРОБНЫЙ ПЕРЕСКАЗ", "РАСПОЗНАННЫЙ ТЕКСТ"
EMPTY_SECTION = r"(?iu)^\W*(данные|информация|сведения)?\s*(отсутству|не\s+(указан|определен|предоставлен|выявлен|рассматрива))"


def lines(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """``(doc, pos, line)``, positions from 0."""
    return docs.select(doc, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("pos", "line"))


def joined(rows: DataFrame, by: list[str], separator: str = "\n", text: str = "line", more: Sequence[Column] = ()) -> DataFrame:
    """Lines of each group put together in order, with ``more`` aggregates of the group beside them."""
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", text))), lambda x: x[text]), separator).alias("text"), *more)


def paginated(docs: DataFrame, per_page: int = 80) -> DataFrame:
    """``(doc, page, text, word_count)``: pages of so many lines, from 1."""
    pages = joined(lines(docs).withColumn("page", (F.col("pos") / per_page).cast("int") + 1), ["doc", "page"])
    return pages.withColumn("word_count", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))


def blocks(rows: DataFrame, begins: Column) -> DataFrame:
    """Lines with a block number: 0 before the first line that begins a block, one more at each that does."""
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("block", F.sum(begins.cast("int")).over(w))


def by_heading(docs: DataFrame, heading: str) -> DataFrame:
    """``(doc, block, heading, text)``: what stands from a heading line to the next; text before the first is left out."""
    rows = blocks(lines(docs), F.col("line").rlike(heading)).where("block > 0")
    heads = rows.groupBy("doc", "block").agg(F.min_by("line", "pos").alias("heading"))
    return joined(rows, ["doc", "block"]).join(heads, ["doc", "block"]).select("doc", "block", "heading", F.trim("text").alias("text"))


def retelling(text: Column) -> Column:
    """The part between the two markers of a protocol, without the marker's line and the rule below it; the whole text without a marker."""
    at, end = F.instr(text, RETELLING), F.instr(text, RECOGNISED)
    body = F.regexp_replace(F.substr(text, at), r"^[^\n]*\n[^\n]*\n", "")
    cut = F.when(end > 0, F.substring_index(body, RECOGNISED, 1)).otherwise(body)
    return F.when(at > 0, F.trim(cut)).otherwise(text)


def protocol_articles(docs: DataFrame, least: int = 30) -> DataFrame:
    """Sections ``### N NAME`` and articles ``### N.M "name" [tag: x]`` of protocols' retellings."""
    cut = by_heading(docs.select("doc", retelling(F.col("text")).alias("text")), PROTOCOL_HEADING)
    part = lambda i: F.regexp_extract("heading", PROTOCOL_HEADING, i)
    article = part(2) != ""
    return cut.where(F.char_length("text") >= least).select(
        "doc", "block", F.when(article, "article").otherwise("section").alias("kind"), part(1).alias("section_num"), F.when(article, F.concat(part(1), F.lit("."), part(2))).alias("article_num"),
        F.when(article, F.trim(part(3))).alias("article_name"), F.when(part(4) != "", part(4)).alias("tag"), "text")


def requisites(text: Column) -> Column:
    """map of the ``key: value`` lines in the head of a protocol; the last value of a key stays."""
    head = F.substring_index(text, RETELLING, 1)
    found = F.regexp_extract_all(head, F.lit(r"(?m)^([А-Яа-яёЁ ]+?):[ \t]*(.*)$"), F.lit(0))
    pairs = F.transform(found, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"].alias("value"))))


def empty_section(body: Column, longest: int = 400) -> Column:
    """Whether a section says no more than that it has nothing to say."""
    bare = F.trim(F.coalesce(body, F.lit("")))
    return (bare == "") | ((F.char_length(bare) <= longest) & bare.rlike(EMPTY_SECTION))


def expertise_sections(docs: DataFrame) -> DataFrame:
    """Informative sections of an expert report, its tariff sections always, and the recognised text as one more chunk."""
    cut = by_heading(docs.select("doc", retelling(F.col("text")).alias("text")), r"^###\s*\d+(?:\.\d+)?\s")
    body = F.trim(F.regexp_replace(F.regexp_replace("text", r"^[^\n]*\n?", ""), r"(?s)\n?={10,}.*$", ""))
    name = F.trim(F.regexp_extract("heading", r'^###\s*\d+(?:\.\d+)?\s+"?([^"\[\n]*)', 1))
    sections = cut.select("doc", "block", F.regexp_extract("heading", r"^###\s*(\d+(?:\.\d+)?)", 1).alias("num"), name.alias("section"), body.alias("text")).where(
        (F.col("text") != "") & (F.lower("section").contains("тариф") | ~empty_section(F.col("text"))))
    tail = docs.where(F.instr("text", RECOGNISED) > 0).select("doc", F.lit(1 << 30).alias("block"), F.lit("ocr").alias("num"), F.lit(RECOGNISED).alias("section"), F.trim(F.regexp_replace(F.element_at(F.split("text", RECOGNISED, 2), 2), r"^[^\n]*\n\s*-{5,}\s*\n", "")).alias("text"))
    return sections.unionByName(tail.where("text <> ''"))


def legal_kind(line: Column) -> tuple[Column, Column]:
    """A line's kind of block and its number; other and empty for a line that begins none."""
    bare, kind, number = F.trim(line), F.lit("other"), F.lit("")
    for name, pattern in reversed(LEGAL_KINDS):
        kind, number = F.when(bare.rlike(pattern), name).otherwise(kind), F.when(bare.rlike(pattern), F.regexp_extract(bare, pattern, 1)).otherwise(number)
    return kind, number


def is_table(block: Column) -> Column:
    """Whether a block looks like a table: six lines or more, over 60 per cent of them short."""
    full = F.filter(F.transform(F.split(block, "\n"), F.trim), lambda x: x != "")
    return (F.size(full) >= 6) & (F.size(F.filter(full, lambda x: F.char_length(x) < 60)) > F.size(full) * 0.6)


def legal_chunks(docs: DataFrame, limit: int = 3000) -> DataFrame:
    """Chunks of legal texts by chapter, article and point, with what they inherit from the chunks before.

    Junk and rule lines go. Chapters, sections and bare article titles stick to the block behind them, lettered
    subpoints and short remarks to the point before them. Oversize chunks are cut between sentences, tables between
    lines with their first line repeated. Texts without any boundary are cut between sentences.
    """
    least = max(80, limit // 12)
    rows = lines(docs).where(~F.trim("line").rlike(JUNK) & ~F.trim("line").rlike(RULE_LINE))
    kind, number = legal_kind(F.col("line"))
    rows = blocks(rows.withColumns({"kind": kind, "number": number}), kind != "other")
    heads = [F.min_by(c, "pos").alias(a) for c, a in (("kind", "kind"), ("number", "number"), ("line", "head"))]
    raw = joined(rows, ["doc", "block"], more=heads).withColumn("text", F.trim("text")).where("text <> ''")
    order = Window.partitionBy("doc").orderBy("block")
    glued = F.lag("kind").over(order).isin("chapter", "section") | ((F.lag("kind").over(order) == "article") & (F.lag(F.char_length("text")).over(order) < least))
    sticks = F.coalesce(glued, F.lit(False)) | ((F.col("kind") == "subpoint") & (F.lag("block").over(order).isNotNull())) | ((F.col("kind") == "other") & (F.char_length("text") < least) & F.lag("block").over(order).isNotNull())
    grouped = raw.withColumn("chunk", F.sum((~sticks).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    leads = [*[F.min_by(c, "pos").alias(c) for c in ("kind", "number", "head")], F.max(F.when(F.col("kind") == "article", F.col("number"))).alias("article")]
    merged = joined(grouped.withColumnRenamed("block", "pos"), ["doc", "chunk"], "\n\n", "text", leads)
    flow = Window.partitionBy("doc").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    context = merged.withColumns({
        "article": F.coalesce(F.last(F.coalesce("article", F.when(F.col("kind").isin("point", "chapter"), F.col("number"))), True).over(flow), F.lit("")),
        "section": F.coalesce(F.last(F.when(F.col("kind").isin("chapter", "section"), F.left(F.trim("head"), F.lit(80))), True).over(flow), F.lit("")),
        "is_table": is_table(F.col("text")),
    })
    cut = exploded(context, lambda t, table: table_parts(t, limit) if table else packed_sentences(t, limit), ["text", "is_table"])
    return cut.select("doc", "chunk", "part", F.col("kind").alias("struct_type"), "number", "article", "section", "piece", F.left(F.substring_index("piece", "\n", 1), F.lit(100)).alias("preview"))


def by_separator(docs: DataFrame, separator: str, least: int = 50) -> DataFrame:
    """``(doc, pos, text)``: trimmed parts between separators, those of ``least`` characters or more."""
    parts = docs.select("doc", F.posexplode(F.split("text", re.sub(r"([\W])", r"\\\1", separator), -1)).alias("pos", "text"))
    return parts.withColumn("text", F.trim("text")).where(F.char_length("text") >= least)


def overlapped(chunks: DataFrame, n: int) -> DataFrame:
    """Each chunk with the last n characters of the one before it in front."""
    before = F.lag("text").over(Window.partitionBy("doc").orderBy("pos"))
    return chunks.withColumn("text", F.concat(F.coalesce(F.right(before, F.lit(n)), F.lit("")), F.col("text")))


def context_text(rows: DataFrame, by: list[str]) -> DataFrame:
    """Chunks ``(pos, line, is_target)`` as one text, targets and neighbours labelled."""
    return joined(rows.withColumn("line", F.concat(F.when(F.col("is_target"), "[target] ").otherwise("[context] "), F.col("line"))), by, "\n\n")


def packed_sentences(text: str, limit: int) -> list[str]:
    """Whole sentences up to the limit in a piece; a longer sentence is cut at blanks, and stands before the piece then open."""
    kept, out, held, size = [], [], [], 0
    for sentence in re.split(r"(?<=[.!?])(?<!т\.д\.)(?<!т\.п\.)\s+", text or ""):
        rest = " ".join(x for x in sentence.splitlines() if x.strip() and not re.search(JUNK, x) and not re.match(RULE_LINE, x.strip())).strip()
        if rest:
            kept.append(rest)
    for sentence in kept:
        if len(sentence) + 1 > limit:
            while len(sentence) > limit:
                at = sentence.rfind(" ", 0, limit)
                at = at if at > 0 else limit
                out.append(sentence[:at].strip())
                sentence = sentence[at:].strip()
            out += [sentence] if sentence else []
        elif held and size + len(sentence) + 1 > limit:
            out.append(" ".join(held))
            held, size = [sentence], len(sentence) + 1
        else:
            held.append(sentence)
            size += len(sentence) + 1
    return [x for x in [*out, " ".join(held)] if x]


def table_parts(text: str, limit: int) -> list[str]:
    """A table's lines in pieces up to the limit, each under its first line."""
    head, *rest = text.split("\n")
    out, now = [], [head]
    for line in rest:
        if len(now) > 1 and sum(map(len, now)) + len(now) + len(line) > limit:
            out.append("\n".join(now))
            now = [head]
        now.append(line)
    return [*out, "\n".join(now)] if len(now) > 1 or not out else out


def snapped(text: str, start: int, end: int) -> int:
    """A place to cut near ``end``: behind a sentence or a word in the last quarter of the window, else behind the next one."""
    if end >= len(text):
        return len(text)
    low = start + (end - start) * 3 // 4
    back = max(text.rfind(p, low, end) for p in ".!?")
    if back >= low:
        return back + 1
    ahead = [p for p in (text.find(c, end) for c in ".!?") if p >= 0]
    if ahead:
        return min(ahead) + 1
    word = text.rfind(" ", low, end)
    return word + 1 if word >= low else text.find(" ", end) + 1 or end


def fixed_parts(text: str, size: int, overlap: int = 0) -> list[str]:
    """Pieces of about ``size`` characters that end where a sentence or word does, each beginning ``overlap`` before the end of the last."""
    out, at = [], 0
    while at < len(text):
        end = snapped(text, at, min(at + size, len(text)))
        out.append(text[at:end].strip())
        if end >= len(text):
            break
        at = max(end - overlap, end - size + 1, at + 1) if overlap else end
    return [x for x in out if x]


def window_parts(text: str, size: int, overlap: int) -> list[str]:
    """Windows for a model: broken at a paragraph, sentence or blank in the last quarter, overlapping, half a window ahead at least."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while at + size < len(text):
        end = at + size
        low = at + size * 3 // 4
        for sep in ("\n\n", ". ", " "):
            p = text.rfind(sep, low, end)
            if p >= 0:
                end = p + len(sep)
                break
        out.append(text[at:end].strip())
        at = max(at + size // 2, end - overlap)
    return [x for x in [*out, text[at:].strip()] if x]


def recursive_parts(text: str, size: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces up to ``size``: cut at the coarsest separator that is there, longer pieces at the next one, and packed again."""
    if len(text) <= size:
        return [text] if text.strip() else []
    sep = next(s for s in separators if s in text)
    finer = separators[separators.index(sep) + 1 :] or ("",)
    parts = text.split(sep) if sep else [text[i : i + size] for i in range(0, len(text), size)]
    out, now = [], ""
    for p in parts:
        if len(p) > size:
            out += [now] if now.strip() else []
            out += recursive_parts(p, size, finer)
            now = ""
        elif now and len(now) + len(sep) + len(p) > size:
            out.append(now)
            now = p
        else:
            now = now + sep + p if now else p
    return [x.strip() for x in [*out, now] if x.strip()]


def exploded(docs: DataFrame, cut: Callable[..., list[str]], inputs: list[str]) -> DataFrame:
    """Rows of ``docs`` without their inputs, with ``part`` (from 0) and ``piece`` for each piece that ``cut`` makes of these, in Arrow batches."""
    keep = [c for c in docs.columns if c not in ("part", "piece", *inputs)]
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep), "part int", "piece string"])

    short_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (x.iloc[i : i + ROWS] for x in batches for i in range(0, len(x), ROWS)):
            made = [cut(*x) for x in b[inputs].itertuples(index=False)]
            n = [len(x) for x in made]
            out = b[keep].loc[b.index.repeat(n)].reset_index(drop=True)
            out["part"] = [i for x in made for i in range(len(x))]
            out["piece"] = [p for x in made for p in x]
            yield out

    return docs.mapInPandas(run, shape)


def chunked(docs: DataFrame, mode: str = "structural", size: int = 1000, overlap: int = 0, least: int = 50, separator: str = "&&", most: int | None = None) -> DataFrame:
    """``docs(doc, text)`` cut by a named mode -> ``(doc, part, piece)``; short pieces left out. Whole texts, unless ``most`` keeps a document's first pieces only (MOST_CHUNKS is the usual number).

    protocol_articles falls back to structural for documents without its headings.
    """
    if mode == "protocol_articles":
        found = protocol_articles(docs, least)
        made = found.select("doc", F.col("block").alias("part"), F.col("text").alias("piece"))
        rest = chunked(docs.join(found.select("doc").distinct(), "doc", "left_anti"), "structural", size, overlap, least, most=most)
        return made.unionByName(rest)
    if mode == "legal":
        cut = legal_chunks(docs, size).select("doc", (F.col("chunk") * 10_000 + F.col("part")).cast("int").alias("part"), "piece")
    elif mode == "separator":
        cut = by_separator(docs, separator, least).select("doc", F.col("pos").alias("part"), F.col("text").alias("piece"))
    else:
        how = {"structural": lambda t: packed_sentences(t, size), "fixed": lambda t: fixed_parts(t or "", size, overlap), "window": lambda t: window_parts(t or "", size, overlap), "recursive": lambda t: recursive_parts(t or "", size)}[mode]
        cut = exploded(docs, how, ["text"]).select("doc", "part", "piece")
    if overlap and mode in ("structural", "separator"):
        cut = overlapped(cut.select("doc", F.col("part").alias("pos"), F.col("piece").alias("text")), overlap).select("doc", F.col("pos").alias("part"), F.col("text").alias("piece"))
    sound = cut.where(F.char_length("piece") >= least)
    if most is None:
        return sound
    rank = F.row_number().over(Window.partitionBy("doc").orderBy("part"))
    return sound.withColumn("_n", rank).where(F.col("_n") <= most).drop("_n")
