"""Parsers of answers and rendered texts, and small keyword rules. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridwright.functions.rules import any_of
from gridwright.functions.text import let

NUMBERED = r"(?isu)Документ\s+(\d+)\s*:\s*(.+?)(?=Документ\s+\d+\s*:|$)"
_FULL = r"(?iu)(\d{4})\s*\(([^)]+)\)\s*:\s*([\d\s]+(?:[.,]\d+)?)\s*тыс"
_SHORT = r"(\d{4})/([^=,\s]+)=([\d.]+)"
# Long words that tell nothing about an answer.
FILLERS = ["который", "которая", "которое", "является", "являются", "необходимо", "необходима"]


def _all(text: Column, pattern: str, *groups: int) -> Column:
    """array<struct<g1, g2, …>> of some groups of every match."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups])


def numbered_answers(answer: Column) -> Column:
    """``Документ i: …`` of a batch answer as array<struct<i int, text string>>, line breaks as blanks."""
    return F.transform(_all(answer, NUMBERED, 1, 2), lambda m: F.struct(m["g1"].try_cast("int").alias("i"), F.replace(F.regexp_replace(m["g2"], r"^\s+|\s+$", ""), F.lit("\n"), F.lit(" ")).alias("text")))


def answers_by_file(answer: Column, files: Column) -> Column:
    """array<struct<file, text>> of a batch answer; if nothing can be read from it, its first 200 characters go to the first file."""
    sound = F.filter(numbered_answers(answer), lambda m: m["i"].between(1, F.size(files)))
    named = F.transform(sound, lambda m: F.struct(F.get(files, m["i"] - 1).alias("file"), m["text"].alias("text")))
    rest = F.array(F.struct(F.get(files, F.lit(0)).alias("file"), F.left(answer, F.lit(200)).alias("text")))
    return F.when(F.size(named) > 0, named).when(F.size(files) > 0, rest).otherwise(F.slice(rest, 1, 0))


def amounts(text: Column) -> Column:
    """A rendered series of amounts as array<struct<year int, label string, value double>> by year.

    Read are ``2024 (label): 12 345 тыс.…`` and, where nothing is of that form, ``2024/label=12345``.
    """
    def made(found: Column) -> Column:
        each = F.transform(found, lambda m: F.struct(m["g1"].cast("int").alias("year"), F.trim(m["g2"]).alias("label"), F.replace(F.regexp_replace(m["g3"], r"\s", ""), F.lit(","), F.lit(".")).try_cast("double").alias("value")))
        return F.filter(each, lambda m: m["value"].isNotNull())

    full, short = made(_all(text, _FULL, 1, 2, 3)), made(_all(text, _SHORT, 1, 2, 3))
    by_year = lambda a: F.transform(F.array_sort(F.transform(a, lambda m, i: F.struct(m["year"].alias("year"), i.alias("i"), m["label"].alias("label"), m["value"].alias("value")))), lambda m: F.struct(m["year"].alias("year"), m["label"].alias("label"), m["value"].alias("value")))
    return by_year(F.when(F.size(full) > 0, full).otherwise(short))


def rendered_articles(text: Column, nonzero: bool = True) -> Column:
    """Rendered articles back to array<struct<name, amounts>>, each name once.

    Read are a line ``★ name`` with its amounts on the lines below, up to an empty line or one that begins with ★ or #,
    and lines ``name: year/label=value, …``. Names have more than three characters; ``nonzero`` leaves out articles
    all of whose values are 0.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x))
    start = F.struct(F.lit(None).cast("string").alias("name"), F.array().cast("array<string>").alias("parts"), F.array().cast("array<struct<name:string,amounts:string>>").alias("out"))

    def closed(acc: Column) -> Column:
        done = F.array(F.struct(acc["name"].alias("name"), F.array_join(acc["parts"], " | ").alias("amounts")))
        return F.when(acc["name"].isNotNull(), F.concat(acc["out"], done)).otherwise(acc["out"])

    def state(name: Column, parts: Column, out: Column) -> Column:
        return F.struct(name.cast("string").alias("name"), parts.cast("array<string>").alias("parts"), out.alias("out"))

    def step(acc: Column, line: Column) -> Column:
        none, empty = F.lit(None), F.array()
        short = F.struct(F.trim(F.substring_index(line, ":", 1)).alias("name"), F.trim(F.substr(line, F.instr(line, ":") + 1)).alias("amounts"))
        outside = F.when(line.contains(":") & line.contains("=") & ~line.startswith("#"), state(none, empty, F.concat(closed(acc), F.array(short)))).otherwise(state(none, empty, closed(acc)))
        return F.when(line.startswith("★"), state(F.trim(F.regexp_replace(line, "^★+", "")), empty, closed(acc))).when(
            acc["name"].isNotNull() & (line != "") & ~line.startswith("#"), state(acc["name"], F.concat(acc["parts"], F.array(line)), acc["out"])).otherwise(outside)

    sound = F.filter(F.aggregate(lines, start, step, closed), lambda a: F.char_length(a["name"]) > 3)
    if nonzero:
        sound = F.filter(sound, lambda a: F.exists(amounts(a["amounts"]), lambda m: m["value"] != 0))
    return let(sound, lambda s: F.filter(s, lambda a, i: ~F.exists(F.slice(s, F.lit(1), i), lambda b: b["name"] == a["name"])))


def table_lines(text: Column) -> Column:
    """Lines of a markdown table in an answer, its rule of dashes left out."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x).rlike(r"^\|.*\|$"))
    return F.filter(lines, lambda x: ~F.trim(x).rlike(r"^\|[\s:|-]+\|$"))


def folder_of(name: Column, preview: Column, folders: list[tuple[str, list[str]]], rest: str) -> Column:
    """The first folder one of whose keywords is in a file's name or preview, in either case; else ``rest``."""
    text, out = F.lower(F.concat_ws(" ", name, F.coalesce(preview, F.lit("")))), F.lit(rest)
    for folder, keys in reversed(folders):
        out = F.when(any_of(text, keys), folder).otherwise(out)
    return out


def tags_of(name: Column, preview: Column, tags: list[tuple[str, list[str]]]) -> Column:
    """All tags one of whose keywords is in a file's name or preview, in their order."""
    text = F.lower(F.concat_ws(" ", name, F.coalesce(preview, F.lit(""))))
    return F.array_compact(F.array(*[F.when(any_of(text, keys), F.lit(tag)) for tag, keys in tags]))


def file_name(kind: Column, day: Column, organisation: Column, name: Column, suffix: Column) -> Column:
    """kind_yyyymmdd_organisation_comment with the file's suffix; the comment is the name up to its first dot, 30 characters at most."""
    owner = F.when(F.coalesce(organisation, F.lit("")) == "", F.lit("Орг")).otherwise(organisation)
    return F.concat(F.concat_ws("_", kind, F.date_format(day, "yyyyMMdd"), owner, F.left(F.substring_index(name, ".", 1), F.lit(30))), suffix)


def section_of(text: Column, routes: list[tuple[str, str]]) -> Column:
    """The section of the first keyword in a question, in either case; null without one."""
    out, low = F.lit(None).cast("string"), F.lower(text)
    for key, section in reversed(routes):
        out = F.when(low.contains(key), section).otherwise(out)
    return out


def answer_is_right(given: Column, right: Column, least: float = 0.4) -> Column:
    """Whether an answer has a share of the long words of the right one, or one is part of the other; without long words, whether they are equal."""
    mine, own = F.trim(F.lower(given)), F.lower(right)
    words = F.filter(F.split(F.trim(own), r"\s+"), lambda w: (F.char_length(w) > 4) & ~w.isin(FILLERS))
    share = F.size(F.filter(words, lambda w: mine.contains(w))) / F.size(words)
    return F.when(F.size(words) > 0, (share >= least) | own.contains(mine) | mine.contains(own)).otherwise(mine == own)


def pseudo_distance(score: Column) -> Column:
    """A fused rank score as a distance: 1 less 60 times it, 0 at least."""
    return F.round(F.greatest(F.lit(0.0), 1 - 60 * score), 3)


def relevance_percent(distance: Column) -> Column:
    return F.round((1 - distance) * 100, 1)


def minutes_needed(top_k: Column, tokens: Column, rate: float = 7.0) -> Column:
    """Minutes that answers of so many tokens take at a rate of tokens a second."""
    return top_k * tokens / rate / 60


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with its ``{placeholders}`` filled; a missing value leaves an empty place."""
    out = template
    for name, v in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


def label_of(code: Column, labels: dict[str, str], default: str | None) -> Column:
    """The label of a code, by a map of literals."""
    pairs = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, code), F.lit(default))
