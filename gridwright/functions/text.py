"""Text expressions: tokens, cleaning, numbers, snippets, file names. Column in, Column out, JVM only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[а-яёa-z0-9]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often a lambda in the body uses it."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    """Lower-cased runs of Cyrillic and Latin letters and digits; of null, none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Whitespace-separated words; of a blank text, none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def without_blocks(text: Column, tag: str = "think") -> Column:
    """``text`` without ``<tag>…</tag>`` blocks, three line breaks or more made two, trimmed."""
    bare = F.regexp_replace(text, rf"(?s)<{tag}>.*?</{tag}>", "")
    return F.trim(F.regexp_replace(bare, r"\n{3,}", "\n\n"))


def number(text: Column) -> Column:
    """A cell as a number: blanks (no-break ones too) dropped, comma or point before the decimals; else null."""
    bare = F.translate(text, " \u00a0\t", "")
    return F.when(bare.rlike(r"^-?\d+([.,]\d+)?$"), F.replace(bare, F.lit(","), F.lit(".")).try_cast("double"))


def money(text: Column) -> Column:
    """A sum written with a currency sign and blanks; null if it isn't one."""
    return F.translate(F.replace(text, F.lit(","), F.lit(".")), "₽ \u00a0", "").try_cast("double")


def numbers(text: Column) -> Column:
    """All positive numbers in a text, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+[.,]?\d*"), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double")), lambda x: x > 0)


def year_of_cell(text: Column, first: int = 2010, last: int = 2045) -> Column:
    """The year in a cell that holds a year and nothing else, maybe with ``.0``; else null."""
    y = F.regexp_extract(F.trim(text), r"^(\d{4})(\.0)?$", 1).try_cast("int")
    return F.when(y.between(first, last), y)


def contains_all(text: Column, query: str) -> Column:
    """Whether every word of the query occurs, in either case."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(True)
    for w in query.lower().split():
        out = out & low.contains(w)
    return out


def stems(query: str) -> list[str]:
    """Beginnings of the query's words: two letters less than the word, four at least."""
    return [w[: max(4, len(w) - 2)] for w in query.lower().split()]


def contains_fuzzy(text: Column, query: str) -> Column:
    """Whether half of the query's stems occur, one at least."""
    low, found = F.lower(F.coalesce(text, F.lit(""))), stems(query)
    hits = sum((low.contains(s).cast("int") for s in found), F.lit(0))
    return hits >= max(1, len(found) // 2)


def occurrences(text: Column, needle: str, limit: int | None = None) -> Column:
    """Positions (from 1) of the needle in either case, overlapping ones too."""
    n = len(needle)
    places = lambda low: F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(low) - n + 1, F.lit(1))), lambda i: F.substr(low, i, F.lit(n)) == needle.lower())
    at = let(F.lower(F.coalesce(text, F.lit(""))), places)
    return F.slice(at, 1, limit) if limit else at


def snippet(text: Column, needle: str, before: int = 80, after: int = 80) -> Column:
    """The text around the first occurrence of the needle; null without one."""
    at = F.instr(F.lower(text), needle.lower())
    begin = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substr(text, begin, at - begin + len(needle) + after))


def highlighted(text: Column, needle: str) -> Column:
    """The needle in bold wherever it stands, in either case."""
    return F.regexp_replace(text, F.lit("(?iu)" + "".join("\\" + c if not c.isalnum() and c != " " else c for c in needle)), F.lit("**$0**"))


def repeats_itself(text: Column, window: int = 10, distinct: int = 2, shortest: int = 20) -> Column:
    """Whether a text is too short, or some window of words has no more than ``distinct`` different ones."""
    def poor(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - window, F.lit(1)))
        return (F.size(w) > window) & F.exists(starts, lambda i: F.size(F.array_distinct(F.slice(w, i, F.lit(window)))) <= distinct)

    return (F.char_length(F.trim(F.coalesce(text, F.lit("")))) < shortest) | let(words(text), poor)


def broken_answer(text: Column, token: str = "<pad>", marker: str = "[loop]") -> Column:
    """Whether an answer is missing, under 20 characters, has a token more than ten times, or a loop marker."""
    n = (F.char_length(text) - F.char_length(F.replace(text, F.lit(token), F.lit("")))) / len(token)
    return text.isNull() | (F.char_length(F.trim(text)) < 20) | (n > 10) | text.contains(marker)


def complete_answer(text: Column) -> Column:
    """Whether the text ends as a finished sentence or list does."""
    return F.rtrim(text).rlike(r"[.!?…»\")\]]$")


def without_emoji(text: Column) -> Column:
    """The text without pictographs and blanks at its beginning."""
    return F.regexp_replace(text, r"^[\x{2600}-\x{27BF}\x{1F000}-\x{1FAFF}\x{FE0F}\x{200D}\s]+", "")


def slug(text: Column, longest: int = 40) -> Column:
    """Latin letters for Cyrillic ones, everything else than letters, digits and hyphens to a hyphen."""
    out = F.lower(text)
    # Letters that take several.
    for a, b in (("ё", "yo"), ("ж", "zh"), ("х", "kh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "shch"), ("ю", "yu"), ("я", "ya"), ("ъ", ""), ("ь", "")):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.translate(out, "абвгдезийклмнопрстуфыэ", "abvgdeziyklmnoprstufye")
    return F.left(F.regexp_replace(F.regexp_replace(out, "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(longest))


def size_label(n: Column) -> Column:
    """Bytes as B, KB or MB, with one decimal from KB on: what lies halfway between two goes to the even one. Null has no label."""
    of = lambda unit, name: F.format_string(f"%.1f {name}", F.bround(n / float(unit), 1))
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1 << 20, of(1 << 10, "KB")).when(n >= 1 << 20, of(1 << 20, "MB"))


def value_label(v: Column) -> Column:
    """A sum for people: millions with two decimals, thousands grouped, else two decimals."""
    return F.when(F.abs(v) >= 1e6, F.concat(F.format_string("%.2f", v / 1e6), F.lit(" млн"))).when(F.abs(v) >= 1e3, F.format_number(v, 0)).otherwise(F.format_string("%.2f", v))


def file_number(name: Column) -> Column:
    """The document number behind a number sign in a file name; empty without one."""
    return F.regexp_extract(name, r"№\s*([0-9А-Яа-яA-Za-z/\-]+)", 1)


def file_date(name: Column) -> Column:
    """The date in a file name as DD.MM.YYYY: written so already, with other separators, or year first; empty without one."""
    a = F.regexp_extract(name, r"(\d{2})[._-](\d{2})[._-](\d{4})", 0)
    b = F.regexp_extract(name, r"(\d{4})[._-](\d{2})[._-](\d{2})", 0)
    forward = F.concat_ws(".", *[F.regexp_extract(name, r"(\d{2})[._-](\d{2})[._-](\d{4})", i) for i in (1, 2, 3)])
    back = F.concat_ws(".", *[F.regexp_extract(name, r"(\d{4})[._-](\d{2})[._-](\d{2})", i) for i in (3, 2, 1)])
    return F.when(a != "", forward).when(b != "", back).otherwise(F.lit(""))


# Kinds of documents by words in the file name, first match wins.
DOC_TYPES = [("npa", ["постановлен", "приказ", "закон", "фз", "нпа"]), ("fas", ["фас"]), ("court", ["суд", "решение", "определение"]), ("methodics", ["методик", "методическ"])]


def first_match(text: Column, ladder: list[tuple[str, list[str]]], default: str | None) -> Column:
    """The first label one of whose words occurs in the lower-cased text."""
    low, out = F.lower(text), F.lit(default)
    for label, keys in reversed(ladder):
        hit = F.lit(False)
        for k in keys:
            hit = hit | low.contains(k)
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def doc_type(name: Column) -> Column:
    return first_match(name, DOC_TYPES, "unknown")


def file_attributes(name: Column, methods: list[str]) -> Column:
    """struct<region, sphere, year, method, organization> of a name whose parts are joined by underscores.

    The year is the first part that is a year or a range of years, the method the first known one behind it, and the
    organization what stands strictly between the two.
    """
    bare = F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")
    parts = F.split(bare, "_")
    is_year = lambda p: p.rlike(r"^(19|20)\d{2}(-(19|20)\d{2})?$")
    year = F.filter(parts, is_year)[0]
    y = F.array_position(parts, year)
    method = F.filter(F.slice(parts, y + 1, F.size(parts)), lambda p: F.lower(p).isin(methods))[0]
    m = F.array_position(parts, method)
    org = F.when(m - y > 1, F.array_join(F.slice(parts, y + 1, m - y - 1), "_"))
    return F.struct(F.get(parts, F.lit(0)).alias("region"), F.get(parts, F.lit(1)).alias("sphere"), year.alias("year"), F.lower(method).alias("method"), org.alias("organization"))


def digest(query: Column, sources: Column, model: str) -> Column:
    """Cache key of a question: md5 of the query, its sources in order, and the model."""
    return F.md5(F.concat_ws("|||", query, F.to_json(F.array_sort(sources)), F.lit(model)))


def preview(text: Column, chars: int = 800, lines: int = 8, longest: int = 350) -> Column:
    """A short plain preview: markdown signs removed, the first lines that have text joined, cut."""
    bare = F.regexp_replace(F.left(text, F.lit(chars)), r"(?m)^[#>*\-\s]+|[*_`]", "")
    kept = F.filter(F.transform(F.split(bare, "\n"), F.trim), lambda x: x != "")
    return F.left(F.array_join(F.slice(kept, 1, lines), " "), F.lit(longest))
