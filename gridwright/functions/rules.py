"""Rule expressions: article types, growth, risk, staffing, depreciation, votes. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridwright.functions.text import first_match

# Words that tell a total line, and those that tell a reference figure.
TOTAL_WORDS = ["итого", "всего", "нвв", "необходимая валовая выручка", "средневзвешенный", "итого по тарифу", "всего по тарифу"]
REFERENCE_WORDS = ["тариф", "руб./", "руб/", "индекс", "объём", "объем", "полезный отпуск", "доля товарной", "численность", "коэффициент", "норматив", "ставка 1 разряда"]

# Cost categories by patterns in the name, first match wins.
COST_CATEGORIES = {
    "PAYROLL": ["оплат.*труд", "фот", "зарплат", "персонал", "ауп", "ппр", "общепроизводствен"],
    "REPAIRS": ["ремонт.*основн", "тоир", "восстановительн", "ремонт.*оборуд"],
    "SOFTWARE": ["по", "программ.*обеспеч", "1с", "лицензи", "картридж", "компьютер"],
    "ADMIN": ["хозяйствен", "канцеляр", "почтов", "офис", "делопроизводств"],
    "ENERGY": ["энергоресурс", "топливо", "газ", "электроэнерг", "тепло", "вода"],
    "RENT": ["аренд", "лизинг"],
    "TRANSFER": ["передач", "ттк", "ттс", "услуг.*передач"],
    "OTHER": ["проч", "иные", "друг"],
}

# Words in an article's name, risk of including it, risk of leaving it out; first match wins.
RISK_BRANCHES = [
    (["ремонт", "ос"], 70, 30),
    (["зарплат", "труд", "ауп"], 40, 85),
    (["электроэнерги", "тепло", "топлив"], 15, 95),
    (["программ", "по", "лицензи"], 55, 40),
    (["тко", "транспортирован", "полигон"], 25, 90),
    (["вод", "перекачк", "химреагент"], 20, 92),
]

# Plan-or-fact labels by what a header says, first match wins.
PLAN_FACT = [
    ("Предложение", ["предложение организации", "предложения организации", "план регулируемой организации", "план регулируемой орга", "план организации", "версия организации"]),
    ("Принято", ["принято органом регулирования", "план органа регулирования", "план органа регулирова", "версия регулятора", "утверждено"]),
    ("Факт", ["факт по данным организации", "факт, принятый органом регулирования", "факт тсо", "факт"]),
    ("Ожидаемое", ["ожидаемое за период по данным организации", "ожидаемое"]),
    ("План", ["план"]),
]
#: Order of the labels when several tell of one period.
PLAN_FACT_RANK = ["Принято", "Предложение", "Факт", "План", "Ожидаемое", ""]


def any_of(text: Column, keys: list[str]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | text.contains(k)
    return out


def plan_fact(text: Column) -> Column:
    """A header's label, its first 30 characters if it has none of the known ones, empty for null."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    return F.coalesce(first_match(bare, PLAN_FACT, None), F.left(bare, F.lit(30)))


def rank_in(value: Column, order: list[str]) -> Column:
    """0 for the first of ``order``, and so on; their number for any other value."""
    out = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        out = F.when(value == v, F.lit(i)).otherwise(out)
    return out


def article_type(name: Column, has_value: Column) -> Column:
    """agg for totals, ref for reference figures, zero without a value, else cost."""
    low = F.lower(F.trim(name))
    return F.when(any_of(low, TOTAL_WORDS), "agg").when(any_of(low, REFERENCE_WORDS), "ref").when(~has_value, "zero").otherwise("cost")


def cost_category(name: Column) -> Column:
    """The first category one of whose patterns occurs; OTHER without one, UNKNOWN for null or empty."""
    low, out = F.lower(name), F.lit("OTHER")
    for category, patterns in reversed(COST_CATEGORIES.items()):
        out = F.when(low.rlike("|".join(patterns)), category).otherwise(out)
    return F.when(name.isNull() | (name == ""), "UNKNOWN").otherwise(out)


def label_priority(label: Column) -> Column:
    """Facts before estimates before plans before accepted figures before the rest."""
    low = F.lower(F.coalesce(label, F.lit("")))
    return F.when(any_of(low, ["факт", "отч"]), 0).when(low.contains("пред"), 1).when(low.contains("план"), 2).when(low.contains("при"), 3).otherwise(4)


def growth_color(base: Column, value: Column, target: float, risk: float) -> Column:
    """red above target + risk per cent, yellow above target or without a base, else green."""
    growth = (value - base) / base * 100
    return F.when(value.isNull() | base.isNull() | (base <= 0), "yellow").when(growth > target + risk, "red").when(growth > target, "yellow").otherwise("green")


def article_risk(name: Column, percent: Column, branches: list = RISK_BRANCHES) -> tuple[Column, Column]:
    """Risks (0 to 100) of including an article and of leaving it out."""
    low, within, without = F.lower(name), F.lit(50), F.lit(50)
    for keys, a, b in reversed(branches):
        hit = any_of(low, keys)
        within, without = F.when(hit, a).otherwise(within), F.when(hit, b).otherwise(without)
    return F.when(percent > 20, F.least(F.lit(100), within + 15)).otherwise(within), F.when(percent < 1, F.greatest(F.lit(0), without - 20)).otherwise(without)


def risk_level(risk: Column) -> Column:
    return F.when(risk >= 70, "red").when(risk >= 40, "yellow").otherwise("green")


def compared(value: Column, benchmark: Column) -> Column:
    """more or less if over ten per cent off the benchmark, else equal."""
    return F.when(value > benchmark * 1.1, "more").when(value < benchmark * 0.9, "less").otherwise("equal")


def deviation_percent(value: Column, benchmark: Column) -> Column:
    return F.when(benchmark == 0, F.lit(0.0)).otherwise(F.round((value - benchmark) / benchmark * 100, 2))


def depreciation(cost: Column, life: Column, method: str = "linear", digits: int | None = 2) -> Column:
    """A year's depreciation: cost over life, twice that if declining; 0 without a sound life or cost. Rounded, unless digits is None."""
    year = cost * (1.0 if method == "linear" else 2.0) / life
    return F.when((life > 0) & cost.isNotNull(), year if digits is None else F.round(year, digits)).otherwise(F.lit(0.0))


def group_fits(group: Column, life: Column, norms: dict[int, tuple[float, float]]) -> Column:
    """Whether a useful life is within its group's norm (least, most)."""
    out = F.lit(False)
    for g, (low, high) in norms.items():
        out = F.when(group == g, (life >= low) & (life <= high)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def staffing_norm(norm: Column, scale: Column) -> Column:
    """Fractions are a norm for each unit of scale, other numbers are absolute."""
    return F.when((norm > 0) & (norm < 1), F.round(norm * scale, 1)).otherwise(norm)


def staffing_status(actual: Column, norm: Column) -> Column:
    """ok up to the norm, warn up to 25 per cent above it, else over."""
    percent = F.when(norm > 0, F.round((actual - norm) / norm * 100, 1)).otherwise(F.lit(0.0))
    return F.when(actual <= norm, "ok").when(percent <= 25, "warn").otherwise("over")


def approval_percent(positive: Column, negative: Column, weight: float = 1.5) -> Column:
    """Share of positive votes, negative ones weighing more; 50 without either."""
    total = positive + negative * weight
    return F.when(total > 0, F.round(positive / total * 100, 1)).otherwise(F.lit(50.0))


def confidence(n: Column) -> Column:
    return F.when(n >= 5, "high").when(n >= 1, "medium").otherwise("low")


# What an explanation says when it agrees with a decision, and when it doesn't.
AGREES = r"(?iu)совпадени[ея]\s+(позици|подход|вариант|метод)|(тот\s+же|такой\s+же|один\s+и\s+тот\s+же)\s+(вариант|подход|принцип|срок|метод)|совпадает\s+с\s+позицией|регулятор\s+(также|тоже)\s+(выбрал|применил|использовал)"
DISAGREES = r"(?iu)противоречи[ея]|не\s+совпадает|противоположн|расхожд|(другой|иной)\s+(вариант|подход|принцип)|регулятор\s+(не\s+согласен|отклонил|отказал)"


def reconciled(decision: Column, reason: Column) -> Column:
    """The decision, turned round where the explanation clearly says the opposite."""
    yes, no = F.coalesce(reason.rlike(AGREES), F.lit(False)), F.coalesce(reason.rlike(DISAGREES), F.lit(False))
    return F.when(yes & ~no & (decision == "negative"), "positive").when(no & ~yes & (decision == "positive"), "negative").otherwise(decision)


def decision_fields(text: Column) -> Column:
    """struct<claimed, accepted, adjustment, rationale>: the first value of each field of a regulator's section."""
    def field(name: str, more: str = "") -> Column:
        raw = F.regexp_extract(text, rf"(?iu){name}{more}\*{{0,2}}\s*(?:\+/-)?\s*:?\s*\*{{0,2}}[ \t]*([^\n\r]+)", 1)
        bare = F.trim(F.regexp_replace(F.regexp_replace(raw, r"[.,;\s]+$", ""), r"^\*+|\*+$", ""))
        return F.when(bare != "", bare)

    return F.struct(field("Заявлено", r"(?:\s+предприятием)?").alias("claimed"), field("Принято", r"(?:\s+экспертами)?").alias("accepted"), field("Корректировка").alias("adjustment"), field("ОБОСНОВАНИЕ").alias("rationale"))


def summarise_plan(chars: Column, chunk: int = 6000, group: int = 10, direct: int = 12000) -> Column:
    """struct<chunks, levels, calls> of a map-reduce summary of a text of so many characters."""
    n = F.when(chars <= direct, F.lit(1)).otherwise(F.ceil(chars / chunk)).cast("int")
    groups = F.ceil(n / group).cast("int")
    levels = F.when(n <= 1, 1).when(n <= group, 2).otherwise(3)
    return F.struct(n.alias("chunks"), levels.alias("levels"), F.when(n <= 1, 1).when(n <= group, n + 1).otherwise(n + groups + 1).alias("calls"))


# What a model's context allows, in tokens.
CONTEXT = {"context": 25_000, "map_output": 600, "chunk": 3_000, "reduce_overhead": 1_000, "reduce_answer": 4_000, "chars_per_token": 4, "group": 3}
SECONDS = {"map": 35, "mid": 60, "reduce": 300}  # a call's usual time


def context_plan(chars: Column, limits: dict[str, int] = CONTEXT) -> Column:
    """How a text of so many characters is summarised within a model's context, as a struct.

    Pieces are as even as the last call allows and no longer than ``chunk``; where their summaries don't fit into it, ``group`` of
    them are put together in a level between. ``context`` is what the largest call needs, rounded up to a thousand tokens.
    A null length counts as 0.
    """
    n = F.coalesce(chars, F.lit(0)).cast("long")
    per, out = limits["chars_per_token"], limits["map_output"]
    fitting = max(1, (limits["context"] - limits["reduce_overhead"] - limits["reduce_answer"]) // out)
    piece = F.least(F.greatest(F.lit(1), F.floor(F.floor(n / per) / fitting)), F.lit(limits["chunk"])).cast("long")
    pieces = F.greatest(F.lit(1), F.ceil(n / (piece * per))).cast("long")
    three = pieces > fitting
    blocks = F.when(three, F.ceil(pieces / limits["group"])).otherwise(0).cast("long")
    last = F.when(three, blocks).otherwise(pieces) * out + limits["reduce_overhead"]
    mapped = piece + out + 200  # the map prompt itself
    need = F.greatest(mapped, F.greatest(last, mapped) + limits["reduce_answer"])
    seconds = pieces * SECONDS["map"] + blocks * SECONDS["mid"] + SECONDS["reduce"]
    return F.struct(
        (piece * per).alias("piece_chars"), pieces.alias("pieces"), F.when(three, 3).otherwise(2).alias("levels"), blocks.alias("blocks"),
        (F.ceil(need / 1000) * 1000).cast("long").alias("context"), F.round(seconds / 60, 1).alias("minutes"))


def mean_annual_amortization(columns: list[str], start: str = "start", end: str = "end", year: str = "year") -> Column:
    """An aggregate: the mean of (start + end) / 2 where a table has both columns, else of the year's column, else 0.

    Rows in which a needed value is null count for nothing; without any row left it is null.
    """
    if start in columns and end in columns:
        return F.avg((F.col(f"`{start}`") + F.col(f"`{end}`")) / 2)
    return F.avg(F.col(f"`{year}`")) if year in columns else F.lit(0.0)
