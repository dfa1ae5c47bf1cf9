"""Irregular sheets to a long fact table.

Cells are rows ``(book, sheet, r, c, s)``; a sheet's header, name column and units are found by aggregates over its
cells, and facts by joining value cells with them. No sheet is ever held as a grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions import rules
from gridwright.functions.text import number, year_of_cell
from gridwright.sources.scratch import keep

SHEET = ["book", "sheet"]
# Machine keys and header words that are no article names.
SERVICE_KEYS = [
    "PJ_YEAR", "PJ_PF", "PJ_DOP", "PJ_PERIOD", "PJ_DOP_FIN", "PJ_DYN", "PJ_DYN_V", "PJ_NAME", "PJ_NAME_UNIT", "PJ_NAME_ED_IZM", "PJ_NAME_DOP", "PJ_NAME_FUEL", "PJ_UNIT",
    "dyn_names", "dyn_name", "uni_prd_data", "uni_org_reg", "uni_pf", "V_POK", "D_YEAR", "obj_mo", "obj_obj",
]
HEADER_WORDS = ["Наименование", "Наименование показателя", "Наименование показател", "№ п/п", "Ед. изм.", "Единица измерения", "Показатель", "Код", "всего", "горячая вода", "пар", "Не определено", "Добавить строку", "Комментарии и примечания", "Комментарии и примечан"]
# What a unit of measure looks like, sheets that hold no articles, and sheets of technical figures.
UNIT = r"(?iu)^\s*(тыс\.?\s*руб\.?|руб\.?|млн\.?\s*руб\.?|Гкал.*|куб\.?\s*м.*|тыс\.?\s*куб\.?\s*м.*|кВт.*|тыс\.?\s*кВт.*|тонн|тн|чел\.?|ед\.?|%|шт\.?|км|руб\.?\s*/.*|т\.у\.т\.?|°?С)\s*$"
SKIPPED_SHEETS = [
    "Инструкция", "Информация JSON", "Список листов", "Общие сведения", "Заявление", "Список территорий", "Список объектов", "Сценарии", "Сценарии (МСА)", "Расчет УЕ", "Транспорт", "Комментарии",
    "TEHSHEET", "TECHSHEET", "REESTR_OBJECT", "REESTR_OBJ_MO", "REESTR_OBJ_TRANSP", "REESTR_MO", "REESTR_ORG", "REESTR_DOP", "REESTR_SEP_DIV", "REESTR_IP_KS", "DICTIONARIES", "Настройка",
    "Титульный", "Документы", "Выбор метода", "Список периодов", "Виды деятельности", "Базы распределения", "Земельные участки", "Реестр жилых домов", "Реестр юр лиц", "Реестр СН", "Реестр ТСО",
    "Реестр договоров", "Информ-я о регулируемой орг-и", "Объекты теплоснабжения", "Список объектов теплоснабжения",
]
SKIPPED_PREFIXES = ["Черновик", "REESTR_", "DICT"]
TECHNICAL = r"(?iu)^(К_ФАС|Р_ФАС|БТр_|БПр_|ТМ\d|Столбцы|Экон\.|Индексы|Справочники|Перечень|Амортизация_ФАС|Реестр потребит)"
LABELS = ["Факт", "Принято", "Предложение", "План", "Ожидаемое"]


def is_unit(s: Column) -> Column:
    return F.coalesce(s.rlike(UNIT), F.lit(False))


def is_article_name(s: Column) -> Column:
    """Whether a cell can name an article: letters, no key, unit, number, code or flag."""
    t = F.trim(s)
    code = ~t.contains(" ") & t.rlike(r"[A-Za-z].*\d.*\d|\d{4,}") & t.rlike(r"[_\-][A-Za-z0-9]{4,}")
    bad = t.isin(SERVICE_KEYS + HEADER_WORDS) | is_unit(t) | t.rlike(r"^[-+]?\d+([.,]\d+)*$") | t.rlike(r"^[MmDdPp]\d{3,}") | t.rlike(r"^(check|ИТОГО_|et_|DYN_|P_|Indicators_)[A-Za-zА-Яа-я0-9_.]+$")
    bad = bad | t.contains("::") | t.startswith("{") | t.contains("funcDyn") | F.lower(t).isin("true", "false", "да", "нет", "x", "×", "-", "—") | code
    return F.coalesce((F.char_length(t) >= 3) & ~bad & t.rlike("[A-Za-zА-Яа-яЁё]"), F.lit(False))


def kept_sheets(cells: DataFrame) -> DataFrame:
    """Cells of sheets that aren't on the skip list and have three rows and two columns at least."""
    named = cells.where(~F.col("sheet").isin(SKIPPED_SHEETS))
    for p in SKIPPED_PREFIXES:
        named = named.where(~F.col("sheet").startswith(p))
    shape = named.groupBy(*SHEET).agg(F.max("r").alias("mr"), F.max("c").alias("mc")).where("mr >= 2 and mc >= 1").select(*SHEET)
    return named.join(shape, SHEET, "left_semi")


def is_template_book(cells: DataFrame) -> DataFrame:
    """``(book, template)``: whether marker sheets or marker cells near the top left show the regulator's own form."""
    mark = F.col("sheet").isin("TECHSHEET", "TEHSHEET") | ((F.col("r") < 20) & (F.col("c") < 6) & (F.trim("s").isin("PJ_YEAR", "PJ_PF") | F.trim("s").startswith("Indicators") | F.trim("s").startswith("D0041")))
    return cells.groupBy("book").agg(F.bool_or(F.coalesce(mark, F.lit(False))).alias("template"))


def year_columns(cells: DataFrame) -> DataFrame:
    """``(…, r, c, year)`` of each sheet's header row: the first with a year marker, else the one with most years, two at least."""
    marked = cells.where((F.col("c") == 0) & (F.trim("s") == "PJ_YEAR")).select(*SHEET, "r", F.lit(1).alias("marked"))
    years = cells.select(*SHEET, "r", "c", year_of_cell(F.col("s")).alias("year")).where("year is not null")
    rows = years.groupBy(*SHEET, "r").agg(F.count("*").alias("n")).join(marked, [*SHEET, "r"], "left").where("n >= 2 or marked = 1")
    best = rows.withColumn("k", F.row_number().over(Window.partitionBy(*SHEET).orderBy(F.desc_nulls_last("marked"), F.when(F.col("marked") == 1, F.lit(0)).otherwise(-F.col("n")), "r"))).where("k = 1")
    return years.join(best.select(*SHEET, "r"), [*SHEET, "r"])


def plan_fact_labels(cells: DataFrame, header: DataFrame) -> DataFrame:
    """The plan-or-fact label of each year column: of the marker row, else the nearest up to six rows above, else three below."""
    near = cells.join(header.select(*SHEET, F.col("r").alias("hr"), "c"), [*SHEET, "c"]).withColumn("label", rules.plan_fact(F.col("s")))
    marker = cells.where((F.col("c") == 0) & (F.trim("s") == "PJ_PF")).select(*SHEET, F.col("r").alias("mr"))
    near = near.join(marker, SHEET, "left")
    distance = F.when(F.col("r") == F.col("mr"), -1).when((F.col("r") <= F.col("hr")) & (F.col("r") >= F.col("hr") - 6), F.col("hr") - F.col("r")).when((F.col("r") > F.col("hr")) & (F.col("r") <= F.col("hr") + 3), 10 + F.col("r") - F.col("hr"))
    good = near.withColumn("d", distance).where(F.col("d").isNotNull() & (F.col("label").isin(LABELS) | (F.col("d") == -1)))
    return good.groupBy(*SHEET, "c").agg(F.min_by("label", "d").alias("pf"))


def name_column(cells: DataFrame, header: DataFrame) -> DataFrame:
    """``(…, name_c)``: the column under a name header near the year row, else the one with most article names of middling length."""
    at = header.groupBy(*SHEET).agg(F.min("r").alias("hr"), F.collect_set("c").alias("year_cs"))
    free = cells.join(at, SHEET).where(~F.array_contains("year_cs", F.col("c")))
    near = free.where((F.col("r") >= F.col("hr") - 8) & (F.col("r") < F.col("hr") + 4))
    titled = near.where(F.trim("s").rlike(r"(?iu)^наименование")).groupBy(*SHEET).agg(F.min_by("c", F.struct("r", "c")).alias("titled"))
    banned = near.where(F.col("s").rlike(r"(?iu)коммент|примечан|обоснован")).select(*SHEET, "c").distinct()
    n = F.char_length(F.trim("s"))
    rated = free.where((F.col("r") > F.col("hr")) & (F.col("r") <= F.col("hr") + 200) & is_article_name(F.col("s"))).join(banned, [*SHEET, "c"], "left_anti").groupBy(*SHEET, "c").agg(F.count_if(n.between(8, 120)).alias("good"), F.count_if(n > 120).alias("long"))
    guessed = rated.where("good > 0").groupBy(*SHEET).agg(F.min_by("c", F.struct(-F.col("good"), F.col("long"), F.col("c"))).alias("guessed"))
    return titled.join(guessed, SHEET, "full").select(*SHEET, F.coalesce("titled", "guessed").alias("name_c"))


def unit_column(cells: DataFrame, header: DataFrame) -> DataFrame:
    """``(…, unit_c)``: the column with most units in the 120 rows below the header."""
    at = header.groupBy(*SHEET).agg(F.min("r").alias("hr"))
    hits = cells.join(at, SHEET).where((F.col("r") > F.col("hr")) & (F.col("r") <= F.col("hr") + 120) & is_unit(F.col("s"))).groupBy(*SHEET, "c").count()
    return hits.groupBy(*SHEET).agg(F.min_by("c", F.struct(-F.col("count"), F.col("c"))).alias("unit_c"))


def facts(cells: DataFrame) -> DataFrame:
    """Cells -> ``(book, sheet, pos, article, period, pf, value, unit)`` of all numbers other than 0 under a year and beside an article name."""
    cells = keep(kept_sheets(cells), "cells")  # read once for each thing that is looked for
    header = keep(year_columns(cells), "header")
    return _values(cells, header, plan_fact_labels(cells, header))


def _values(cells: DataFrame, header: DataFrame, labels: DataFrame) -> DataFrame:
    """Facts below ``header(…, r, c, year)``, labelled by ``labels(…, c, pf)``."""
    names, units = name_column(cells, header), unit_column(cells, header)
    named = cells.join(names, SHEET).where(F.col("c") == F.col("name_c")).where(is_article_name(F.col("s")) & (F.char_length(F.trim("s")) <= 160)).select(*SHEET, "r", F.trim("s").alias("article"))
    united = cells.join(units, SHEET).where((F.col("c") == F.col("unit_c")) & is_unit(F.col("s"))).select(*SHEET, "r", F.trim("s").alias("unit"))
    values = cells.join(header.select(*SHEET, F.col("r").alias("hr"), "c", "year"), [*SHEET, "c"]).where("r > hr").withColumn("value", number(F.col("s"))).where("value <> 0")
    out = values.join(named, [*SHEET, "r"]).join(united, [*SHEET, "r"], "left").join(labels, [*SHEET, "c"], "left")
    return out.select(*SHEET, F.col("r").alias("pos"), "article", F.col("year").alias("period"), F.coalesce("pf", F.lit("")).alias("pf"), "value", F.coalesce("unit", F.lit("")).alias("unit"))


def header_text_facts(cells: DataFrame, depth: int = 8) -> DataFrame:
    """Facts of sheets whose years and labels stand in the texts of their first ``depth`` rows. Those end where the first article with a number begins."""
    cells = keep(kept_sheets(cells), "cells")
    numbered = cells.where(number(F.col("s")).isNotNull() & year_of_cell(F.col("s")).isNull()).select(*SHEET, "r").distinct()
    begins = cells.where((F.col("r") < depth + 1) & is_article_name(F.col("s"))).join(numbered, [*SHEET, "r"]).groupBy(*SHEET).agg(F.min("r").alias("first"))
    top = cells.join(begins, SHEET, "left").where(F.col("r") < F.least(F.coalesce("first", F.lit(depth)), F.lit(depth))).drop("first")
    columns = keep(header_text_columns(top, depth), "header")
    header = columns.join(begins, SHEET, "left").select(*SHEET, (F.least(F.coalesce("first", F.lit(depth)), F.lit(depth)) - 1).alias("r"), "c", "year")
    return _values(cells, keep(header, "header"), columns.select(*SHEET, "c", "pf"))


def parsed(cells: DataFrame) -> DataFrame:
    """The facts of whole books: the regulator's own forms by their header rows; other books by header texts, and by header rows on
    sheets where these tell nothing. Cleaned, one of each, other than 0, with the book's ``format``."""
    kind = keep(is_template_book(cells), "books")
    own, other = (cells.join(kind.where(F.col("template") == t).select("book"), "book", "left_semi") for t in (True, False))
    texts = keep(header_text_facts(other), "facts")
    rest = other.join(texts.select(*SHEET).distinct(), SHEET, "left_anti")
    both = facts(own).unionByName(texts).unionByName(facts(rest))
    form = F.when(F.col("template"), F.lit("template")).otherwise(F.lit("free"))
    return deduplicated(cleaned(both)).where("value <> 0").join(kind.select("book", form.alias("format")), "book")


def book_counts(cells: DataFrame, long: DataFrame) -> DataFrame:
    """``(book, sheets, sheets_parsed, records, articles)``: of all sheets those that gave facts, and what these are."""
    sheets = cells.groupBy("book").agg(F.count_distinct("sheet").alias("sheets"))
    got = long.groupBy("book").agg(F.count_distinct("sheet").alias("sheets_parsed"), F.count("*").alias("records"), F.count_distinct("article").alias("articles"))
    return sheets.join(got, "book", "left").fillna(0)


def header_text_columns(cells: DataFrame, depth: int = 8) -> DataFrame:
    """``(…, c, year, pf)`` of sheets whose years stand in header texts: a column's first rows stacked, decree numbers and dates
    dropped, a range of years taken by its end, columns without a year taking that of the column to the left."""
    stacked = cells.where(F.col("r") < depth).groupBy(*SHEET, "c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "s"))), lambda x: x["s"]), " ").alias("t"))
    bare = F.regexp_replace("t", r"(?iu)(от\s+)?\d{1,2}\.\d{1,2}\.\d{4}|№\s*\S+", " ")
    last = F.try_element_at(F.regexp_extract_all(bare, F.lit(r"(20[1-4]\d)"), F.lit(0)), F.lit(-1))
    texts = stacked.withColumns({"own": last.try_cast("int"), "pf": rules.plan_fact(F.col("t"))})
    left = F.last("own", True).over(Window.partitionBy(*SHEET).orderBy("c").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return texts.withColumn("year", left).where(F.col("year").isNotNull() & F.col("pf").isin(LABELS)).select(*SHEET, "c", "year", "pf")


def deduplicated(long: DataFrame, pos: str = "pos") -> DataFrame:
    """One fact for each (book, sheet, article, period, pf): by the label's rank, then the first."""
    w = Window.partitionBy(*[c for c in ("book", "sheet") if c in long.columns], "article", "period", "pf").orderBy(rules.rank_in(F.col("pf"), rules.PLAN_FACT_RANK), pos)
    return long.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cleaned(long: DataFrame) -> DataFrame:
    """Facts with sound names, cut to 200 characters."""
    return long.withColumn("article", F.left(F.trim("article"), F.lit(200))).where((F.char_length("article") >= 3) & ~F.col("article").startswith("{") & F.col("article").rlike("[A-Za-zА-Яа-яЁё]"))


def articles(long: DataFrame) -> DataFrame:
    """``(sheet, article, unit, type, tech_sheet, series, checked)``: each article's series in order, its most frequent unit, and the default choice.

    Costs on sheets that aren't technical are chosen; if there are none at all, costs and zeros everywhere.
    """
    units = long.where("unit <> ''").groupBy("sheet", "article", "unit").count()
    unit = units.groupBy("sheet", "article").agg(F.min_by("unit", F.struct(-F.col("count"), F.col("unit"))).alias("unit"))
    tech = long.groupBy("sheet").agg((F.avg((F.trim("unit") == "").cast("int")) > 0.8).alias("bare")).select("sheet", (F.col("bare") | F.trim("sheet").rlike(TECHNICAL)).alias("tech_sheet"))
    series = long.groupBy("sheet", "article").agg(F.array_sort(F.collect_list(F.struct("period", "pf", "value"))).alias("series"))
    kind = rules.article_type(F.col("article"), F.exists("series", lambda x: x["value"] != 0))
    out = series.join(unit, ["sheet", "article"], "left").join(tech, "sheet").withColumn("type", kind)
    good = (F.col("type") == "cost") & ~F.col("tech_sheet")
    some = out.agg(F.coalesce(F.bool_or(good), F.lit(False)).alias("some"))
    return out.crossJoin(F.broadcast(some)).select("sheet", "article", F.coalesce("unit", F.lit("")).alias("unit"), "type", "tech_sheet", "series", F.when(F.col("some"), good).otherwise(F.col("type").isin("cost", "zero")).alias("checked"))


def rendered(long: DataFrame) -> DataFrame:
    """Each article's series as one compact line, largest article first by ``rank``."""
    from gridwright.functions.text import value_label

    part = F.concat(F.col("period").cast("string"), F.when(F.col("pf") != "", F.concat(F.lit("/"), F.left("pf", F.lit(3)))).otherwise(F.lit("")), F.lit("="), value_label(F.col("value")))
    lines = long.withColumn("part", part).groupBy("article").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("period", "pf", "part"))), lambda x: x["part"]), ", ").alias("line"), F.abs(F.max("value")).alias("size"))
    return lines


def range_total(cells: DataFrame, column: int, first: int, last: int, how: str = "sum") -> DataFrame:
    """SUM or AVERAGE over a range of one column of each sheet, cells that are no numbers left out."""
    values = cells.where((F.col("c") == column) & F.col("r").between(first, last)).withColumn("v", number(F.col("s"))).where("v is not null")
    return values.groupBy(*SHEET).agg((F.sum if how == "sum" else F.avg)("v").alias("value"))
