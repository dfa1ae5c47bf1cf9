"""Line dedup: lines that many documents share are kept in one of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import ascii_lower, keep

_BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without blanks (20, 09-0D) at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(_BLANKS)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``text_col`` rebuilt from the lines that stay, and ``n_lines``, ``n_dropped`` (long) added.

    Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines except in
    the largest id that has them. Key hashes (128 bits) are counted in two steps, distinct (key, document) pairs and
    then documents a key, both pre-aggregated before their shuffle. Positions to drop come back to a document as words
    of 64 bits; its text is shuffled once, by document.

    A null text counts as an empty one: one empty line. Several rows with one id are one document for the counts, each
    row is rebuilt on its own. Rows with a null id are one document, never the largest. A text that loses all its lines
    becomes empty. Columns of the input named ``n_lines`` or ``n_dropped`` are replaced; others are passed on, whatever
    their names. An empty table stays empty. Long texts and lines are taken whole.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text"))
    row_key = F.unhex(F.md5("_text"))
    cut = own.select("_id", row_key.alias("_row"), F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
    keyed = cut.select("_id", "_row", "_pos", line_key(F.col("_line")).alias("_line")).where(F.char_length("_line") >= min_chars)
    hashed = keep(keyed.select("_id", "_row", "_pos", F.unhex(F.md5("_line")).alias("_key")), "lines")
    per_doc = hashed.select("_key", "_id").distinct()
    common = per_doc.groupBy("_key").agg(F.count("*").alias("_docs"), F.max("_id").alias("_last")).where(F.col("_docs") >= min_docs)
    common = keep(common.select("_key", "_last"), "common-lines")
    gone = hashed.join(common, "_key").where(~F.col("_id").eqNullSafe(F.col("_last")))
    words = gone.groupBy("_id", "_row", (F.col("_pos") / 64).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, _pos & 63))").alias("m"))
    marks = keep(words.groupBy("_id", "_row").agg(F.array_sort(F.collect_list(F.struct("w", "m"))).alias("_marks")), "dropped-lines")

    names = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{id_col}`").alias("_id"), text.alias("_text"))
    met = plain.withColumn("_row", F.unhex(F.md5("_text"))).join(
        marks.select(F.col("_id").alias("_i"), F.col("_row").alias("_r"), "_marks"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_row") == F.col("_r")), "left")
    lines = F.split("_text", "\n", -1)
    # a dense array of masks, then one look-up for each line
    last = F.element_at("_marks", -1)["w"]
    dense = F.aggregate("_marks", F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array_repeat(F.lit(0).cast("bigint"), x["w"] - F.size(a)), F.array(x["m"])))
    met = met.withColumn("_dense", F.when(last.isNull(), F.array().cast("array<bigint>")).otherwise(dense)).withColumn("_lines", lines)
    stays = F.expr("filter(_lines, (x, i) -> (shiftright(coalesce(get(_dense, i div 64), 0L), i % 64) & 1L) = 0L)")
    met = met.withColumn("_kept", F.when(F.size("_dense") == 0, F.col("_lines")).otherwise(stays))
    out = [F.col(f"c{names.index(c)}").alias(c) if c in names else F.array_join("_kept", "\n").alias(c) for c in docs.columns if c in names or c == text_col]
    n, m = F.size("_lines").cast("long"), F.size("_kept").cast("long")
    return met.select(*out, n.alias("n_lines"), (n - m).alias("n_dropped"))
