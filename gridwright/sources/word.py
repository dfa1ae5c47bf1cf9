"""Texts of Word files: one archive a row, opened by tasks where the file is read."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the name space of a document's elements.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_BREAKS = {W + "tab": "\t", W + "br": "\n", W + "cr": "\n"}


def _inline(element: ElementTree.Element) -> str:
    """The text of a paragraph's runs, with its tabs and line breaks."""
    return "".join(x.text or "" if x.tag == W + "t" else _BREAKS.get(x.tag, "") for r in element.iter(W + "r") for x in r)


def _rows(table: ElementTree.Element) -> Iterator[list[str]]:
    """Cells of a table's rows; a cell over several columns, or continued from the row above, has its text in each of them."""
    above: list[str] = []
    for row in table.findall(W + "tr"):
        cells: list[str] = []
        for cell in row.findall(W + "tc"):
            props = cell.find(W + "tcPr")
            span = props.find(W + "gridSpan") if props is not None else None
            merge = props.find(W + "vMerge") if props is not None else None
            text = "\n".join(_inline(p) for p in cell.findall(W + "p")).strip()
            if merge is not None and merge.get(W + "val", "continue") == "continue" and len(above) > len(cells):
                text = above[len(cells)]
            cells += [text] * (int(span.get(W + "val", "1")) if span is not None else 1)
        above = cells
        yield cells


def document_text(content: bytes) -> str:
    """The paragraphs of a Word archive that aren't blank, then its tables' rows, cells joined by `` | ``, a line each."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open("word/document.xml") as xml:
        body = ElementTree.parse(xml).getroot().find(W + "body")
    if body is None:
        return ""
    lines = [t for t in map(_inline, body.findall(W + "p")) if t.strip()]
    return "\n".join([*lines, *(" | ".join(cells) for table in body.findall(W + "tbl") for cells in _rows(table))])


def word_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, doc, text, error)`` of every file below a folder: Word archives (docx) with their whole text and no error.

    A broken archive has a null text and what was wrong with it; a file of another kind, which is not opened, the error
    ``unsupported``. An empty document has the empty text. Files of no bytes are not listed, as Spark's reader leaves them out. Where archives are large, ``spark.sql.execution.arrow.maxRecordsPerBatch``
    bounds how many of them a task holds.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = found.select("path", F.element_at(F.split("path", "/"), -1).alias("doc"), "content")
    wanted = F.lower("doc").endswith(".docx")

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for content in b["content"]:
                try:
                    made.append((document_text(bytes(content)), None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, NotImplementedError, RuntimeError, ValueError, OSError, EOFError) as e:
                    made.append((None, f"broken: {type(e).__name__}"))
            yield pd.DataFrame({"path": b["path"], "doc": b["doc"], "text": [t for t, _ in made], "error": [e for _, e in made]})

    others = named.where(~wanted).select("path", "doc", F.lit(None).cast("string").alias("text"), F.lit("unsupported").alias("error"))
    return named.where(wanted).mapInPandas(opened, "path string, doc string, text string, error string").unionByName(others)
