"""Spreadsheets (.xlsx) as tables: the sheet's XML is read out of the archive by the executors.

The files come through Spark's binary reader, so any store that Spark reads will do. A workbook is the unit of
a task, and is bounded by its format (1,048,576 rows); its cells leave the task in batches.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvion.sources.files import label

#: Cells in a batch.
CELLS = 50_000
#: The namespaces of a workbook's parts.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _sheet_path(book: zipfile.ZipFile, sheet: str | int) -> str:
    """Where the sheet of a name, or of a place from 0 on, lies in the archive."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = [(s.get("name"), links[s.get(_LINK)]) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
    if isinstance(sheet, int):
        if not 0 <= sheet < len(sheets):
            raise ValueError(f"the workbook has {len(sheets)} sheets")
        target = sheets[sheet][1]
    elif sheet in dict(sheets):
        target = dict(sheets)[sheet]
    else:
        raise ValueError(f"the workbook has no sheet {sheet}")
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _texts(part: ElementTree.Element) -> str:
    """A string of one or several runs; phonetic hints are no text."""
    return "".join(t.text or "" for run in (part, *part.findall(f"{_MAIN}r")) for t in run.findall(f"{_MAIN}t"))


def _column(reference: str) -> int:
    """A to 0, Z to 25, AA to 26..."""
    number = 0
    for c in re.match("[A-Z]+", reference)[0]:
        number = number * 26 + ord(c) - 64
    return number - 1


def read_cells(content: bytes, sheet: str | int) -> Iterator[tuple[int, int, str | None, float | None]]:
    """(row from 1, column from 0, text, number) of the cells that hold something. Booleans are 1 and 0,
    dates the days that the format counts; errors are text."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = [_texts(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")] if "xl/sharedStrings.xml" in book.namelist() else []
        row, column = 0, -1
        with book.open(_sheet_path(book, sheet)) as xml:
            for event, e in ElementTree.iterparse(xml, ("start", "end")):
                if event == "start" and e.tag == f"{_MAIN}row":
                    row, column = int(e.get("r") or row + 1), -1
                elif event == "end" and e.tag == f"{_MAIN}c":
                    column = _column(e.get("r")) if e.get("r") else column + 1
                    kind, v = e.get("t", "n"), e.find(f"{_MAIN}v")
                    if kind == "inlineStr":
                        text = _texts(e.find(f"{_MAIN}is"))
                    elif v is None or v.text is None:
                        continue
                    else:
                        text = shared[int(v.text)] if kind == "s" else v.text
                    if kind in ("n", "b"):
                        yield row, column, None, float(text)
                    else:
                        yield row, column, text, None
                elif event == "end" and e.tag == f"{_MAIN}row":
                    e.clear()  # rows that are done take no memory


def cells(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """path, row, column, text, number of all cells that hold something, of one workbook or several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(name: str, held: list) -> pa.RecordBatch:
            rows, columns, texts, values = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array(rows, pa.int32()), pa.array(columns, pa.int32()), pa.array(texts, pa.string()), pa.array(values, pa.float64())], ["path", "row", "column", "text", "number"])

        for files in batches:
            for name, content in zip(files.column("path").to_pylist(), files.column("content")):
                held = []
                for cell in read_cells(content.as_py(), sheet):
                    held.append(cell)
                    if len(held) >= CELLS:
                        yield batch(name, held)
                        held = []
                if held:
                    yield batch(name, held)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row int, column int, text string, number double")


def table(spark: SparkSession, path: str, sheet: str | int = 0, header: int = 1) -> DataFrame:
    """The sheet's rows below its ``header``: a column of text for each named one, numbers as they would be written;
    empty cells are null, empty rows absent. Of columns of one name the first counts."""
    found = cells(spark, path, sheet)
    names: dict[str, int] = {}
    for r in found.where(F.col("row") == header).orderBy("column").collect():  # one row of the sheet
        shown = r["text"] if r["text"] is not None else f"{r['number']:g}"
        if shown.strip():
            names.setdefault(shown.strip(), r["column"])
    whole = (F.col("number") == F.floor("number")) & (F.abs("number") < 1e15)
    shown = F.coalesce("text", F.when(whole, F.col("number").cast("bigint").cast("string")).otherwise(F.col("number").cast("string")))
    rows = found.where(F.col("row") > header).groupBy("path", "row").agg(F.lit(0).alias("__0"), *(F.max(F.when(F.col("column") == k, shown)).alias(f"__c{k}") for k in names.values()))
    return rows.select("row", *(F.col(f"__c{k}").alias(n) for n, k in names.items()))


def places_sheet(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """well, x, y, z from a sheet with these names in any case; a missing one raises. Rows without a well are left out;
    coordinates that are no numbers are null."""
    raw = table(spark, path, sheet)
    names = {c.strip().lower(): c for c in raw.columns[1:]}
    if missing := [c for c in ("well", "x", "y", "z") if c not in names]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    quoted = lambda c: F.col("`" + names[c].replace("`", "``") + "`")
    return raw.where(quoted("well").isNotNull()).select(label(quoted("well")).alias("well"), *(quoted(c).try_cast("double").alias(c) for c in "xyz"))
