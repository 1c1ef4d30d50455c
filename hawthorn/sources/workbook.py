"""Workbooks (.xlsx) as rows of cells, by the standard library: shared and inline strings, numbers, booleans, cached results.

Files are read by Spark (binaryFile), so any file system that Spark reaches will do; a file is one task.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def _number(raw: str) -> str:
    """Whole numbers without a fraction, whatever their size."""
    if re.fullmatch(r"-?\d+", raw):
        return str(int(raw))
    value = float(raw)
    return str(int(value)) if value.is_integer() else repr(value)


def _date_styles(styles: bytes | None) -> set[int]:
    """Indexes of cell formats that show dates."""
    if styles is None:
        return set()
    root = ElementTree.fromstring(styles)
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")) for f in root.iter(f"{MAIN}numFmt")}
    dates = {*range(14, 23), *range(45, 48), *(k for k, code in own.items() if re.search("[dmyhs]", code, re.I))}
    formats = root.find(f"{MAIN}cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId", 0)) in dates}


def _date(raw: str, from_1904: bool) -> str:
    """A serial number as the text of a date and time; below one day a time of day."""
    days = float(raw)
    start = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 31 if 0 < days < 60 else 30)
    if 0 <= days < 1 and not from_1904:
        return str((datetime.datetime(1900, 1, 1) + datetime.timedelta(seconds=round(days * 86400))).time())
    return str(start + datetime.timedelta(days=int(days), seconds=round(days % 1 * 86400)))


def parse(content: bytes) -> Iterator[tuple[str, int, int, list[str | None], list[str | None]]]:
    """(sheet, its place, row number, cells, their kinds) of all sheets in order; kinds are n, s, b and d for numbers, texts, booleans and dates."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        dates = _date_styles(z.read("xl/styles.xml") if "xl/styles.xml" in names else None)
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        from_1904 = any(x.get("date1904") in ("1", "true") for x in book.iter(f"{MAIN}workbookPr"))
        shared = [_text(n) for n in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for place, sheet in enumerate(book.iter(f"{MAIN}sheet")):
            target = targets[sheet.get(f"{LINK}id")]
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            found = []
            for at, row in enumerate(ElementTree.fromstring(z.read(path)).iter(f"{MAIN}row"), 1):
                cells: list[str | None] = []
                kinds: list[str | None] = []
                for c in row.iter(f"{MAIN}c"):
                    k = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (k + 1 - len(cells))
                    kinds += [None] * (k + 1 - len(kinds))
                    kind, value = c.get("t", "n"), c.find(f"{MAIN}v")
                    if kind == "inlineStr":
                        cells[k], kinds[k] = _text(c), "s"
                    elif value is None or value.text is None:
                        cells[k] = None
                    elif kind == "s":
                        cells[k], kinds[k] = shared[int(value.text)], "s"
                    elif kind == "b":
                        cells[k], kinds[k] = "True" if value.text == "1" else "False", "b"
                    elif kind == "n" and int(c.get("s", 0)) in dates:
                        cells[k], kinds[k] = _date(value.text, from_1904), "d"
                    else:
                        cells[k], kinds[k] = (_number(value.text), "n") if kind == "n" else (value.text, "s")
                found.append((int(row.get("r", at)), cells, kinds))
            width = max((len(c) for _, c, _ in found), default=0)
            for number, cells, kinds in found:  # a sheet's rows are as wide as its widest
                yield sheet.get("name"), place, number, cells + [None] * (width - len(cells)), kinds + [None] * (width - len(kinds))


_SCHEMA = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("sheet_no", pa.int32()), ("row_no", pa.int32()), ("cells", pa.list_(pa.string())), ("kinds", pa.list_(pa.string()))])


def _rows(batches):
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = [(name, *row) for row in parse(content)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*found)) or [()] * len(_SCHEMA), _SCHEMA)], schema=_SCHEMA)


def read_workbook(spark: SparkSession, path: str, sheets: list[str] | None = None, first_row: int = 1, last_row: int | None = None) -> DataFrame:
    """path, sheet, sheet_no, row_no, cells, kinds of workbooks; rows from first_row to last_row of the sheets asked for (all)."""
    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_rows, "path string, sheet string, sheet_no int, row_no int, cells array<string>, kinds array<string>")
    rows = rows.filter(F.col("row_no") >= first_row)
    if last_row:
        rows = rows.filter(F.col("row_no") <= last_row)
    return rows.filter(F.col("sheet").isin(sheets)) if sheets else rows


def side_by_side(rows: DataFrame, offsets: list[int], width: int) -> DataFrame:
    """Tables that stand side by side in a sheet, one below the other; block tells them apart."""
    blocks = F.array(*[F.struct(F.lit(i).alias("block"), F.slice("cells", F.lit(o + 1), F.lit(width)).alias("cells")) for i, o in enumerate(offsets)])
    keys = [c for c in ("path", "sheet", "row_no") if c in rows.columns]
    return rows.select(*keys, F.explode(blocks).alias("b")).select(*keys, "b.block", "b.cells")


def with_headers(rows: DataFrame) -> DataFrame:
    """path, sheet, row_no, cells, fields of the rows below the first of each sheet: fields are a map from the sheet's header.

    Sheets are told apart by book and name. Repeated headers: the first; blank ones: none. Headers are one row a sheet.
    """
    heads = rows.filter("row_no = 1").select(F.col("path").alias("_p"), F.col("sheet").alias("_s"), F.col("cells").alias("heads"))
    body = rows.filter("row_no > 1").join(heads, (F.col("path") == F.col("_p")) & (F.col("sheet") == F.col("_s")))
    pairs = F.filter(F.zip_with("heads", "cells", lambda k, v: F.struct(k.alias("k"), v.alias("v"))), lambda p: p["k"].isNotNull() & (p["k"] != ""))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda q: q["k"] == p["k"]))
    return body.select("path", "sheet", "row_no", "cells", F.map_from_entries(first).alias("fields"))
