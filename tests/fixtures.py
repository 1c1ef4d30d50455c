"""Generated inputs: a workbook of 1,050 rules, and a minimal .xlsx writer."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from hawthorn.schema import CATEGORIES, HEADERS


def rows_of(code: str, sheet: str, kind: str, n: int) -> list[list]:
    return [[i, f"{code}-{i:03d}", f"规则{i}", sheet, kind, f"子类{i % 7}", "全厂", "" if i % 3 else "触发", f"内容 {code} {i}", "", f"文件{i % 5}.pdf", i % 40 + 1, "依据", ""] for i in range(1, n + 1)]


def workbook_rows() -> dict[str, list[list]]:
    return {sheet: rows_of(code, sheet, kind, n) for code, sheet, kind, n, _ in CATEGORIES}


def _cell(ref: str, value) -> str:
    if value is None or value == "":
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{value}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'


def _name(k: int) -> str:
    return (chr(64 + k // 26) if k >= 26 else "") + chr(65 + k % 26)


def xlsx(sheets: dict[str, list[list]], headers: bool = True) -> bytes:
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = list(sheets)
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names))) + "</Relationships>")
        for i, n in enumerate(names):
            rows = ([[h for h, _ in HEADERS]] if headers else []) + sheets[n]
            body = "".join(f'<row r="{r}">' + "".join(_cell(f"{_name(k)}{r}", v) for k, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()
