"""Gap plan and extraction report over rules and their audit records; tables are DataFrames, reports are Markdown of bounded tables."""

from __future__ import annotations

import io
import json
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .coverage import gaps
from .validation import _at, _kind, _text

#: Columns of the export, those of a rule and those of its audit record.
RULE_COLUMNS = ["rule_id", "description", "sets_json", "parameters_json"]
AUDIT_COLUMNS = ["subcategory", "target_group_id", "extraction_phase", "extraction_mode", "source_file", "source_priority", "source_sheet_or_section", "source_location", "validation_status", "audit_note"]
#: Rows of a sheet at most.
SHEET_ROWS = 1_048_576


def counted_records(audit: DataFrame, emitted: DataFrame, phase: str | None = None) -> DataFrame:
    """rule_id, big_category, target_group_id of the audit records (ordinal, doc) that count: of emitted rules, of the phase, not failed."""
    v = F.try_parse_json("doc")
    rows = audit.select(v.alias("a")).filter(_kind(F.col("a")) == "OBJECT")
    part = lambda k: _at(F.col("a"), k)
    status = part("validation_status")
    passed = F.coalesce(_kind(status) == "VOID", F.lit(True)) | F.coalesce(_text(status).isin("PASS", "REVIEW"), F.lit(False))
    rows = rows.filter(passed)
    if phase:
        rows = rows.filter(_text(part("extraction_phase")) == phase)
    rows = rows.select(_text(part("rule_id")).alias("rule_id"), F.nullif(_text(part("big_category")), F.lit("")).alias("big_category"), F.nullif(_text(part("target_group_id")), F.lit("")).alias("target_group_id"))
    return rows.join(emitted.select("rule_id").distinct(), "rule_id", "left_semi")


def compute_gap(categories: DataFrame, groups: DataFrame, audit: DataFrame, emitted: DataFrame, phase: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(categories, groups, unassigned ids): what is extracted, by distinct rule, against the targets.

    categories: big_category, target_count, note; groups: target_group_id, big_category, subcategories (array), kind, value, low, high.
    """
    records = counted_records(audit, emitted, phase)
    of = lambda c: records.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("_k")).agg(F.countDistinct("rule_id").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    by_category = categories.join(of("big_category"), F.col("big_category") == F.col("_k"), "left").select(
        "big_category", "target_count", n.alias("extracted_unique"), (F.col("target_count") - n).alias("difference_to_target"), F.coalesce(n >= F.col("target_count"), F.lit(False)).alias("control_reached"), "note"
    )
    counted = groups.join(of("target_group_id"), F.col("target_group_id") == F.col("_k"), "left").drop("_k").withColumn("n", n)
    target = tx.target_display(F.col("kind"), F.col("value"), F.col("low"), F.col("high"))
    by_group = gaps(counted).withColumn("target_display", target).withColumnRenamed("n", "extracted_unique")
    return by_category, by_group, records.filter("target_group_id IS NULL").select("rule_id").distinct()


def uncovered_slots(groups: DataFrame, slots: DataFrame) -> DataFrame:
    """target_group_id, missing, numeric_only, topology of slots (target_group_id, kind, covered, numeric_only) that nothing covers."""
    open_slot = F.coalesce(~F.col("covered"), F.lit(True))
    return slots.groupBy("target_group_id").agg(
        F.count_if(open_slot).alias("missing"), F.bool_or(F.coalesce(F.col("numeric_only"), F.lit(False))).alias("numeric_only"), F.bool_or(open_slot & (F.col("kind") == "topology")).alias("topology"),
    )


def supplement_reasons(by_group: DataFrame, slots: DataFrame) -> DataFrame:
    """target_group_id, reasons: why documents may add rules to a group; any one is enough, and a closed group has none."""
    open_slots = uncovered_slots(by_group, slots).withColumnRenamed("target_group_id", "_g")
    joined = by_group.join(open_slots, F.col("target_group_id") == F.col("_g"), "left")
    tests = {
        "remaining": F.coalesce("remaining", "remaining_low") > 0, "uncovered_subcategory": F.col("extracted_unique") == 0, "uncovered_slot": F.col("missing") > 0,
        "numeric_only": F.col("numeric_only"), "topology": F.col("topology"),
    }
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]))
    return joined.select("target_group_id", F.when(F.col("closed"), F.array().cast("array<string>")).otherwise(reasons).alias("reasons"))


def _cells(*values) -> str:
    return "| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in values) + " |"


def gap_markdown(by_category: DataFrame, by_group: DataFrame, unassigned: DataFrame, phase: str | None, listed: int = 1000) -> str:
    """The gap plan. Categories and groups are the catalog's; of unassigned ids the first `listed` are named and the rest counted."""
    yes = lambda x: "是" if x else "否"
    lines = ["# 剩余规则补缺计划", "", f"统计阶段：`{phase or 'all_emitted'}`", "", "## 1. 大类覆盖", "", "| 大类 | 目标控制线 | 已提取唯一规则 | 与目标差 | 达到控制线 |", "|---|---:|---:|---:|---|"]
    lines += [_cells(r.big_category, r.target_count, r.extracted_unique, r.difference_to_target, yes(r.control_reached)) for r in by_category.collect()]
    lines += ["", "## 2. Target group 缺口", "", "| target_group | 大类 | 子类/组 | 目标 | 已提取 | 剩余 | 关闭新增 | 文档补缺 |", "|---|---|---|---:|---:|---:|---|---|"]
    for r in by_group.collect():
        left = r.remaining if r.remaining is not None else f"{r.remaining_low}–{r.remaining_high}" if r.remaining_low is not None else "未明确"
        lines.append(_cells(r.target_group_id, r.big_category, "、".join(r.subcategories or []), r.target_display, r.extracted_unique, left, yes(r.closed), "需要" if r.supplement else "数量上不需要"))
    ids = [r.rule_id for r in unassigned.orderBy("rule_id").limit(listed + 1).collect()]
    if ids:
        more = unassigned.count() - listed if len(ids) > listed else 0
        lines += ["", "## 3. 未绑定 target_group 的规则", "", *[f"- {x}" for x in ids[:listed]], *([f"- … +{more}"] if more else [])]
    return "\n".join(lines) + "\n"


def mode_counts(audit: DataFrame) -> DataFrame:
    """big_category, subcategory, mode, rules of audit records."""
    v = F.try_parse_json("doc")
    part = lambda k: _text(_at(v, k)).alias(k)
    return audit.select(part("big_category"), part("subcategory"), part("extraction_mode"), part("rule_id")).groupBy("big_category", "subcategory", "extraction_mode").agg(F.countDistinct("rule_id").alias("rules"))


def extraction_markdown(catalog: DataFrame, audit: DataFrame, rules: DataFrame, by_category: DataFrame, verdict: dict, run: dict) -> str:
    """The extraction report: by category the modes, targets and subcategories; the verdict of validation; what the run has done.

    catalog: big_category, big_order, enabled; rules: big_category (a row each); verdict: as of validation.summary().
    """
    modes = ["direct", "calculated", "summarized", "missing", "conflict"]
    found = mode_counts(audit).collect()
    final = {r.big_category: r["count"] for r in rules.groupBy("big_category").count().collect()}
    names = catalog.orderBy("big_order").collect()
    lines = ["# 知识规则提取报告", "", "## 1. 总体统计", "", _cells("大类", *modes, "最终规则数"), "|---|" + "---:|" * 6]
    for c in names:
        n = {m: sum(r.rules for r in found if r.big_category == c.big_category and r.extraction_mode == m) for m in modes}
        lines.append(_cells(c.big_category, *[n[m] for m in modes], final.get(c.big_category, 0)))
    lines += ["", "## 2. 数量控制线与最终覆盖", "", "| 大类 | 目标控制线 | 最终唯一规则 | 差值 | 说明 |", "|---|---:|---:|---:|---|"]
    lines += [_cells(r.big_category, r.target_count, r.extracted_unique, r.difference_to_target, r.note) for r in by_category.collect()]
    lines += ["", "## 3. 逐类结果", ""]
    for c in names:
        lines += [f"### {c.big_order}. {c.big_category}", "", "| 子类 | 规则数 | 备注 |", "|---|---:|---|"]
        for sub in c.enabled or []:
            n = sum(r.rules for r in found if (r.big_category, r.subcategory) == (c.big_category, sub) and r.extraction_mode not in ("missing", "missing_template"))
            gone = any((r.big_category, r.subcategory) == (c.big_category, sub) and r.extraction_mode in ("missing", "missing_template") for r in found)
            lines.append(_cells(sub, n, "已输出" if n else "缺失" if gone else "无可输出规则/待核对"))
        lines.append("")
    lines += ["## 4. 严格校验", "", f"- valid: `{verdict['valid']}`", f"- errors: {verdict['error_count']}", f"- warnings: {verdict['warning_count']}", "", "## 5. 流程审计", "", *[f"- {k}: `{v}`" for k, v in run.items()]]
    return "\n".join(lines) + "\n"


def export_table(rules: DataFrame, audit: DataFrame) -> DataFrame:
    """big_category, ordinal and the 14 columns of the export, the audit's blank where there is no record; of repeated records the last counts.

    rules: big_category, ordinal, doc; audit: ordinal, doc.
    """
    v, a = F.try_parse_json("doc"), F.try_parse_json("doc")
    rows = rules.select("big_category", "ordinal", _text(_at(v, "rule_id")).alias("rule_id"), _text(_at(v, "description")).alias("description"), F.get_json_object("doc", "$.sets").alias("sets_json"), F.get_json_object("doc", "$.parameters").alias("parameters_json"))
    shown = lambda k: F.coalesce(F.try_variant_get(a, f"$.{k}", "string"), F.lit("")).alias(k)
    last = audit.select("ordinal", _text(_at(a, "rule_id")).alias("_id"), *[shown(k) for k in AUDIT_COLUMNS]).filter("_id IS NOT NULL").groupBy("_id").agg(F.max_by(F.struct(*AUDIT_COLUMNS), "ordinal").alias("r"))
    return rows.join(last, F.col("rule_id") == F.col("_id"), "left").select("big_category", "ordinal", *RULE_COLUMNS, *[F.coalesce(F.col(f"r.{k}"), F.lit("")).alias(k) for k in AUDIT_COLUMNS])


def _sheet_name(k: int) -> str:
    return (chr(64 + k // 26) if k >= 26 else "") + chr(65 + k % 26)


def workbook_bytes(sheets: dict[str, list[list[str]]]) -> bytes:
    """An .xlsx of text cells, one sheet for each entry."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package, kinds = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    out = io.BytesIO()
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        n = range(1, len(sheets) + 1)
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}.worksheet+xml"/>' for i in n)
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(name)}" sheetId="{i}" r:id="rId{i}"/>' for i, name in zip(n, sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
        for i, rows in zip(n, sheets.values()):
            cell = lambda r, k, v: f'<c r="{_sheet_name(k)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' if v else ""
            body = "".join(f'<row r="{r}">' + "".join(cell(r, k, v) for k, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def export_workbook(table: DataFrame, names: list[str]) -> bytes:
    """A sheet for each category: a title, the kinds of columns, the headers and the rules in order. A sheet holds so many rows; more are an error (then write_csv_by() takes them)."""
    head = [["JSON字段"] * len(RULE_COLUMNS) + ["审计字段"] * len(AUDIT_COLUMNS), RULE_COLUMNS + AUDIT_COLUMNS]
    sheets = {}
    for name in names:
        rows = [[r[c] or "" for c in RULE_COLUMNS + AUDIT_COLUMNS] for r in table.filter(F.col("big_category") == name).orderBy("ordinal").limit(SHEET_ROWS).toLocalIterator()]
        if len(rows) + 3 > SHEET_ROWS:
            raise ValueError(f"{name} has more rules than a sheet holds")
        sheets[name] = [[f"{name}知识规则汇总"], *head, *rows]
    return workbook_bytes(sheets)


def finalize(rules: DataFrame, audit: DataFrame, catalog: DataFrame, verdict: dict, put) -> bool:
    """Writes the export by put(name, bytes), unless validation found errors: then its verdict alone."""
    put("validation_report.json", json.dumps(verdict, ensure_ascii=False, indent=2).encode())
    if not verdict["valid"]:
        return False
    put("rules.xlsx", export_workbook(export_table(rules, audit), [r.big_category for r in catalog.orderBy("big_order").collect()]))
    return True
