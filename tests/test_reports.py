"""Gap plan, extraction report, and the export of eight sheets (two here)."""

import json

from hawthorn.operators.reports import compute_gap, export_table, extraction_markdown, finalize, gap_markdown, supplement_reasons
from hawthorn.operators.validation import summary
from hawthorn.sources.workbook import read_workbook


def _docs(spark, docs):
    return spark.createDataFrame([(i, json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)], "ordinal long, doc string")


def _inputs(spark):
    a = lambda i, g, **k: {"rule_id": f"r{i}", "big_category": "A", "subcategory": "s", "target_group_id": g, "extraction_phase": "table_first", "extraction_mode": "direct"} | k
    audit = _docs(spark, [a(1, "g1"), a(1, "g1"), a(2, "g1", validation_status="REVIEW"), a(3, "g2", validation_status="FAIL"), a(4, "g2", extraction_phase="document_supplement"), a(5, None), a(6, "g2", validation_status=None), {"rule_id": "gone", "target_group_id": "g2"}, 7, a(7, "g3", big_category="B", subcategory="t", extraction_mode="missing")])
    emitted = spark.createDataFrame([(f"r{i}",) for i in range(1, 8)], "rule_id string")
    categories = spark.createDataFrame([("A", 4, "n"), ("B", 1, ""), ("C", None, "x")], "big_category string, target_count long, note string")
    groups = spark.createDataFrame([("g1", "A", ["s", "u"], "exact", 2, None, None), ("g2", "A", ["s"], "interval", None, 1, 3), ("g3", "B", [], "approx", 2, None, None), ("g4", "B", [], "unspecified", None, None, None)], "target_group_id string, big_category string, subcategories array<string>, kind string, value long, low long, high long")
    return audit, emitted, categories, groups


def test_gap_of_a_phase_and_of_all(spark):
    audit, emitted, categories, groups = _inputs(spark)
    by_category, by_group, loose = compute_gap(categories, groups, audit, emitted, "table_first")
    assert {r.big_category: (r.extracted_unique, r.difference_to_target, r.control_reached) for r in by_category.collect()} == {"A": (4, 0, True), "B": (1, 0, True), "C": (0, None, False)}
    got = {r.target_group_id: (r.extracted_unique, r.remaining, r.remaining_low, r.remaining_high, r.closed, r.supplement, r.target_display) for r in by_group.collect()}
    assert got == {"g1": (2, 0, None, None, True, False, "2"), "g2": (1, None, 0, 2, False, False, "1–3"), "g3": (1, 1, None, None, False, True, "约2"), "g4": (0, None, None, None, False, True, "未明确")}
    assert [r.rule_id for r in loose.collect()] == ["r5"]
    assert {r.target_group_id: r.extracted_unique for r in compute_gap(categories, groups, audit, emitted)[1].collect()}["g2"] == 2
    text = gap_markdown(by_category, by_group, loose, "table_first")
    assert "| g1 | A | s、u | 2 | 2 | 0 | 是 | 数量上不需要 |" in text and "| g2 | A | s | 1–3 | 1 | 0–2 | 否 | 数量上不需要 |" in text and "- r5" in text and "| C |  | 0 |  | 否 |" in text
    slots = spark.createDataFrame([("g1", "entity", False, True), ("g2", "topology", False, False), ("g2", "entity", True, True), ("g3", "entity", True, None)], "target_group_id string, kind string, covered boolean, numeric_only boolean")
    assert {r.target_group_id: r.reasons for r in supplement_reasons(by_group, slots).collect()} == {"g1": [], "g2": ["uncovered_slot", "numeric_only", "topology"], "g3": ["remaining"], "g4": ["uncovered_subcategory"]}


def test_report_and_export(spark, tmp_path):
    audit, emitted, categories, groups = _inputs(spark)
    rule = lambda i: {"rule_id": f"r{i}", "description": f"d{i} <&>", "sets": [{"set_name": "U", "subset_name": None, "element": "x"}], "parameters": {}}
    rules = spark.createDataFrame([("A" if i < 7 else "B", 1 if i < 7 else 2, i, json.dumps(rule(i))) for i in range(1, 8)], "big_category string, big_order int, ordinal long, doc string")
    catalog = spark.createDataFrame([("A", 1, ["s", "u"]), ("B", 2, ["t"])], "big_category string, big_order int, enabled array<string>")
    verdict = summary(spark.createDataFrame([], "level string"), rules, catalog)
    text = extraction_markdown(catalog, audit, rules, compute_gap(categories, groups, audit, emitted)[0], verdict, {"preflight": True})
    assert "| A | 6 | 0 | 0 | 0 | 0 | 6 |" in text and "| s | 6 | 已输出 |" in text and "| u | 0 | 无可输出规则/待核对 |" in text and "| t | 0 | 缺失 |" in text and "- valid: `True`" in text
    table = {r.rule_id: r for r in export_table(rules, audit).collect()}
    assert table["r1"].sets_json == '[{"set_name":"U","subset_name":null,"element":"x"}]' and table["r2"].validation_status == "REVIEW" and table["r3"].extraction_mode == "direct"
    put = lambda name, data: (tmp_path / name).write_bytes(data)
    assert finalize(rules, audit, catalog, verdict, put)
    rows = read_workbook(spark, str(tmp_path / "rules.xlsx"))
    cells = {(r.sheet, r.row_no): r.cells for r in rows.collect()}
    assert cells["A", 3][:5] == ["rule_id", "description", "sets_json", "parameters_json", "subcategory"] and cells["A", 4][:2] == ["r1", "d1 <&>"] and cells["B", 4][7] == "missing" and len(cells) == 3 + 6 + 3 + 1
    bad = dict(verdict, valid=False)
    (tmp_path / "x").mkdir()
    assert not finalize(rules, audit, catalog, bad, lambda name, data: (tmp_path / "x" / name).write_bytes(data)) and [p.name for p in (tmp_path / "x").iterdir()] == ["validation_report.json"]
