"""Four-field rules: one mutation for each message; text functions; files."""

import html
import json

import pytest
from pyspark.sql import functions as F

from hawthorn.functions import text as tx
from hawthorn.operators.coverage import gaps
from hawthorn.operators.validation import ORDER, rule_issues, summary, validate
from hawthorn.sources.files import (
    audit_records, broken_files, catalog_files, fingerprints, index_of, inventory, json_lines, json_rules, markdown_table, rules_of, statuses, write_csv_by, write_partitioned, write_rules,
)

GOOD = {"rule_id": "r1", "description": "d", "sets": [{"set_name": "U", "subset_name": None, "element": "CDU"}], "parameters": {"MAX": {"value": 0, "unit": None}, "ON": {"value": True, "unit": "x"}}}


def _with(path, value):
    doc = json.loads(json.dumps(GOOD))
    at = doc
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return doc


BIG = "罐区类"
MUTATIONS = [
    (GOOD, []), ({**GOOD, "sets": [], "parameters": {}}, []), ([1], ["rule must be an object"]), (7, ["rule must be an object"]),
    ({k: v for k, v in GOOD.items() if k not in ("sets", "rule_id")}, ["missing top-level fields: ['rule_id', 'sets']"]),
    ({**GOOD, "more": 1, "an": 2}, ["forbidden extra top-level fields: ['more', 'an']"]),
    ({**GOOD, "notes": 1}, ["forbidden extra top-level fields: ['notes']", "old/non-template metadata leaked into rule: ['notes']"]),
    ({"notes": 1, "rule_id": " "}, ["missing top-level fields: ['description', 'sets', 'parameters']", "forbidden extra top-level fields: ['notes']", "old/non-template metadata leaked into rule: ['notes']"]),
    (_with(["rule_id"], " "), ["rule_id must be non-empty string"]), (_with(["rule_id"], 7), ["rule_id must be non-empty string"]),
    (_with(["description"], ""), ["description must be non-empty string"]), (_with(["description"], None), ["description must be non-empty string"]),
    (_with(["description"], "a DEMO"), ["reference/DEMO wording leaked into field rule"]), (_with(["description"], "格式示例"), ["reference/DEMO wording leaked into field rule"]),
    (_with(["description"], "非现场已核实规则。"), ["reference/DEMO wording leaked into field rule"]), (_with(["description"], "示例"), []),
    (_with(["sets"], {}), ["sets must be an array"]), (_with(["parameters"], []), ["parameters must be an object"]),
    (_with(["sets", 0], "x"), ["sets[0]: set item must be object"]), (_with(["sets", 0], '{"set_name": 1}'), ["sets[0]: set item must be object"]),
    (_with(["sets", 0], {"set_name": "U", "element": "x"}), ["sets[0]: missing set fields: ['subset_name']"]),
    (_with(["sets", 0], {"set_name": "", "subset_name": 3, "element": " ", "z": 1, "b": 2}), ["sets[0]: extra set fields: ['z', 'b']", "sets[0]: set_name must be non-empty string", "sets[0]: subset_name must be string or null", "sets[0]: element must be non-empty string"]),
    (_with(["sets", 0, "element"], "DEMO-1"), ["sets[0]: DEMO entity leaked into field rule"]), (_with(["sets", 0, "element"], "示例"), []),
    (_with(["parameters", "MAX"], 5), ["parameters.MAX: parameter item must be object"]),
    (_with(["parameters", "MAX"], {"value": 1}), ["parameters.MAX: missing parameter fields: ['unit']"]),
    (_with(["parameters", "MAX"], {"value": [1], "unit": 5, "at": 0}), ["parameters.MAX: extra parameter fields: ['at']", "parameters.MAX: parameter value must be scalar", "parameters.MAX: unit must be string or null"]),
    (_with(["parameters", "MAX", "value"], {"a": 1}), ["parameters.MAX: parameter value must be scalar"]), (_with(["parameters", "MAX", "value"], None), []),
    ({**GOOD, "parameters": {" ": {"value": 1, "unit": None}}}, ["parameters. : parameter name must be non-empty string"]),
    (_with(["rule_id"], "it's"), []),
]


def _rules(spark, docs, big=BIG, order=1):
    return spark.createDataFrame([(big, order, i, json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)], "big_category string, big_order int, ordinal long, doc string")


def test_each_rule_message(spark):
    got = {}
    for r in rule_issues(_rules(spark, [d for d, _ in MUTATIONS])).orderBy(*ORDER).collect():
        i, _, part = r.place.removeprefix(f"{BIG}[").partition("]")
        got.setdefault(int(i), []).append((part.lstrip(".") + ": " if part else "") + r.message)
        assert r.level == "ERROR"
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(m) for i, (_, m) in enumerate(MUTATIONS) if m}
    assert got[21][0] == "sets[0]: extra set fields: ['z', 'b']"


def _audit(spark, records):
    return spark.createDataFrame([(i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(records)], "ordinal long, doc string")


def test_each_audit_message(spark):
    rules = _rules(spark, [{**GOOD, "rule_id": f"r{i}"} for i in range(8)] + [{**GOOD, "rule_id": "r3"}]).unionByName(_rules(spark, [{**GOOD, "rule_id": "r0"}, {**GOOD, "rule_id": "q"}], "流程类", 2))
    fine = lambda i, **k: {"rule_id": f"r{i}", "big_category": BIG, "subcategory": "s", "target_group_id": "g", "extraction_phase": "table_first", "source_priority": "P1", "dedup_key": f"k{i}", "extraction_mode": "direct"} | k
    records = [
        fine(1), fine(2, extraction_mode="guess", dedup_key=""), fine(3, target_group_id="h", extraction_phase=None, source_priority="R0", dedup_key="k1"), fine(4, big_category="x", subcategory="off"),
        fine(5, subcategory="bare"), fine(6, subcategory="two"), fine(7, subcategory="hint"), {"rule_id": "gone"}, "no record", fine(0, big_category="流程类"), fine(9, extraction_mode=3),
    ]
    catalog = spark.createDataFrame([(BIG, ["s", "bare", "two", "hint"]), ("流程类", ["s"])], "big_category string, enabled array<string>")
    sets = "array<struct<set_name string, subset_name string>>"
    spec = spark.createDataFrame([(BIG, "s", [("U", None)]), (BIG, "two", [("U", None), ("T", None)]), (BIG, "hint", [("U", "Ucdu")]), ("流程类", "s", [("U", None)])], f"big_category string, subcategory string, signature {sets}")
    groups = spark.createDataFrame([("g",)], "target_group_id string")
    issues = validate(rules, _audit(spark, records), catalog, spec, groups)
    at = lambda i: f"manifest.audit_records[{i}]"
    want = [
        ("ERROR", f"{BIG}[8]", f"duplicate rule_id 'r3'; first seen at {BIG}[3]"), ("ERROR", "流程类[0]", f"duplicate rule_id 'r0'; first seen at {BIG}[0]"),
        ("ERROR", "manifest", "rules missing audit records: ['q']"), ("WARNING", "manifest", "audit records without emitted rules: ['gone', 'r9']"),
        ("ERROR", at(1), "invalid extraction_mode 'guess'"), ("ERROR", at(1), "missing required audit field dedup_key"),
        ("ERROR", at(2), "missing required audit field extraction_phase"), ("ERROR", at(2), "unknown target_group_id 'h'"), ("ERROR", at(2), "invalid extraction_phase None"), ("ERROR", at(2), "invalid or control-only source_priority 'R0'"),
        ("ERROR", at(3), f"big_category 'x' does not match rule file '{BIG}'"), ("ERROR", at(3), f"subcategory 'off' is not enabled in {BIG}"), ("ERROR", at(4), "no enabled template spec for subcategory 'bare'"),
        ("ERROR", at(5), "sets set_name signature ['U'] differs from the template's ['U', 'T']"),
        ("WARNING", at(6) + ".sets[0]", "subset_name None differs from template example 'Ucdu'; verify against symbol document and actual entity class"),
        ("ERROR", at(10), "invalid extraction_mode 3"), ("ERROR", at(2), "duplicate emitted dedup_key also used by 'r1'"),
    ]
    assert [(r.level, r.place, r.message) for r in issues.orderBy(*ORDER).collect()] == want
    got = summary(issues, rules, catalog)
    assert got == {"valid": False, "error_count": 15, "warning_count": 2, "rule_counts": {BIG: 9, "流程类": 2}, "total_rules": 11}


def test_rule_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([GOOD, 3]))
    (tmp_path / "b.json").write_text("{oops")
    (tmp_path / "c.json").write_text("{}")
    catalog = spark.createDataFrame([("A", 1, "a.json"), ("B", 2, "b.json"), ("C", 3, "c.json"), ("D", 4, "d.json")], "big_category string, big_order int, name string")
    files = catalog_files(spark, str(tmp_path), catalog)
    rules = rules_of(files)
    assert [(r.big_category, r.ordinal) for r in rules.orderBy("ordinal").collect()] == [("A", 0), ("A", 1)]
    got = [(r.place, r.message) for r in validate(rules, files=files).orderBy(*ORDER).collect()]
    assert got == [("A[1]", "rule must be an object"), ("B", "invalid JSON"), ("C", "top-level JSON must be an array"), ("D", "missing required JSON file: d.json")]


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("value,pattern,expected", [("ABC", "a%", True), ("Äb", "ä%", False), ("a\\b", "%\\b", True), ("axc", "A_C", True), ("abc", "b", False)])
def test_like(spark, value, pattern, expected):
    assert _one(spark, tx.like_ascii(F.lit(value), pattern)) is expected


def test_text_functions(spark):
    assert _one(spark, tx.strip(F.lit("　 a b \n"))) == "a b"
    assert _one(spark, tx.cell_text(F.lit(" 1.0 "))) == "1.0" and _one(spark, tx.cell_text(F.lit(None).cast("string"))) == ""
    assert [_one(spark, tx.number_text(F.lit(x))) for x in (12.0, -3.0, 0.25)] == ["12", "-3", "0.25"]
    numbers = {" 1,234.5 ": 1234.5, "—": None, "1d": None, "1f": None, "": None, "１２": 12.0, "1_000": 1000.0, "1__0": None, "+.5e2": 50.0, "1e": None, "-inf": float("-inf"), "0x1": None}
    assert {k: _one(spark, tx.number(F.lit(k))) for k in numbers} == numbers
    integers = {"+5": 5, "12.0": None, " 7 ": 7, "１２": 12, "1_000": 1000, "x": None, "": None}
    assert {k: _one(spark, tx.integer(F.lit(k))) for k in integers} == integers
    assert [_one(spark, tx.general_number(F.lit(x))) for x in (14.3, 5000.0, 1e-7)] == ["14.3", "5000", "1e-07"]
    assert _one(spark, tx.clean_chat(F.lit("a &amp;lt; b <small>3 s</small>\n"))) == "a &lt; b"
    assert _one(spark, tx.clean_chat(F.lit('x&nbsp;y <SMALL style="c">q</SMALL> '))) == "x\u00a0y"
    for text in ("no refs", "&lt;&gt;&quot;&#39;&#x27;", "&notit; &ampx &Alpha; &nosuch; & &;", "&#0; &#xD800; &#128; &#1; &#x1F642;", "a &copy b&NotEqualTilde;"):
        assert _one(spark, tx.unescape_html(F.lit(text))) == html.unescape(text), text
    assert _one(spark, tx.escape_html(F.lit("<a&'>"))) == "&lt;a&amp;&#x27;&gt;"
    assert _one(spark, tx.normal_name(F.lit("A_b.C 院（北京）,：- b"))) == "A_b.C院b"
    lists = {"null": [], '"  a "': ["a"], '" "': [], '["a", " ", 3, null]': ["a", "3", "None"], "{}": [], "5": []}
    assert {k: _one(spark, tx.string_list(F.parse_json(F.lit(k)))) for k in lists} == lists
    sets = F.array(*[F.struct(F.lit(a).alias("set_name"), F.lit(b).cast("string").alias("subset_name"), F.lit(c).alias("element")) for a, b, c in (("U", None, "x"), ("T", "t", "y"))])
    assert _one(spark, tx.dedup_key(F.lit("c"), F.lit("s"), sets, F.array(F.lit("MIN"), F.lit("MAX")))) == "c|s|T/t/y+U//x|MAX+MIN"
    assert _one(spark, tx.tank_key(F.lit(" T-101"))) == "101"


def test_gap_ladder(spark):
    rows = [("exact", 5, 0, 0, 5), ("exact", 5, 0, 0, 3), ("advisory_exact", 5, 0, 0, 9), ("approx", 5, 0, 0, 4), ("interval", 0, 3, 6, 4), ("approx_interval", 0, 3, 6, 2), ("unspecified", 0, 0, 0, 0), ("odd", 0, 0, 0, 1)]
    got = gaps(spark.createDataFrame(rows, "kind string, value long, low long, high long, n long")).collect()
    assert [(r.remaining, r.remaining_low, r.remaining_high, r.closed, r.supplement) for r in got] == [
        (0, None, None, True, False), (2, None, None, False, True), (0, None, None, False, False), (1, None, None, False, True), (None, 0, 2, False, False), (None, 1, 4, False, True), (None, None, None, False, True), (None, None, None, False, True)
    ]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text(json.dumps([GOOD, GOOD]))
    (tmp_path / "sub" / "b.json").write_text(json.dumps({"meta": 1, "rules": [GOOD]}))
    (tmp_path / "sub" / "skip.json").write_text("[]")
    rows = json_rules(spark, str(tmp_path), ["skip.json"])
    assert sorted((r.file, r.ordinal, json.loads(r.doc)["rule_id"]) for r in rows.collect()) == [("a.json", 0, "r1"), ("a.json", 1, "r1"), ("b.json", 0, "r1")]
    assert len(fingerprints(spark, str(tmp_path / "a.json")).first().sha256) == 64
    (tmp_path / "t.XLS").write_text("x")
    (tmp_path / "n.txt").write_text("x")
    (tmp_path / "模版.md").write_text("x")
    (tmp_path / "odd.bin").write_text("x")
    kinds = {r.name: (r.priority, r.priorities) for r in inventory(spark, str(tmp_path), ["模版"]).collect()}
    assert kinds == {"a.json": ("P4", ["P4"]), "b.json": ("P4", ["P4"]), "skip.json": ("P4", ["P4"]), "t.XLS": ("P1", ["P1"]), "n.txt": ("P3", ["P3", "P5"]), "模版.md": ("R0", ["R0"]), "odd.bin": (None, [])}
    (tmp_path / "sub" / "broken.json").write_text("{oops")
    (tmp_path / "sub" / "flat.json").write_text('{"a": 1}')
    assert {(r.file, r.reason) for r in broken_files(spark, str(tmp_path)).collect()} == {("broken.json", "invalid JSON"), ("flat.json", "top-level JSON must be an array")}
    assert {r.file for r in json_rules(spark, str(tmp_path), exclude_dirs=["sub"]).collect()} == {"a.json"}
    (tmp_path / "m.json").write_text(json.dumps({"run": {}, "audit_records": [{"rule_id": "r1"}, 3]}))
    assert [(r.ordinal, r.doc) for r in audit_records(spark, str(tmp_path / "m.json")).collect()] == [(0, '{"rule_id":"r1"}'), (1, "3")]
    some = spark.createDataFrame([("x", "p", "{\"a\": \"格\"}"), ("x", "q", "{}"), ("y", "p", "{}")], "c string, s string, doc string")
    out = f"{tmp_path}/out"
    write_partitioned(some, out, ["c", "s"])
    written = write_partitioned(some.filter("c = 'x' AND s = 'p'").withColumn("doc", F.lit("{\"b\": 1}")), out, ["c", "s"])
    assert {(r.c, r.s, r.doc) for r in spark.read.json(out).collect()} == {("x", "p", '{"b": 1}'), ("x", "q", "{}"), ("y", "p", "{}")}
    catalog = some.select("c", "s").distinct()
    assert {(r.c, r.s, r["count"], r.status) for r in statuses(written, catalog, ["c", "s"]).collect()} == {("x", "p", 1, "ready"), ("x", "q", 0, "pending"), ("y", "p", 0, "pending")}
    write_rules(some, f"{tmp_path}/whole.json", {"made": "now"}, ["c", "s"])
    text = (tmp_path / "whole.json").read_text()
    assert json.loads(text) == {"meta": {"made": "now", "rule_count": 3}, "rules": [{"a": "格"}, {}, {}]} and '  "meta"' in text and "格" in text
    with pytest.raises(ValueError, match="more than 2"):
        write_rules(some, f"{tmp_path}/whole.json", {}, ["c"], most=2)
    write_csv_by(some, f"{tmp_path}/csv", "c")
    assert {(r.c, r.s) for r in spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()} == {("x", "p"), ("x", "q"), ("y", "p")}
    assert json_lines(some.filter("s = 'q'")) == ['{"c": "x", "s": "q", "doc": "{}"}']
    assert _one(spark, tx.blank_to_null(F.lit(" 　"))) is None and _one(spark, tx.strip_tags(F.lit(" <b>x</b> "))) == "x"
    counts = index_of(spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "p")], "c string, s string"), "c", "s")
    assert {(r.c, r.s): r.rules for r in counts.collect()} == {("x", "p"): 1, ("x", "q"): 1, ("y", "p"): 1, ("x", None): 2, ("y", None): 1}
    assert markdown_table(counts.filter("s IS NULL").orderBy("c"), ["c", "rules"]) == "| c | rules |\n|---|---|\n| x | 2 |\n| y | 1 |\n"
