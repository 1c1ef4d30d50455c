"""The rule store: golden counts, idempotent import, editing, archiving; workbook source and validation."""

import pytest
from pyspark.sql import functions as F

from hawthorn.operators.issues import parse_rows, preview, workbook_issues
from hawthorn.schema import CATEGORIES, HEADERS, category_spec
from hawthorn.sources.workbook import read_workbook, side_by_side, with_headers
from hawthorn.store import CommitConflict, ImportConflict, RuleStore

from fixtures import rows_of, workbook_rows, xlsx


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("book") / "rules.xlsx"
    path.write_bytes(xlsx(workbook_rows()))
    return read_workbook(spark, str(path), first_row=2).select("sheet", "row_no", "cells").cache()


def test_workbook_is_valid_and_has_the_golden_counts(spark, book):
    spec = category_spec(spark)
    assert workbook_issues(book, spec).count() == 0
    rows = parse_rows(book, spec)
    counts = {r.category_code: r["count"] for r in rows.groupBy("category_code").count().collect()}
    assert counts == {c: n for c, _, _, n, _ in CATEGORIES} and sum(counts.values()) == 1050
    assert rows.select("rule_no").distinct().count() == 1050


def test_import_edit_archive(spark, book, tmp_path):
    rows = parse_rows(book, category_spec(spark))
    store = RuleStore(spark, f"file://{tmp_path}/store")
    first = store.import_rows(rows, "rules.xlsx")
    assert (first["inserted"], first["updated"], first["unchanged"]) == (1050, 0, 0)
    second = store.import_rows(rows, "rules.xlsx")
    assert (second["inserted"], second["unchanged"]) == (0, 1050)
    assert {r.code: r.rules for r in store.stats().collect()} == {c: n for c, _, _, n, _ in CATEGORIES}
    assert store.next_number("SOP") == "SOP-258"
    form = {"rule_no": "SOP-258", "rule_name": "测试 名", "category_code": "SOP", "subtype": "s", "applicable_scope": "a", "rule_content": "c", "source_file": "f", "source_page": "1", "source_basis": "b", "status": "draft"}
    store.save_rule(form)
    assert store.active().count() == 1051
    assert store.search("测试", "SOP", "draft").count() == 1
    assert store.set_archived("SOP-258", True) and not store.set_archived("SOP-258", True)
    assert store.search(status="archived").count() == 1 and store.next_number("SOP") == "SOP-259"
    with pytest.raises(ValueError):
        store.save_rule(form, "SOP-258")
    assert store.set_archived("SOP-258", False)
    assert store.get("SOP-258")["deleted_at"] is None and store.get("SOP-258")["status"] == "published"
    assert [r.action for r in store.changes("SOP-258").collect()] == ["restore", "archive", "insert"]
    changed = rows.withColumn("rule_content", F.when(F.col("rule_no") == "QS-001", "other").otherwise(F.col("rule_content")))
    with pytest.raises(ImportConflict):
        store.import_rows(changed, "rules.xlsx")
    assert store.batches().filter("status = 'conflict'").count() == 1
    assert store.import_rows(changed, "rules.xlsx", update_existing=True)["updated"] == 1
    assert store.get("QS-001")["version"] == 2 and store.get("QS-001")["source_file"].startswith("文件")
    assert store.documents().count() == 6 and store.documents().select("id").distinct().count() == 6
    assert store.rules().count() == 1051 and store.rules().select("id").distinct().count() == 1051
    assert {r.action: r["count"] for r in store.logs().groupBy("action").count().collect()} == {"insert": 1051, "archive": 1, "restore": 1, "update": 1}
    assert store.logs().agg(F.min("id"), F.max("id"), F.countDistinct("id")).first() == (1, 1054, 1054)
    # found by the basis of a rule, and by its document's name
    assert store.search("依据").count() == 1050 and store.search("文件3.PDF", "QS").count() > 0 and store.find("文件3").count() == 0
    assert [r.rule_no for r in store.find("规则1", "QS", 3).collect()] == ["QS-001", "QS-010", "QS-011"]
    rows, figures = store.page(category="SOP", page=99, page_size=0)
    assert (figures["page"], figures["pages"], figures["previous"], figures["next"], figures["page_size"]) == (13, 13, 12, 13, 20) and rows.count() == 18
    board = store.dashboard()
    assert (board["active"], board["draft"], board["archived"], board["sources"]) == (1051, 0, 0, 6) and len(board["subtypes"]) == 8 and board["recent"][0]["rule_no"] == "QS-001"
    assert [r.status for r in store.latest_batches(0).collect()] == ["success"]
    store.save_rule({**form, "rule_no": "SOP-300"}, "SOP-258")
    assert [r.action for r in store.changes("SOP-300").collect()] == ["update", "restore", "archive", "insert"]
    bad = rows_of("SOP", CATEGORIES[0][1], CATEGORIES[0][2], 1)
    broken = parse_rows(spark.createDataFrame([(CATEGORIES[0][1], 2, [str(x) for x in bad[0]])], "sheet string, row_no int, cells array<string>"), category_spec(spark))
    with pytest.raises(Exception, match="broken row"):
        store.import_rows(broken.withColumn("rule_content", F.raise_error(F.lit("broken row"))), "broken.xlsx")
    last = store.latest_batches(1).first()
    assert (last.status, last.source_file_name) == ("failed", "broken.xlsx") and "broken row" in last.error_message and store.rules().count() == 1051


def _small(spark, n=3, content="c"):
    rows = rows_of("SOP", CATEGORIES[0][1], CATEGORIES[0][2], n)
    raw = spark.createDataFrame([(CATEGORIES[0][1], i + 2, [str(x) for x in [*r[:8], content, *r[9:]]]) for i, r in enumerate(rows)], "sheet string, row_no int, cells array<string>")
    return parse_rows(raw, category_spec(spark))


def test_commit_that_stops_anywhere_leaves_the_old_state(spark, tmp_path):
    store = RuleStore(spark, f"file://{tmp_path}/store")
    store.import_rows(_small(spark), "a.xlsx")
    seen = sorted((r.rule_no, r.rule_content, r.version) for r in store.rules().collect())
    steps = []

    class Stopped(BaseException):
        pass

    for stop in range(40):
        dying, done = RuleStore(spark, store.path), [0]

        def wrap(f, dying=dying, done=done, stop=stop):
            def run(*a, **k):
                if done[0] == stop:
                    raise Stopped
                done[0] += 1
                return f(*a, **k)

            return run

        for name in ("_write", "_folder", "_publish"):
            setattr(dying, name, wrap(getattr(dying, name)))
        try:
            dying.import_rows(_small(spark, 4, "other"), "b.xlsx", update_existing=True)
            break
        except Stopped:
            steps.append(stop)
            assert sorted((r.rule_no, r.rule_content, r.version) for r in store.rules().collect()) == seen
            assert store.batches().count() == 1 and store.logs().count() == 3 and store.version() == 1
    assert len(steps) > 5 and store.version() == 2 and store.rules().count() == 4 and store.logs().count() == 7


def test_of_two_writers_one_is_refused(spark, tmp_path):
    store = RuleStore(spark, f"file://{tmp_path}/store")
    store.import_rows(_small(spark), "a.xlsx")
    slow, publish = RuleStore(spark, store.path), RuleStore._publish
    slow._publish = lambda state: (store.set_archived("SOP-002", True), publish(slow, state))
    with pytest.raises(CommitConflict):
        slow.set_archived("SOP-001", True)
    assert [r.rule_no for r in store.rules().filter("deleted_at IS NOT NULL").collect()] == ["SOP-002"] and store.version() == 2
    assert not [f for f in (tmp_path / "store" / "commits").iterdir() if "draft" in f.name and not f.name.endswith(".crc")]


def test_migrations_run_once(spark, tmp_path):
    store = RuleStore(spark, f"file://{tmp_path}/store")
    store.import_rows(_small(spark), "a.xlsx")
    state = store.state()
    bare = store.rules().withColumn("source_document_id", F.lit(None).cast("long"))
    buckets = sorted(state["rules"])
    store._commit(state | {"documents": []}, rules=store._rewritten(state, bare, buckets), moved={"documents": 1})
    assert store.search("规则1").count() == 0
    assert store.migrate() == ["001_initial", "002_documents"] and store.migrate() == []
    assert store.search("规则1").count() == 1 and store.documents().count() == 3


FAULTS = {
    "width": lambda r: r[:13], "sequence_not_integer": lambda r: ["x", *r[1:]], "blank": lambda r: [*r[:2], "", *r[3:]],
    "prefix": lambda r: [r[0], "QS-900", *r[2:]], "category": lambda r: [*r[:3], "别的", *r[4:]], "knowledge_type": lambda r: [*r[:4], "别的", *r[5:]],
}


@pytest.mark.parametrize("code", FAULTS)
def test_each_row_fault_is_found(spark, code):
    rows = rows_of("SOP", CATEGORIES[0][1], CATEGORIES[0][2], 5)
    rows[2] = FAULTS[code](rows[2])
    raw = spark.createDataFrame([(CATEGORIES[0][1], i + 2, [str(x) for x in r]) for i, r in enumerate(rows)], "sheet string, row_no int, cells array<string>")
    spec = category_spec(spark).filter("code = 'SOP'").withColumn("expected_count", F.lit(5))
    found = {r.code for r in workbook_issues(raw, spec).collect()}
    assert code in found and found - {code} <= {"sequence_gap", "count", "total"}


def test_sheet_faults_and_blank_rows(spark):
    rows = rows_of("SOP", CATEGORIES[0][1], CATEGORIES[0][2], 4)
    rows[1][1] = "SOP-001"
    rows.insert(2, [""] * 14)
    raw = spark.createDataFrame([(CATEGORIES[0][1], i + 2, [str(x) for x in r]) for i, r in enumerate(rows)], "sheet string, row_no int, cells array<string>")
    issues = workbook_issues(raw, category_spec(spark).filter("code IN ('SOP', 'QS')"))
    got = {r.code: r.detail for r in issues.collect()}
    sheet = CATEGORIES[0][1]
    assert got == {"duplicate_rule_no": f"SOP-001 {sheet}!A2 {sheet}!A3", "sequence_gap": "", "count": "257 3", "missing_sheet": "", "total": "415 3"}
    lines, more = preview(issues, 2)
    assert [x.split(": ")[1].split(" ")[0] for x in lines] == ["duplicate_rule_no", "sequence_gap"] and more == 3


def test_preview_is_in_row_order_and_headers_are_checked(spark):
    rows = rows_of("SOP", CATEGORIES[0][1], CATEGORIES[0][2], 12)
    rows[1][2], rows[9][2] = "", " "
    raw = spark.createDataFrame([(CATEGORIES[0][1], i + 2, [str(x) for x in r]) for i, r in enumerate(rows)], "sheet string, row_no int, cells array<string>")
    spec = category_spec(spark).filter("code IN ('SOP', 'QS')").withColumn("expected_count", F.lit(10))
    heads = spark.createDataFrame([(CATEGORIES[0][1], [h for h, _ in HEADERS]), (CATEGORIES[1][1], ["a"])], "sheet string, cells array<string>")
    lines, more = preview(workbook_issues(raw, spec, heads), 9)
    sheet = CATEGORIES[0][1]
    assert lines == [f"ERROR {sheet}!3: blank (规则名称)", f"ERROR {sheet}!11: blank (规则名称)", f"ERROR {sheet}: sequence_gap", f"ERROR {CATEGORIES[1][1]}: header", "ERROR workbook: total (20 10)"] and more == 0


def test_workbook_cells(spark, tmp_path):
    path = tmp_path / "x.xlsx"
    path.write_bytes(xlsx({"a": [["code", "v", "v"], ["p", 5.0, True], ["q", 0.25, None]], "b": [[1, 2, 3, 4], [5, 6, 7, 8]]}, headers=False))
    rows = read_workbook(spark, str(path))
    assert {(r.sheet, r.row_no): r.cells for r in rows.collect()}[("a", 2)] == ["p", "5", "True"]
    assert sorted(r.fields["v"] for r in with_headers(rows.filter("sheet = 'a'")).collect()) == ["0.25", "5"]
    assert sorted((r.row_no, r.block, r.cells) for r in side_by_side(rows.filter("sheet = 'b'"), [0, 2], 2).collect()) == [(1, 0, ["1", "2"]), (1, 1, ["3", "4"]), (2, 0, ["5", "6"]), (2, 1, ["7", "8"])]


def test_books_with_one_sheet_name_and_dates(spark, tmp_path):
    for name, head in (("x", "v"), ("y", "w")):
        (tmp_path / f"{name}.xlsx").write_bytes(xlsx({"a": [["code", head], [name, "1.0"]]}, headers=False))
    rows = with_headers(read_workbook(spark, str(tmp_path / "*.xlsx")))
    assert sorted(tuple(sorted(r.fields.items())) for r in rows.collect()) == [(("code", "x"), ("v", "1.0")), (("code", "y"), ("w", "1.0"))]
    assert set(side_by_side(read_workbook(spark, str(tmp_path / "x.xlsx")), [0], 2).columns) == {"path", "sheet", "row_no", "block", "cells"}
    from hawthorn.sources.workbook import _date, _date_styles, _number

    style = b'<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.0&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>'
    assert _date_styles(style) == {1, 2} and _date_styles(None) == set()
    assert [_date(x, False) for x in ("45000", "45000.5", "1", "0.25")] == ["2023-03-15 00:00:00", "2023-03-15 12:00:00", "1900-01-01 00:00:00", "06:00:00"]
    assert [_number(x) for x in ("12", "12.0", "0.25", "12345678901234567890")] == ["12", "12", "0.25", "12345678901234567890"]
