"""Validation as tables of issues: each check is a message or null, and all messages of a row explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import FIELDS, HEADERS, REQUIRED

LEVEL, WHERE, CODE = "level", "place", "code"


def explode_issues(df: DataFrame, place: Column, checks: dict[str, Column], level: str = "ERROR") -> DataFrame:
    """place, code, level: a row for every check (code -> Column of bool) that holds."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]))
    return df.select(place.alias(WHERE), F.explode(found).alias(CODE), F.lit(level).alias(LEVEL))


def parse_rows(raw: DataFrame, spec: DataFrame) -> DataFrame:
    """Typed rule rows from raw (sheet, row_no, cells): blank rows go, cells are cleaned, category and hash are added."""
    cell = lambda i: tx.cell_text(F.get("cells", i))
    blank = F.size(F.filter("cells", lambda x: tx.cell_text(x) != "")) == 0
    rows = raw.filter(~F.coalesce(blank, F.lit(True))).select("sheet", "row_no", F.size("cells").alias("width"), *[cell(i).alias(f) for i, f in enumerate(FIELDS)])
    rows = rows.withColumn("sequence", tx.integer(F.col("sequence_no"))).join(
        spec.select(F.col("sheet_name").alias("sheet"), F.col("code").alias("category_code"), F.col("knowledge_type").alias("spec_type"), "prefix"), "sheet", "left"
    )
    return rows.withColumn("content_hash", tx.hash_array([F.col(f) for f in FIELDS[1:]]))


#: Steps of a workbook's checks in the order in which they are reported.
STEPS = ["missing_sheet", "header", "width", "sequence_not_integer", "blank", "duplicate_rule_no", "prefix", "category", "knowledge_type", "sequence_gap", "count", "total"]


def workbook_issues(raw: DataFrame, spec: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """place, code, level, detail, sheet_order, row_no of all issues of a workbook. raw: sheet, row_no, cells, without headers.

    A row's checks end at its first of: width, sequence, blank fields, repeated number. Rows that come through are
    records; only they count for prefixes, sequences, counts and the total. Where heads (sheet, cells) are given,
    a sheet whose header differs is passed over as a whole, and sheets without rows aren't missing.
    """
    order = spec.select(F.col("sheet_name").alias("sheet"), F.col("display_order").alias("sheet_order"), "expected_count")
    rows = parse_rows(raw, spec).join(order.drop("expected_count"), "sheet")
    sheets = order.join(raw.select("sheet").distinct().withColumn("there", F.lit(True)), "sheet", "left")
    if heads is not None:
        head = heads.select("sheet", F.transform("cells", tx.cell_text).alias("head"))
        sheets = sheets.drop("there").join(head, "sheet", "left").withColumn("there", F.when(F.col("head").isNotNull(), True)).withColumn("bad_head", F.col("head") != F.array(*[F.lit(h) for h, _ in HEADERS]))
        rows = rows.join(sheets.filter("bad_head OR there IS NULL").select("sheet"), "sheet", "left_anti")
    else:
        sheets = sheets.withColumn("bad_head", F.lit(False))
    blank = F.array_compact(F.array(*[F.when(F.col(f) == "", F.lit(h)) for h, f in HEADERS if f in REQUIRED]))
    stop = F.when(F.col("width") != len(FIELDS), "width").when(F.col("sequence").isNull(), "sequence_not_integer").when(F.size(blank) > 0, "blank")
    rows = rows.withColumns({"stop": stop, "missing": blank})
    # the first place of each number, among rows that got so far
    first = rows.filter("stop IS NULL").groupBy(F.col("rule_no").alias("_no")).agg(F.min(F.struct("sheet_order", "row_no", "sheet")).alias("first"))
    rows = rows.join(first, F.col("rule_no") == F.col("_no"), "left")
    again = F.col("stop").isNull() & ((F.col("first.sheet_order") != F.col("sheet_order")) | (F.col("first.row_no") != F.col("row_no")))
    rows = rows.withColumn("stop", F.when(again, "duplicate_rule_no").otherwise(F.col("stop")))
    record = F.col("stop").isNull()
    issue = lambda code, detail: F.struct(F.lit(code).alias("code"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail"))
    cell = lambda sheet, row: F.concat(sheet, F.lit("!A"), row.cast("string"))
    found = F.array_compact(F.array(
        F.when(F.col("stop") == "width", issue("width", F.col("width"))),
        F.when(F.col("stop") == "sequence_not_integer", issue("sequence_not_integer", F.col("sequence_no"))),
        F.when(F.col("stop") == "blank", issue("blank", F.array_join("missing", ", "))),
        F.when(F.col("stop") == "duplicate_rule_no", issue("duplicate_rule_no", F.concat(F.col("rule_no"), F.lit(" "), cell(F.col("first.sheet"), F.col("first.row_no")), F.lit(" "), cell(F.col("sheet"), F.col("row_no"))))),
        F.when(record & ~F.startswith("rule_no", "prefix"), issue("prefix", F.col("rule_no"))),
        F.when(record & (F.col("category_name") != F.col("sheet")), issue("category", F.col("category_name"))),
        F.when(record & (F.col("knowledge_type") != F.col("spec_type")), issue("knowledge_type", F.col("knowledge_type"))),
    ))
    columns = [F.col("i.code").alias(CODE), F.lit("ERROR").alias(LEVEL), F.col("i.detail").alias("detail"), "sheet_order", "row_no"]
    out = rows.select(F.concat_ws("!", "sheet", F.col("row_no").cast("string")).alias(WHERE), "sheet_order", "row_no", F.explode(found).alias("i")).select(WHERE, *columns)
    # a sheet's records in row order; a sheet is one task, as in the workbook
    number = F.row_number().over(Window.partitionBy("sheet").orderBy("row_no"))
    kept = rows.filter(record).select("sheet", (F.col("sequence") == number).alias("ok")).groupBy("sheet").agg(F.bool_and("ok").alias("ok"), F.count("*").alias("n"))
    sheets = sheets.join(kept, "sheet", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    usable = F.col("there").isNotNull() & ~F.col("bad_head")
    found = F.array_compact(F.array(
        F.when(F.col("there").isNull(), issue("missing_sheet", F.lit(""))),
        F.when(F.col("there").isNotNull() & F.col("bad_head"), issue("header", F.lit(""))),
        F.when(usable & ~F.coalesce("ok", F.lit(True)), issue("sequence_gap", F.lit(""))),
        F.when(usable & (F.col("n") != F.col("expected_count")), issue("count", F.concat_ws(" ", F.col("expected_count").cast("string"), F.col("n").cast("string")))),
    ))
    out = out.unionByName(sheets.select(F.col("sheet").alias(WHERE), "sheet_order", F.lit(None).cast("int").alias("row_no"), F.explode(found).alias("i")).select(WHERE, *columns))
    total = sheets.agg(F.sum("expected_count").alias("want"), F.sum("n").alias("n")).filter("want <> n")
    whole = issue("total", F.concat_ws(" ", F.col("want").cast("string"), F.col("n").cast("string")))
    return out.unionByName(total.select(F.lit("workbook").alias(WHERE), F.lit(None).cast("int").alias("sheet_order"), F.lit(None).cast("int").alias("row_no"), whole.alias("i")).select(WHERE, *columns))


def preview(issues: DataFrame, n: int = 30) -> tuple[list[str], int]:
    """The first n issues as text, in the order of sheets, rows and checks (a sheet's own after those of its rows), and how many more there are."""
    step = F.array_position(F.array(*[F.lit(x) for x in STEPS]), F.col(CODE))
    first = [F.asc_nulls_last("sheet_order"), F.when(F.col(CODE).isin("missing_sheet", "header"), 0).otherwise(1), F.asc_nulls_last("row_no"), step, WHERE]
    rows = issues.orderBy(*first).limit(n).collect()
    return [f"{r.level} {r.place}: {r.code}" + (f" ({r.detail})" if r.detail else "") for r in rows], max(0, issues.count() - n)
