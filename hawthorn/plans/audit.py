"""Validation of whole rules and audit records, gap plans and matching, with faults put into the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.matching import first_match
from ..operators.reports import compute_gap, export_table, supplement_reasons
from ..operators.validation import audit_issues, duplicate_issues, rule_issues, with_ids
from .registry import query, table

#: A rule for each part; eight of the thirteen classes of keys have faults.
DOC = """CASE p_partkey % 13 WHEN 0 THEN '[1]' WHEN 1 THEN '{"rule_id":"r","sets":[]}' WHEN 2 THEN '{"rule_id":"r2","description":"d","sets":[],"parameters":{},"notes":"x","zz":1}' WHEN 3 THEN '{"rule_id":" ","description":"DEMO","sets":{},"parameters":[]}'
WHEN 4 THEN '{"rule_id":7,"description":"格式示例","sets":[3,{"set_name":"U","element":"x"}],"parameters":{}}' WHEN 5 THEN '{"rule_id":"r5","description":"d","sets":[{"set_name":"","subset_name":1,"element":"DEMO","at":0}],"parameters":{}}'
WHEN 6 THEN '{"rule_id":"r6","description":"d","sets":[],"parameters":{"MAX":{"value":1},"MIN":5," ":{"value":{},"unit":3,"x":1}}}' WHEN 7 THEN '{"rule_id":"r7","description":"' || p_name || '","sets":[{"set_name":"U","subset_name":null,"element":" "}],"parameters":{"MAX":{"value":[1],"unit":null}}}'
ELSE '{"rule_id":"r-' || p_partkey || '","description":"' || p_name || '","sets":[{"set_name":"U","subset_name":null,"element":"x"}],"parameters":{"MAX":{"value":1.5,"unit":"m"}}}' END"""


def _rules(spark, sf):
    return table(spark, sf, "part").select(F.lit("A").alias("big_category"), F.lit(1).alias("big_order"), F.col("p_partkey").alias("ordinal"), F.expr(DOC.replace("\n", " ")).alias("doc"))


@query("""SELECT p_partkey, suffix, message FROM part, (VALUES (0, '', 'rule must be an object'), (1, '', 'missing top-level fields: [''description'', ''parameters'']'), (2, '', 'forbidden extra top-level fields: [''notes'', ''zz'']'),
(2, '', 'old/non-template metadata leaked into rule: [''notes'']'), (3, '', 'rule_id must be non-empty string'), (3, '', 'reference/DEMO wording leaked into field rule'), (3, '', 'sets must be an array'), (3, '', 'parameters must be an object'),
(4, '', 'rule_id must be non-empty string'), (4, '', 'reference/DEMO wording leaked into field rule'), (4, '.sets[0]', 'set item must be object'), (4, '.sets[1]', 'missing set fields: [''subset_name'']'),
(5, '.sets[0]', 'extra set fields: [''at'']'), (5, '.sets[0]', 'set_name must be non-empty string'), (5, '.sets[0]', 'subset_name must be string or null'), (5, '.sets[0]', 'DEMO entity leaked into field rule'),
(6, '.parameters.MAX', 'missing parameter fields: [''unit'']'), (6, '.parameters.MIN', 'parameter item must be object'), (6, '.parameters. ', 'parameter name must be non-empty string'), (6, '.parameters. ', 'extra parameter fields: [''x'']'),
(6, '.parameters. ', 'parameter value must be scalar'), (6, '.parameters. ', 'unit must be string or null'), (7, '.sets[0]', 'element must be non-empty string'), (7, '.parameters.MAX', 'parameter value must be scalar')) v(c, suffix, message) WHERE p_partkey % 13 = c""")
def rule_messages(spark, sf):
    """Every fault of every rule, as messages with their places."""
    return rule_issues(_rules(spark, sf)).select(F.col("ordinal").alias("p_partkey"), F.regexp_replace("place", r"^A\[[0-9]+\]", "").alias("suffix"), "message")


@query("""WITH i AS (SELECT p_partkey, CASE p_partkey % 13 WHEN 1 THEN 'r' WHEN 2 THEN 'r2' WHEN 3 THEN ' ' WHEN 5 THEN 'r5' WHEN 6 THEN 'r6' WHEN 7 THEN 'r7' END AS id FROM part), f AS (SELECT id, min(p_partkey) AS first FROM i WHERE id IS NOT NULL GROUP BY 1)
SELECT p_partkey, 'duplicate rule_id ''' || id || '''; first seen at A[' || first || ']' AS message FROM i JOIN f USING (id) WHERE p_partkey <> first""")
def rule_duplicates(spark, sf):
    """Rules whose id another rule before has, and where."""
    return duplicate_issues(with_ids(_rules(spark, sf))).select(F.col("ordinal").alias("p_partkey"), "message")


#: Audit records of whole rules (key % 13 over 7); each of 17 classes has a fault or none.
RECORD = """concat('{"rule_id":"r-', p_partkey, '","big_category":"', CASE WHEN p_partkey % 17 = 1 THEN 'B' ELSE 'A' END, '","subcategory":"', CASE p_partkey % 17 WHEN 2 THEN 'off' WHEN 3 THEN 'bare' WHEN 4 THEN 'two' WHEN 5 THEN 'hint' ELSE 's' END, '","target_group_id":"',
CASE WHEN p_partkey % 17 = 6 THEN 'h' WHEN p_partkey % 17 = 7 THEN '' ELSE 'g' END, '","extraction_phase":', CASE WHEN p_partkey % 17 = 8 THEN 'null' ELSE '"table_first"' END, ',"source_priority":"', CASE WHEN p_partkey % 17 = 9 THEN 'R0' ELSE 'P1' END,
'","dedup_key":"', CASE WHEN p_partkey % 17 = 10 THEN 'same' ELSE concat('k', p_partkey) END, '","extraction_mode":"', CASE WHEN p_partkey % 17 = 11 THEN 'guess' ELSE 'direct' END, '"}')"""


@query("""WITH r AS (SELECT p_partkey, p_partkey % 17 AS c FROM part WHERE p_partkey % 13 > 7 AND p_partkey % 19 <> 0), m AS (SELECT p_partkey, message FROM r, (VALUES (1, 'big_category ''B'' does not match rule file ''A'''), (2, 'subcategory ''off'' is not enabled in A'), (3, 'no enabled template spec for subcategory ''bare'''),
(4, 'sets set_name signature [''U''] differs from the template''s [''U'', ''T'']'), (5, 'subset_name None differs from template example ''Up''; verify against symbol document and actual entity class'), (6, 'unknown target_group_id ''h'''), (7, 'missing required audit field target_group_id'),
(8, 'missing required audit field extraction_phase'), (8, 'invalid extraction_phase None'), (9, 'invalid or control-only source_priority ''R0'''), (11, 'invalid extraction_mode ''guess''')) v(k, message) WHERE c = k),
d AS (SELECT p_partkey, 'duplicate emitted dedup_key also used by ''r-' || (SELECT min(p_partkey) FROM r WHERE c = 10) || '''' AS message FROM r WHERE c = 10 AND p_partkey <> (SELECT min(p_partkey) FROM r WHERE c = 10)),
g AS (SELECT p_partkey FROM part WHERE p_partkey % 13 > 7 AND p_partkey % 19 = 0 UNION SELECT NULL WHERE false)
SELECT p_partkey, message FROM m UNION ALL SELECT p_partkey, message FROM d UNION ALL
SELECT 0, 'rules missing audit records: [' || (SELECT string_agg('''' || id || '''', ', ' ORDER BY id) FROM (SELECT id FROM (SELECT 'r-' || p_partkey AS id FROM g UNION SELECT unnest(['r', 'r2', ' ', 'r5', 'r6', 'r7'])) ORDER BY id LIMIT 20)) || ']'""")
def audit_messages(spark, sf):
    """Every fault between rules and their audit records."""
    audit = table(spark, sf, "part").filter("p_partkey % 13 > 7 AND p_partkey % 19 <> 0").select(F.col("p_partkey").alias("ordinal"), F.expr(RECORD.replace("\n", " ")).alias("doc"))
    catalog = spark.createDataFrame([("A", ["s", "bare", "two", "hint"])], "big_category string, enabled array<string>")
    spec = spark.createDataFrame([("A", "s", [("U", None)]), ("A", "two", [("U", None), ("T", None)]), ("A", "hint", [("U", "Up")])], "big_category string, subcategory string, signature array<struct<set_name string, subset_name string>>")
    groups = spark.createDataFrame([("g",)], "target_group_id string")
    return audit_issues(_rules(spark, sf), audit, catalog, spec, groups).select(F.col("ordinal").alias("p_partkey"), "message")


TARGETS = [("small", "exact", 400, None, None), ("red", "advisory_exact", 500, None, None), ("hot", "approx", 100, None, None), ("large", "interval", None, 300, 420), ("blue", "approx_interval", None, 10, 20), ("green", "unspecified", None, None, None), ("none", "unspecified", None, None, None)]
GAPS = """WITH t AS (SELECT * FROM (VALUES ('small', 'exact', 400, NULL, NULL), ('red', 'advisory_exact', 500, NULL, NULL), ('hot', 'approx', 100, NULL, NULL), ('large', 'interval', NULL, 300, 420), ('blue', 'approx_interval', NULL, 10, 20), ('green', 'unspecified', NULL, NULL, NULL), ('none', 'unspecified', NULL, NULL, NULL)) v(g, kind, value, low, high)),
n AS (SELECT g, kind, value, low, high, (SELECT count(*) FROM part WHERE string_split(p_name, ' ')[1] = g AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 3 <> 1)::BIGINT AS n FROM t)"""


def _gap(spark, sf):
    k = F.col("p_partkey")
    record = F.to_json(F.struct(
        F.concat(F.lit("r"), k.cast("string")).alias("rule_id"), F.lit("A").alias("big_category"), F.get(F.split("p_name", " "), F.lit(0)).alias("target_group_id"),
        F.when(k % 5 == 0, "FAIL").when(k % 2 == 0, "PASS").alias("validation_status"), F.when(k % 7 == 0, "document_supplement").otherwise("table_first").alias("extraction_phase"),
    ))
    rows = table(spark, sf, "part")
    # each record twice: rules count once
    audit = rows.select(k.alias("ordinal"), record.alias("doc")).withColumn("again", F.explode(F.sequence(F.lit(0), F.lit(1)))).select("ordinal", "doc")
    emitted = rows.filter(k % 3 != 1).select(F.concat(F.lit("r"), k.cast("string")).alias("rule_id"))
    categories = spark.createDataFrame([("A", 700, "")], "big_category string, target_count long, note string")
    groups = spark.createDataFrame([(g, "A", [g], kind, value, low, high) for g, kind, value, low, high in TARGETS], "target_group_id string, big_category string, subcategories array<string>, kind string, value long, low long, high long")
    return compute_gap(categories, groups, audit, emitted, "table_first")


@query(GAPS + """ SELECT g, kind, n, CASE WHEN kind IN ('exact', 'advisory_exact', 'approx') THEN greatest(value - n, 0) END AS remaining, CASE WHEN kind LIKE '%interval' THEN greatest(low - n, 0) END AS remaining_low, CASE WHEN kind LIKE '%interval' THEN greatest(high - n, 0) END AS remaining_high,
kind = 'exact' AND n >= value AS closed, CASE WHEN kind IN ('exact', 'advisory_exact', 'approx') THEN n < value WHEN kind LIKE '%interval' THEN n < low ELSE n = 0 END AS supplement,
CASE kind WHEN 'approx' THEN '约' || value WHEN 'interval' THEN low || '–' || high WHEN 'approx_interval' THEN '约' || low || '–' || high WHEN 'unspecified' THEN '未明确' ELSE value::VARCHAR END AS target FROM n""")
def gap_plan(spark, sf):
    """The gap of every target group from audit records of one phase: failed ones and rules not emitted don't count, repeats once."""
    by_group = _gap(spark, sf)[1]
    return by_group.select(F.col("target_group_id").alias("g"), "kind", F.col("extracted_unique").alias("n"), "remaining", "remaining_low", "remaining_high", "closed", "supplement", F.col("target_display").alias("target"))


@query(GAPS + """, s AS (SELECT * FROM (VALUES ('red', 'entity', false, false), ('large', 'topology', false, false), ('blue', 'entity', true, true), ('small', 'entity', false, true)) v(g, slot, covered, numeric_only)),
r AS (SELECT n.g, concat_ws(',', CASE WHEN coalesce(CASE WHEN kind IN ('exact', 'advisory_exact', 'approx') THEN greatest(value - n, 0) WHEN kind LIKE '%interval' THEN greatest(low - n, 0) END, 0) > 0 THEN 'remaining' END, CASE WHEN n = 0 THEN 'uncovered_subcategory' END,
CASE WHEN NOT covered THEN 'uncovered_slot' END, CASE WHEN numeric_only THEN 'numeric_only' END, CASE WHEN NOT covered AND slot = 'topology' THEN 'topology' END) AS reasons, kind = 'exact' AND n >= value AS closed FROM n LEFT JOIN s ON n.g = s.g)
SELECT g, CASE WHEN closed THEN '' ELSE reasons END AS reasons FROM r""")
def supplement_plan(spark, sf):
    """Why documents may add rules to a group: any of five reasons; a closed group has none."""
    slots = spark.createDataFrame([("red", "entity", False, False), ("large", "topology", False, False), ("blue", "entity", True, True), ("small", "entity", False, True)], "target_group_id string, kind string, covered boolean, numeric_only boolean")
    return supplement_reasons(_gap(spark, sf)[1], slots).select(F.col("target_group_id").alias("g"), F.array_join("reasons", ",").alias("reasons"))


@query("""WITH a AS (SELECT p_partkey, 'REVIEW' AS status, '' AS note FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'PASS', '' FROM part WHERE p_partkey % 3 = 1)
SELECT 'r-' || p_partkey AS rule_id, p_name AS description, '[{"set_name":"U","subset_name":null,"element":"x"}]' AS sets_json, coalesce(status, '') AS validation_status FROM part LEFT JOIN a USING (p_partkey) WHERE p_partkey % 13 > 7""")
def export_rows_of_rules(spark, sf):
    """Rules with the columns of their last audit record, blank where there is none."""
    k = F.col("p_partkey")
    rows = table(spark, sf, "part")
    record = lambda status: F.to_json(F.struct(F.concat(F.lit("r-"), k.cast("string")).alias("rule_id"), F.lit(status).alias("validation_status")))
    first = rows.filter(k % 3 != 2).select((k * 2).alias("ordinal"), record("PASS").alias("doc"))
    last = rows.filter(k % 3 == 0).select((k * 2 + 1).alias("ordinal"), record("REVIEW").alias("doc"))
    return export_table(_rules(spark, sf).filter("ordinal % 13 > 7"), last.unionByName(first)).select("rule_id", "description", "sets_json", "validation_status")


@query("""WITH c AS (SELECT word, row_number() OVER (ORDER BY word DESC) AS i FROM (SELECT DISTINCT string_split(p_name, ' ')[2] || '（' || p_brand || '）' AS word FROM part WHERE p_partkey % 50 = 0)),
m AS (SELECT p_partkey, word, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS r FROM part JOIN c ON contains(replace(p_name, ' ', ''), regexp_replace(word, '（.*）', '')) OR contains(regexp_replace(word, '（.*）', ''), replace(p_name, ' ', '')))
SELECT p_partkey, word FROM m WHERE r = 1""")
def candidate_match(spark, sf):
    """The first candidate of a table, in its order, whose normal name equals, holds or is held by the row's."""
    parts = table(spark, sf, "part")
    words = parts.filter("p_partkey % 50 = 0").select(F.concat(F.get(F.split("p_name", " "), F.lit(1)), F.lit("（"), "p_brand", F.lit("）")).alias("word")).distinct()
    listed = words.agg(F.reverse(F.array_sort(F.collect_list("word"))).alias("ws")).select(F.posexplode("ws").alias("i", "word"))
    return first_match(parts.select("p_partkey", "p_name"), "p_name", listed, "word", "i").select("p_partkey", "word")


NESTED = """concat('{"output":[{"content":[{"text":"', p_name, '"},{"content":"', p_brand, '"},{"text":"","content":"', p_type, '"},3]},', CASE WHEN p_partkey % 3 = 0 THEN '{"type":"x"},' ELSE '"junk",' END, '{"content":[{"text":"', p_partkey, '"},{"text":""}]}]', CASE WHEN p_partkey % 4 = 0 THEN ',"output_text":"whole"' ELSE '' END, '}')"""


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'whole' ELSE p_name || chr(10) || p_brand || chr(10) || p_type || chr(10) || p_partkey END AS text FROM part""")
def response_text(spark, sf):
    """The text of a nested response: its own if it has one, else the texts, or contents, of all items in order."""
    v = F.try_parse_json(F.expr(NESTED))
    part = lambda x, k: F.try_variant_get(x, f"$.{k}", "string")
    each = F.transform(F.try_variant_get(v, "$.output", "array<variant>"), lambda o: F.coalesce(F.try_variant_get(o, "$.content", "array<variant>"), F.array().cast("array<variant>")))
    texts = F.transform(F.flatten(each), lambda c: F.coalesce(F.nullif(part(c, "text"), F.lit("")), F.nullif(part(c, "content"), F.lit(""))))
    return table(spark, sf, "part").select("p_partkey", F.coalesce(F.nullif(part(v, "output_text"), F.lit("")), F.array_join(F.array_compact(texts), "\n")).alias("text"))
