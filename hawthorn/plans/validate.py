"""Validation queries: workbook rows, closed JSON, signatures, audit records, lint."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.issues import explode_issues
from .registry import query, table

FAULTY = """SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '  ' ELSE c_name END AS name, CASE WHEN c_custkey % 13 = 0 THEN 'x' || c_custkey ELSE c_custkey::VARCHAR END AS seq,
CASE WHEN c_custkey % 17 = 0 THEN '' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE c_nationkey END AS nation FROM customer"""
ISSUES = f"""WITH f AS ({FAULTY}), i AS (SELECT c_custkey AS place, 'blank_name' AS code FROM f WHERE trim(name) = '' UNION ALL SELECT c_custkey, 'sequence_not_integer' FROM f WHERE NOT regexp_matches(seq, '^[0-9]+$')
UNION ALL SELECT c_custkey, 'blank_segment' FROM f WHERE segment = '' UNION ALL SELECT c_custkey, 'unknown_nation' FROM f WHERE nation IS NULL UNION ALL SELECT c_custkey, 'prefix' FROM f WHERE trim(name) <> '' AND NOT starts_with(name, 'Customer#00000'))"""


def _faulty(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        "c_custkey", F.when(k % 11 == 0, "  ").otherwise(F.col("c_name")).alias("name"), F.when(k % 13 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string")).alias("seq"),
        F.when(k % 17 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"), F.when(k % 19 != 0, F.col("c_nationkey")).alias("nation"),
    )


def _issues(spark, sf):
    name = F.trim("name")
    checks = {
        "blank_name": name == "", "sequence_not_integer": F.col("seq").try_cast("int").isNull(), "blank_segment": F.col("segment") == "",
        "unknown_nation": F.col("nation").isNull(), "prefix": (name != "") & ~F.startswith("name", F.lit("Customer#00000")),
    }
    return explode_issues(_faulty(spark, sf), F.col("c_custkey"), checks).select("place", "code")


@query(ISSUES + " SELECT place, code FROM i")
def wb_validate(spark, sf):
    """Row checks of a workbook; every fault of a row is a row."""
    return _issues(spark, sf)


@query(ISSUES + " SELECT place, code, (SELECT count(*) - 30 FROM i) AS more FROM i ORDER BY place, code LIMIT 30")
def error_preview(spark, sf):
    """The first 30 faults and the number of the rest."""
    issues = _issues(spark, sf)
    return issues.orderBy("place", "code").limit(30).withColumn("more", issues.agg(F.count("*") - 30).scalar())


@query(f"""WITH f AS ({FAULTY}) SELECT c_custkey, concat_ws('、', CASE WHEN trim(name) = '' THEN 'name' END, CASE WHEN segment = '' THEN 'segment' END, CASE WHEN nation IS NULL THEN 'nation' END) AS missing FROM f
WHERE trim(name) = '' OR segment = '' OR nation IS NULL""")
def form_validation(spark, sf):
    """All missing fields of a form in one message."""
    out = _faulty(spark, sf).select("c_custkey", F.concat_ws("、", F.when(F.trim("name") == "", "name"), F.when(F.col("segment") == "", "segment"), F.when(F.col("nation").isNull(), "nation")).alias("missing"))
    return out.filter("missing <> ''")


DOC = """CASE o_orderkey % 5 WHEN 0 THEN '{"rule_id":"r","description":"d","sets":[],"parameters":{}}' WHEN 1 THEN '{"rule_id":"r","description":"d","sets":[]}'
WHEN 2 THEN '{"rule_id":"r","description":"d","sets":[],"parameters":{},"note":1}' WHEN 3 THEN '{"rule_id":"r","description":"d","sets":[],"parameters":{},"status":"x"}' ELSE '{"description":"d"}' END"""


@query(f"""WITH k AS (SELECT o_orderkey, json_keys(({DOC})::JSON) AS k FROM orders), a AS (SELECT ['rule_id', 'description', 'sets', 'parameters'] AS want)
SELECT o_orderkey, len(list_filter(want, lambda x: NOT list_contains(k, x)))::INT AS missing, len(list_filter(k, lambda x: NOT list_contains(want, x)))::INT AS extra, list_contains(k, 'status') AS forbidden FROM k, a""")
def json_keys_strict(spark, sf):
    """Closed JSON: missing, extra and forbidden keys, on the text's own keys."""
    doc = F.expr(DOC.replace("\n", " "))
    want = F.array(*[F.lit(x) for x in ("rule_id", "description", "sets", "parameters")])
    k = table(spark, sf, "orders").select("o_orderkey", F.json_object_keys(doc).alias("k"))
    return k.select("o_orderkey", F.size(F.array_except(want, "k")).alias("missing"), F.size(F.array_except("k", want)).alias("extra"), F.array_contains("k", "status").alias("forbidden"))


@query("""WITH p AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"v":[1,2]}' WHEN 1 THEN '{"v":"a"}' WHEN 2 THEN '{"v":null}' ELSE replace(props, 'k', 'v') END AS doc FROM events)
SELECT event_id, CASE json_type(doc, '$.v') WHEN 'ARRAY' THEN 'error' WHEN 'OBJECT' THEN 'error' ELSE 'ok' END AS verdict FROM p""")
def json_params(spark, sf):
    """A parameter's value may be any scalar, not an array or object."""
    e = F.col("event_id")
    doc = F.when(e % 4 == 0, '{"v":[1,2]}').when(e % 4 == 1, '{"v":"a"}').when(e % 4 == 2, '{"v":null}').otherwise(F.replace("props", F.lit("k"), F.lit("v")))
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(doc), "$.v", "variant"))
    return table(spark, sf, "events").select("event_id", F.when(kind.rlike("^(ARRAY|OBJECT)"), "error").otherwise("ok").alias("verdict"))


@query("""WITH s AS (SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS sig FROM lineitem GROUP BY 1) SELECT l_orderkey, sig = 'A,N,R' AS equal, sig FROM s""")
def json_signature(spark, sf):
    """The ordered list of set names against a template's."""
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("s"))
    sig = F.array_join(F.transform("s", lambda x: x["l_returnflag"]), ",")
    return s.select("l_orderkey", sig.alias("sig")).select("l_orderkey", (F.col("sig") == "A,N,R").alias("equal"), "sig")


@query("""SELECT event_id, code FROM (SELECT event_id, unnest([CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'mode' END, CASE WHEN value > 50 THEN 'priority' END, CASE WHEN user_id % 10 = 0 THEN 'group' END]) AS code FROM events) WHERE code IS NOT NULL""")
def audit_checks(spark, sf):
    """Domains of an audit record's fields, and membership of its group."""
    groups = spark.range(1, 10).select(F.col("id").alias("g"))
    e = table(spark, sf, "events").withColumn("m", F.col("user_id") % 10).join(F.broadcast(groups), F.col("m") == F.col("g"), "left")
    checks = {"mode": ~F.col("event_type").isin("view", "click", "purchase"), "priority": F.col("value") > 50, "group": F.col("g").isNull()}
    return explode_issues(e, F.col("event_id"), checks).select(F.col("place").alias("event_id"), "code")


@query("""SELECT p_partkey, code FROM (SELECT p_partkey, unnest([CASE WHEN p_size % 10 = p_partkey % 10 THEN 'equal_bounds' END, CASE WHEN contains(p_name, 'red') AND contains(p_name, 'e') THEN 'both_bounds' END, CASE WHEN contains(p_type, 'A') THEN 'comma' END]) AS code FROM part) WHERE code IS NOT NULL""")
def lint_patterns(spark, sf):
    """Suspicious patterns, each a finding."""
    checks = {"equal_bounds": F.col("p_size") % 10 == F.col("p_partkey") % 10, "both_bounds": F.col("p_name").contains("red") & F.col("p_name").contains("e"), "comma": F.col("p_type").contains("A")}
    return explode_issues(table(spark, sf, "part"), F.col("p_partkey"), checks).select(F.col("place").alias("p_partkey"), "code")


@query("""SELECT p_partkey, CASE WHEN s.arity IS NULL THEN 'no_template' WHEN s.arity = len(string_split(p_name, ' ')) THEN 'ok' ELSE 'arity' END AS verdict FROM part LEFT JOIN (VALUES ('ECONOMY', 2), ('SMALL', 3), ('LARGE', 2)) s(t, arity) ON p_type = t""")
def spec_lookup(spark, sf):
    """A subcategory's template; none is an error."""
    s = spark.createDataFrame([("ECONOMY", 2), ("SMALL", 3), ("LARGE", 2)], "t string, arity int")
    p = table(spark, sf, "part").join(F.broadcast(s), F.col("p_type") == F.col("t"), "left")
    return p.select("p_partkey", F.when(F.col("arity").isNull(), "no_template").when(F.col("arity") == F.size(F.split("p_name", " ")), "ok").otherwise("arity").alias("verdict"))


@query("""SELECT c_custkey, len(string_split(c_name || '.' || c_mktsegment || CASE WHEN c_nationkey % 2 = 0 THEN '.n' ELSE '' END, '.'))::INT AS arity FROM customer""")
def element_arity(spark, sf):
    """Parts of a composite element."""
    e = F.concat("c_name", F.lit("."), "c_mktsegment", F.when(F.col("c_nationkey") % 2 == 0, ".n").otherwise(""))
    return table(spark, sf, "customer").select("c_custkey", F.size(F.split(e, r"\.")).alias("arity"))


@query("""SELECT p_partkey, p_size % 5 = 0 AS fixed, contains(p_name, 'small') AND p_size > 20 AS combined FROM part""")
def atomic_bounds(spark, sf):
    """One bound for a rule: equal pairs and combined ones are flagged."""
    return table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 5 == 0).alias("fixed"), (F.col("p_name").contains("small") & (F.col("p_size") > 20)).alias("combined"))


@query("""WITH s AS (SELECT l_orderkey, l_returnflag AS set_name, CASE WHEN l_tax = 0 THEN NULL ELSE l_linestatus END AS element FROM lineitem) SELECT l_orderkey, set_name, count(*) AS n, count(*) FILTER (element IS NULL) AS bad FROM s GROUP BY 1, 2""")
def set_items(spark, sf):
    """Set items by rule and set, those without an element counted."""
    bad = F.count_if(F.col("l_tax") == 0)
    return table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("set_name")).agg(F.count("*").alias("n"), bad.alias("bad"))


@query("""SELECT DISTINCT k AS field FROM (SELECT unnest(json_keys(props::JSON)) AS k FROM events UNION ALL SELECT unnest(['unit', 'value'])) ORDER BY 1""")
def field_union(spark, sf):
    """All field names that occur."""
    seen = table(spark, sf, "events").select(F.explode(F.json_object_keys("props")).alias("field"))
    return seen.union(spark.createDataFrame([("unit",), ("value",)], "field string")).distinct()


@query("""SELECT l_orderkey, l_returnflag, min(r) AS at FROM (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) GROUP BY 1, 2""")
def list_distinct(spark, sf):
    """Distinct values of a list with where each first stands."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", F.row_number().over(w).cast("long").alias("r")).groupBy("l_orderkey", "l_returnflag").agg(F.min("r").alias("at"))
