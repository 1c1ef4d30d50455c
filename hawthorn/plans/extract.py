"""Extraction queries: workbook rows made of the driver's tables through the extraction operators; the SQL follows the source system's rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import extraction as ex
from .registry import query, table

#: Words that names are made of, one or two by key.
WORDS = ["催化", "重整", "乙烯", "聚丙烯", "聚烯", "MTBE", "气体分馏", "气分", "航煤", "柴油", "苯", "芳烃", "常压", "蒸馏", "焦化", "渣油", "轻烃", "原油", "汽油", "石脑油", "喷气燃料", "液化气", "丙烷", "丙烯", "C4", "碳四", "二甲苯", "蜡油", "甲醇", "厂"]
LIST = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
NAMED = f"n AS (SELECT p_partkey, {LIST}[p_partkey % 30 + 1] || CASE WHEN p_partkey % 2 = 0 THEN {LIST}[(p_partkey // 30) % 30 + 1] ELSE '' END AS name FROM part)"


def _named(spark, sf):
    words, k = F.array(*[F.lit(w) for w in WORDS]), F.col("p_partkey")
    second = F.get(words, (F.floor(k / 30) % 30).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.concat(F.get(words, (k % 30).cast("int")), F.when(k % 2 == 0, second).otherwise("")).alias("name"))


@query(f"""WITH {NAMED} SELECT p_partkey, name, CASE WHEN contains(name, '催化') THEN '催化' WHEN contains(name, '重整') THEN '重整' WHEN contains(name, '乙烯') THEN '乙烯' WHEN contains(name, '聚丙烯') OR contains(name, '聚烯') THEN '聚烯烃'
WHEN contains(name, 'MTBE') THEN 'MTBE' WHEN contains(name, '气体分馏') OR contains(name, '气分') THEN '气分' WHEN contains(name, '航煤') THEN '航煤加氢' WHEN contains(name, '柴油') THEN '汽柴油加氢' WHEN contains(name, '苯') OR contains(name, '芳烃') THEN '芳烃'
WHEN contains(name, '常压') OR contains(name, '蒸馏') THEN '一次装置常减压' WHEN contains(name, '焦化') THEN '延迟焦化' WHEN contains(name, '渣油') THEN '渣加' WHEN contains(name, '轻烃') THEN '轻烃回收' ELSE '一次装置常减压' END AS subcategory FROM n""")
def taxonomy_devices(spark, sf):
    """Subcategories of units by the first word that their name contains."""
    return _named(spark, sf).withColumn("subcategory", ex.device_subcategory(F.col("name")))


@query(f"""WITH {NAMED} SELECT p_partkey, name, CASE WHEN contains(name, '原油') THEN '原油罐' WHEN contains(name, '渣油') THEN '渣油罐' WHEN contains(name, '柴油') THEN '柴油罐' WHEN contains(name, '汽油') OR contains(name, '石脑油') THEN '汽油罐'
WHEN contains(name, '航煤') OR contains(name, '喷气燃料') THEN '煤油罐' WHEN regexp_matches(name, '轻烃|液化气|丙烷|丙烯|C4|碳四') THEN '轻烃罐' WHEN contains(name, '芳烃') OR contains(name, '苯') THEN '芳烃罐' WHEN contains(name, '蜡油') THEN '蜡油罐' ELSE '中间产品罐' END AS subcategory FROM n""")
def taxonomy_tanks(spark, sf):
    """Subcategories of tanks by what they hold."""
    return _named(spark, sf).withColumn("subcategory", ex.tank_subcategory(F.col("name")))


@query(f"""WITH {NAMED} SELECT p_partkey, name, CASE WHEN contains(name, '催化') THEN '催化' WHEN contains(name, '重整') THEN '重整' WHEN contains(name, 'MTBE') THEN 'MTBE' WHEN contains(name, '气体分馏') THEN '气分' WHEN contains(name, '航煤') THEN '航煤加氢'
WHEN contains(name, '柴油') THEN '汽柴油加氢' WHEN contains(name, '汽油') THEN 'S-ZORB' WHEN contains(name, '乙苯') OR contains(name, '苯乙烯') THEN '芳烃' ELSE '一次装置常减压' END AS subcategory FROM n""")
def taxonomy_points(spark, sf):
    """Subcategories of sampling points by their sheet."""
    return _named(spark, sf).withColumn("subcategory", ex.point_subcategory(F.col("name")))


@query("""WITH u AS (SELECT p_partkey, ['重整', 'PTA', '常减压', 's-zorb', '乙烯', '油浆拔头', '渣加', '未知'][p_partkey % 8 + 1] AS unit FROM part)
SELECT p_partkey, unit, CASE WHEN unit IN ('重整', '乙烯', '渣加') THEN 'upstream' ELSE 'downstream' END AS side FROM u WHERE unit NOT IN ('常减压', '未知')""")
def unit_classes(spark, sf):
    """Units of the ten upstream and ten downstream classes; any other is rejected."""
    units = F.array(*[F.lit(x) for x in ("重整", "PTA", "常减压", "s-zorb", "乙烯", "油浆拔头", "渣加", "未知")])
    rows = table(spark, sf, "part").select("p_partkey", F.get(units, (F.col("p_partkey") % 8).cast("int")).alias("unit"))
    return rows.withColumn("side", ex.unit_side(F.col("unit"))).filter("side IS NOT NULL")


CAPACITY = """c AS (SELECT c_custkey + 1 AS row_no, CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE '<b>' || c_mktsegment || '</b>' || c_custkey END AS name, CASE WHEN c_custkey % 7 = 0 THEN '—' ELSE (c_custkey % 1000)::VARCHAR END AS first,
CASE WHEN c_custkey % 13 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN '1,' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') ELSE (c_custkey * 2)::VARCHAR END AS rated, (c_custkey * 3)::VARCHAR AS most, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '0.5' END AS low FROM customer)"""


@query(f"""WITH {CAPACITY}, p AS (SELECT row_no, trim(regexp_replace(name, '<[^>]+>', '', 'g')) AS name, try_cast(replace(first, ',', '') AS DOUBLE) AS first, try_cast(replace(rated, ',', '') AS DOUBLE) AS rated, most::DOUBLE AS most, coalesce(low::DOUBLE, 0) AS low FROM c)
SELECT 'R-UNIT-CAP-' || printf('%03d', row_no) AS rule_id, name AS subject, '{{"variable":"feed_rate","operator":"between","value":[' || CASE WHEN rated * low = floor(rated * low) THEN (rated * low)::BIGINT::VARCHAR ELSE (rated * low)::VARCHAR END || ',' || most::BIGINT || '],"unit":"t/d"}}' AS bound,
name || '初始负荷' || coalesce(first::BIGINT::VARCHAR, 'None') || '吨/天、额定负荷' || rated::BIGINT || '吨/天、最大加工负荷' || most::BIGINT || '吨/天。' AS description FROM p WHERE row_no >= 3 AND name <> '' AND rated IS NOT NULL""")
def device_bounds(spark, sf):
    """Load bounds of units out of a sheet's cells: tags and commas go, rows without a name or a load are passed over."""
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    cells = F.array(
        F.lit(""), F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit("<b>"), "c_mktsegment", F.lit("</b>"), text(k))), F.lit(""), F.when(k % 7 == 0, "—").otherwise(text(k % 1000)),
        F.when(k % 13 == 0, "").when(k % 3 == 0, F.concat(F.lit("1,"), F.lpad(text(k % 1000), 3, "0"))).otherwise(text(k * 2)), text(k * 3), F.lit(None).cast("string"), F.when(k % 5 != 0, "0.5"),
    )
    rows = table(spark, sf, "customer").select(F.lit("book").alias("path"), F.lit("s").alias("sheet"), (k + 1).cast("int").alias("row_no"), cells.alias("cells"), F.array().cast("array<string>").alias("kinds"))
    return ex.device_capacity(rows).select("rule_id", "subject", F.col("then").alias("bound"), "description")


TANK_ROWS = """t AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN '延炼' ELSE '延石化' END AS plant, CASE WHEN s_suppkey % 17 = 3 THEN '待定' || s_suppkey WHEN s_suppkey % 9 = 1 THEN 'T-41' || s_suppkey ELSE 'T-' || s_suppkey END AS tank,
10 + s_suppkey % 7 AS high, CASE WHEN s_suppkey % 10 = 5 THEN NULL ELSE 1 + s_suppkey % 2 END AS low, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 8 + s_suppkey % 11 END AS height FROM supplier),
a AS (SELECT * FROM t WHERE low IS NOT NULL AND NOT contains(tank, '待')), b AS (SELECT k, plant, tank, high + CASE WHEN k % 20 = 5 THEN 1 ELSE 0 END AS high, 1 AS low FROM t WHERE k % 10 = 5 AND k % 2 = 1 AND NOT contains(tank, '待')),
f AS (SELECT plant, tank, high, low, CASE WHEN plant = '延石化' AND regexp_matches(tank, '^T-4[1238]') THEN 'disputed' WHEN height IS NOT NULL AND high > height THEN 'above' END AS reason FROM a WHERE k % 23 <> 0
UNION ALL SELECT plant, tank, high, low, CASE WHEN k % 20 = 5 THEN 'partial' END FROM b WHERE k % 23 <> 0)"""


@query(f"""WITH {TANK_ROWS} SELECT 'TANK_LEVEL_' || kind || '_' || CASE plant WHEN '延炼' THEN 'YL' ELSE 'YSH' END || '_' || upper(regexp_replace(tank, '[^A-Za-z0-9]', '', 'g')) AS rule_id,
plant || tank || '罐（油）安全液位' || CASE kind WHEN 'MIN' THEN '下限' ELSE '上限' END || '为' || CASE kind WHEN 'MIN' THEN low ELSE high END || '米。' AS description FROM f, (VALUES ('MIN'), ('MAX')) v(kind) WHERE kind = 'MIN' OR reason IS NULL""")
def tank_bounds(spark, sf):
    """Safe levels of tanks from two sources side by side; lower bounds always, upper ones unless withheld."""
    return ex.tank_levels(*_tank_sources(spark, sf), by=("s_suppkey",))[0].select("rule_id", "description")


@query(f"""WITH {TANK_ROWS} SELECT tank, CASE reason WHEN 'disputed' THEN '车间罐容表与汇总表上限口径不一致' WHEN 'partial' THEN '0724表仅填写的上限与0720表不一致' ELSE '上限' || high || '米高于罐高' || (SELECT height FROM t WHERE t.tank = f.tank) || '米' END AS reason FROM f WHERE reason IS NOT NULL""")
def tank_withheld(spark, sf):
    """Upper bounds that are withheld, with the reason."""
    return ex.tank_levels(*_tank_sources(spark, sf), by=("s_suppkey",))[1].select("tank", "reason")


def _tank_sources(spark, sf):
    """Every supplier has books of its own, as in the SQL: two suppliers' tanks may have one name (T-41 and 46, T- and 4146)."""
    k = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    tank = F.when(k % 17 == 3, F.concat(F.lit("待定"), text(k))).when(k % 9 == 1, F.concat(F.lit("T-41"), text(k))).otherwise(F.concat(F.lit("T-"), text(k)))
    none = F.lit(None).cast("string")
    block = [F.lit("油"), tank, F.lit("1"), text(10 + k % 7), F.when(k % 10 != 5, text(1 + k % 2)), none, none, none, none, F.when(k % 4 != 0, text(8 + k % 11))]
    blank = [none] * 10
    rows = table(spark, sf, "supplier")
    kinds = lambda cells: F.transform(cells, lambda c: F.when(c.rlike(r"^-?[0-9.]+$"), "n").when(c.isNotNull(), "s")).alias("kinds")
    cells = F.when(k % 2 == 0, F.array(*block, *blank, *blank)).otherwise(F.array(*blank, *blank, *block))
    primary = rows.select(k, F.lit(5).alias("row_no"), cells.alias("cells"), kinds(cells))
    high = 10 + k % 7 + F.when(k % 20 == 5, 1).otherwise(0)
    cells = F.array(F.lit("x"), F.lit("延石化"), none, F.lit("油"), tank, none, none, none, none, none, text(high), F.lit("1"))
    collected = rows.filter((k % 10 == 5) & (k % 2 == 1)).select(k, F.lit(6).alias("row_no"), cells.alias("cells"), kinds(cells))
    crude = rows.filter(k % 23 == 0).select(k, tank.alias("element"))
    return primary, collected, crude


@query("""WITH s AS (SELECT c_custkey, 'unit' AS set_name, c_name AS element FROM customer UNION ALL SELECT c_custkey, 'material', c_mktsegment FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'material', 'N' || c_nationkey FROM customer WHERE c_custkey % 3 = 1)
SELECT c_custkey, set_name, NULL::VARCHAR AS subset_name, element FROM s""")
def scope_rows(spark, sf):
    """A scope's map as set rows, lists of elements expanded, empty ones without a row."""
    k, name = F.col("c_custkey"), F.col("c_mktsegment")
    more = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(name, F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))).otherwise(F.array(name))
    scope = F.create_map(F.lit("unit"), F.array("c_name"), F.lit("material"), more)
    return table(spark, sf, "customer").select("c_custkey", F.explode(ex.scope_sets(scope)).alias("s")).select("c_custkey", "s.set_name", "s.subset_name", "s.element")


RAW = """CASE event_id % 6 WHEN 0 THEN 'null' WHEN 1 THEN '"  ' || event_type || ' "' WHEN 2 THEN '["' || event_type || '", " ", ' || user_id || ', null]' WHEN 3 THEN '{"a": 1}' WHEN 4 THEN '" "' ELSE '[]' END"""


@query("""SELECT event_id, CASE event_id % 6 WHEN 1 THEN event_type WHEN 2 THEN event_type || '|' || user_id || '|None' ELSE '' END AS items, CASE event_id % 6 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS n FROM events""")
def string_lists(spark, sf):
    """Values of any kind as lists of texts."""
    items = tx.string_list(F.try_parse_json(F.expr(RAW)))
    return table(spark, sf, "events").select("event_id", items.alias("x")).select("event_id", F.array_join("x", "|").alias("items"), F.size("x").alias("n"))


@query("""WITH s AS (SELECT l_orderkey, coalesce(string_agg(l_returnflag || '/' || CASE WHEN l_linestatus = 'F' THEN '' ELSE l_linestatus END || '/' || l_linenumber, '+' ORDER BY l_returnflag || '/' || CASE WHEN l_linestatus = 'F' THEN '' ELSE l_linestatus END || '/' || l_linenumber), '') AS sets FROM lineitem GROUP BY 1)
SELECT l_orderkey, 'c' || l_orderkey % 3 || '|s|' || sets || '|' || CASE WHEN l_orderkey % 2 = 0 THEN 'MAX+MIN' ELSE 'SET' END AS key FROM s""")
def dedup_keys(spark, sf):
    """What identifies a rule: category, subcategory, sorted sets, sorted parameter names; never values."""
    item = F.struct(F.col("l_returnflag").alias("set_name"), F.when(F.col("l_linestatus") != "F", F.col("l_linestatus")).alias("subset_name"), F.col("l_linenumber").cast("string").alias("element"))
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("sets"))
    names = F.when(F.col("l_orderkey") % 2 == 0, F.array(F.lit("MIN"), F.lit("MAX"))).otherwise(F.array(F.lit("SET")))
    return rows.select("l_orderkey", tx.dedup_key(F.concat(F.lit("c"), (F.col("l_orderkey") % 3).cast("string")), F.lit("s"), F.col("sets"), names).alias("key"))


@query("""SELECT p_partkey, code FROM (SELECT p_partkey, unnest([CASE WHEN p_size % 4 = 0 THEN 'equal_bounds' END, CASE WHEN p_partkey % 5 = 0 THEN 'both_bounds' END, CASE WHEN p_partkey % 7 < 2 THEN 'comma' END, CASE WHEN p_size % 4 = 0 AND p_partkey % 2 = 0 THEN 'bound_on_fixed_value' END,
CASE WHEN p_partkey % 2 = 1 AND p_size % 3 <> 0 THEN 'product_property_on_sidecut' END]) AS code FROM part) WHERE code IS NOT NULL""")
def lint_rules(spark, sf):
    """The five suspicious patterns, each a finding."""
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf, "part").select(
        k.alias("rule_id"), F.when(k % 2 == 0, "BOUND").otherwise("PRODUCT_PROPERTY").alias("kind"), F.when(k % 5 == 0, "下限和上限").otherwise("下限").alias("description"),
        F.when(k % 7 == 0, "a,b").when(k % 7 == 1, "a，b").otherwise("a").alias("element"), size.cast("string").alias("low"), (size + size % 4).cast("string").alias("high"), (size % 3 == 0).alias("final_product"),
    )
    return ex.lint(rows).select(F.col("rule_id").alias("p_partkey"), "code")
