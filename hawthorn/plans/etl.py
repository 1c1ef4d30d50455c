"""Extraction ETL: unpivots, splits, taxonomies, bounds, reconciliation of two sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from .registry import query, table


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, measure, val FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_tax, CASE WHEN l_quantity > 25 THEN l_quantity END AS l_quantity FROM lineitem) UNPIVOT (val FOR measure IN (l_discount, l_tax, l_quantity))""")
def melt_measures(spark, sf):
    """Wide to long, nulls left out."""
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf, "lineitem").select(*ids, "l_discount", "l_tax", F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("l_quantity"))
    return rows.unpivot(ids, ["l_discount", "l_tax", "l_quantity"], "measure", "val").filter("val IS NOT NULL")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ((l_quantity > 25)::INT + (l_discount > 0.05)::INT + (l_tax > 0.04)::INT)::INT AS indicators FROM lineitem WHERE (l_quantity > 25)::INT + (l_discount > 0.05)::INT + (l_tax > 0.04)::INT >= 2""")
def map_density(spark, sf):
    """Rows with at least two numeric indicators in their map."""
    m = F.map_filter(
        F.create_map(
            F.lit("q"), F.when(F.col("l_quantity") > 25, F.col("l_quantity")), F.lit("d"), F.when(F.col("l_discount") > 0.05, F.col("l_discount")), F.lit("t"), F.when(F.col("l_tax") > 0.04, F.col("l_tax"))
        ),
        lambda k, v: v.isNotNull(),
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.size(m).alias("indicators")).filter("indicators >= 2")


@query("""SELECT p_partkey, CASE WHEN contains(p_name, 'red') OR contains(p_name, 'hot') THEN 'warm' WHEN contains(p_name, 'blue') THEN 'cold' WHEN contains(p_name, 'small') THEN 'size' WHEN contains(p_type, 'ECONOMY') THEN 'cheap' ELSE 'other' END AS subcategory FROM part""")
def taxonomy_case(spark, sf):
    """An ordered taxonomy by words contained; the first that fits."""
    name = tx.first_case(F.col("p_name"), [(["red", "hot"], "warm"), (["blue"], "cold"), (["small"], "size")], "")
    return table(spark, sf, "part").select("p_partkey", F.when(name != "", name).when(F.col("p_type").contains("ECONOMY"), "cheap").otherwise("other").alias("subcategory"))


@query("""SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part""")
def split_explode(spark, sf):
    """A delimited cell to rows."""
    return table(spark, sf, "part").select("p_partkey", F.explode(F.split(F.trim("p_name"), r"[、，,\s]+")).alias("token"))


@query("""SELECT p_partkey, 'MIN' AS kind, (p_size - 5)::INT AS bound FROM part WHERE p_size > 5 UNION ALL SELECT p_partkey, 'MAX', (p_size + 5)::INT FROM part""")
def bounds_split(spark, sf):
    """A pair of bounds to a rule each; a lower bound only where there is one."""
    pair = F.array(F.struct(F.lit("MIN").alias("kind"), F.when(F.col("p_size") > 5, F.col("p_size") - 5).alias("bound")), F.struct(F.lit("MAX").alias("kind"), (F.col("p_size") + 5).alias("bound")))
    return table(spark, sf, "part").select("p_partkey", F.explode(F.filter(pair, lambda x: x["bound"].isNotNull())).alias("b")).select("p_partkey", "b.kind", "b.bound")


@query("""WITH a AS (SELECT s_suppkey AS k, round(s_acctbal / 100)::BIGINT AS v FROM supplier WHERE s_suppkey % 4 <> 0), b AS (SELECT l_suppkey AS k, max(l_quantity)::BIGINT AS v FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, a.v AS first, b.v AS second, CASE WHEN a.k IS NULL THEN 'second_only' WHEN b.k IS NULL THEN 'first_only' WHEN a.v = b.v THEN 'agree' ELSE 'disagree' END AS verdict
FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(a.k, b.k) NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def reconcile_two_sources(spark, sf):
    """Two sources on one key, without the excluded ones; where they overlap they must agree."""
    s = table(spark, sf, "supplier")
    a = s.filter("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("k"), F.round(F.col("s_acctbal") / 100).cast("long").alias("first"))
    b = table(spark, sf, "lineitem").filter("l_suppkey % 5 <> 0").groupBy(F.col("l_suppkey").alias("k2")).agg(F.max("l_quantity").cast("long").alias("second"))
    both = a.join(b, F.col("k") == F.col("k2"), "full_outer")
    verdict = F.when(F.col("k").isNull(), "second_only").when(F.col("k2").isNull(), "first_only").when(F.col("first") == F.col("second"), "agree").otherwise("disagree")
    out = both.select(F.coalesce("k", "k2").alias("k"), "first", "second", verdict.alias("verdict"))
    return out.join(s.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("k")), "k", "left_anti")


@query("""SELECT page_id, md5(trim(regexp_replace(html, '<[^>]+>', '', 'g'))) AS digest FROM pages""")
def html_strip(spark, sf):
    """Text without tags."""
    return table(spark, sf, "pages").select("page_id", F.md5(F.trim(F.regexp_replace("html", "<[^>]+>", "")).cast("binary")).alias("digest"))


@query("""WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '1,' || lpad((event_id % 1000)::VARCHAR, 3, '0') WHEN 1 THEN '—' WHEN 2 THEN '' WHEN 3 THEN ' 0 ' ELSE (event_id % 100)::VARCHAR || '.5' END AS cell, value FROM events)
SELECT event_id, try_cast(replace(trim(cell), ',', '') AS DOUBLE) AS num, round(value * coalesce(try_cast(replace(trim(cell), ',', '') AS DOUBLE), 0), 4) AS bound FROM t""")
def clean_number(spark, sf):
    """Numbers from cells: commas go, dashes and blanks are null, zero stays zero; a derived bound."""
    e = F.col("event_id")
    cell = (
        F.when(e % 5 == 0, F.concat(F.lit("1,"), F.lpad((e % 1000).cast("string"), 3, "0"))).when(e % 5 == 1, "—").when(e % 5 == 2, "").when(e % 5 == 3, " 0 ")
        .otherwise(F.concat((e % 100).cast("string"), F.lit(".5")))
    )
    return table(spark, sf, "events").select("event_id", "value", tx.number(cell).alias("num")).select("event_id", "num", F.round(F.col("value") * F.coalesce("num", F.lit(0.0)), 4).alias("bound"))


@query("""SELECT s_suppkey, sum(l_quantity) > 13000 AND s_acctbal < 3000 AS withheld, CASE WHEN starts_with(s_name, 'Supplier#00000000') AND s_nationkey < 10 THEN 'prefix' WHEN max(l_quantity) > 49 AND s_acctbal < 3000 THEN 'height' WHEN max(l_tax) < 0.08 THEN 'disagrees' END AS reason
FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey, s_acctbal, s_name, s_nationkey""")
def withhold_case(spark, sf):
    """An ordered ladder of reasons to withhold an upper bound; none: it is emitted."""
    b = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("total"), F.max("l_quantity").alias("high"), F.max("l_tax").alias("tax"))
    low = F.col("s_acctbal") < 3000
    reason = F.when(F.startswith("s_name", F.lit("Supplier#00000000")) & (F.col("s_nationkey") < 10), "prefix").when((F.col("high") > 49) & low, "height").when(F.col("tax") < 0.08, "disagrees")
    return table(spark, sf, "supplier").join(b, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", ((F.col("total") > 13000) & low).alias("withheld"), reason.alias("reason"))


@query("""SELECT c_custkey, concat_ws('；', c_name, CASE WHEN c_acctbal > 0 THEN '余额' || c_mktsegment END, CASE WHEN c_nationkey % 2 = 0 THEN 'N' || c_nationkey END) AS description FROM customer""")
def concat_optional(spark, sf):
    """A description of the fragments there are."""
    return table(spark, sf, "customer").select(
        "c_custkey",
        tx.join_present("；", F.col("c_name"), F.when(F.col("c_acctbal") > 0, F.concat(F.lit("余额"), "c_mktsegment")), F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))).alias("description"),
    )


@query("""SELECT p_partkey, p_name FROM part WHERE NOT starts_with(p_name, 'small') AND NOT contains(p_name, 'hot') AND NOT contains(p_name, 'gear') AND regexp_matches(p_size::VARCHAR, '^[0-9]+$')""")
def junk_rows(spark, sf):
    """Without footers, pending or unknown rows, and rows whose bound isn't a number."""
    n = F.col("p_name")
    return table(spark, sf, "part").filter(~n.startswith("small") & ~n.contains("hot") & ~n.contains("gear") & tx.integer(F.col("p_size").cast("string")).isNotNull()).select("p_partkey", "p_name")


@query("""SELECT s_suppkey, upper(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) AS suffix, regexp_replace(s_name, '^Supplier#0*', '') AS tank FROM supplier""")
def id_suffix(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", tx.id_suffix(F.col("s_name")).alias("suffix"), F.regexp_replace("s_name", "^Supplier#0*", "").alias("tank"))


@query("""SELECT p_partkey, format('{:.6g}', p_retailprice) AS num FROM part""")
def num_text_g(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.general_number(F.col("p_retailprice")).alias("num"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_quantity * l_discount * 10000 + 0.5) / 10000 AS by_level, floor(l_extendedprice * l_tax * 100 + 0.5) / 100 AS by_load FROM lineitem WHERE l_discount IS NOT NULL AND l_discount <> 0 AND l_tax <> 0""")
def derived_formulas(spark, sf):
    """Level times factor and load times factor; blank or zero isn't a factor."""
    rows = table(spark, sf, "lineitem").filter("l_discount <> 0 AND l_tax <> 0")
    half_up = lambda a, b, unit: F.floor(F.col(a) * F.col(b) * unit + 0.5) / unit
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", half_up("l_quantity", "l_discount", 10000).alias("by_level"), half_up("l_extendedprice", "l_tax", 100).alias("by_load"))


@query("""SELECT p_partkey, 'p_brand' AS name, p_brand AS val FROM part UNION ALL SELECT p_partkey, 'p_size', p_size::VARCHAR FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey, 'p_type', p_type FROM part""")
def params_from_object(spark, sf):
    """An object's scalar fields as named parameters; missing ones are dropped."""
    m = F.create_map(F.lit("p_brand"), F.col("p_brand"), F.lit("p_size"), F.when(F.col("p_size") > 10, F.col("p_size").cast("string")), F.lit("p_type"), F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", F.explode(F.map_filter(m, lambda k, v: v.isNotNull())).alias("name", "val"))


@query("""SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'light' WHEN 'SMALL' THEN 'light' WHEN 'LARGE' THEN 'heavy' END AS class FROM part WHERE p_type IN ('ECONOMY', 'SMALL', 'LARGE')""")
def class_scope(spark, sf):
    """Entities mapped to their class; those without one are rejected."""
    m = spark.createDataFrame([("ECONOMY", "light"), ("SMALL", "light"), ("LARGE", "heavy")], "p_type string, class string")
    return table(spark, sf, "part").join(F.broadcast(m), "p_type").select("p_partkey", "class")


@query("""SELECT r_regionkey, json_object('name', r_name, 'note', NULL)::VARCHAR AS doc FROM region""")
def serialize_row(spark, sf):
    """A row as JSON, nulls kept."""
    return table(spark, sf, "region").select("r_regionkey", F.to_json(F.struct(F.col("r_name").alias("name"), F.lit(None).cast("string").alias("note")), {"ignoreNullFields": "false"}).alias("doc"))
