"""Dashboard figures over the rule store. Orders stand for rules (F archived, P draft, O published)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query, table


@query("""SELECT count(*) FILTER (o_orderstatus <> 'F') AS active, count(*) FILTER (o_orderstatus = 'P') AS draft, count(*) FILTER (o_orderstatus = 'F') AS archived FROM orders""")
def dash_summary(spark, sf):
    """Conditional sums in one pass; zeros on an empty table."""
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").agg(F.count_if(s != "F").alias("active"), F.count_if(s == "P").alias("draft"), F.count_if(s == "F").alias("archived"))


@query("""SELECT count(DISTINCT o_custkey) AS sources FROM orders WHERE o_orderstatus <> 'F'""")
def dash_sources(spark, sf):
    """Distinct sources over active rules."""
    return table(spark, sf, "orders").filter("o_orderstatus <> 'F'").agg(F.countDistinct("o_custkey").alias("sources"))


@query("""WITH c AS (SELECT n_nationkey, n_name, count(s_suppkey) AS rules FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 8000 GROUP BY 1, 2),
t AS (SELECT sum(rules) AS total FROM c)
SELECT n_nationkey, n_name, rules, CASE WHEN total > 0 THEN round(rules / total * 100, 1) ELSE 0.0 END AS pct FROM c, t""")
def dash_categories(spark, sf):
    """Rules of each category, those without any included, and their share: the predicate stands in the join."""
    strong = table(spark, sf, "supplier").filter("s_acctbal > 8000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    counts = table(spark, sf, "nation").join(strong, F.col("n_nationkey") == F.col("k"), "left").select("n_nationkey", "n_name", F.coalesce("n", F.lit(0)).cast("long").alias("rules"))
    # the total over the few categories' counts, not over the rules again
    total = F.sum("rules").over(Window.partitionBy(F.lit(0)))
    return counts.select("n_nationkey", "n_name", "rules", F.when(total > 0, F.round(F.col("rules") / total * 100, 1)).otherwise(0.0).alias("pct"))


@query("""SELECT p_type AS subtype, count(*) AS rules FROM part GROUP BY 1 ORDER BY rules DESC, subtype LIMIT 8""")
def dash_top8(spark, sf):
    """The eight most frequent subtypes."""
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("subtype")).agg(F.count("*").alias("rules")).orderBy(F.desc("rules"), "subtype").limit(8)


@query("""SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5""")
def dash_recent(spark, sf):
    """The five latest rules, archived ones included."""
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(5)


@query("""SELECT event_type AS record_type, count(*) AS n FROM events GROUP BY 1""")
def record_type_counts(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("record_type")).agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT n_regionkey, n_nationkey, count(s_suppkey) AS rules FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1, 2)
SELECT r_name, count(*) AS subcategories, sum(rules)::BIGINT AS rules FROM region JOIN n ON r_regionkey = n_regionkey GROUP BY 1""")
def rollup_index(spark, sf):
    """Rules by subcategory summed up to the category."""
    n = table(spark, sf, "nation").join(table(spark, sf, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_regionkey", "n_nationkey").agg(F.count("s_suppkey").alias("rules"))
    return table(spark, sf, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").agg(F.count("*").alias("subcategories"), F.sum("rules").alias("rules"))


@query("""SELECT user_id % 5 AS category, count(*) FILTER (event_type = 'view') AS "view", count(*) FILTER (event_type = 'click') AS click,
count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup FROM events GROUP BY 1""")
def status_pivot(spark, sf):
    """Counts by status in fixed columns, one row for each category."""
    kinds = ["view", "click", "purchase", "signup"]
    wide = table(spark, sf, "events").withColumn("category", F.col("user_id") % 5).groupBy("category").pivot("event_type", kinds).agg(F.count(F.lit(1)))
    return wide.select("category", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in kinds])


@query("""SELECT count(*) FILTER (toxic = 1) AS errors, count(*) FILTER (quality = 0) AS warnings, count(*) FILTER (toxic = 1) = 0 AS valid FROM labels""")
def severity_counts(spark, sf):
    errors = F.count_if(F.col("toxic") == 1)
    return table(spark, sf, "labels").agg(errors.alias("errors"), F.count_if(F.col("quality") == 0).alias("warnings"), (errors == 0).alias("valid"))


@query("""WITH x AS (SELECT p_type, p_brand, l_orderkey, l_suppkey, unnest([l_returnflag, l_linestatus]) AS field FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT p_brand AS category, p_type AS subcategory, (count(*) // 2)::BIGINT AS rules, count(DISTINCT l_orderkey) AS documents, count(DISTINCT l_suppkey) AS subjects, count(DISTINCT field) AS field_count
FROM x GROUP BY 1, 2 ORDER BY rules DESC, field_count DESC, category, subcategory LIMIT 20""")
def richness(spark, sf):
    """Subcategories by number of rules: distinct documents, subjects and field names; the first 20."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("category"), F.col("p_type").alias("subcategory"), "l_orderkey", "l_suppkey", F.array("l_returnflag", "l_linestatus").alias("fields")
    )
    keys = ["category", "subcategory"]
    # field names are a small vocabulary: sets of them ride along with the counts, in one pass
    out = rows.groupBy(*keys).agg(F.count("*").alias("rules"), F.countDistinct("l_orderkey").alias("documents"), F.countDistinct("l_suppkey").alias("subjects"), F.collect_set("fields").alias("names"))
    out = out.withColumn("field_count", F.size(F.array_distinct(F.flatten("names"))).cast("long"))
    return out.select(*keys, "rules", "documents", "subjects", "field_count").orderBy(F.desc("rules"), F.desc("field_count"), *keys).limit(20)
