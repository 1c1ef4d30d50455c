"""Import diffs, upserts, transitions and order-dependent rules, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.diff import classify, keep_first
from ..sources.files import export_rows
from .registry import query, table


@query("""WITH o AS (SELECT o_orderkey, md5(o_orderpriority || o_orderstatus) AS h, o_orderstatus = 'F' AS gone FROM orders WHERE o_orderkey % 3 <> 0),
n AS (SELECT o_orderkey, md5(o_orderpriority || CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE o_orderstatus END) AS h FROM orders WHERE o_orderkey % 5 <> 0)
SELECT n.o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN gone THEN 'archived_conflict' WHEN n.h = o.h THEN 'unchanged' ELSE 'update' END AS action FROM n LEFT JOIN o USING (o_orderkey)""")
def import_diff(spark, sf):
    """Each row of a new snapshot against those stored: insert, update, unchanged or in conflict with an archived one."""
    rows = table(spark, sf, "orders")
    digest = lambda s: F.md5(F.concat("o_orderpriority", s).cast("binary")).alias("content_hash")
    old = rows.filter("o_orderkey % 3 <> 0").select("o_orderkey", digest(F.col("o_orderstatus")), (F.col("o_orderstatus") == "F").alias("archived"))
    new = rows.filter("o_orderkey % 5 <> 0").select("o_orderkey", digest(F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(F.col("o_orderstatus"))))
    return classify(new, old, "o_orderkey", archived="archived").select("o_orderkey", "action")


@query("""WITH have AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0), asked AS (SELECT DISTINCT c_name FROM customer WHERE c_custkey % 3 = 0),
fresh AS (SELECT c_name FROM asked WHERE c_name NOT IN (SELECT c_name FROM have))
SELECT c_custkey AS id, c_name FROM have UNION ALL SELECT (SELECT max(c_custkey) FROM have) + row_number() OVER (ORDER BY c_name), c_name FROM fresh""")
def doc_upsert(spark, sf):
    """Documents by natural key: those that are there keep their ids, new ones get the next, in order of name.

    Numbers come from the new rows' ranks; those are the few names that a batch adds.
    """
    rows = table(spark, sf, "customer")
    have = rows.filter("c_custkey % 2 = 0").select("c_custkey", "c_name")
    fresh = rows.filter("c_custkey % 3 = 0").select("c_name").distinct().join(have.select("c_name"), "c_name", "left_anti")
    top = have.agg(F.max("c_custkey")).scalar()
    new = fresh.select((F.row_number().over(Window.orderBy("c_name")) + top).alias("id"), "c_name")
    return have.select(F.col("c_custkey").alias("id"), "c_name").unionByName(new)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'F' ELSE 'F' END ELSE CASE o_orderstatus WHEN 'F' THEN 'O' ELSE o_orderstatus END END AS status,
(1 + CASE WHEN (o_orderkey % 2 = 0) = (o_orderstatus = 'F') THEN 0 ELSE 1 END)::INT AS version,
CASE WHEN (o_orderkey % 2 = 0) = (o_orderstatus = 'F') THEN NULL WHEN o_orderkey % 2 = 0 THEN 'archive' ELSE 'restore' END AS action FROM orders""")
def state_transition(spark, sf):
    """Archive even rules, restore odd ones: nothing where the state is so already, restored ones are published."""
    flag, gone = F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus") == "F"
    change = flag != gone
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(flag, "F").when(gone, "O").otherwise(F.col("o_orderstatus")).alias("status"),
        (F.lit(1) + change.cast("int")).alias("version"), F.when(change, F.when(flag, "archive").otherwise("restore")).alias("action"),
    )


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1""")
def keep_first_order(spark, sf):
    """The first row of each key in input order."""
    return keep_first(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS section FROM events""")
def ffill_section(spark, sf):
    """Forward fill: a marker row sets the section of those after it, within each sheet."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "events").select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("section"))


@query("""WITH r AS (SELECT l_orderkey, CASE WHEN l_orderkey % 5 = 0 THEN 8 - l_linenumber ELSE l_linenumber END AS seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem)
SELECT l_orderkey, bool_and(seq = k) AS contiguous, count(*) AS n FROM r GROUP BY 1""")
def seq_contiguity(spark, sf):
    """Whether a sheet's sequence numbers are 1..n in the order of its rows; every fifth sheet numbers them backwards."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    seq = F.when(F.col("l_orderkey") % 5 == 0, 8 - F.col("l_linenumber")).otherwise(F.col("l_linenumber"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", (seq == F.row_number().over(w)).alias("ok"))
    return rows.groupBy("l_orderkey").agg(F.bool_and("ok").alias("contiguous"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT n_regionkey, count(*) AS found FROM nation GROUP BY 1), s AS (SELECT r_name AS sheet, (r_regionkey + 4)::BIGINT AS expected, coalesce(found, 0)::BIGINT AS found FROM region LEFT JOIN c ON r_regionkey = n_regionkey)
SELECT * FROM s WHERE found <> expected UNION ALL SELECT 'total', sum(expected)::BIGINT, sum(found)::BIGINT FROM s HAVING sum(expected) <> sum(found)""")
def expected_counts(spark, sf):
    """Sheets whose number of rows isn't the expected one, and the total where it isn't."""
    c = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    spec = table(spark, sf, "region").select(F.col("r_name").alias("sheet"), "r_regionkey", (F.col("r_regionkey") + 4).cast("long").alias("expected"))
    sheets = spec.join(c, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("sheet", "expected", F.coalesce("n", F.lit(0)).cast("long").alias("found"))
    total = sheets.agg(F.lit("total").alias("sheet"), F.sum("expected").alias("expected"), F.sum("found").alias("found"))
    return sheets.unionByName(total).filter("found <> expected")


@query("""WITH o AS (SELECT 'R-' || (c_custkey % 997) AS rule_no, c_custkey AS row_no, (c_custkey * 7919) % 100003 AS ordinal FROM customer),
f AS (SELECT rule_no, row_no, ordinal, first_value(row_no) OVER w AS first_row, row_number() OVER w AS k FROM o WINDOW w AS (PARTITION BY rule_no ORDER BY ordinal))
SELECT rule_no, row_no, first_row FROM f WHERE k > 1""")
def dup_location(spark, sf):
    """Repeats of a key in row order, each with the row where the key first stands; rows come in an order of their own, not that of their numbers."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(F.concat(F.lit("R-"), (k % 997).cast("string")).alias("rule_no"), k.alias("row_no"), (k * 7919 % 100003).alias("ordinal"))
    first = rows.groupBy(F.col("rule_no").alias("f_no")).agg(F.min(F.struct("ordinal", "row_no")).alias("first"))
    both = rows.join(first, F.col("rule_no") == F.col("f_no")).filter(F.col("ordinal") > F.col("first.ordinal"))
    return both.select("rule_no", "row_no", F.col("first.row_no").alias("first_row"))


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4 AND role IN ('user', 'assistant') AND trim(text) <> ''""")
def last_n_turns(spark, sf):
    """The last four turns of each conversation, sliced before the filter on roles and blanks."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = table(spark, sf, "conversations").withColumn("r", F.row_number().over(w)).filter("r <= 4")
    return rows.filter(F.col("role").isin("user", "assistant") & (F.trim("text") != "")).select("conv_id", "turn", "role")


@query("""SELECT count(*) AS shared FROM (SELECT n_name FROM nation INTERSECT SELECT s_name FROM supplier)""")
def intersect_empty(spark, sf):
    """New ids that exist already: must be none."""
    return table(spark, sf, "nation").select("n_name").intersect(table(spark, sf, "supplier").select(F.col("s_name").alias("n_name"))).agg(F.count("*").alias("shared"))


@query("""SELECT 'nation' AS producer, n_name AS name FROM nation UNION ALL SELECT 'region', r_name FROM region UNION ALL SELECT 'supplier', s_name FROM supplier UNION ALL SELECT 'customer', c_name FROM customer UNION ALL SELECT 'part', p_name FROM part""")
def union_sources(spark, sf):
    """Five producers' rows in one table, columns by name."""
    out = None
    for name, col in (("nation", "n_name"), ("region", "r_name"), ("supplier", "s_name"), ("customer", "c_name"), ("part", "p_name")):
        part = table(spark, sf, name).select(F.lit(name).alias("producer"), F.col(col).alias("name"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT r_regionkey AS ordinal, CASE WHEN r_regionkey IN (1, 3) THEN 'replaced' ELSE r_name END AS name, CASE WHEN r_regionkey IN (1, 3) THEN 0 ELSE length(r_name) END::INT AS n FROM region""")
def stats_replace(spark, sf):
    """An ordered list with two of its rows replaced."""
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("ordinal"), F.col("r_name").alias("name"), F.length("r_name").alias("n"))
    new = r.filter(F.col("ordinal").isin(1, 3)).select("ordinal", F.lit("replaced").alias("name"), F.lit(0).alias("n"))
    return r.filter(~F.col("ordinal").isin(1, 3)).unionByName(new)


@query("""SELECT 'missing' AS side, doc_id FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def manifest_missing(spark, sf):
    """Emitted rules without an audit record."""
    return table(spark, sf, "documents").filter("lang = 'en'").join(table(spark, sf, "labels"), "doc_id", "left_anti").select(F.lit("missing").alias("side"), "doc_id")


@query("""SELECT 'orphan' AS side, doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def manifest_orphan(spark, sf):
    """Audit records without an emitted rule."""
    return table(spark, sf, "labels").join(table(spark, sf, "documents").filter("lang = 'en'"), "doc_id", "left_anti").select(F.lit("orphan").alias("side"), "doc_id")


@query("""WITH a AS (SELECT doc_id, quality, toxic, 0 AS ordinal FROM labels UNION ALL SELECT doc_id, 1 - quality, NULL, 1 FROM labels WHERE doc_id % 3 = 0),
l AS (SELECT doc_id, arg_max({'q': quality, 't': toxic}, ordinal) AS a FROM a GROUP BY 1)
SELECT doc_id, source, coalesce(a.q::VARCHAR, '') AS quality, coalesce(a.t::VARCHAR, '') AS toxic FROM documents LEFT JOIN l USING (doc_id)""")
def export_left_default(spark, sf):
    """Rules with their audit columns, blank where there is no record; of repeated records the last in order counts, whatever its values."""
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    again = labels.filter("doc_id % 3 = 0").select("doc_id", (1 - F.col("quality")).alias("quality"), F.lit(None).cast("int").alias("toxic"))
    audit = labels.withColumn("ordinal", F.lit(0)).unionByName(again.withColumn("ordinal", F.lit(1)))
    return export_rows(table(spark, sf, "documents"), audit, "doc_id", ["doc_id", "source"], ["quality", "toxic"], F.col("ordinal"))


@query("""SELECT l_orderkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END, l_linenumber, l_suppkey, l_partkey, l_quantity) AS r FROM lineitem) WHERE r = 1""")
def authority_pick(spark, sf):
    """Of sources in conflict, the one with the highest authority."""
    rank = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3)
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_linenumber", "l_partkey", rank.alias("rank"))
    return keep_first(rows, ["l_orderkey"], ["rank", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity"]).select("l_orderkey", "l_suppkey", "l_quantity")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 4 <> 1 THEN o_totalprice END AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
SELECT r.o_custkey, o_orderkey, rank, c_mktsegment AS segment, coalesce(score, b.base, 0) AS score FROM r JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT c_custkey AS k, c_acctbal AS base FROM customer WHERE c_nationkey % 3 <> 0) b ON b.k = r.o_custkey WHERE rank <= 5 AND o_orderkey % 3 <> 0 AND c_custkey % 11 <> 0""")
def rerank_join(spark, sf):
    """Top five by the model's order with their candidates: the rank is given before unmatched ones drop, so it may have holes; a score that the model lacks is the heuristic's, or 0."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    score = F.when(F.col("o_orderkey") % 4 != 1, F.col("o_totalprice"))
    r = table(spark, sf, "orders").select("o_custkey", "o_orderkey", score.alias("own"), F.row_number().over(w).cast("long").alias("rank")).filter("rank <= 5").filter("o_orderkey % 3 <> 0")
    customers = table(spark, sf, "customer")
    base = customers.filter("c_nationkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("base"))
    known = r.join(customers.filter("c_custkey % 11 <> 0").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return known.join(base, F.col("o_custkey") == F.col("k"), "left").select("o_custkey", "o_orderkey", "rank", F.col("c_mktsegment").alias("segment"), F.coalesce("own", "base", F.lit(0.0)).alias("score"))
