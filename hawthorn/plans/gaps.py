"""Coverage and gap queries. Brands stand for target groups, the parts sold by them for rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.coverage import audited, gaps, with_counts
from .registry import query, table

KINDS = "CASE k % 7 WHEN 0 THEN 'exact' WHEN 1 THEN 'advisory_exact' WHEN 2 THEN 'approx' WHEN 3 THEN 'interval' WHEN 4 THEN 'approx_interval' WHEN 5 THEN 'unspecified' ELSE 'other' END"
TARGETS = f"SELECT p_brand, k, {KINDS} AS kind, (60 + k * 3)::BIGINT AS value, (50 + k * 2)::BIGINT AS low, (90 + k * 2)::BIGINT AS high FROM (SELECT DISTINCT p_brand, regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT AS k FROM part)"
COUNTED = f"WITH t AS ({TARGETS}), c AS (SELECT p_brand, count(DISTINCT p_partkey) AS n FROM part WHERE p_size > 10 GROUP BY 1), g AS (SELECT t.*, coalesce(n, 0)::BIGINT AS n FROM t LEFT JOIN c USING (p_brand))"


def _gaps(spark, sf):
    part = table(spark, sf, "part")
    k = F.regexp_extract("p_brand", r"(\d+)", 1).cast("long")
    kind = F.when(k % 7 == 0, "exact").when(k % 7 == 1, "advisory_exact").when(k % 7 == 2, "approx").when(k % 7 == 3, "interval").when(k % 7 == 4, "approx_interval").when(k % 7 == 5, "unspecified").otherwise("other")
    targets = part.select("p_brand").distinct().select("p_brand", kind.alias("kind"), (k * 3 + 60).alias("value"), (k * 2 + 50).alias("low"), (k * 2 + 90).alias("high"))
    return gaps(with_counts(targets, part.filter("p_size > 10").select("p_brand", "p_partkey"), "p_brand", "p_partkey"))


@query(COUNTED + """ SELECT p_brand, kind, n, greatest(value - n, 0) AS remaining, kind = 'exact' AND n >= value AS closed, n < value AS supplement FROM g WHERE kind IN ('exact', 'advisory_exact', 'approx')""")
def gap_exact(spark, sf):
    """Targets of one number: what remains, whether it is closed, whether supplements are needed."""
    return _gaps(spark, sf).filter("remaining IS NOT NULL").select("p_brand", "kind", "n", "remaining", "closed", "supplement")


@query(COUNTED + """ SELECT p_brand, kind, n, greatest(low - n, 0) AS remaining_low, greatest(high - n, 0) AS remaining_high, n < low AS supplement FROM g WHERE kind IN ('interval', 'approx_interval')""")
def gap_interval(spark, sf):
    return _gaps(spark, sf).filter("remaining_low IS NOT NULL").select("p_brand", "kind", "n", "remaining_low", "remaining_high", "supplement")


@query("""WITH n AS (SELECT p_type, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1) SELECT p_type, n, 300 - n AS difference, n >= 300 AS control_reached FROM n""")
def gap_category(spark, sf):
    """A category's distance to its control line; it may be negative."""
    n = table(spark, sf, "part").groupBy("p_type").agg(F.countDistinct("p_partkey").alias("n"))
    return n.select("p_type", "n", (F.lit(300) - F.col("n")).alias("difference"), (F.col("n") >= 300).alias("control_reached"))


@query(COUNTED + """ SELECT p_brand, CASE WHEN kind IN ('exact', 'advisory_exact', 'approx') THEN n < value WHEN kind IN ('interval', 'approx_interval') THEN n < low WHEN kind = 'unspecified' THEN n = 0 ELSE true END AS needed FROM g""")
def supplement_needed(spark, sf):
    """Whether a group is open for supplements, for every kind of target."""
    return _gaps(spark, sf).select("p_brand", F.col("supplement").alias("needed"))


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def unassigned_ids(spark, sf):
    """Distinct rules without a target group."""
    return table(spark, sf, "documents").select("doc_id").distinct().join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("""WITH a AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN NULL WHEN quality = 1 THEN 'PASS' WHEN toxic = 0 THEN 'REVIEW' ELSE 'FAIL' END AS status FROM labels)
SELECT a.doc_id, status FROM a WHERE (status IS NULL OR status IN ('PASS', 'REVIEW')) AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def audit_filter(spark, sf):
    """Audit records of emitted rules that didn't fail; no status counts as passed."""
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(None).cast("string")).when(F.col("quality") == 1, "PASS").when(F.col("toxic") == 0, "REVIEW").otherwise("FAIL")
    audit = table(spark, sf, "labels").select("doc_id", status.alias("validation_status"))
    return audited(audit, table(spark, sf, "documents").filter("lang = 'en'"), "doc_id").select("doc_id", F.col("validation_status").alias("status"))


@query("""SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)""")
def coverage_slots(spark, sf):
    """Entities of the roster without a rule."""
    covered = table(spark, sf, "supplier").filter("s_acctbal > 8000").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, sf, "nation").join(covered, "n_nationkey", "left_anti").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("""SELECT n_name, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000) THEN 'emitted' WHEN n_regionkey = 2 THEN 'missing' ELSE 'pending' END AS status FROM nation""")
def coverage_status(spark, sf):
    """emitted with any audited rule, missing if declared so, else pending."""
    covered = table(spark, sf, "supplier").filter("s_acctbal > 8000").select(F.col("s_nationkey").alias("k")).distinct()
    n = table(spark, sf, "nation").join(covered, F.col("n_nationkey") == F.col("k"), "left")
    return n.select("n_name", F.when(F.col("k").isNotNull(), "emitted").when(F.col("n_regionkey") == 2, "missing").otherwise("pending").alias("status"))


@query("""SELECT l_orderkey, l_linenumber, count(DISTINCT l_suppkey) AS users FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) > 1""")
def dedup_conflict(spark, sf):
    """One identity used by several rules."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.countDistinct("l_suppkey").alias("users")).filter("users > 1")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN count(DISTINCT l_quantity) = 1 THEN 'duplicate' ELSE 'conflict' END AS verdict FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def dup_evidence(spark, sf):
    """Repeated keys: duplicates where the values agree, conflicts where they don't."""
    g = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))
    return g.filter("n > 1").select("l_orderkey", "l_linenumber", F.when(F.col("low") == F.col("high"), "duplicate").otherwise("conflict").alias("verdict"))


@query("""SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / nullif(sum(l_quantity), 0), 4) AS by_mass, round(sum(l_tax * l_discount) / nullif(sum(l_discount), 0), 6) AS by_volume FROM lineitem GROUP BY 1""")
def wavg_mix(spark, sf):
    """Properties of a mix: each with the weight that suits it."""
    mean = lambda w, x, d: F.round(F.sum(F.col(w) * F.col(x)) / F.nullif(F.sum(w), F.lit(0.0)), d)
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(mean("l_quantity", "l_extendedprice", 4).alias("by_mass"), mean("l_discount", "l_tax", 6).alias("by_volume"))
