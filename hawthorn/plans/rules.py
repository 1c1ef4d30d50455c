"""Rule queries: search, pages, lookups, numbering and history."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .registry import query, table

UP, LO = tx.UPPER, tx.LOWER


def clamp(value: int | None, low: int, high: int, default: int) -> int:
    """low..high; the default where none is given."""
    return max(low, min(high, default if value is None else int(value)))


def page_of(df: DataFrame, order: list, page: int, page_size: int | None) -> tuple[DataFrame, dict]:
    """One page and its figures: sizes 5..100 (20 where none is given), pages from 1 to the last."""
    size = clamp(page_size or None, 5, 100, 20)  # a size of 0 is none
    total = df.count()
    pages = max(1, math.ceil(total / size))
    at = max(1, min(pages, page))
    return df.orderBy(*order).offset((at - 1) * size).limit(size), {"total": total, "pages": pages, "page": at, "page_size": size, "previous": max(1, at - 1), "next": min(pages, at + 1)}


def by_status(status: str | None, deleted=None, state=None):
    """archived: deleted; published, draft: not deleted and of that state; anything else: not deleted."""
    deleted = F.col("deleted_at").isNotNull() if deleted is None else deleted
    state = F.col("status") if state is None else state
    if status == "archived":
        return deleted
    if status in ("published", "draft"):
        return ~deleted & (state == status)
    return ~deleted


def by_category(category: str | None, column: str = "category_code"):
    return F.lit(True) if not category or category == "ALL" else F.col(column) == category


@query(f"""SELECT o_orderkey, o_orderpriority, c_name FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus <> 'F' AND (translate(o_orderpriority, '{UP}', '{LO}') LIKE '%urgent%' OR translate(c_name, '{UP}', '{LO}') LIKE '%urgent%' OR translate(c_mktsegment, '{UP}', '{LO}') LIKE '%urgent%')""")
def search_ui(spark, sf):
    """Keyword search over the rule's columns and those of its document."""
    rows = table(spark, sf, "orders").filter("o_orderstatus <> 'F'").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.filter(tx.contains_any([F.col("o_orderpriority"), F.col("c_name"), F.col("c_mktsegment")], " UrGent ")).select("o_orderkey", "o_orderpriority", "c_name")


@query(f"""SELECT p_partkey, p_name, p_brand FROM part WHERE p_size % 7 <> 0 AND p_type = 'ECONOMY' AND (translate(p_name, '{UP}', '{LO}') LIKE '%r_d%' OR translate(p_brand, '{UP}', '{LO}') LIKE '%r_d%') ORDER BY p_partkey LIMIT 200""")
def search_cli(spark, sf):
    """Keyword search over the own columns of active rules of a category, in order of number; wildcards in the keyword are live, limits clamped."""
    active = table(spark, sf, "part").filter("p_size % 7 <> 0").filter(by_category("ECONOMY", "p_type"))
    rows = active.filter(tx.contains_any([F.col("p_name"), F.col("p_brand")], "R_D"))
    return rows.select("p_partkey", "p_name", "p_brand").orderBy("p_partkey").limit(clamp(900, 1, 200, 20))


@query("""SELECT 'all' AS variant, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'archived', count(*) FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'draft', count(*) FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'published', count(*) FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'urgent', count(*) FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT'""")
def search_status(spark, sf):
    """Each status filter, and a category with it; one pass."""
    gone, state = F.col("o_orderstatus") == "F", F.when(F.col("o_orderstatus") == "P", "draft").otherwise("published")
    tests = {s: by_status(s, gone, state) for s in ("all", "archived", "draft", "published")}
    tests["urgent"] = by_status(None, gone, state) & by_category("1-URGENT", "o_orderpriority")
    sums = table(spark, sf, "orders").agg(*[F.count_if(t).alias(k) for k, t in tests.items()])
    return sums.unpivot([], list(tests), "variant", "n")


@query("""SELECT o_orderkey, c_name, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 20 OFFSET 40""")
def page_rules(spark, sf):
    """The third page of twenty, by category, sequence and number."""
    rows = table(spark, sf, "orders").filter("o_orderstatus <> 'F'").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return page_of(rows, ["o_orderpriority", "o_orderdate", "o_orderkey"], 3, None)[0].select("o_orderkey", "c_name", "o_orderpriority")


@query("""WITH t AS (SELECT count(*) AS total FROM orders WHERE o_orderstatus <> 'F'), p AS (SELECT total, greatest(1, ceil(total / 20))::BIGINT AS pages FROM t)
SELECT total, pages, asked, least(greatest(1, asked), pages)::BIGINT AS page, greatest(1, least(greatest(1, asked), pages) - 1)::BIGINT AS previous, least(pages, least(greatest(1, asked), pages) + 1)::BIGINT AS next FROM p, (VALUES (0), (1), (7), (999999)) v(asked)""")
def page_figures(spark, sf):
    """Total, number of pages, and for pages asked for the clamped one, the one before and the one after."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / 20)).cast("long")
    rows = table(spark, sf, "orders").filter("o_orderstatus <> 'F'").agg(F.count("*").alias("total")).select("total", pages.alias("pages"), F.explode(F.array(*[F.lit(x) for x in (0, 1, 7, 999999)])).alias("asked"))
    rows = rows.withColumn("page", F.least(F.greatest(F.lit(1), "asked"), "pages").cast("long"))
    return rows.withColumns({"previous": F.greatest(F.lit(1), F.col("page") - 1).cast("long"), "next": F.least("pages", F.col("page") + 1).cast("long")})


@query("""SELECT o_orderkey, o_orderstatus, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey = 7""")
def rule_lookup(spark, sf):
    """One rule with its document and category; archived ones too."""
    o = table(spark, sf, "orders").filter("o_orderkey = 7")
    return o.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "o_orderstatus", "c_name", "n_name")


@query("""SELECT 'SOP-' || printf('%03d', coalesce(max(regexp_extract(c_name, '^Customer#([0-9]+)$', 1)::INT), 0) + 1) AS next_no FROM customer WHERE regexp_matches(c_name, '^Customer#[0-9]+$')""")
def next_number(spark, sf):
    """The largest suffix plus one, three digits at least, archived rules counted."""
    suffix = F.regexp_extract("c_name", r"^Customer#(\d+)$", 1).try_cast("int")
    return table(spark, sf, "customer").agg(F.format_string("SOP-%03d", F.coalesce(F.max(suffix), F.lit(0)) + 1).alias("next_no"))


@query("""SELECT l_returnflag AS category, (coalesce(max(l_linenumber), 0) + 1)::INT AS next_seq FROM lineitem GROUP BY 1""")
def next_sequence(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("category")).agg((F.coalesce(F.max("l_linenumber"), F.lit(0)) + 1).cast("int").alias("next_seq"))


@query("""SELECT e.event_id, e.event_type, c.c_name FROM events e JOIN customer c ON e.user_id = c.c_custkey ORDER BY e.event_id DESC LIMIT 100""")
def change_history(spark, sf):
    """The latest changes with what they changed; a clamped limit."""
    return table(spark, sf, "events").join(table(spark, sf, "customer"), F.col("user_id") == F.col("c_custkey")).select("event_id", "event_type", "c_name").orderBy(F.desc("event_id")).limit(clamp(500, 1, 100, 20))


@query("""SELECT event_type, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""")
def batch_latest(spark, sf):
    """The latest batch of each kind: a maximum with its row, not a sort of the group."""
    top = table(spark, sf, "events").groupBy("event_type").agg(F.max(F.struct("event_id", "user_id")).alias("top"))
    return top.select("event_type", "top.event_id", "top.user_id")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 3""")
def history_view(spark, sf):
    """The three latest changes of each rule."""
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return table(spark, sf, "events").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("user_id", "event_id", "event_type")


@query("""SELECT o_orderkey, coalesce(CASE o_orderstatus WHEN 'F' THEN '已归档' WHEN 'P' THEN '草稿' END, o_orderstatus) AS label, replace(o_orderpriority, '-', '') AS category,
CASE WHEN o_orderkey % 4 = 0 THEN '约' || o_orderkey WHEN o_orderkey % 4 = 1 THEN o_orderkey || '–' || (o_orderkey + 5) WHEN o_orderkey % 4 = 2 THEN o_orderkey::VARCHAR ELSE '未明确' END AS target FROM orders""")
def label_map(spark, sf):
    """Display labels: known statuses by a dictionary, others as they are; targets in words."""
    labels = F.when(F.col("o_orderstatus") == "F", "已归档").when(F.col("o_orderstatus") == "P", "草稿")
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "approx").when(k % 4 == 1, "interval").when(k % 4 == 2, "exact").otherwise("unspecified")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.coalesce(labels, F.col("o_orderstatus")).alias("label"), F.replace("o_orderpriority", F.lit("-"), F.lit("")).alias("category"), tx.target_display(kind, k, k, k + 5).alias("target")
    )


@query("""SELECT c_custkey, starts_with(c_name, 'Customer#0000') AS ok FROM customer""")
def prefix_check(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", tx.has_prefix(F.col("c_name"), F.lit("Customer#0000")).alias("ok"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events""")
def utc_ts(spark, sf):
    return table(spark, sf, "events").select("event_id", tx.utc_text(F.col("ts")).alias("at"))


@query("""SELECT p_partkey, sha256(to_json([p_name, p_brand, p_type, p_size::VARCHAR])::VARCHAR) AS content_hash FROM part""")
def content_hash_array(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.hash_array([F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")]).alias("content_hash"))


@query("""SELECT c_custkey, sha256(json_object('mktsegment', c_mktsegment, 'name', c_name, 'nation', CASE WHEN c_nationkey = 0 THEN NULL ELSE c_nationkey::VARCHAR END)::VARCHAR) AS rule_hash FROM customer""")
def content_hash_object(spark, sf):
    nation = F.when(F.col("c_nationkey") != 0, F.col("c_nationkey").cast("string"))
    return table(spark, sf, "customer").select("c_custkey", tx.hash_object({"name": F.col("c_name"), "mktsegment": F.col("c_mktsegment"), "nation": nation}).alias("rule_hash"))
