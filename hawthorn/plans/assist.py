"""Text post-processing: JSON repair, names, chat text, grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from .registry import query, table

WRAPPED = "CASE event_id % 4 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'Result: ' || props || ' as asked' WHEN 2 THEN 'none' ELSE props END"


def repaired(text):
    """The JSON in a text: fences go, else the first widest braces or brackets; null where there is none that parses."""
    plain = tx.strip(F.regexp_replace(text, r"(?m)^\s*```(?:json)?\s*$", ""))
    inner = F.regexp_extract(plain, r"(?s)(\{.*\}|\[.*\])", 1)
    doc = F.when(F.try_parse_json(plain).isNotNull(), plain).otherwise(inner)
    return F.when((doc != "") & F.try_parse_json(doc).isNotNull(), doc)


@query(f"""WITH w AS (SELECT event_id, {WRAPPED} AS raw FROM events), e AS (SELECT event_id, regexp_extract(raw, '(\\{{.*\\}})', 1) AS doc FROM w) SELECT event_id, CASE WHEN doc <> '' AND json_valid(doc) THEN json_extract_string(doc, '$.k')::BIGINT END AS k FROM e""")
def json_repair(spark, sf):
    """Objects out of fenced or surrounding prose."""
    raw = F.expr(WRAPPED.replace("chr(10)", "'\\n'"))
    doc = repaired(raw)
    return table(spark, sf, "events").select("event_id", F.get_json_object(doc, "$.k").cast("long").alias("k"))


@query("""WITH b AS (SELECT * FROM (VALUES (1, 'red'), (2, 'bolt'), (3, 'small ring')) v(i, brand)) SELECT p_partkey, brand FROM (SELECT p_partkey, brand, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS r FROM part JOIN b ON contains(replace(p_name, ' ', ''), replace(brand, ' ', '')) OR contains(replace(brand, ' ', ''), replace(p_name, ' ', ''))) WHERE r = 1""")
def name_match(spark, sf):
    """The first candidate, in list order, whose normal name equals, holds or is held by the row's: a ladder, no join."""
    name = tx.normal_name(F.col("p_name"))
    out = None
    for brand in ("red", "bolt", "small ring"):
        flat = brand.replace(" ", "")
        test = name.contains(flat) | F.contains(F.lit(flat), name)
        out = F.when(test, F.lit(brand)) if out is None else out.when(test, F.lit(brand))
    return table(spark, sf, "part").select("p_partkey", out.alias("brand")).filter("brand IS NOT NULL")


@query("""SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS flat FROM conversations WHERE trim(text) <> '' GROUP BY 1""")
def flatten_nested(spark, sf):
    """A conversation's messages as labelled text, blanks left out."""
    rows = table(spark, sf, "conversations").filter(F.trim("text") != "").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return rows.select("conv_id", F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n\n").alias("flat"))


@query("""SELECT conv_id, turn, md5(trim(text)) AS digest FROM conversations""")
def chat_clean(spark, sf):
    """Chat text without a trailing note and with entities unescaped."""
    noted = F.concat("text", F.lit("\n<small>12 s</small>"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(tx.clean_chat(noted).cast("binary")).alias("digest"))


@query("""SELECT conv_id, turn, CASE WHEN contains(lower(role), 'assist') THEN 'assistant' WHEN contains(lower(role), 'sys') THEN 'system' ELSE 'user' END AS who FROM conversations""")
def provider_norm(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.provider(F.col("role"), [("assist", "assistant"), ("sys", "system")], "user").alias("who"))


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN d.source ELSE '' END AS url FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l USING (doc_id)""")
def grounding(spark, sf):
    """A link is kept only where it is among the search results."""
    known = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("k")).distinct()
    return table(spark, sf, "documents").join(known, F.col("doc_id") == F.col("k"), "left").select("doc_id", F.when(F.col("k").isNotNull(), F.col("source")).otherwise("").alias("url"))


@query("""SELECT DISTINCT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)""")
def grounded_names(spark, sf):
    """A named entity is kept only with known evidence: of an allowed place, and with a source that says so."""
    allowed = table(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("k"))
    said = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("e"))
    named = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return named.join(allowed, F.col("c_nationkey") == F.col("k"), "left_semi").join(said, F.col("o_orderkey") == F.col("e"), "left_semi").select("o_orderkey", "c_name").distinct()
