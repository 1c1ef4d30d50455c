"""JSON rule files, fingerprints, inventories, and sinks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Source priorities and the formats that each takes; formats of several belong to the first unless the file is known to be of another kind.
TIERS = [("P1", ["xlsx", "xls", "csv", "tsv"]), ("P2", ["docx", "pdf", "md"]), ("P3", ["docx", "pdf", "md", "txt"]), ("P4", ["docx", "pdf", "md", "json"]), ("P5", ["docx", "pdf", "md", "txt"])]
#: The priority of control and reference files, which are never a source.
CONTROL = "R0"


def _listed(text: Column) -> Column:
    """The rules of a file's text: an array, or an object with `rules`; each as JSON text."""
    return F.from_json(F.when(F.ltrim(text).startswith("{"), F.get_json_object(text, "$.rules")).otherwise(text), "array<string>")


def _texts(spark: SparkSession, path: str, exclude: list[str] | None, exclude_dirs: list[str] | None, recursive: bool) -> DataFrame:
    reader = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", str(recursive).lower())
    rows = reader.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), "value")
    if exclude:
        rows = rows.filter(~F.col("file").isin(exclude))
    if exclude_dirs:
        folders = F.transform(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), F.url_decode)
        rows = rows.filter(~F.arrays_overlap(folders, F.array(*[F.lit(d) for d in exclude_dirs])))
    return rows


def json_rules(spark: SparkSession, path: str, exclude: list[str] | None = None, recursive: bool = True, exclude_dirs: list[str] | None = None) -> DataFrame:
    """file, ordinal, doc: the rules of JSON files that hold an array, or an object with `rules`, each as JSON text.

    Files of the names in exclude, and those below folders of the names in exclude_dirs, are passed over. Files are taken as text,
    so keys that no schema knows are still there. What is no such file has no rules: broken_files() tells them.
    """
    rows = _texts(spark, path, exclude, exclude_dirs, recursive)
    return rows.select("file", F.posexplode(_listed(F.col("value"))).alias("ordinal", "doc"))


def broken_files(spark: SparkSession, path: str, exclude: list[str] | None = None, recursive: bool = True, exclude_dirs: list[str] | None = None) -> DataFrame:
    """file, reason of JSON files without an array or an object with `rules`."""
    kind = F.schema_of_variant(F.try_parse_json("value"))
    listed = F.when(kind.startswith("OBJECT"), F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), "$.rules", "variant"))).otherwise(kind)
    reason = F.when(kind.isNull(), "invalid JSON").when(~F.coalesce(listed.startswith("ARRAY"), F.lit(False)), "top-level JSON must be an array")
    return _texts(spark, path, exclude, exclude_dirs, recursive).select("file", reason.alias("reason")).filter("reason IS NOT NULL")


def catalog_files(spark: SparkSession, path: str, catalog: DataFrame) -> DataFrame:
    """big_category, big_order, name, text of each file that the catalog (big_category, big_order, name) asks for; text is null where there is none."""
    texts = _texts(spark, path, None, None, False).select(F.url_decode(F.regexp_extract("path", "([^/]*)$", 1)).alias("_name"), F.col("value").alias("text"))
    return catalog.join(texts, F.col("name") == F.col("_name"), "left").select("big_category", "big_order", "name", "text")


def rules_of(files: DataFrame) -> DataFrame:
    """big_category, big_order, ordinal, doc of the rules in files that hold an array; items that aren't objects too."""
    items = F.try_variant_get(F.try_parse_json("text"), "$", "array<variant>")
    rows = files.select("big_category", "big_order", "text", F.posexplode(items).alias("ordinal", "v"))
    # a rule's own text keeps the order of its keys
    own = F.expr("get_json_object(text, concat('$[', ordinal, ']'))")
    return rows.select("big_category", "big_order", F.col("ordinal").cast("long").alias("ordinal"), F.when(F.schema_of_variant("v").startswith("OBJECT"), own).otherwise(F.to_json("v")).alias("doc"))


def audit_records(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, doc of the audit records of a manifest (a JSON object)."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.posexplode(F.from_json(F.get_json_object("value", "$.audit_records"), "array<string>")).alias("ordinal", "doc"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def inventory(spark: SparkSession, path: str, control: list[str] | None = None) -> DataFrame:
    """path, name, extension, priorities, priority, bytes, modified of each file below path; contents aren't read.

    priorities are all that take the file's format, priority the first of them; files whose name holds one of the words in
    control are control files; a format that none takes has no priority.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    named = files.withColumn("name", F.url_decode(F.element_at(F.split("path", "/"), -1))).withColumn("extension", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))
    takes = F.array_compact(F.array(*[F.when(F.col("extension").isin(formats), F.lit(p)) for p, formats in TIERS]))
    steers = F.lit(False)
    for word in control or []:
        steers = steers | F.col("name").contains(word)
    priorities = F.when(steers, F.array(F.lit(CONTROL))).otherwise(takes)
    return named.select("path", "name", "extension", priorities.alias("priorities"), F.get(priorities, F.lit(0)).alias("priority"), "bytes", "modified")


def write_partitioned(rules: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """JSON lines in a folder for each value of keys; only folders that rules has values for are replaced. Gives keys, count, status of them."""
    rules.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).json(path)
    return rules.groupBy(*keys).agg(F.count("*").alias("count")).withColumn("status", F.lit("ready"))


def statuses(written: DataFrame, catalog: DataFrame, keys: list[str]) -> DataFrame:
    """The catalog's keys with count and status: ready, or pending where there are no rules."""
    return catalog.select(*keys).join(written.select(*keys, "count"), keys, "left").select(*keys, F.coalesce("count", F.lit(0)).alias("count"), F.when(F.col("count") > 0, "ready").otherwise("pending").alias("status"))


def write_json(spark: SparkSession, path: str, value) -> None:
    """A bounded value as one pretty JSON file, its text unescaped, by whatever file system Spark reaches."""
    _put(spark, path, (json.dumps(value, ensure_ascii=False, indent=2) + "\n").encode())


def write_rules(rules: DataFrame, path: str, meta: dict, order: list[str], most: int = 200_000) -> None:
    """`{meta, rules}` as one pretty JSON file; rules has doc (JSON text). An error beyond so many rules: write_partitioned() takes those."""
    rows = rules.orderBy(*order).select("doc").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules for one file")
    write_json(rules.sparkSession, path, {"meta": meta | {"rule_count": len(rows)}, "rules": [json.loads(r.doc) for r in rows]})


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def index_of(rules: DataFrame, category: str, subcategory: str) -> DataFrame:
    """Counts by category and subcategory, and of the category as a whole (subcategory null)."""
    return rules.rollup(category, subcategory).agg(F.count("*").alias("rules")).filter(F.col(category).isNotNull())


def export_rows(rules: DataFrame, audit: DataFrame, rule_id: str, canonical: list[str], audit_columns: list[str], ordinal: Column) -> DataFrame:
    """The export's columns: those of the rule, and of its last audit record, blank where there is none."""
    last = audit.groupBy(rule_id).agg(F.max_by(F.struct(*audit_columns), ordinal).alias("a"))
    text = lambda c: F.coalesce(F.col(f"a.{c}").cast("string"), F.lit("")).alias(c)
    return rules.join(last, rule_id, "left").select(*canonical, *[text(c) for c in audit_columns])


def write_csv_by(rows: DataFrame, path: str, key: str) -> None:
    rows.write.mode("overwrite").partitionBy(key).option("header", True).csv(path)


def json_lines(rows: DataFrame) -> list[str]:
    """Rows of a bounded report as JSON texts, for printing."""
    return [json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str) for r in rows.collect()]


def markdown_table(rows: DataFrame, columns: list[str]) -> str:
    """A bounded report (an aggregate) as a Markdown table."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    body = ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows.select(*columns).collect()]
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *body]) + "\n"
