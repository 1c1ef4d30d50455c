"""Validation of four-field rules given as JSON texts, and of the audit records that go with them.

Rules and records are rows, documents their JSON texts; every fault is a row (level, place, message), in the order
in which a reader of the files would meet them (columns step, big_order, ordinal, item, rank).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import DEMO_ELEMENT, DEMO_TEXT, FORBIDDEN_KEYS, MODES, PARAMETER_KEYS, PHASES, PRIORITIES, RULE_KEYS, SET_KEYS

ORDER = ["step", "big_order", "ordinal", "item", "rank"]
#: Names that a message lists at most.
LISTED = 20


def literal(c: Column) -> Column:
    """A text in quotes, as messages show it: single ones unless only those occur in it; None for null."""
    text = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    double = c.contains("'") & ~c.contains('"')
    return F.when(c.isNull(), "None").when(double, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'")))


def listed(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, literal), ", "), F.lit("]"))


def _lit(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, VOID, ... of a variant; null where there is none."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _at(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _text(v: Column) -> Column:
    """The text of a variant that is one, else null."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _shown(v: Column) -> Column:
    """A variant as messages show it."""
    kind = _kind(v)
    word = F.try_variant_get(v, "$", "string")
    return F.when(v.isNull() | (kind == "VOID"), "None").when(kind == "STRING", literal(word)).when(kind == "BOOLEAN", F.initcap(word)).otherwise(F.coalesce(word, F.to_json(v)))


def _blank(v: Column) -> Column:
    return F.coalesce(tx.strip(_text(v)), F.lit("")) == ""


def _truthy(v: Column) -> Column:
    """Neither missing nor null, empty, zero or false."""
    empty = F.to_json(v).isin('""', "0", "0.0", "false", "[]", "{}", "null")
    return F.coalesce(v.isNotNull() & (_kind(v) != "VOID") & ~empty, F.lit(False))


def _issues(rows: DataFrame, step: int, place: Column, checks: list[tuple[str, Column, Column | str]], item: Column | None = None) -> DataFrame:
    """A row for each check (level, test, message) that holds; rows has big_order and ordinal."""
    one = lambda i, level, test, message: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(i).alias("rank"), F.lit(level).alias("level"), (F.lit(message) if isinstance(message, str) else message).alias("message")))
    found = F.array_compact(F.array(*[one(i, *c) for i, c in enumerate(checks)]))
    rows = rows.select(F.lit(step).alias("step"), "big_order", F.col("ordinal").cast("long").alias("ordinal"), (F.lit(-1) if item is None else item).cast("int").alias("item"), place.alias("place"), F.explode(found).alias("i"))
    return rows.select(*ORDER[:4], "i.rank", "i.level", "place", "i.message")


def _indexed(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _keys(doc: Column) -> Column:
    return F.coalesce(F.json_object_keys(doc), F.array().cast("array<string>"))


def rule_issues(rules: DataFrame, forbidden: list[str] = FORBIDDEN_KEYS) -> DataFrame:
    """Faults of each rule by itself. rules: big_category, big_order, ordinal, doc (JSON text).

    Keys are compared on the text itself (a schema would pass over keys that it doesn't know), in its order. A missing
    key ends a rule's checks, or those of the set or parameter that lacks it; an extra key doesn't.
    """
    v = F.try_parse_json("doc")
    rows = rules.select("big_category", "big_order", "ordinal", "doc", v.alias("v")).withColumns({"kind": _kind(F.col("v")), "keys": _keys(F.col("doc"))})
    where = _indexed(F.col("big_category"), "[", F.col("ordinal"), "]")
    is_object = F.coalesce(F.col("kind") == "OBJECT", F.lit(False))
    missing, extra = F.array_except(_lit(RULE_KEYS), "keys"), F.array_except("keys", _lit(RULE_KEYS))
    leaked = F.filter("keys", lambda k: k.isin(forbidden))
    full = is_object & (F.size(missing) == 0)
    part = lambda k: _at(F.col("v"), k)
    demo = lambda c, words: F.coalesce(_text(c), F.lit("")).rlike("|".join(words))
    out = _issues(rows, 1, where, [
        ("ERROR", ~is_object, "rule must be an object"),
        ("ERROR", is_object & (F.size(missing) > 0), F.concat(F.lit("missing top-level fields: "), listed(missing))),
        ("ERROR", is_object & (F.size(extra) > 0), F.concat(F.lit("forbidden extra top-level fields: "), listed(extra))),
        ("ERROR", is_object & (F.size(leaked) > 0), F.concat(F.lit("old/non-template metadata leaked into rule: "), listed(leaked))),
        ("ERROR", full & _blank(part("rule_id")), "rule_id must be non-empty string"),
        ("ERROR", full & _blank(part("description")), "description must be non-empty string"),
        ("ERROR", full & ~_blank(part("description")) & demo(part("description"), DEMO_TEXT), "reference/DEMO wording leaked into field rule"),
        ("ERROR", full & ~F.coalesce(_kind(part("sets")) == "ARRAY", F.lit(False)), "sets must be an array"),
        ("ERROR", full & ~F.coalesce(_kind(part("parameters")) == "OBJECT", F.lit(False)), "parameters must be an object"),
    ])
    whole = rows.filter(full)
    sets = whole.select("big_category", "big_order", "ordinal", "doc", F.posexplode(F.try_variant_get("v", "$.sets", "array<variant>")).alias("i", "s"))
    sets = sets.withColumn("keys", _keys(F.expr("get_json_object(doc, concat('$.sets[', i, ']'))"))).withColumn("is_object", F.coalesce(_kind(F.col("s")) == "OBJECT", F.lit(False)))
    missing, extra = F.array_except(_lit(SET_KEYS), "keys"), F.array_except("keys", _lit(SET_KEYS))
    is_object, part = F.col("is_object"), lambda k: _at(F.col("s"), k)
    full = is_object & (F.size(missing) == 0)
    place = _indexed(where, ".sets[", F.col("i"), "]")
    optional = lambda v: ~F.coalesce(_kind(v).isin("STRING", "VOID"), F.lit(True))
    out = out.unionByName(_issues(sets, 1, place, [
        ("ERROR", ~is_object, "set item must be object"),
        ("ERROR", is_object & (F.size(missing) > 0), F.concat(F.lit("missing set fields: "), listed(missing))),
        ("ERROR", is_object & (F.size(extra) > 0), F.concat(F.lit("extra set fields: "), listed(extra))),
        ("ERROR", full & _blank(part("set_name")), "set_name must be non-empty string"),
        ("ERROR", full & optional(part("subset_name")), "subset_name must be string or null"),
        ("ERROR", full & _blank(part("element")), "element must be non-empty string"),
        ("ERROR", full & ~_blank(part("element")) & demo(part("element"), DEMO_ELEMENT), "DEMO entity leaked into field rule"),
    ], F.col("i")))
    # parameters by name: their texts keep the order of keys, the variants their types
    texts = F.from_json(F.get_json_object("doc", "$.parameters"), "map<string,string>")
    params = whole.filter(F.coalesce(_kind(_at(F.col("v"), "parameters")) == "OBJECT", F.lit(False))).select("big_category", "big_order", "ordinal", F.try_variant_get("v", "$.parameters", "map<string,variant>").alias("m"), F.posexplode(texts).alias("i", "name", "doc"))
    params = params.withColumn("p", F.element_at("m", F.col("name"))).withColumn("keys", F.when(_kind(F.col("p")) == "OBJECT", _keys(F.col("doc"))).otherwise(F.array().cast("array<string>")))
    missing, extra = F.array_except(_lit(PARAMETER_KEYS), "keys"), F.array_except("keys", _lit(PARAMETER_KEYS))
    is_object, part = F.coalesce(_kind(F.col("p")) == "OBJECT", F.lit(False)), lambda k: _at(F.col("p"), k)
    full = is_object & (F.size(missing) == 0)
    place = _indexed(where, ".parameters.", F.col("name"))
    return out.unionByName(_issues(params, 1, place, [
        ("ERROR", tx.strip(F.col("name")) == "", "parameter name must be non-empty string"),
        ("ERROR", ~is_object, "parameter item must be object"),
        ("ERROR", is_object & (F.size(missing) > 0), F.concat(F.lit("missing parameter fields: "), listed(missing))),
        ("ERROR", is_object & (F.size(extra) > 0), F.concat(F.lit("extra parameter fields: "), listed(extra))),
        ("ERROR", full & F.coalesce(_kind(part("value")).isin("OBJECT", "ARRAY"), F.lit(False)), "parameter value must be scalar"),
        ("ERROR", full & optional(part("unit")), "unit must be string or null"),
    ], F.col("i") + 1_000_000))


def with_ids(rules: DataFrame) -> DataFrame:
    """Rules that are objects with a text as rule_id: rule_id, big_category, big_order, ordinal, v."""
    v = F.try_parse_json("doc")
    rows = rules.select("big_category", "big_order", "ordinal", v.alias("v")).filter(_kind(F.col("v")) == "OBJECT")
    return rows.withColumn("rule_id", _text(_at(F.col("v"), "rule_id"))).filter("rule_id IS NOT NULL")


def duplicate_issues(ided: DataFrame) -> DataFrame:
    """Rules whose id an earlier rule of any file has, with where it first stands."""
    first = ided.groupBy(F.col("rule_id").alias("_id")).agg(F.min(F.struct("big_order", "ordinal", "big_category")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    again = ided.join(first, F.col("rule_id") == F.col("_id")).filter((F.col("big_order") != F.col("f.big_order")) | (F.col("ordinal") != F.col("f.ordinal")))
    message = F.concat(F.lit("duplicate rule_id "), literal(F.col("rule_id")), F.lit("; first seen at "), _indexed(F.col("f.big_category"), "[", F.col("f.ordinal"), "]"))
    return _issues(again, 1, _indexed(F.col("big_category"), "[", F.col("ordinal"), "]"), [("ERROR", F.lit(True), message)], F.lit(2_000_000))


def audit_issues(rules: DataFrame, audit: DataFrame, catalog: DataFrame, spec: DataFrame, groups: DataFrame) -> DataFrame:
    """Faults between rules and their audit records.

    audit: ordinal, doc (JSON text); catalog: big_category, enabled (array of subcategories); spec: big_category, subcategory,
    signature (array of set_name, subset_name); groups: target_group_id. Of rules, and of records, with one id the last counts
    where one is looked up; repeats of a dedup_key are told against the first.
    """
    ided = with_ids(rules)
    emitted = ided.groupBy("rule_id").agg(F.max_by(F.struct("big_category", "v"), F.struct("big_order", "ordinal")).alias("r")).select(F.col("rule_id").alias("_rid"), F.col("r.big_category").alias("file_big"), F.col("r.v").alias("rule"))
    v = F.try_parse_json("doc")
    records = audit.select("ordinal", F.lit(0).alias("big_order"), v.alias("a")).filter(_kind(F.col("a")) == "OBJECT")
    part = lambda k: _at(F.col("a"), k)
    records = records.withColumn("rule_id", _text(part("rule_id")))
    ids = lambda df, c: df.select(F.col(c).alias("id")).distinct()
    noted = ids(records.filter("rule_id IS NOT NULL"), "rule_id")
    known = ids(emitted, "_rid")

    def side(left, right, level, message, rank):
        some = left.join(right, "id", "left_anti").orderBy("id").limit(LISTED).agg(F.sort_array(F.collect_list("id")).alias("ids")).filter(F.size("ids") > 0)
        return some.select(F.lit(2).alias("step"), F.lit(0).alias("big_order"), F.lit(rank).cast("long").alias("ordinal"), F.lit(-1).alias("item"), F.lit(0).alias("rank"), F.lit(level).alias("level"), F.lit("manifest").alias("place"), F.concat(F.lit(message), listed(F.col("ids"))).alias("message"))

    out = side(known, noted, "ERROR", "rules missing audit records: ", 0).unionByName(side(noted, known, "WARNING", "audit records without emitted rules: ", 1))
    place = _indexed("manifest.audit_records[", F.col("ordinal"), "]")
    rows = records.join(emitted, F.col("rule_id") == F.col("_rid"), "left")
    enabled = catalog.select(F.col("big_category").alias("_big"), "enabled")
    rows = rows.join(F.broadcast(enabled), F.col("file_big") == F.col("_big"), "left")
    group = groups.select(F.col("target_group_id").alias("_g")).distinct().withColumn("known_group", F.lit(True))
    rows = rows.join(group, _text(part("target_group_id")) == F.col("_g"), "left")
    signature = spec.select(F.col("big_category").alias("_sb"), F.col("subcategory").alias("_ss"), "signature")
    rows = rows.join(signature, (F.col("file_big") == F.col("_sb")) & (_text(part("subcategory")) == F.col("_ss")), "left")
    hit = F.col("_rid").isNotNull()
    outside = lambda k, values: ~F.coalesce(_text(part(k)).isin(values), F.lit(False))
    allowed = F.coalesce(F.array_contains("enabled", _text(part("subcategory"))), F.lit(False))
    names = F.transform(F.filter(F.try_variant_get("rule", "$.sets", "array<variant>"), lambda s: _kind(s) == "OBJECT"), lambda s: _text(_at(s, "set_name")))
    names = F.coalesce(names, F.array().cast("array<string>"))
    wanted = F.transform("signature", lambda s: s["set_name"])
    checks = [("ERROR", _kind(part("extraction_mode")).isNotNull() & (_kind(part("extraction_mode")) != "VOID") & outside("extraction_mode", MODES), F.concat(F.lit("invalid extraction_mode "), _shown(part("extraction_mode"))))]
    checks += [("ERROR", hit & ~_truthy(part(k)), f"missing required audit field {k}") for k in ("target_group_id", "extraction_phase", "source_priority", "dedup_key")]
    checks += [
        ("ERROR", hit & _truthy(part("target_group_id")) & F.col("known_group").isNull(), F.concat(F.lit("unknown target_group_id "), _shown(part("target_group_id")))),
        ("ERROR", hit & outside("extraction_phase", PHASES), F.concat(F.lit("invalid extraction_phase "), _shown(part("extraction_phase")))),
        ("ERROR", hit & outside("source_priority", PRIORITIES), F.concat(F.lit("invalid or control-only source_priority "), _shown(part("source_priority")))),
        ("ERROR", hit & ~F.coalesce(_text(part("big_category")) == F.col("file_big"), F.lit(False)), F.concat(F.lit("big_category "), _shown(part("big_category")), F.lit(" does not match rule file "), literal(F.col("file_big")))),
        ("ERROR", hit & ~allowed, F.concat(F.lit("subcategory "), _shown(part("subcategory")), F.lit(" is not enabled in "), F.col("file_big"))),
        ("ERROR", hit & allowed & F.col("signature").isNull(), F.concat(F.lit("no enabled template spec for subcategory "), _shown(part("subcategory")))),
        ("ERROR", hit & allowed & ~names.eqNullSafe(wanted) & F.col("signature").isNotNull(), F.concat(F.lit("sets set_name signature "), listed(names), F.lit(" differs from the template's "), listed(wanted))),
    ]
    out = out.unionByName(_issues(rows, 3, place, checks))
    pairs = F.posexplode(F.arrays_zip("signature", F.try_variant_get("rule", "$.sets", "array<variant>").alias("sets"))).alias("i", "z")
    zipped = rows.filter(hit & allowed & F.col("signature").isNotNull()).select("ordinal", "big_order", pairs).select("ordinal", "big_order", "i", F.col("z.signature").alias("want"), F.col("z.sets").alias("s"))
    subset = _at(F.col("s"), "subset_name")
    other = F.col("want.subset_name").isNotNull() & (_kind(F.col("s")) == "OBJECT") & ~F.coalesce(_text(subset) == F.col("want.subset_name"), F.lit(False))
    message = F.concat(F.lit("subset_name "), _shown(subset), F.lit(" differs from template example "), literal(F.col("want.subset_name")), F.lit("; verify against symbol document and actual entity class"))
    out = out.unionByName(_issues(zipped, 3, _indexed(place, ".sets[", F.col("i"), "]"), [("WARNING", other, message)], F.col("i")))
    keyed = records.join(known, F.col("rule_id") == F.col("id")).filter(_truthy(part("dedup_key"))).select("ordinal", "big_order", "rule_id", F.to_json(part("dedup_key")).alias("k"))
    first = keyed.groupBy(F.col("k").alias("_k")).agg(F.min_by("rule_id", "ordinal").alias("first_id"))
    again = keyed.join(first, F.col("k") == F.col("_k")).filter("rule_id <> first_id")
    return out.unionByName(_issues(again, 4, place, [("ERROR", F.lit(True), F.concat(F.lit("duplicate emitted dedup_key also used by "), literal(F.col("first_id"))))]))


def file_issues(files: DataFrame) -> DataFrame:
    """Files that are missing or hold no array. files: big_category, big_order, name, text (null: no such file)."""
    kind = _kind(F.try_parse_json("text"))
    rows = files.withColumn("ordinal", F.lit(-1))
    return _issues(rows, 1, F.col("big_category"), [
        ("ERROR", F.col("text").isNull(), F.concat(F.lit("missing required JSON file: "), F.col("name"))),
        ("ERROR", F.col("text").isNotNull() & kind.isNull(), "invalid JSON"),
        ("ERROR", F.col("text").isNotNull() & kind.isNotNull() & (kind != "ARRAY"), "top-level JSON must be an array"),
    ])


def validate(rules: DataFrame, audit: DataFrame | None = None, catalog: DataFrame | None = None, spec: DataFrame | None = None, groups: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """All issues of rules, of their files where files is given, and of their audit records where audit is given."""
    out = rule_issues(rules).unionByName(duplicate_issues(with_ids(rules)))
    if files is not None:
        out = out.unionByName(file_issues(files))
    return out if audit is None else out.unionByName(audit_issues(rules, audit, catalog, spec, groups))


def summary(issues: DataFrame, rules: DataFrame, catalog: DataFrame) -> dict:
    """valid, error_count, warning_count, rule_counts of all categories and total_rules."""
    n = {r.level: r["count"] for r in issues.groupBy("level").count().collect()}
    found = {r.big_category: r["count"] for r in rules.groupBy("big_category").count().collect()}
    counts = {r.big_category: found.get(r.big_category, 0) for r in catalog.select("big_category").collect()}
    return {"valid": not n.get("ERROR"), "error_count": n.get("ERROR", 0), "warning_count": n.get("WARNING", 0), "rule_counts": counts, "total_rules": sum(counts.values())}
