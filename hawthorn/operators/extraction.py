"""Extraction of rules from workbook rows: capacities, tanks, crude properties, assays, sampling points, tank levels.

Rows come from sources.workbook.read_workbook: path, sheet, sheet_no, row_no, cells, kinds. A rule is a row; what it says of its subject
is `object`, a map from field to JSON text (in the order of its fields as far as maps keep it), and doc_of() gives the whole as JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .numbering import numbered

#: Words in a name, and the subcategory that the first of them gives.
DEVICES = [
    (["催化"], "催化"), (["重整"], "重整"), (["乙烯"], "乙烯"), (["聚丙烯", "聚烯"], "聚烯烃"), (["MTBE"], "MTBE"), (["气体分馏", "气分"], "气分"), (["航煤"], "航煤加氢"),
    (["柴油"], "汽柴油加氢"), (["苯", "芳烃"], "芳烃"), (["常压", "蒸馏"], "一次装置常减压"), (["焦化"], "延迟焦化"), (["渣油"], "渣加"), (["轻烃"], "轻烃回收"),
]
TANKS = [
    (["原油"], "原油罐"), (["渣油"], "渣油罐"), (["柴油"], "柴油罐"), (["汽油", "石脑油"], "汽油罐"), (["航煤", "喷气燃料"], "煤油罐"),
    (["轻烃", "液化气", "丙烷", "丙烯", "C4", "碳四"], "轻烃罐"), (["芳烃", "苯", "二甲苯", "乙苯", "苯乙烯"], "芳烃罐"), (["蜡油"], "蜡油罐"),
]
POINTS = [
    (["催化"], "催化"), (["重整"], "重整"), (["MTBE"], "MTBE"), (["气体分馏"], "气分"), (["航煤"], "航煤加氢"), (["柴油"], "汽柴油加氢"), (["汽油"], "S-ZORB"), (["乙苯", "苯乙烯"], "芳烃"),
]
#: What a name without any of these words is.
PRIMARY_UNIT, MIDDLE_TANK = "一次装置常减压", "中间产品罐"
#: Classes of units, upstream and downstream.
UPSTREAM = ["中压加裂", "高压加裂", "催拆改制", "渣加", "延迟焦化", "汽柴油加氢", "重整", "催化", "芳烃", "乙烯"]
DOWNSTREAM = ["s-zorb", "航煤加氢", "PTA", "轻烃回收", "气分", "MTBE", "溶脱", "油浆拔头", "聚酯", "聚烯烃"]
#: Plants, their short names, words of tanks that aren't settled, and tanks whose upper bound two tables give differently.
PLANTS = {"延炼": "YL", "延石化": "YSH"}
PENDING, UNKNOWN = "待", "未知"
DISPUTED = ("延石化", ["T-41", "T-42", "T-43", "T-48"])
WITHHELD = {"disputed": "车间罐容表与汇总表上限口径不一致", "partial": "0724表仅填写的上限与0720表不一致"}


def device_subcategory(name: Column) -> Column:
    return tx.first_case(F.coalesce(name, F.lit("")), DEVICES, PRIMARY_UNIT)


def tank_subcategory(material: Column) -> Column:
    return tx.first_case(F.coalesce(material, F.lit("")), TANKS, MIDDLE_TANK)


def point_subcategory(sheet: Column) -> Column:
    return tx.first_case(F.coalesce(sheet, F.lit("")), POINTS, PRIMARY_UNIT)


def unit_side(unit: Column) -> Column:
    """upstream or downstream for a class of units, null for any other: those are rejected."""
    return F.when(unit.isin(UPSTREAM), "upstream").when(unit.isin(DOWNSTREAM), "downstream")


def cell(i: int) -> Column:
    """A cell's text without tags, stripped; null where it is empty."""
    return F.nullif(tx.strip_tags(F.get("cells", F.lit(i))), F.lit(""))


def value(i: int) -> Column:
    """A cell's number: one that is typed, or a text that reads as one; booleans and dates aren't."""
    return F.when(~F.coalesce(F.get("kinds", F.lit(i)).isin("b", "d"), F.lit(False)), tx.number(F.get("cells", F.lit(i))))


def typed(i: int) -> Column:
    """A cell's number if the cell is a number, not a text that looks like one."""
    return F.when(F.get("kinds", F.lit(i)) == "n", tx.number(F.get("cells", F.lit(i))))


def quoted(c: Column) -> Column:
    """A text as JSON; null as null."""
    return F.when(c.isNull(), "null").otherwise(F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]\z", ""))


def figure(c: Column) -> Column:
    """A number as JSON: whole ones without a fraction; null as null."""
    return F.when(c.isNull(), "null").otherwise(tx.number_text(c))


def _object(**fields: Column) -> Column:
    return F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])


def scope_sets(scope: Column) -> Column:
    """Set items of a scope (map from set name to elements), lists expanded: set_name, subset_name (null), element."""
    each = F.transform(F.map_entries(scope), lambda e: F.transform(e["value"], lambda x: F.struct(e["key"].alias("set_name"), F.lit(None).cast("string").alias("subset_name"), x.alias("element"))))
    return F.flatten(each)


def object_parameters(fields: Column) -> Column:
    """The scalar fields of an object as parameters: name to {value, unit: null}; missing values, lists and objects are left out."""
    plain = F.map_filter(fields, lambda k, v: v.isNotNull() & (v != "null") & ~v.startswith("[") & ~v.startswith("{"))
    return F.transform_values(plain, lambda k, v: F.concat(F.lit('{"value":'), v, F.lit(',"unit":null}')))


def _rule(rows: DataFrame, rule_id: Column, category: str, subcategory: Column, name: Column, description: Column, subject: Column, predicate, fields: Column, scope: Column, record_type, then: Column | None = None, parameters: Column | None = None, column: Column | None = None) -> DataFrame:
    text = lambda c: F.lit(c) if isinstance(c, str) else c
    bounded = F.lit(None).cast("string") if then is None else then
    return rows.select(
        rule_id.alias("rule_id"), F.lit("process_specification").alias("type"), F.lit(category).alias("category"), subcategory.alias("subcategory"), name.alias("name"), description.alias("description"), scope.alias("scope"),
        text(record_type).alias("record_type"), bounded.alias("then"), F.when(bounded.isNotNull(), F.lit('[{"target":"MILP","type":"variable_bound"}]')).otherwise("[]").alias("mapping"), subject.alias("subject"),
        text(predicate).alias("predicate"), fields.alias("object"), scope_sets(scope).alias("sets"), (object_parameters(fields) if parameters is None else parameters).alias("parameters"),
        F.struct(F.element_at(F.split("path", "/"), -1).alias("document"), F.col("sheet"), F.col("row_no").alias("row"), (F.lit(None).cast("int") if column is None else column).alias("column")).alias("source"),
    )


def _between(variable: str, low: Column, high: Column, unit: str) -> Column:
    return F.concat(F.lit(f'{{"variable":"{variable}","operator":"between","value":['), figure(low), F.lit(","), figure(high), F.lit(f'],"unit":"{unit}"}}'))


def _py(c: Column) -> Column:
    """A number in a sentence, as it was typed: whole ones without a fraction; None where there is none."""
    return F.when(c.isNull(), "None").otherwise(tx.number_text(c))


def device_capacity(rows: DataFrame) -> DataFrame:
    """Load bounds of units, from the third row on: rows with a name, a rated and a largest load."""
    name = cell(1)
    initial, rated, most, high, low = (value(i) for i in range(3, 8))
    rows = rows.filter((F.col("row_no") >= 3) & name.isNotNull() & rated.isNotNull() & most.isNotNull())
    fields = _object(initial_load=figure(initial), rated_load=figure(rated), max_load=figure(most), max_load_factor=figure(high), min_load_factor=figure(low), unit=quoted(F.lit("t/d")))
    then = _between("feed_rate", F.round(rated * F.coalesce(low, F.lit(0.0)), 6), most, "t/d")
    says = F.concat(name, F.lit("初始负荷"), _py(initial), F.lit("吨/天、额定负荷"), _py(rated), F.lit("吨/天、最大加工负荷"), _py(most), F.lit("吨/天。"))
    rule_id = F.format_string("R-UNIT-CAP-%03d", "row_no")
    return _rule(rows, rule_id, "装置类", device_subcategory(name), F.concat(name, F.lit("负荷边界")), says, name, "feed_rate", fields, F.create_map(F.lit("unit"), F.array(name)), "rule", then)


def tanks(rows: DataFrame, first: int = 5, last: int = 122) -> DataFrame:
    """Volumes and safe levels of tanks; rows without material, tank or volume and totals are passed over."""
    material, tank, volume = cell(0), cell(1), value(2)
    upper, lower, level, factor, density = (value(i) for i in (3, 4, 6, 7, 8))
    rows = rows.filter(F.col("row_no").between(first, last) & material.isNotNull() & tank.isNotNull() & volume.isNotNull() & ~F.startswith(material, F.lit("共计")))
    fields = _object(material=quoted(material), volume=figure(volume), unit=quoted(F.lit("m3")))
    levels = _object(safe_upper_level=figure(upper), safe_lower_level=figure(lower), initial_level=figure(level), meter_coefficient=figure(factor), density=figure(density))
    fields = F.when(upper.isNotNull(), F.map_concat(fields, levels)).otherwise(fields)
    then = F.when(upper.isNotNull(), _between("liquid_level", lower, upper, "m"))
    says = F.concat(material, tank, F.lit("罐容为"), _py(volume), F.lit("立方米，来源表中记录了罐容及可用液位参数。"))
    scope = F.create_map(F.lit("tank"), F.array(tank), F.lit("material"), F.array(material))
    return _rule(rows, F.format_string("R-TANK-PARAM-%03d", "row_no"), "罐区类", tank_subcategory(material), F.concat(tank, F.lit("罐容与安全液位")), says, tank, "tank_capacity_and_level", fields, scope, F.when(upper.isNotNull(), "rule").otherwise("parameter"), then)


def tank_description(rules: DataFrame) -> DataFrame:
    """rules with the description of tanks made anew of the fragments there are: volume, safe levels, first level, factor, density."""
    field = lambda k: F.nullif(F.element_at("object", k), F.lit("null"))
    plain = lambda k: F.regexp_replace(field(k), '^"|"\\z', "")
    short = lambda k: F.when(field(k).rlike(r"[.eE]"), tx.general_number(field(k).try_cast("double"))).otherwise(plain(k))
    has = lambda k: F.map_contains_key("object", k)
    shown = lambda k: F.coalesce(short(k), F.lit("None"))
    parts = F.concat_ws(
        "；", F.concat(F.coalesce(plain("material"), F.lit("")), F.lit("罐"), "subject"),
        F.when(has("volume"), F.concat(F.lit("罐容"), shown("volume"), F.coalesce(plain("unit"), F.lit("m3")))),
        F.when(has("safe_lower_level") & has("safe_upper_level"), F.concat(F.lit("安全液位"), shown("safe_lower_level"), F.lit("–"), shown("safe_upper_level"), F.lit("m"))),
        F.when(has("initial_level"), F.concat(F.lit("初始液位"), shown("initial_level"), F.lit("m"))), F.when(has("meter_coefficient"), F.concat(F.lit("液位计系数"), shown("meter_coefficient"))),
        F.when(field("density").isNotNull(), F.concat(F.lit("密度"), short("density"))),
    )
    mine = F.col("subcategory").endswith("罐") & (F.col("predicate") == "tank_capacity_and_level")
    return rules.withColumn("description", F.when(mine, F.concat(parts, F.lit("。"))).otherwise(F.col("description")))


def crude_properties(rows: DataFrame) -> DataFrame:
    """Properties of crudes, from the third row on: rows with an id and a name."""
    cid, name = cell(0), cell(1)
    api, gravity, sulfur, acid = (value(i) for i in range(2, 6))
    rows = rows.filter((F.col("row_no") >= 3) & cid.isNotNull() & name.isNotNull())
    fields = _object(crude_id=quoted(cid), api=figure(api), specific_gravity=figure(gravity), sulfur=figure(sulfur), acid_value=figure(acid))
    says = F.concat(name, F.lit("（"), cid, F.lit("）的API度、比重、硫含量和酸值见原油性质数据表。"))
    return _rule(rows, F.format_string("R-CRUDE-PROP-%03d", "row_no"), "原油类", F.lit("原油混合性质计算"), F.concat(name, F.lit("原油性质参数")), says, name, "crude_properties", fields, F.create_map(F.lit("material"), F.array(name)), "fact")


def assays(rows: DataFrame, crudes: tuple[str, ...] = ("YCO", "RCO")) -> DataFrame:
    """Assay values: a marker row (*...) names the section of those below it; a rule for each crude's number. A sheet is filled as one, like its file is read."""
    mark, stream = cell(0), cell(1)
    section = F.last(F.when(F.startswith(mark, F.lit("*")), F.regexp_replace(mark, r"^\*+", "")), ignorenulls=True).over(Window.partitionBy("path", "sheet").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("section", section).filter(mark.isNotNull() & ~F.startswith(mark, F.lit("*")) & stream.isNotNull() & F.col("section").isNotNull())
    each = F.array(*[F.struct(F.lit(c).alias("crude"), F.lit(2 + i).alias("at"), value(2 + i).alias("x")) for i, c in enumerate(crudes)])
    rows = rows.withColumn("v", F.explode(F.filter(each, lambda e: e["x"].isNotNull())))
    crude, x, section = F.col("v.crude"), F.col("v.x"), F.col("section")
    sub = F.when(section.contains("质量收率"), "原油混合侧线产品收率计算").otherwise("原油混合性质计算")
    fields = _object(crude_id=quoted(crude), side_stream_id=quoted(mark), side_stream=quoted(stream), value=figure(x), unit=F.lit("null"))
    says = F.concat(crude, F.lit("加工时"), stream, F.lit("的"), section, F.lit("为"), _py(x), F.lit("。"))
    rule_id = F.format_string("R-CRUDE-ASSAY-%03d-%d", F.col("row_no"), F.col("v.at"))
    scope = F.create_map(F.lit("material"), F.array(stream), F.lit("crude"), F.array(crude))
    return _rule(rows, rule_id, "原油类", sub, F.concat_ws("-", crude, mark, section), says, mark, section, fields, scope, "parameter", column=(F.col("v.at") + 1).cast("int"))


def point_properties(rows: DataFrame, start: int, folder: str) -> DataFrame:
    """Measured properties of sampling points in all sheets: rows with a code, a sample and at least two numbers under a header.

    Rules are numbered from start on, in the order of books, sheets and rows. Of headers that repeat the last number counts.
    """
    heads = rows.filter("row_no = 1").select(F.col("path").alias("_p"), F.col("sheet").alias("_s"), F.transform("cells", lambda c: F.nullif(tx.strip_tags(c), F.lit(""))).alias("heads"))
    body = rows.filter("row_no > 1").join(heads, (F.col("path") == F.col("_p")) & (F.col("sheet") == F.col("_s"))).drop("_p", "_s")
    numbers = F.transform("cells", lambda c, i: F.when(~F.coalesce(F.get("kinds", i).isin("b", "d"), F.lit(False)), tx.number(c)))
    pairs = F.zip_with("heads", numbers, lambda h, x: F.struct(h.alias("h"), x.alias("x")))
    body = body.withColumn("pairs", F.filter(F.filter(pairs, lambda p, i: i >= 3), lambda p: p["h"].isNotNull() & p["x"].isNotNull()))
    last = F.filter("pairs", lambda p, i: ~F.exists(F.slice("pairs", i + 2, F.size("pairs")), lambda q: q["h"] == p["h"]))
    code, sample = cell(0), cell(1)
    body = body.withColumn("found", F.map_from_entries(last)).filter(code.isNotNull() & sample.isNotNull() & (F.size("found") >= 2)).drop("pairs", "heads")
    body = numbered(body, ["path", "sheet_no", "row_no"], start, folder)
    unit = F.coalesce(cell(2), F.col("sheet"))
    entries = F.transform(F.map_entries("found"), lambda e: F.concat(quoted(e["key"]), F.lit(":"), figure(e["value"])))
    fields = _object(sample_dot_code=quoted(code), sample_name=quoted(sample), device_name=quoted(cell(2)), indicators=F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")))
    params = F.transform_values("found", lambda k, v: F.concat(F.lit('{"value":'), figure(v), F.lit(',"unit":null}')))
    says = F.concat(unit, F.lit("的"), sample, F.lit("点位包含"), F.size("found").cast("string"), F.lit("项数值性质指标。"))
    scope = F.create_map(F.lit("unit"), F.array(unit), F.lit("material"), F.array(sample))
    return _rule(body, F.format_string("R-UNIT-POINT-%05d", "id"), "装置类", point_subcategory(F.col("sheet")), F.concat(unit, F.lit("-"), sample, F.lit("点位性质")), says, sample, "measured_properties", fields, scope, "fact", parameters=params)


def doc_of(rules: DataFrame) -> Column:
    """A rule of this module as JSON text."""
    json_map = lambda c: F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))
    field = lambda k, v: F.concat(F.lit(f'"{k}":'), v)
    parts = [field(k, quoted(F.col(k))) for k in ("rule_id", "type", "category", "subcategory", "name", "description")] + [
        field("scope", F.to_json("scope")), field("record_type", quoted(F.col("record_type"))), field("when", F.lit("null")), field("then", F.coalesce("then", F.lit("null"))), field("mapping", F.col("mapping")),
        field("subject", quoted(F.col("subject"))), field("predicate", quoted(F.col("predicate"))), field("object", json_map("object")), field("sets", F.to_json("sets", {"ignoreNullFields": "false"})),
        field("parameters", json_map("parameters")), field("source", F.to_json("source")), field("review_status", quoted(F.lit("draft"))),
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def tank_key(plant: Column, tank: Column) -> Column:
    return F.concat_ws("|", plant, tx.tank_key(tank))


def _found_in(rows: DataFrame, other: DataFrame, key: str, other_key: str, by: tuple[str, ...], how: str) -> DataFrame:
    """rows joined with other on a key within the same values of by, nulls included."""
    other = other.withColumnsRenamed({c: f"_by_{c}" for c in by})
    on = F.col(key) == F.col(other_key)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return rows.join(other, on, how).drop(*[f"_by_{c}" for c in by])


def _level(rows: DataFrame, kind: str, by: tuple[str, ...]) -> DataFrame:
    low = kind == "MIN"
    figure_of = F.col("low" if low else "high")
    plant_id = F.create_map(*[F.lit(x) for kv in PLANTS.items() for x in kv])[F.col("plant")]
    says = F.concat("plant", "tank", F.lit("罐（"), F.coalesce("material", F.lit("None")), F.lit(f"）安全液位{'下限' if low else '上限'}为"), tx.general_number(figure_of), F.lit("米。"))
    name = f"inventory_level_{kind.lower()}"
    doc = F.concat(F.lit(f'{{"{name}":{{"value":'), figure(figure_of), F.lit(',"unit":"m"}}'))
    return rows.select(
        *by, F.concat(F.lit(f"TANK_LEVEL_{kind}_"), plant_id, F.lit("_"), tx.id_suffix(F.col("tank"))).alias("rule_id"), says.alias("description"),
        F.array(F.struct(F.lit("T").alias("set_name"), F.lit(None).cast("string").alias("subset_name"), F.col("tank").alias("element"))).alias("sets"), doc.alias("parameters"),
    )


def tank_levels(primary: DataFrame, collected: DataFrame, crude: DataFrame, offsets: tuple[int, int] = (0, 20), first: tuple[int, int] = (5, 6), by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Safe levels of tanks from two sources: (rules, withheld, faults).

    primary: rows with two plants side by side (material, tank, -, high, low, ..., height); collected: rows with groups of tanks;
    crude: element, tanks that other rules cover. A lower bound is always given. An upper one is withheld where the sources are known
    to differ, where it is above the tank's height, and, for tanks of the second source alone, where the first has
    another upper bound without a lower one. faults are what must not be: bounds out of order, a tank twice in a source,
    sources that disagree, a tank of the second source alone in the first plant, or higher than the tank.
    by: columns of all three inputs that say whose tanks they are. Names are only compared within the same values, and the results
    carry them; without any, a name is one tank wherever it stands.
    """
    block = lambda o, plant: F.struct(
        F.lit(plant).alias("plant"), F.get("cells", F.lit(o)).alias("material"), F.nullif(F.get("cells", F.lit(o + 1)), F.lit("")).alias("tank"),
        typed(o + 3).alias("high"), typed(o + 4).alias("low"), typed(o + 9).alias("height"),
    )
    blocks = F.array(*[block(o, plant) for o, plant in zip(offsets, PLANTS)])
    a = primary.filter(F.col("row_no") >= first[0]).select(*by, "row_no", F.explode(blocks).alias("b")).select(*by, "row_no", "b.*").filter("tank IS NOT NULL AND high IS NOT NULL").withColumn("key", tank_key(F.col("plant"), F.col("tank")))
    partial = a.filter("low IS NULL").groupBy(*by, F.col("key").alias("p_key")).agg(F.max_by("high", "row_no").alias("p_high"))
    a = a.filter("low IS NOT NULL").withColumn("tank", tx.strip(F.col("tank"))).filter(~F.col("tank").contains(PENDING) & ~F.col("tank").contains(UNKNOWN))
    plant = F.when(F.get("cells", F.lit(1)).contains(next(iter(PLANTS))), next(iter(PLANTS))).otherwise(list(PLANTS)[1])
    b = collected.filter(F.col("row_no") >= first[1]).select(*by, "row_no", plant.alias("plant"), F.get("cells", F.lit(3)).alias("material"), F.get("cells", F.lit(4)).alias("group"), typed(10).alias("high"), typed(11).alias("low"), typed(7).alias("height"))
    b = b.filter("group <> '' AND high IS NOT NULL AND low IS NOT NULL").withColumn("tank", F.explode(F.split(tx.strip(F.col("group")), r"(?U)[、，,\s]+")))
    b = b.filter((F.col("tank") != "") & ~F.col("tank").contains(PENDING)).drop("group").withColumn("key", tank_key(F.col("plant"), F.col("tank")))
    twice = lambda df, source: df.groupBy(*by, "key").agg(F.count("*").alias("n")).filter("n > 1").select(*by, "key", F.lit(f"twice in the {source} source").alias("fault"))
    order = lambda df: df.filter("NOT (0 <= low AND low < high)").select(*by, "key", F.lit("bounds out of order").alias("fault"))
    second = _found_in(b, a.select(*by, F.col("key").alias("a_key")), "key", "a_key", by, "left_anti")
    gone = crude.select(*by, F.col("element").alias("c_tank")).distinct()
    mine = _found_in(a, gone, "tank", "c_tank", by, "left_anti")
    other = _found_in(second, gone, "tank", "c_tank", by, "left_anti")
    above = F.coalesce(F.col("high") > F.col("height"), F.lit(False))
    plant, starts = DISPUTED
    disputed = (F.col("plant") == plant) & F.expr(" OR ".join(f"startswith(tank, '{s}')" for s in starts))
    high = F.concat(F.lit("上限"), tx.general_number(F.col("high")), F.lit("米高于罐高"), tx.general_number(F.col("height")), F.lit("米"))
    mine = mine.withColumn("reason", F.when(disputed, WITHHELD["disputed"]).when(above, high))
    other = _found_in(other, partial, "key", "p_key", by, "left").withColumn("reason", F.when(F.col("p_high") != F.col("high"), WITHHELD["partial"]))
    both = _found_in(mine.filter("reason IS NULL"), b.select(*by, F.col("key").alias("b_key"), F.col("high").alias("b_high"), F.col("low").alias("b_low")), "key", "b_key", by, "inner")
    faults = twice(a, "first").unionByName(twice(b, "second")).unionByName(order(a)).unionByName(order(other))
    faults = faults.unionByName(both.filter("b_high <> high OR b_low <> low").select(*by, "key", F.lit("sources disagree").alias("fault")))
    faults = faults.unionByName(other.filter(F.col("plant") != plant).select(*by, "key", F.lit("in the second source alone").alias("fault"))).unionByName(other.filter(above).select(*by, "key", F.lit("bound above the tank").alias("fault")))
    columns = [*by, "plant", "tank", "material", "high", "low", "reason"]
    every = mine.select(*columns).unionByName(other.select(*columns))
    rules = _level(every, "MIN", by).unionByName(_level(every.filter("reason IS NULL"), "MAX", by))
    return rules, every.filter("reason IS NOT NULL").select(*by, "tank", "reason"), faults.distinct()


def start_conditions(tanks: DataFrame) -> DataFrame:
    """The pressure that a tank has to have before its pump starts. tanks: tank, pump, pressure (MPa), occasion."""
    says = F.concat("occasion", F.lit("，"), "tank", F.lit("付料并启动"), "pump", F.lit("泵前，罐压力须保持在"), tx.general_number(F.col("pressure")), F.lit("兆帕以上。"))
    return tanks.select(
        F.concat(F.lit("TANK_GAS_FRACTIONATION_PUMP_START_PRESSURE_MIN_"), F.replace("tank", F.lit("-"), F.lit(""))).alias("rule_id"), says.alias("description"),
        F.array(F.struct(F.lit("T").alias("set_name"), F.lit(None).cast("string").alias("subset_name"), F.col("tank").alias("element"))).alias("sets"),
        F.concat(F.lit('{"pump_start_tank_pressure_min":{"value":'), figure(F.col("pressure")), F.lit(',"unit":"MPa"}}')).alias("parameters"),
    )


def richness(rules: DataFrame) -> DataFrame:
    """For each category and subcategory: rules, documents, subjects and the field names of objects and parameters; the richest first."""
    names = F.array_union(F.map_keys("object"), F.map_keys("parameters"))
    # field names are few: a set of each group's is bounded by the vocabulary
    out = rules.groupBy("category", "subcategory").agg(
        F.count("*").alias("sample_count"), F.countDistinct("source.document").alias("source_file_count"), F.countDistinct("subject").alias("subject_count"), F.collect_set(names).alias("names"),
    )
    return out.withColumn("numeric_field_count", F.size(F.array_distinct(F.flatten("names")))).drop("names").withColumn("status", F.lit("ready")).orderBy(F.desc("sample_count"), F.desc("numeric_field_count"), "category", "subcategory")


def lint(rules: DataFrame) -> DataFrame:
    """rule_id, code of what looks wrong. rules: rule_id, kind, description, element, low, high (texts of a bound), final_product (boolean)."""
    checks = {
        "equal_bounds": F.col("low").isNotNull() & (F.col("low") == F.col("high")),
        "both_bounds": F.col("description").contains("下限") & F.col("description").contains("上限"),
        "comma": F.col("element").rlike("[,，]"),
        "bound_on_fixed_value": (F.col("kind") == "BOUND") & F.col("low").isNotNull() & (F.col("low") == F.col("high")),
        "product_property_on_sidecut": (F.col("kind") == "PRODUCT_PROPERTY") & ~F.col("final_product"),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]))
    return rules.select("rule_id", F.explode(found).alias("code"))
