"""Record types, category specification and fixed vocabularies of the rule engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Sheet and knowledge type of each category, with the expected number of rules.
CATEGORIES = [
    ("SOP", "操作规程规则", "操作规程类", 257, 1),
    ("QS", "质量标准规则", "质量标准类", 158, 2),
    ("FLOW", "流程特征规则", "流程特征类", 135, 3),
    ("PROC", "工艺规范规则", "工艺规范类", 275, 4),
    ("EXP", "调度经验规则", "调度经验类", 225, 5),
]

#: The workbook's headers and the fields they fill.
HEADERS = [
    ("序号", "sequence_no"), ("规则编号", "rule_no"), ("规则名称", "rule_name"), ("规则类别", "category_name"), ("知识类型", "knowledge_type"),
    ("子类型", "subtype"), ("适用范围", "applicable_scope"), ("触发条件", "trigger_condition"), ("规则内容", "rule_content"), ("参数范围", "parameter_text"),
    ("来源文件", "source_file"), ("来源页码", "source_page"), ("来源依据", "source_basis"), ("备注", "notes"),
]
FIELDS = [f for _, f in HEADERS]
REQUIRED = ["rule_no", "rule_name", "category_name", "knowledge_type", "subtype", "applicable_scope", "rule_content", "source_file", "source_page", "source_basis"]
OPTIONAL = ["trigger_condition", "parameter_text", "notes"]
STATUSES = ("draft", "published", "archived")

#: Keys of a four-field rule, and keys that must not leak into one.
RULE_KEYS = ["rule_id", "description", "sets", "parameters"]
SET_KEYS = ["set_name", "subset_name", "element"]
PARAMETER_KEYS = ["value", "unit"]
MODES = ["direct", "calculated", "summarized", "missing", "conflict", "missing_template"]
PHASES = ["table_first", "document_supplement"]
PRIORITIES = ["P1", "P2", "P3", "P4", "P5"]

FORBIDDEN_KEYS = ["type", "category", "subject", "predicate", "source", "provenance", "confidence", "extraction_status", "notes", "subcategory"]
DEMO_TEXT, DEMO_ELEMENT = ["DEMO", "格式示例", "非现场已核实规则"], ["DEMO"]


def category_spec(spark: SparkSession) -> DataFrame:
    """code, sheet_name, knowledge_type, expected_count, display_order, prefix."""
    return spark.createDataFrame(
        [(c, s, k, n, o, f"{c}-") for c, s, k, n, o in CATEGORIES],
        "code string, sheet_name string, knowledge_type string, expected_count int, display_order int, prefix string",
    )
