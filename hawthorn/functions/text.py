"""Scalar functions as Columns: cell cleaning, SQL LIKE of the source system, hashes, numbers, text shapes.

No Python UDFs, so all of it stays in the JVM and inside whole-stage code.
"""

from __future__ import annotations

import json
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def like_ascii(c: Column, pattern: str) -> Column:
    """LIKE that folds ASCII case only; % and _ are live, there is no escape character."""
    lowered = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in pattern)
    return ascii_lower(c).like(lowered.replace("\\", "\\\\"))


def contains_any(columns: list[Column], keyword: str | None) -> Column:
    """Keyword search: an OR of LIKE %keyword% over columns; a blank keyword matches everything."""
    word = (keyword or "").strip()
    if not word:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.coalesce(like_ascii(c, f"%{word}%"), F.lit(False)) for c in columns])


def strip(c: Column) -> Column:
    """Trims all Unicode white space, not U+0020 only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def cell_text(c: Column) -> Column:
    """A text cell's text: null is empty. What a cell holds as text stays as it is (`1.0` too)."""
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def number_text(c: Column) -> Column:
    """A number cell's text: a whole number loses its fraction, null is empty."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.coalesce(F.when(whole, c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string")), F.lit(""))


def hash_array(columns: list[Column]) -> Column:
    """SHA-256 of the compact JSON array of texts."""
    return F.sha2(F.to_json(F.array(*columns)).cast("binary"), 256)


def hash_object(columns: dict[str, Column]) -> Column:
    """SHA-256 of the compact JSON object with sorted keys, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"}).cast("binary"), 256)


def strip_tags(c: Column) -> Column:
    return strip(F.regexp_replace(c, "<[^>]+>", ""))


def _digits(c: Column) -> Column:
    """Stripped, full-width digits as ASCII, single underscores between digits gone: as the source system's parser reads numbers."""
    return F.regexp_replace(F.translate(strip(c), "０１２３４５６７８９", "0123456789"), r"(?<=[0-9])_(?=[0-9])", "")


def number(c: Column) -> Column:
    """A number from text: thousands commas go; anything else that isn't one (a type suffix, a dash) is null."""
    text = _digits(F.replace(strip(c), F.lit(","), F.lit("")))
    plain = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    named = text.rlike(r"(?i)^[+-]?(inf|infinity|nan)$")
    sign = F.when(F.startswith(text, F.lit("-")), F.lit("-")).otherwise("")
    word = F.when(F.lower(text).endswith("nan"), F.lit("NaN")).otherwise(F.concat(sign, F.lit("Infinity")))
    return F.when(plain, text.try_cast("double")).when(named, word.try_cast("double"))


def integer(c: Column) -> Column:
    text = _digits(c)
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))


def first_case(c: Column, branches: list[tuple[list[str], str]], default: str) -> Column:
    """The value of the first branch of which a word is contained; order matters."""
    out = None
    for words, value in branches:
        test = reduce(lambda a, b: a | b, [c.contains(w) for w in words])
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.otherwise(F.lit(default))


def tank_key(c: Column) -> Column:
    return F.regexp_replace(strip(c), "^T-", "")


def id_suffix(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def general_number(c: Column) -> Column:
    """Six significant digits without trailing zeros, like %g."""
    text = F.format_string("%.6g", c)
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")


def join_present(sep: str, *parts: Column) -> Column:
    """Fragments joined; null ones are left out."""
    return F.concat_ws(sep, *parts)


def normal_name(c: Column) -> Column:
    """A name without bracketed text, white space and the punctuation ·・,，。:：-; case stays."""
    return F.regexp_replace(F.regexp_replace(c, r"[（(].*?[）)]", ""), r"(?U)[\s·・,，。:：-]", "")


def unescape_html(c: Column) -> Column:
    """HTML character references as the characters they stand for: named ones (also without semicolon, the longest name that fits) and numeric ones."""
    pattern = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    # numbers 128 to 159 stand for what code page 1252 has there
    page = F.from_json(F.lit(json.dumps({str(i): bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160)})), "map<string,string>")

    def numeric(ref):
        digits = F.regexp_replace(ref, "[&#xX;]", "")
        code = F.when(F.lower(ref).startswith("&#x"), F.conv(F.right(F.concat(F.lit("0"), digits), F.lit(12)), 16, 10)).otherwise(digits).try_cast("bigint")
        bad = code.isNull() | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF) | (code == 0)
        gone = code.between(1, 8) | code.between(0xE, 0x1F) | (code == 0x7F) | (code == 0xB) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(bad, F.lit("\ufffd")).when(code.between(128, 159), F.element_at(page, code.cast("string"))).when(gone, F.lit("")).otherwise(char)

    def named(ref):
        name = ref.substr(F.lit(2), F.length(ref) - 1)
        sizes = F.sequence(F.length(name), F.lit(2), F.lit(-1))
        fits = F.filter(F.transform(sizes, lambda n: F.concat(F.element_at(names, name.substr(F.lit(1), n)), name.substr(n + 1, F.length(name)))), lambda x: x.isNotNull())
        return F.coalesce(F.element_at(names, name), F.when(F.length(name) >= 2, F.get(fits, F.lit(0))), ref)

    refs = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    chars = F.transform(refs, lambda r: F.when(F.startswith(r, F.lit("&#")), numeric(r)).otherwise(named(r)))
    parts = F.zip_with(F.split(c, pattern, -1), chars, lambda text, char: F.concat(text, F.coalesce(char, F.lit(""))))
    return F.when(c.contains("&"), F.array_join(parts, "")).otherwise(c)


def clean_chat(c: Column) -> Column:
    """Without a trailing <small> note, character references unescaped, stripped."""
    return strip(unescape_html(F.regexp_replace(c, r"(?is)\s*<small[^>]*>.*?</small>\s*\z", "")))


def string_list(v: Column) -> Column:
    """A variant as a list of texts: null and other kinds are empty, a text is one (stripped), of an array all that aren't blank."""
    kind = F.schema_of_variant(v)
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("None")))
    text = strip(F.try_variant_get(v, "$", "string"))
    none = F.array().cast("array<string>")
    return F.when(F.startswith(kind, F.lit("ARRAY")), F.filter(items, lambda x: strip(x) != "")).when((kind == "STRING") & (text != ""), F.array(text)).otherwise(none)


def dedup_key(category: Column, subcategory: Column, sets: Column, parameters: Column) -> Column:
    """What identifies a rule whatever its values: category, subcategory, sorted sets (set_name, subset_name, element) and sorted parameter names."""
    part = lambda x: F.concat_ws("/", *[F.coalesce(x[f], F.lit("")) for f in ("set_name", "subset_name", "element")])
    return F.concat_ws("|", category, subcategory, F.array_join(F.array_sort(F.transform(sets, part)), "+"), F.array_join(F.array_sort(parameters), "+"))


def escape_html(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def provider(c: Column, known: list[tuple[str, str]], default: str) -> Column:
    """A provider's name by substring, else the default."""
    return first_case(F.lower(F.coalesce(c, F.lit(""))), [([w], name) for w, name in known], default)


def target_display(kind: Column, value: Column, low: Column, high: Column) -> Column:
    """A gap target in words: a prefix for approximate ones, low–high for intervals."""
    span = F.concat(low.cast("string"), F.lit("–"), high.cast("string"))
    return (
        F.when(kind == "approx_interval", F.concat(F.lit("约"), span)).when(kind == "interval", span)
        .when(kind == "approx", F.concat(F.lit("约"), value.cast("string"))).when(kind.isin("exact", "advisory_exact"), value.cast("string")).otherwise("未明确")
    )


def has_prefix(c: Column, prefix: Column) -> Column:
    return F.startswith(c, prefix)


def utc_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
