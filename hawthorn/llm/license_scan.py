"""License scans: MinHash bands over overlapping text windows, then exact containment. DataFrame functions only.

Words are `[a-z0-9]+` of the text with A-Z lowered; shingles are five words. Templates of T shingles
are looked for in windows of 2s shingles that start at each multiple of s, s being the least power of two
with s >= T: so a template at any place lies whole in some window. A window with at least
80 % of a template's shingles has similarity over 0.19 to it; each of 96 bands holds one
minimum, so the two share a band with probability over 1 - 2e-9. Windows that share a band are
verified on the shingles themselves: 100 * matched >= 80 * T. A template of fewer than five words is one
shingle of all its words, found by comparing words; one without any word is an error.

Minima are taken after xor with a constant for each band. A window can only share a band with a
template if it holds the shingle that is the template's minimum there, so windows without any such
shingle are passed over at no loss; all others get all their minima.

All of it is arrays within a row: no shuffle, whatever the skew. Cases: null, empty or short text: no match;
repeated rows: each scanned; ties between windows: the first; several licences in a text: a row each; null doc_id:
kept; very long texts: whole; empty table: no rows; extra columns: ignored. Templates are a parameter
of bounded size. The query looks for TEMPLATES and NOTICES.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let
from .url_filters import LOWER, UPPER

K, PERCENT, BANDS, SEED = 5, 80, 96, 3
#: License lines and notices, by identifier.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
    "You can obtain one at https://mozilla.org/MPL/2.0/.",
}
#: Notices of fewer words than a shingle, by identifier.
NOTICES = {"All-rights-reserved": "All rights reserved."}


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0))


def shingle_hashes(w: Column) -> Column:
    return F.when(F.size(w) >= K, F.transform(F.sequence(F.lit(1), F.size(w) - (K - 1)), lambda i: F.xxhash64(F.slice(w, i, K)))).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(w: Column, first: Column, n: int) -> Column:
    """Texts of at most n shingles from the 0-based place first."""
    last = F.least(first + n, F.size(w) - (K - 1))
    return F.transform(F.sequence(first + 1, last), lambda i: F.array_join(F.slice(w, i.cast("int"), K), " "))


def _constants(bands: int) -> list[int]:
    rng = random.Random(SEED)
    return [rng.randrange(-(2**63), 2**63) for _ in range(bands)]


class Templates:
    """Shingles and band minima of templates, made by the same expressions; tens of rows on the driver."""

    def __init__(self, spark, templates: dict[str, str] = TEMPLATES, bands: int = BANDS):
        rows = spark.createDataFrame(list(templates.items()), "id string, text string").select("id", words(F.col("text")).alias("w"))
        found = {row.id: row.w for row in rows.collect()}
        if empty := sorted(i for i, w in found.items() if not w):
            raise ValueError(f"templates without words can't be matched: {', '.join(empty)}")
        self.short = [{"id": i, "words": " ".join(w)} for i, w in sorted(found.items()) if len(w) < K]
        rows = rows.filter(F.size("w") >= K).select("id", shingle_hashes(F.col("w")).alias("h"), F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (K - 1)), lambda i: F.array_join(F.slice("w", i, K), " "))).alias("s"))
        self.constants = _constants(bands)
        self.items = []
        for row in sorted(rows.collect(), key=lambda r: r.id):
            least = [min(row.h, key=lambda x: x ^ c) for c in self.constants]
            size = 1
            while size < len(row.s):
                size *= 2
            self.items.append({"id": row.id, "shingles": list(row.s), "n": len(row.s), "step": size, "least": least, "minima": [x ^ c for x, c in zip(least, self.constants)]})
        self.steps = sorted({t["step"] for t in self.items})


def _windows(step: int, templates: Templates, percent: int) -> Column:
    """Verified matches of the templates of one step: array of (id, n, matched, start); columns w, h, hits."""
    mine = [t for t in templates.items if t["step"] == step]
    near = F.array_distinct(F.flatten(F.transform("hits", lambda p: F.array(F.floor(p / step), F.floor(p / step) - 1))))
    starts = F.transform(F.filter(near, lambda k: k >= 0), lambda k: (k * step).cast("int"))
    constants = F.array(*[F.lit(c) for c in templates.constants])

    def window(start):
        items = F.slice("h", start + 1, 2 * step)
        minima = let(items, lambda x: F.transform(constants, lambda c: F.array_min(F.transform(x, lambda y: y.bitwiseXOR(c)))))

        def tried(m):
            def shared(t):
                equal = F.exists(F.zip_with(m, F.array(*[F.lit(x) for x in t["minima"]]), lambda a, b: a == b), lambda z: z)
                texts = shingle_texts(F.col("w"), start, 2 * step)
                count = F.size(F.array_intersect(texts, F.array(*[F.lit(x) for x in t["shingles"]])))
                return F.when(equal, F.struct(F.lit(t["id"]).alias("id"), F.lit(t["n"]).cast("long").alias("n"), count.cast("long").alias("matched"), start.cast("long").alias("start")))

            return F.array(*[shared(t) for t in mine])

        return let(minima, tried)

    return F.filter(F.flatten(F.transform(starts, window)), lambda m: m.isNotNull() & (m["matched"] * 100 >= m["n"] * percent))


def _notices(w: Column, short: list[dict]) -> Column:
    """Templates under K words: array of (license, n_shingles, n_matched, start), start being the first window of two shingles."""

    def note(text, t):
        at = F.locate(f" {t['words']} ", text)
        before = text.substr(F.lit(1), at - 1)
        place = F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))
        one = F.lit(1).cast("long")
        return F.when(at > 0, F.struct(F.lit(t["id"]).alias("license"), one.alias("n_shingles"), one.alias("n_matched"), F.greatest(place - 1, F.lit(0)).cast("long").alias("start")))

    text = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    return let(text, lambda x: F.filter(F.array(*[note(x, t) for t in short]), lambda m: m.isNotNull()))


def scan(docs: DataFrame, templates: Templates, percent: int = PERCENT) -> DataFrame:
    """doc_id, license, n_shingles, n_matched, start for each licence found in each row of docs (doc_id, text)."""
    known = [F.lit(x) for x in sorted({x for t in templates.items for x in t["least"]})]
    # each array is bound once, and rows without hits go by an explode: a filter would be pushed below and evaluate them again
    at = lambda h: F.filter(F.transform(h, lambda x, i: F.when(x.isin(known), i)), lambda i: i.isNotNull())
    notes = lambda w: [_notices(w, templates.short).alias("notes")] if templates.short else []
    facts = let(words(F.col("text")), lambda w: let(shingle_hashes(w), lambda h: F.struct(w.alias("w"), h.alias("h"), at(h).alias("hits"), *notes(w))))
    use = lambda f: (F.size(f["hits"]) > 0) | (F.size(f["notes"]) > 0) if templates.short else F.size(f["hits"]) > 0
    hits = docs.select("doc_id", F.explode(F.filter(F.array(facts), use)).alias("f")).select("doc_id", "f.*")
    long = [F.flatten(F.array(*[_windows(s, templates, percent) for s in templates.steps])).alias("found")] if templates.items else []
    found = hits.select("doc_id", *long, *(["notes"] if templates.short else []))

    def best(t):
        same = F.filter("found", lambda m: m["id"] == t["id"])
        top = F.array_max(F.transform(same, lambda m: F.struct(m["matched"].alias("matched"), (-m["start"]).alias("back"))))
        return let(top, lambda x: F.when(x.isNotNull(), F.struct(F.lit(t["id"]).alias("license"), F.lit(t["n"]).cast("long").alias("n_shingles"), x["matched"].alias("n_matched"), (-x["back"]).alias("start"))))

    parts = [F.filter(F.array(*[best(t) for t in templates.items]), lambda m: m.isNotNull())] if templates.items else []
    parts += [F.col("notes")] if templates.short else []
    rows = found.select("doc_id", F.explode(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("m"))
    return rows.select("doc_id", "m.license", "m.n_shingles", "m.n_matched", "m.start")


def op10_license_scan(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), Templates(spark, TEMPLATES | NOTICES))


def sql(templates: dict[str, str] = TEMPLATES | NOTICES) -> str:
    """Every window against every template, without bands; templates under a shingle as sequences of words."""
    rows = ", ".join(f"('{i}', '{x.replace(chr(39), chr(39) * 2)}')" for i, x in templates.items())
    shingle = "list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i : i + 4], ' '))"
    return f"""
WITH t AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM (VALUES {rows}) v(id, text)),
ts AS (SELECT DISTINCT id, unnest({shingle}) AS s FROM t WHERE len(w) >= {K}),
tn AS (SELECT id, count(*) AS n, (2 ** ceil(log2(count(*))))::BIGINT AS step FROM ts GROUP BY 1),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z0-9]+') AS w FROM documents),
ds AS (SELECT doc_id, r, unnest({shingle}) AS s, unnest(range(0, greatest(len(w) - 4, 0))) AS p FROM d WHERE len(w) >= {K}),
h AS (SELECT doc_id, r, p, id, ds.s, n, step FROM ds JOIN ts ON ds.s = ts.s JOIN tn USING (id)),
k AS (SELECT doc_id, r, id, n, s, (p // step - x) * step AS start FROM h, (VALUES (0), (1)) v(x) WHERE p // step - x >= 0),
m AS (SELECT doc_id, r, id, n, start, count(DISTINCT s) AS matched FROM k GROUP BY ALL HAVING 100 * count(DISTINCT s) >= {PERCENT} * n),
b AS (SELECT *, row_number() OVER (PARTITION BY r, id ORDER BY matched DESC, start) AS o FROM m),
x AS (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS line FROM d),
y AS (SELECT doc_id, id, left(line, instr(line, ' ' || array_to_string(t.w, ' ') || ' ') - 1) AS before FROM x, t WHERE len(t.w) < {K} AND contains(line, ' ' || array_to_string(t.w, ' ') || ' '))
SELECT doc_id, id AS license, n AS n_shingles, matched AS n_matched, start FROM b WHERE o = 1
UNION ALL SELECT doc_id, id, 1, 1, greatest(length(before) - length(replace(before, ' ', '')) - 1, 0) FROM y"""


QUERIES = {"op10_license_scan": op10_license_scan}
SQL = {"op10_license_scan": sql()}
