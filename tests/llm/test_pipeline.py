"""The pipeline against a brute-force version, stage by stage."""

import hashlib
import os
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from hawthorn.llm import bpe, common, mixing, quality_rules, registry
from test_small import WORD, brute_repeats, sentence

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    passage, rows = sentence(rng, 60), []
    for i in range(60):
        text = sentence(rng, 60)
        if i % 6 == 1:
            text = sentence(rng, 20) + "\n" + passage + "\n" + sentence(rng, 30)
        if i % 6 == 2 and i > 6:
            text = " ".join([*rows[0][1].split()[:-1], f"end{i}"])
        rows.append((i, text, "en", "big" if i % 3 else "small", len(text)))
    rows += [(60, None, "en", None, 0), (61, "same word " * 40, None, "big", 400), (62, "", "en", "big", 0)]
    path = tmp_path_factory.mktemp("pipe")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in quality_rules.judge(docs).collect() if r.kept}
    out = corpus_pipeline.quality(spark, docs, folder)
    assert out.columns == COLUMNS and {r.doc_id for r in out.collect()} == kept and not kept & {60, 61, 62}
    # five-word shingles, similarity 0.8
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i in kept for w in [WORD.findall(rows[i].text.lower())]}
    up = {i: i for i in kept}
    for _ in kept:
        for i in kept:
            for j in kept:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    up[i] = up[j] = min(up[i], up[j])
    single = sorted(i for i in kept if up[i] == i)
    out = corpus_pipeline.near_dedup(spark, out, folder)
    assert out.columns == COLUMNS and sorted(r.doc_id for r in out.collect()) == single and len(single) < len(kept)
    cut = brute_repeats([rows[i].text for i in single])
    out = corpus_pipeline.passages(spark, out, folder)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == COLUMNS
    for i, (n, removed, _, digest) in zip(single, cut):
        if removed < n:
            assert hashlib.sha256(got[i].text.encode()).hexdigest() == digest and got[i].n_chars == len(got[i].text)
    assert sum(removed for _, removed, _, _ in cut) > 0
    plan = mixing.plan(out)
    copies = {r.doc_id: r.copies for r in mixing.assigned(out, plan).collect()}
    mixed = corpus_pipeline.mixture(spark, out, folder)
    assert mixed.columns == COLUMNS and Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})
    enc = bpe.encoder("", "")
    want = Counter((i, len(enc.encode_ordinary(got[i].text)), hashlib.sha256(got[i].text.encode()).hexdigest()) for i, n in copies.items() for _ in range(n))
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.tokens(spark, mixed, folder).collect()) == want
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()) == want


def shared(spark):
    return f"{common.shared_dir(spark).removeprefix('file://')}/hawthorn"


def _written(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_empty_table(spark, tmp_path):
    out = corpus_pipeline.run(spark, _written(spark, tmp_path, [], "doc_id long, text string, lang string, source string, n_chars long"))
    assert out.count() == 0 and set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_repeated_ids_ties_and_columns_of_clashing_names(spark, tmp_path):
    """Rows that repeat, one id with several texts, null ids and texts; columns named like what the stages add."""
    rng = np.random.default_rng(23)
    extra = ["_gone", "n_removed", "_doc", "copies", "kept", "component_id", "spans", "row", "_r", "distance", "q_n_words", "m_place", "epochs", "place", "n_words"]
    rows = [(i % 30, sentence(rng, 40), "en", "a" if i % 4 else None, 5) for i in range(60)]
    rows += rows[:6] + [(None, rows[7][1], "en", "a", 1), (None, None, None, None, None), (70, "", "en", "a", 0), (71, "one", "en", "b", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    folder = _written(spark, tmp_path, [(*r, *[f"{c}{i}" for c in extra]) for i, r in enumerate(rows)], schema)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns
        for row in after.limit(20).collect():
            assert {row[c].removeprefix(c) for c in extra} == {row["_doc"].removeprefix("_doc")}
    before = set(os.listdir(shared(spark)))
    out = corpus_pipeline.run(spark, folder)
    assert len(set(os.listdir(shared(spark))) - before) == 1  # the result alone is left
    assert 0 < out.count() <= 2 * len(rows) and {r.doc_id for r in out.collect()} <= {r[0] for r in rows}


def test_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {x.split("_")[0] + "_" for x in names if x.startswith("op")} and "pipeline" in names
    assert set(registry.oracle_sql()) <= names
