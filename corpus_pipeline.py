"""A corpus pipeline: five stages over documents, each written and read again.

quality rules -> MinHash near-dedup -> suffix-array dedup -> mixing -> byte-level BPE.
Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hawthorn.llm import bpe, common, minhash_dedup, mixing, quality_rules, suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't outliers of their language and source."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return minhash_dedup.keep_one(docs, words=5, percent=80, bands=46)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes or more that an earlier document, or place, has; empty ones go."""
    cut = suffix_dedup.remove_repeats(docs)
    removed = F.col(cut.columns[-1])
    kept = cut.filter((removed == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(removed > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.select(*[n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at temperature weights; documents of small sources repeat, of large ones some are left out."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row and digests of the ids and of the text they decode to."""
    return bpe.digest_documents(docs)


STAGES = [
    ("7 quality rules", quality),
    ("3 MinHash near-dedup", near_dedup),
    ("9 suffix-array dedup", passages),
    ("4 mixing to target weights", mixture),
    ("8 byte-level BPE", tokens),
]

#: SQL can't express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents in sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        with common.scratch(spark) as keep:
            after = keep(stage(spark, docs, sf_dir), f"stage-{name.split()[0]}", "zstd")
        if i:  # what the stage before has stored; never the input
            common.forget(docs)
        docs = after
    return docs
