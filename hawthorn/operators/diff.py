"""Import diff: what a new snapshot of keyed, hashed rows does to the rows there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(new: DataFrame, old: DataFrame, key: str, digest: str = "content_hash", archived: str | None = None) -> DataFrame:
    """key, action for each row of new: insert, update, unchanged, or archived_conflict where old holds it as archived.

    Both sides are hashed by key once; only key, digest and the archived flag are shuffled.
    """
    gone = F.col(archived) if archived else F.lit(False)
    before = old.select(F.col(key).alias("_key"), F.col(digest).alias("_digest"), gone.alias("_gone"))
    action = (
        F.when(F.col("_key").isNull(), "insert").when(F.col("_gone"), "archived_conflict").when(F.col(digest).eqNullSafe(F.col("_digest")), "unchanged").otherwise("update")
    )
    return new.join(before, F.col(key) == F.col("_key"), "left").withColumn("action", action).drop("_key", "_digest", "_gone")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by order: a minimum carrying its row, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])
