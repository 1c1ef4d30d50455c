"""Coverage against targets: the gap ladder by kind of target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_counts(targets: DataFrame, emitted: DataFrame, key: str, rule_id: str) -> DataFrame:
    """targets with n, the distinct rules emitted for each; 0 where there is none."""
    n = emitted.groupBy(F.col(key).alias("_key")).agg(F.countDistinct(rule_id).alias("_n"))
    return targets.join(n, F.col(key) == F.col("_key"), "left").withColumn("n", F.coalesce("_n", F.lit(0)).cast("long")).drop("_key", "_n")


def gaps(counted: DataFrame) -> DataFrame:
    """counted (kind, value, low, high, n) with remaining, remaining_low, remaining_high, closed, supplement."""
    kind, n = F.col("kind"), F.col("n")
    left = lambda c: F.greatest(F.col(c) - n, F.lit(0)).cast("long")
    single, span = kind.isin("exact", "advisory_exact", "approx"), kind.isin("interval", "approx_interval")
    return counted.withColumns(
        {
            "remaining": F.when(single, left("value")),
            "remaining_low": F.when(span, left("low")),
            "remaining_high": F.when(span, left("high")),
            "closed": (kind == "exact") & (left("value") == 0),
            "supplement": F.when(single, n < F.col("value")).when(span, n < F.col("low")).when(kind == "unspecified", n == 0).otherwise(True),
        }
    ).withColumn("closed", F.coalesce("closed", F.lit(False)))


def audited(audit: DataFrame, emitted: DataFrame, rule_id: str, phase: str | None = None, phase_col: str = "extraction_phase", status_col: str = "validation_status") -> DataFrame:
    """Audit rows of emitted rules, of the phase if one is given, not failed."""
    ok = F.col(status_col).isNull() | F.col(status_col).isin("PASS", "REVIEW")
    if phase:
        ok = ok & (F.col(phase_col) == phase)
    return audit.filter(ok).join(emitted.select(rule_id).distinct(), rule_id, "left_semi")
