"""Consecutive numbers for rows in an order, without a single task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[str], start: int, folder: str, column: str = "id") -> DataFrame:
    """df with column: start, start + 1, ... by order. Ranges are sorted in tasks and written to folder; only their sizes meet in one."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(folder)
    rows = df.sparkSession.read.parquet(folder).withColumn("_part", F.shiftright("_at", 33))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + start
    return rows.join(before, F.col("_part") == F.col("_p")).withColumn(column, place.cast("long")).select(*[c for c in df.columns if c != column], column)
