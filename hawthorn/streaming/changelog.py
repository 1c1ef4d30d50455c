"""Extension (no counterpart in the batch engine): change-log ingestion as a stream.

Files of change events are read as they arrive; each run takes what is there and stops
(availableNow), so it can be scheduled. The checkpoint makes reruns after a failure exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())]
)


def read(spark: SparkSession, path: str, files_each: int = 64) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_each).json(path)


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Changes of each kind by hour; events later than `late` are dropped by the watermark, repeated ids count once."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def append(df: DataFrame, path: str, checkpoint: str) -> None:
    """Writes what has arrived and is final to Parquet, then stops."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
