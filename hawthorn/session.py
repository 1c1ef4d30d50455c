"""Session helper used by the bench, the tests and ad-hoc runs."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, memory: str = "8g", shuffle: int = 8, app: str = "hawthorn") -> SparkSession:
    """A local session with the settings the engine assumes (UTC, AQE, Arrow)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="hawthorn-wh-"))
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="hawthorn-shared-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
