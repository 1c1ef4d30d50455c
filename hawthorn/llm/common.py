"""Shared plumbing: the shared folder, lineage cuts and joins with a checked size."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import threading
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders made in the innermost scratch() of a thread.
_open = threading.local()
#: Rows up to which a keyed side may be broadcast; beyond it the join is salted.
BROADCAST_ROWS = 20_000
#: Copies of each key in a salted join.
SALTS = 32
#: Rows of a small table that are left to one task; tasks that it is left to at least.
FEW_ROWS, FEW_TASKS = 10_000, 8


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset and the session runs in one process (tests, local runs), a temporary folder is set instead.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        sc = spark.sparkContext._jsc.sc()
        path = sc.getCheckpointDir().get() if sc.getCheckpointDir().isDefined() else None
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="hawthorn-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/hawthorn/{label}-{uuid.uuid4().hex}"
    made = getattr(_open, "made", None)
    if made is not None:
        made.append(path)
    return path


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20):
    """Within it, what runs hands Python at most about so many bytes at a time: texts of any length in bounded memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are stored within it are deleted at its end, also where it fails; what it yields stores one that stays (until an outer scratch ends)."""
    outer = getattr(_open, "made", None)
    made, kept = [], []
    _open.made = made

    def keep(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
        out = store(df, label, codec)
        kept.append(made.pop())
        return out

    try:
        yield keep
    finally:
        _open.made = outer
        if outer is not None:
            outer += kept
        for path in made:
            _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def store(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    with small_batches(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Gives freed memory of this Python process back: idle workers stay, and would hold what their last task needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: nothing to give back this way
        pass


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and broadcasts of plans that are gone, and the driver's heap shrink, before more are made."""
    spark.range(1).count()  # the session holds the plan that ran last
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df, the result of a shuffle that is known to have about so many rows, in as few tasks as they ask for.

    Adaptive execution does so too where it may; without it a table of few rows takes a task, and room in the driver, for each shuffle partition.
    """
    return df.coalesce(max(FEW_TASKS, -(-rows // FEW_ROWS)))


def store_by(df: DataFrame, label: str, keys: list[str], codec: str = "snappy") -> DataFrame:
    """Like store(), laid out in buckets by keys, as many as there are shuffle partitions: joins and groupings by keys need no shuffle.

    df should be dealt out by keys already. Only the files stay, in the shared folder: the name of the table is gone at once.
    """
    spark = df.sparkSession
    name = f"hawthorn_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with small_batches(spark):
        df.write.option("path", new_path(spark, label)).option("compression", codec).bucketBy(n, *keys).sortBy(*keys).format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def folders(df: DataFrame) -> list[str]:
    """The folders of tables made by store() that df reads."""
    found = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    return sorted(f for f in found if re.search("/hawthorn/[^/]+-[0-9a-f]{32}$", f))


def forget(df: DataFrame) -> None:
    """Deletes the files of a table made by store(); only for tables that nothing reads any more."""
    for folder in folders(df):
        _delete(df.sparkSession, folder)


def keyed_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", known: int | None = None) -> DataFrame:
    """Joins parameters onto rows whatever the skew of the keys, null keys included.

    small holds one row for each key. It is counted first, unless its number of rows is known: up to BROADCAST_ROWS
    rows it is broadcast, beyond that both sides are salted, so that a key with a third of all
    rows is spread over SALTS tasks.
    """
    if (small.limit(BROADCAST_ROWS + 1).count() if known is None else known) <= BROADCAST_ROWS:
        side, on = F.broadcast(small), keys
        left = big
    else:
        on = [*keys, "_salt"]
        left = big.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        side = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    right = side.select(*[F.col(k).alias(f"_k_{k}") for k in on], *[c for c in side.columns if c not in on])
    cond = None
    for k in on:
        test = left[k].eqNullSafe(right[f"_k_{k}"])
        cond = test if cond is None else cond & test
    return left.join(right, cond, how).drop(*[f"_k_{k}" for k in on], "_salt")


def bounded(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df (of a few numbers a row) with a broadcast hint if it has at most so many rows; beyond that as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value, body):
    """Binds an expression once: body gets a variable, so that it isn't evaluated for every use."""
    return F.transform(F.array(value), body)[0]


def packed(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, and the whole row as _doc: other columns can't clash with what is added."""
    return df.select(*names, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_doc"))
