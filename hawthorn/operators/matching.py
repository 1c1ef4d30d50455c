"""Names matched with a list of candidates by equality or containment of their normal forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Candidates at most: they are compared with every distinct name.
CANDIDATES = 20_000


def first_match(rows: DataFrame, name: str, candidates: DataFrame, candidate: str, ordinal: str) -> DataFrame:
    """rows with the first candidate, in order of ordinal, whose normal name equals, holds or is held by that of the row; others go.

    Each distinct normal name is tried once. The candidates are a list of checked size, broadcast as one array, so
    no pairs are made: a name looks through the list and stops at the first that fits.
    """
    if candidates.limit(CANDIDATES + 1).count() > CANDIDATES:
        raise ValueError(f"more than {CANDIDATES} candidates")
    one = candidates.select(F.struct(F.col(ordinal).alias("o"), F.col(candidate).alias("c"), tx.normal_name(F.col(candidate)).alias("n")).alias("x"))
    listed = [(r.x.o, r.x.c, r.x.n) for r in one.collect()]
    spark = rows.sparkSession
    table = spark.createDataFrame([(0, [(c, n) for _, c, n in sorted(listed)])], "_one int, _list array<struct<c string, n string>>")
    # the list is one row: it is met by a key that every name has, not by a join without one
    names = rows.select(tx.normal_name(F.col(name)).alias("_name")).filter("_name <> ''").distinct().withColumn("_k", F.length("_name") * 0)
    fits = lambda x: (x["n"] != "") & (F.contains("_name", x["n"]) | F.contains(x["n"], F.col("_name")))
    found = names.join(F.broadcast(table), F.col("_k") == F.col("_one")).select("_name", F.get(F.filter("_list", fits), F.lit(0))["c"].alias(candidate)).filter(F.col(candidate).isNotNull())
    return rows.join(found, tx.normal_name(F.col(name)) == F.col("_name")).drop("_name")
