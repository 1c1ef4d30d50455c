"""Mixing sources to target weights: temperature, a bisected exponent, budgeted block permutations.

A source's share of tokens s becomes a weight in proportion to s**a. Of exponents from 1 (as it is)
to 0 (all equal) the largest is sought that meets the target entropy (a share of log(number of
sources)); if some source would then be repeated more than `repeats` times, the least
exponent above it that keeps to the limit. Both are monotone, and are bisected ten levels
at a time, each time by one aggregation over the table of sources.

A source with weight w gets floor(w * budget) tokens: whole epochs, and a rest. Its
documents fall into 1,024 blocks by a hash of doc_id; epoch e takes the blocks in the order of a
permutation (p * block + q) mod 1024, p odd, drawn from (source, e). The rest takes whole blocks in its
epoch's order while they fit, and of the next block the documents in hash order while they
fit. So whether a document is taken is an expression of its source's few parameters: no
source, however large, is sorted or gathered in one task.

Tokens are words `[^\\x20\\x09-\\x0D]+`. Cases: null or empty text: 0 tokens, in every full epoch, and in
the rest where its block is; null source: a source of its own; repeated rows: each counted, and
taken or left together; sources without tokens: one epoch; empty table: no rows; ties of hash: taken
or left together; extra columns: ignored by plan(), kept by mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_join, packed, scratch, store

BLOCKS = 1024
ENTROPY, REPEATS, BUDGET, SEED = 0.85, 4.0, 1.0, 11
LEVELS, ROUNDS = 10, 3


def n_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")).cast("long")


def _block() -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(BLOCKS)).cast("long")


def _order() -> Column:
    return F.xxhash64(F.lit(SEED + 1), "doc_id")


def _turned(block: Column, source: Column, epoch: Column) -> Column:
    """The block's place in an epoch of its source."""
    draw = lambda k: F.pmod(F.xxhash64(F.lit(SEED + k), source, epoch), F.lit(BLOCKS))
    return F.pmod((draw(2) * 2 + 1) * block + draw(3), F.lit(BLOCKS)).cast("long")


def _search(sources: DataFrame, test, low: float, high: float, rising: bool) -> float:
    """Bisects [low, high] for the edge of test(w, a, total w) -> aggregate bool Column, ten levels at a time: each source tries all points of a grid.

    rising: the test holds above the edge, and the least exponent where it holds is sought; else the largest.
    """
    steps = 1 << LEVELS
    for _ in range(ROUNDS):
        at = lambda i: low + (high - low) * i / steps  # noqa: E731, B023
        tried = sources.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("a", at(F.col("i")))
        holds = sorted(r.i for r in tried.withColumn("w", F.pow("share", "a")).groupBy("i").agg(test.alias("holds")).filter("holds").select("i").collect())
        if rising:
            k = min(holds, default=steps)
            low, high = at(max(0, k - 1)), at(k)
        else:
            k = max(holds, default=0)
            low, high = at(k), at(min(steps, k + 1))
    return high if rising else low


def exponent(sources: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float = BUDGET) -> float:
    """sources: one row for each with share > 0 (and n, their number, in each row)."""
    z, a = F.sum("w"), F.max("a")
    # H = log Z - a * sum(w log s) / Z
    spread_enough = F.log(z) - a * F.sum(F.col("w") * F.log("share")) / z >= F.lit(entropy) * F.log(F.max("n").cast("double")) - 1e-12
    few_repeats = F.max(F.col("w") / F.col("share")) / z * budget <= repeats
    a = _search(sources, spread_enough, 0.0, 1.0, rising=False)
    return max(a, _search(sources, few_repeats, 0.0, 1.0, rising=True)) if budget <= repeats else 1.0


def plan(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float = BUDGET) -> DataFrame:
    """One row for each source: source, tokens, weight, quota, epochs, cut_block, cut_order; stored.

    budget is a multiple of the tokens there are.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(_planned(docs, entropy, repeats, budget), "plan")


def _planned(docs: DataFrame, entropy: float, repeats: float, budget: float) -> DataFrame:
    rows = store(docs.select("source", _block().alias("block"), _order().alias("at"), n_tokens(F.col("text")).alias("n")), "mix-rows")
    by_source = rows.groupBy("source").agg(F.sum("n").alias("tokens"))
    total, number = by_source.filter("tokens > 0").agg(F.sum("tokens"), F.count("*")).first()
    total = total or 0
    sources = store(by_source.filter("tokens > 0").select("source", "tokens", (F.col("tokens") / F.lit(float(max(1, total)))).alias("share"), F.lit(number).alias("n")), "sources")
    a = exponent(sources, entropy, repeats, budget) if total else 1.0
    z = sources.agg(F.sum(F.pow("share", F.lit(a)))).first()[0] or 1.0
    quotas = sources.select(
        "source", "tokens", (F.pow("share", F.lit(a)) / z).alias("weight"), F.floor(F.pow("share", F.lit(a)) / z * float(total * budget)).alias("quota")
    ).withColumns({"epochs": F.floor(F.col("quota") / F.col("tokens"))})
    quotas = store(quotas.withColumn("rest", F.col("quota") - F.col("epochs") * F.col("tokens")), "quotas")
    # whole blocks that fit, in the order of the last epoch
    sums = rows.groupBy("source", "block").agg(F.sum("n").alias("n"))
    placed = keyed_join(sums, quotas.select("source", "epochs", "rest"), ["source"], "inner", number).withColumn("place", _turned(F.col("block"), F.col("source"), F.col("epochs")))
    run = Window.partitionBy("source").orderBy("place")
    placed = placed.withColumn("sum", F.sum("n").over(run))
    over = placed.filter(F.col("sum") > F.col("rest")).groupBy("source").agg(F.min_by(F.struct("place", "block", (F.col("rest") - F.col("sum") + F.col("n")).alias("room")), "place").alias("cut"))
    cuts = store(over.select("source", F.col("cut.place").alias("cut_block"), F.col("cut.block").alias("block"), F.col("cut.room").alias("room")), "cuts")
    # of the next block, documents in hash order; those of one hash go together
    inside = keyed_join(rows, cuts.withColumnRenamed("block", "b2"), ["source"], "inner", number).filter(F.col("block") == F.col("b2")).groupBy("source", "at", "room").agg(F.sum("n").alias("n"))
    inside = inside.withColumn("sum", F.sum("n").over(Window.partitionBy("source").orderBy("at"))).filter(F.col("sum") <= F.col("room"))
    last = inside.groupBy("source").agg(F.max("at").alias("cut_order"))
    out = keyed_join(keyed_join(quotas.drop("rest"), cuts.select("source", "cut_block"), ["source"], known=number), last, ["source"], known=number)
    return out.withColumn("cut_block", F.coalesce("cut_block", F.lit(BLOCKS)))


def assigned(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """docs with copies, and m_place, the block's place in the last epoch."""
    rows = keyed_join(docs, sources.select("source", "epochs", "cut_block", "cut_order"), ["source"])
    epochs = F.coalesce("epochs", F.lit(1)).cast("long")
    rows = rows.withColumn("m_place", _turned(_block(), F.col("source"), epochs))
    more = (F.col("m_place") < F.col("cut_block")) | ((F.col("m_place") == F.col("cut_block")) & (_order() <= F.col("cut_order")))
    return rows.withColumn("copies", epochs + F.when(F.coalesce(more, F.lit(False)) & F.col("epochs").isNotNull(), 1).otherwise(0)).drop("epochs", "cut_block", "cut_order")


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs as mixed: each row as often as its source's weight asks; columns as they are."""
    rows = assigned(packed(docs, "doc_id", "source"), plan(docs.select("doc_id", "source", "text"), **how))
    return rows.filter("copies > 0").withColumn("m_epoch", F.explode(F.expr("sequence(1L, copies)"))).select("_doc.*")


def op4_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    rows = assigned(docs, plan(docs))
    return rows.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"), "copies", F.col("m_place").alias("place"))


QUERIES = {"op4_mixing": op4_mixing}
SQL: dict[str, str] = {}
