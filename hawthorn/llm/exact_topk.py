"""Exact top-k inner products: norm-sorted vectors, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Components become whole numbers floor(scale * x). The vectors' Gram matrix is summed over the
table and its eigenvectors (the right singular vectors of the data) rotate all vectors,
so that the first few coordinates carry most of every product. Candidates are sorted by
descending length and written as that: range-partitioned, in sorted blocks. Each task takes its
candidates in order for a block of queries and keeps k best for each. For a candidate c and
query q the product is at most

    q1.c1 + |q2| |c2|        (1: leading rotated coordinates, 2: the rest)

and at most |q| |c|. A query whose k-th best is above |q| |c| for the longest c of a block of candidates
passes over that block, whatever comes after it (a task reads several files, in no order of length);
a candidate whose bound is below the k-th best is not multiplied out. What is
left gets the exact whole-number product, so rounding in the rotation can't change results
(bounds carry a margin). The `longest` longest candidates are tried first: their k-th best score for a query is where
every task starts, so that tasks pass over, and send, nothing below it. Queries come in blocks of at most block_rows vectors;
one block at a time is broadcast against all candidates and what is found for it stored, so that no more than a block is ever
on the driver. The tasks' lists, at most k rows for a query each, merge by a grouped window at the end.

Cases: vectors null, empty or with null or non-finite components: take no part; vectors of
unequal lengths: the shorter is padded with zeros; ties: smaller vec_id; repeated vec_ids: each
row is a candidate, none is one for a query of its vec_id, and a query row that repeats is
answered once; fewer than k candidates: all; empty table: no rows; extra columns: ignored; products
that may pass 53 bits: multiplied in whole numbers; a result that isn't a 64-bit number: an error, since
the score can't be given (such products rank rightly, so only k best that hold one fail).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import folders, scratch, store

SCALE, K, LEAD, BLOCK_ROWS, LONGEST = 64, 20, 16, 16384, 8192
#: A place not taken, and scores below and above what a long can hold.
NONE, LOW, HIGH = -(2**63), -(2**63) + 1, 2**63 - 1


def whole_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array<double> of whole numbers), norm2 for the rows that take part."""
    x = F.col("embedding")
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    # doubles from 2**53 on are whole, and may be too large for floor's bigint
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    v = F.transform(x, lambda c: whole(c.cast("double") * scale))
    rows = table.filter(good & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows padded with zeros, as float64."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    sizes = np.diff(np.asarray(column.offsets))
    if n and (sizes == dims).all():
        return flat.reshape(n, dims)
    out = np.zeros((n, dims))
    out[np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rotation(vectors: DataFrame, dims: int) -> np.ndarray:
    """Eigenvectors of the Gram matrix, the largest first; dims * dims numbers reach the driver."""

    def grams(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            m = _matrix(batch.column(0), dims)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "g"])

    parts = vectors.select("v").mapInArrow(grams, "i bigint, g array<double>").select("i", F.posexplode("g").alias("j", "x"))
    rows = parts.groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    gram = np.zeros((dims, dims))
    for i, j, x in rows:
        gram[i, j] = x
    # any rotation gives right bounds
    return np.linalg.eigh(gram)[1][:, ::-1] if np.isfinite(gram).all() else np.eye(dims)


def _products(q: np.ndarray, c: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Exact products (int64) of the wanted pairs of rows, clipped to LOW and HIGH; NONE for the others."""
    q_norm, c_norm = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    if q_norm.max() * c_norm.max() < 2.0**52:
        return np.where(wanted, q @ c.T, NONE).astype(np.int64)
    size = np.where((q_norm[:, None] == 0) | (c_norm == 0), 0, q_norm[:, None] * c_norm)
    out = np.full(size.shape, NONE, np.int64)
    small, huge = wanted & (size < 2.0**52), wanted & ~(size < 2.0**62)
    out[small] = (q @ c.T)[small].astype(np.int64)
    rows, cols = (np.flatnonzero((wanted & ~small & ~huge).any(axis=a)) for a in (1, 0))
    if len(rows):
        # sums may wrap, but what they come to is below 2**62
        middle = (wanted & ~small & ~huge)[np.ix_(rows, cols)]
        whole = np.where(np.abs(q[rows]) < 2.0**63, q[rows], 0).astype(np.int64) @ np.where(np.abs(c[cols]) < 2.0**63, c[cols], 0).astype(np.int64).T
        out[np.ix_(rows, cols)] = np.where(middle, whole, out[np.ix_(rows, cols)])
    for i, j in np.argwhere(huge):
        out[i, j] = min(max(sum(int(a) * int(b) for a, b in zip(q[i], c[j])), LOW), HIGH)
    return out


def _scan(asked, k: int, lead: int, block: int = 512):
    """Candidates (vec_id, v), in any order, fastest longest first -> (query, place, vec_id, score): k best of the task for each query.

    asked() gives the queries' ids, places, vectors and starts (scores below which nothing is wanted), and the rotation.
    """

    def run(batches):
        ids, places, queries, start, turn = asked()
        dims = queries.shape[1]
        q_turned = queries @ turn
        q1, q2 = q_turned[:, :lead], np.linalg.norm(q_turned[:, lead:], axis=1)
        q_norm = np.linalg.norm(queries, axis=1)
        n = len(queries)
        best = np.full((n, k), NONE, np.int64)
        owner = np.full((n, k), np.iinfo(np.int64).max)
        for batch in batches:
            cand, vectors = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64), _matrix(batch.column(1), dims)
            for at in range(0, len(cand), block):
                c, cid = vectors[at : at + block], cand[at : at + block]
                c_norm = np.linalg.norm(c, axis=1)
                margin = 1e-6 * (1 + q_norm.max(initial=0) * c_norm.max())
                # for this block alone: a task may read several sorted files, in any order
                kth = np.maximum(best[:, k - 1], start).astype(np.float64)
                live = np.flatnonzero(~(q_norm * c_norm.max() + margin < kth))
                if not len(live):
                    continue
                turned = c @ turn
                bound = q1[live] @ turned[:, :lead].T + np.outer(q2[live], np.linalg.norm(turned[:, lead:], axis=1)) + margin
                hit = ~(bound < kth[live][:, None])
                rows = np.flatnonzero(hit.any(axis=1))
                if not len(rows):
                    continue
                use = np.flatnonzero(hit.any(axis=0))
                mine = live[rows]
                wanted = hit[np.ix_(rows, use)] & (ids[mine][:, None] != cid[use][None, :])
                scores = np.concatenate([best[mine], _products(queries[mine], c[use], wanted)], axis=1)
                owners = np.concatenate([owner[mine], np.broadcast_to(cid[use], wanted.shape)], axis=1)
                order = np.lexsort((owners, ~scores), axis=1)[:, :k]
                best[mine] = np.take_along_axis(scores, order, 1)
                owner[mine] = np.take_along_axis(owners, order, 1)
        q, at = np.nonzero((best > NONE) & (best >= start[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(places[q]), pa.array(owner[q, at]), pa.array(best[q, at])], ["query_id", "place", "vec_id", "score"])

    return run


def _starts(heads: tuple[np.ndarray, np.ndarray], dims: int, k: int, step: int = 1024):
    """(vec_id, place, v) -> with start, the k-th best score among heads (ids, vectors); NONE where there are fewer."""
    cid, c = heads

    def run(batches):
        for batch in batches:
            ids, queries = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64), _matrix(batch.column(2), dims)
            start = np.full(len(ids), NONE, np.int64)
            for at in range(0, len(ids), step):
                scores = _products(queries[at : at + step], c, ids[at : at + step, None] != cid[None, :])
                if len(cid) >= k:
                    start[at : at + step] = np.partition(scores, len(cid) - k, axis=1)[:, len(cid) - k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start)], ["vec_id", "place", "v", "start"])

    return run


def top_k(table: DataFrame, every: int = 20, k: int = K, scale: int = SCALE, lead: int = LEAD, block_rows: int = BLOCK_ROWS, longest: int = LONGEST) -> DataFrame:
    """query_id, rank, vec_id, score; queries are the rows whose vec_id is divisible by every. Stored."""
    with scratch(table.sparkSession) as keep:
        return keep(_best(table, every, k, scale, lead, block_rows, longest), "top-k")


def _best(table: DataFrame, every: int, k: int, scale: int, lead: int, block_rows: int, longest: int) -> DataFrame:
    spark = table.sparkSession
    sc = spark.sparkContext
    schema = "query_id long, rank int, vec_id long, score long"
    vectors = whole_vectors(table, scale)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = store(vectors.repartitionByRange(n, F.desc("norm2"), F.col("vec_id")).sortWithinPartitions(F.desc("norm2"), "vec_id"), "by-norm")
    dims = ordered.agg(F.max(F.size("v"))).first()[0]
    if not dims:
        return spark.createDataFrame([], schema)
    turn = rotation(ordered, dims)
    rows = lambda df, *columns: [np.asarray(x.to_numpy(), np.int64) if x.type == pa.int64() else _matrix(x, dims) for x in df.select(*columns).toArrow().columns]
    heads = sc.broadcast(tuple(rows(ordered.orderBy(F.desc("norm2"), "vec_id").limit(longest), "vec_id", "v")))
    queries = ordered.filter(F.col("vec_id") % every == 0).select("vec_id", "v").dropDuplicates(["vec_id", "v"]).select("vec_id", F.monotonically_increasing_id().alias("place"), "v")
    asked = store(queries.mapInArrow(lambda batches: _starts(heads.value, dims, k)(batches), "vec_id bigint, place bigint, v array<double>, start bigint"), "queries")
    heads.destroy()
    # blocks of queries by hash, more of them until none is over the bound
    blocks = max(1, -(-asked.count() // block_rows))
    part = lambda: F.pmod(F.xxhash64("place"), F.lit(blocks))
    while asked.groupBy(part().alias("b")).count().filter(F.col("count") > block_rows).count():
        blocks += -(-blocks // 4)
    found = []
    for b in range(blocks):
        mine = rows(asked.filter(part() == b), "vec_id", "place", "v", "start")
        block = sc.broadcast((*mine, turn))
        hits = ordered.select("vec_id", "v").mapInArrow(_scan(lambda block=block: block.value, k, min(lead, dims)), "query_id bigint, place bigint, vec_id bigint, score bigint")
        found.append(store(hits, "hits"))
        block.destroy()
    out = spark.read.schema(found[0].schema).parquet(*[folder for x in found for folder in folders(x)])
    window = Window.partitionBy("query_id", "place").orderBy(F.desc("score"), "vec_id")
    score = F.when(F.col("score").isin(LOW, HIGH), F.raise_error("a score is beyond 64 bits").cast("long")).otherwise(F.col("score"))
    return out.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))


def op2_exact_topk(spark, sf_dir):
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def sql() -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {K}"""


QUERIES = {"op2_exact_topk": op2_exact_topk}
SQL = {"op2_exact_topk": sql()}
