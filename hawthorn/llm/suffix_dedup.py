"""Suffix-array dedup: repeated passages across a corpus, by a logarithmic family of suffix arrays.

What is removed: each byte covered by a `length`-byte string (window) that also starts earlier,
in the order of (doc_id, start). All of it is exact up to 64-bit hashes (128 bits for whole runs).

The arrays are sparse. A window's anchor is the place of its smallest `gram`-byte gram by
hash (leftmost of equals), so equal windows have equal anchors, and consecutive windows with
one anchor form a run. The suffix array of a batch holds one entry for each distinct run: the
gram's hash, the run's content hash, and where the run first starts; it is a table
bucketed and sorted by that key. Batches come in order of doc_id, so what an existing level
holds is always earlier. For each batch:

1. runs of the batch are made in tasks; a run seen earlier in the same share of a task is a repeat there and
   then, and goes on without its content (a hot passage sends one row with it for each share);
2. they are sorted by key and place, so that the first of each is the batch's own array, and merge-scanned
   (sort-merge join on the buckets, no shuffle of the index) against each level;
3. entries that are new become a level of rank 0; two levels of equal rank merge into one of the next.

Runs that are equal as a whole are settled then, by 128 bits. Runs that share a gram but differ (edges of
passages) are settled at the end window by window: each first occurrence of such a run gives
its windows' hashes, again only the first in each share, and the smallest place of each
(gram, hash) wins. Coverage is then applied to the texts, which are laid out by row once, so that
they are shuffled once in all.

Cases: null text: empty; empty or short texts: nothing removed; doc_id null or repeated: such tables
get row numbers in the order of (doc_id, text), null first, and results for each row; very
long texts: in pieces that overlap by a window; empty table: no rows; extra columns: ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from .common import forget, release, scratch, store, store_by

_U = np.uint64
LENGTH, GRAM = 100, 40
#: Batches that a table is taken in: so many at least, and as many more as its bytes ask for. Results don't depend on it.
BATCHES, BATCH_BYTES = 4, 64 << 30
#: Bytes of one text handled at a time; below 2**24.
PIECE = 1_000_000
SHIFT = 1024
#: Runs, or windows, that a task gathers before it tells first ones from repeats.
HELD = 500_000


def _slide_min(a: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[: len(a) - (width - size)], a[width - size :]) if size < width else a


def _prefix(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(kernels._BYTE[data] * kernels.powers(kernels._BASE, len(data)), out=total[1:])
    return total


def _runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(text index, gram hash, content hash, start in the bytes, windows) of each run."""
    n = len(data)
    if n < length:
        return None
    total, inv = _prefix(data), kernels.powers(kernels._INV, n)
    grams = kernels.mix((total[gram:] - total[:-gram]) * inv[: n - gram + 1])
    low = _U(0xFFFFFF)
    anchor = (_slide_min((grams & ~low) | np.arange(len(grams), dtype=_U), length - gram + 1) & low).astype(np.int64)
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes >= length)
    if not len(full):
        return None
    edge = np.zeros(len(anchor) + 1, np.int32)
    edge[offsets[:-1][full]] += 1
    edge[offsets[1:][full] - length + 1] -= 1
    at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(anchor[at]) != 0)) + 1
    first, last = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])]
    x = anchor[first]
    windows = last - first + 1
    content = kernels.mix((total[last + length] - total[first]) * inv[first] + windows.astype(_U) * _U(0x9E3779B97F4A7C15) + (x - first).astype(_U) * _U(0xC2B2AE3D27D4EB4F))
    return np.searchsorted(offsets, first, "right") - 1, grams[x], content, first, windows


def _pieces(column, length: int):
    """(row, bytes, offsets, base) with long texts in overlapping pieces, base being the piece's start."""
    for row, data, offsets in kernels.text_chunks(column):
        if len(offsets) == 2 and len(data) > PIECE:
            for base in range(0, len(data) - length + 1, PIECE):
                part = data[base : base + PIECE + length - 1]
                yield row, part, np.array([0, len(part)]), base
        else:
            yield row, data, offsets, 0


def _firsts(key: tuple[np.ndarray, ...], rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """True where an entry is the earliest (row, start) of its key."""
    order = np.lexsort((starts, rows, *key))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in key:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.zeros(len(order), bool)
    out[order] = new
    return out


def _signed(x: np.ndarray, valid: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), mask=~valid)


def _run_rows(length: int, gram: int):
    def out(parts):
        g, c, doc, start, windows = (np.concatenate(x) for x in zip(*parts))
        fresh = _firsts((c, g), doc, start)
        span = start * SHIFT + windows
        # repeats that are known have no content hash, and a key that spreads them
        g = np.where(fresh, g, kernels.mix(doc.astype(_U) * _U(0x9E3779B97F4A7C15) + span.astype(_U)))
        return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), _signed(c, fresh), pa.array(doc), pa.array(span)], ["g", "c", "row", "span"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            for row, data, offsets, base in _pieces(batch.column(1), length):
                found = _runs(data, offsets, length, gram)
                if found is None:
                    continue
                which, g, c, first, windows = found
                parts.append((g, c, ids[row + which], (first - offsets[which] + base).astype(np.int64), windows))
                held += len(g)
                if held > HELD:
                    yield out(parts)
                    parts, held = [], 0
        if parts:
            yield out(parts)

    return run


def _window_rows(length: int):
    """(row, text, grams, spans) -> (g, h, row, p): windows of the given runs, by their run's gram and their own hash; h is null for a repeat in this share."""

    def out(parts):
        g, h, row, p = (np.concatenate(x) for x in zip(*parts))
        return pa.RecordBatch.from_arrays([pa.array(g), _signed(h, _firsts((h, g), row, p)), pa.array(row), pa.array(p)], ["g", "h", "row", "p"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for row, text, grams, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)):
                data = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
                spans, grams = np.array(spans.as_py(), np.int64), np.array(grams.as_py(), np.int64)
                starts, n = spans // SHIFT, spans % SHIFT
                p = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
                total = _prefix(data)
                h = kernels.mix((total[p + length] - total[p]) * kernels.powers(kernels._INV, len(data))[p])
                parts.append((np.repeat(grams, n), h, np.full(len(p), row, np.int64), p))
                held += len(p)
                if held > HELD:
                    yield out(parts)
                    parts, held = [], 0
        if parts:
            yield out(parts)

    return run


def _later(batches):
    """Of rows sorted by (g, h, row, p), all but the first of each (g, h); rows without h are repeats already."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        g = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
        valid = np.asarray(batch.column(1).is_valid())
        h = np.asarray(batch.column(1).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1]) & valid[:-1] & valid[1:]
        same[0] = bool(valid[0]) and last == (int(g[0]), int(h[0]))
        last = (int(g[-1]), int(h[-1])) if valid[-1] else None
        start = np.asarray(batch.column(3).to_numpy(zero_copy_only=False), np.int64) * SHIFT + 1
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(start)], ["row", "span"]).filter(pa.array(same | ~valid))


def covered(spans: np.ndarray, size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal covered runs of a text of size bytes."""
    start, n = spans // SHIFT, spans % SHIFT
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n - 1 + length, -1)
    inside = np.cumsum(edge[:-1]) > 0
    step = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


class SuffixFamily:
    """Levels of suffix arrays, kept as bucketed files in the shared folder; ingest() takes batches in order of their rows."""

    def __init__(self, spark, length: int = LENGTH, gram: int = GRAM):
        self.spark, self.length, self.gram = spark, length, gram
        self.levels: list[tuple[int, DataFrame]] = []

    def _write(self, df: DataFrame) -> DataFrame:
        """df is laid out by (g, c) already, by a window or a join of the buckets: no shuffle here."""
        return store_by(df.select("g", "c", "row", "span", "older"), "suffixes", ["g", "c"])

    def _level(self, table: DataFrame) -> DataFrame:
        return table.filter("NOT older").select("g", "c", "row", "span")

    def _merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Two levels merge bucket by bucket; their keys are disjoint."""
        left, right = (self._level(t).select(*[F.col(c).alias(f"{c}{k}") for c in ("g", "c", "row", "span")]) for k, t in enumerate((a, b)))
        both = left.join(right, (F.col("g0") == F.col("g1")) & (F.col("c0") == F.col("c1")), "full_outer")
        return both.select(*[F.coalesce(f"{c}0", f"{c}1").alias(c) for c in ("g", "c", "row", "span")], F.lit(False).alias("older"))

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Adds a batch (row, text); gives its repeated runs as stored rows (row, span).

        One shuffle of the batch's runs; all but the first of each are repeats, and that too if a level has it.
        """
        runs = docs.select("row", "text").mapInArrow(_run_rows(self.length, self.gram), "g bigint, c bigint, row bigint, span bigint")
        place = F.row_number().over(Window.partitionBy("g", "c").orderBy("row", "span"))
        array = runs.withColumn("older", F.col("c").isNull() | (place > 1))
        for i, (_, table) in enumerate(self.levels):
            level = self._level(table).select(F.col("g").alias(f"g{i}"), F.col("c").alias(f"c{i}"))
            array = array.join(level, (F.col("g") == F.col(f"g{i}")) & (F.col("c") == F.col(f"c{i}")), "left")
            array = array.withColumn("older", F.col("older") | F.col(f"g{i}").isNotNull()).drop(f"g{i}", f"c{i}")
        own = self._write(array)
        repeats = store(own.filter("older").select("row", "span"), "repeats")
        self.levels.append((0, own))
        release(self.spark)
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels[-2:]
            merged = self._write(self._merged(a, b))
            self.levels[-2:] = [(rank + 1, merged)]
            forget(a)
            forget(b)
            release(self.spark)
        return repeats

    def entries(self) -> DataFrame:
        out = None
        for _, table in self.levels:
            out = self._level(table) if out is None else out.unionByName(self._level(table))
        return out

    def contested(self) -> DataFrame:
        """row, g, span: the first occurrences of runs whose gram also has another run; stored."""
        mixed = store(self.entries().groupBy("g").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a < b").select(F.col("g").alias("g2")), "mixed")
        release(self.spark)
        out = store(self.entries().select("row", "g", "span").join(mixed, F.col("g") == F.col("g2")).select("row", "g", "span"), "contested")
        forget(mixed)
        return out

    def close(self) -> None:
        for _, table in self.levels:
            forget(table)
        self.levels = []


def numbered(docs: DataFrame) -> DataFrame:
    """row and the columns of docs (doc_id, text, ...); row orders the documents. It is doc_id itself where that is a key."""
    ids = docs.select("doc_id").groupBy("doc_id").count()
    if not ids.filter("doc_id IS NULL OR count > 1").limit(1).count():
        return docs.withColumn("row", F.col("doc_id").cast("long"))
    return store(docs.orderBy("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "numbered")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """row, spans (packed: start * 1024 + windows) of all windows that also start earlier.

    docs: row, text, laid out by row (store_by), so that texts meet what is asked of them without a shuffle.
    """
    spark = docs.sparkSession
    batches = max(BATCHES, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // batch_bytes))
    cuts = docs.agg(F.percentile_approx("row", [i / batches for i in range(1, batches)])).first()[0] or []
    bounds = [None, *sorted(set(cuts)), None]
    family, found = SuffixFamily(spark, length, gram), []
    try:
        for low, high in zip(bounds, bounds[1:]):
            part = docs if low is None else docs.filter(F.col("row") > low)
            found.append(family.ingest(part if high is None else part.filter(F.col("row") <= high)))
        contested = family.contested()
    finally:
        family.close()
    release(spark)
    asked = contested.groupBy(F.col("row").alias("r2")).agg(F.collect_list(F.struct("g", "span")).alias("runs"))
    texts = docs.select("row", "text").join(asked, F.col("row") == F.col("r2")).select("row", "text", F.col("runs.g").alias("grams"), F.col("runs.span").alias("spans"))
    windows = texts.mapInArrow(_window_rows(length), "g bigint, h bigint, row bigint, p bigint")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = windows.repartition(n, "g", F.coalesce("h", F.xxhash64("row", "p"))).sortWithinPartitions("g", "h", "row", "p")
    found.append(store(spread.mapInArrow(_later, "row bigint, span bigint"), "windows"))
    forget(contested)
    release(spark)
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return every.groupBy("row").agg(F.collect_list("span").alias("spans"))


def _apply(length: int, keep):
    """Turns (…, text, spans) batches into what keep gives for (bytes, starts, ends)."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            rows = []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                spans = spans.as_py()
                a, b = covered(np.array(spans, np.int64), len(data), length) if spans else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                rows.append(keep(data, a, b))
            extra = pa.Table.from_pylist(rows) if rows else None
            if extra is None:
                continue
            carried = [n for n in names if n not in ("text", "spans", *extra.column_names)]
            extra = extra.combine_chunks()
            cols = [batch.column(n) for n in carried] + [extra.column(n).chunk(0) for n in extra.column_names]
            yield pa.RecordBatch.from_arrays(cols, [*carried, *extra.column_names])

    return run


def kept_bytes(data: bytes, a: np.ndarray, b: np.ndarray) -> bytes:
    at, parts = 0, []
    for s, e in zip(a.tolist(), b.tolist()):
        parts.append(data[at:s])
        at = e
    parts.append(data[at:])
    return b"".join(parts)


def _judged(docs: DataFrame, keep, schema, length: int, **how) -> DataFrame:
    """docs (doc_id, text, ...) without text, and what keep says of each text; stored."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with scratch(spark) as stay:
        rows = store_by(numbered(docs).repartition(n, "row"), "by-row", ["row"], "zstd")
        release(spark)
        spans = repeated_spans(rows.select("row", "text"), length=length, **how)
        joined = rows.join(spans.select(F.col("row").alias("_r"), "spans"), F.col("row") == F.col("_r"), "left")
        return stay(joined.select(*[F.col(c) for c in docs.columns if c != "text"], "text", "spans").mapInArrow(_apply(length, keep), schema), "judged", "zstd")


def remove_repeats(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """docs with text without its repeated bytes; a character that was cut goes as a whole. The last column, n_removed, is new; where docs has one, its name gets _ added until none has it."""
    keep = lambda data, a, b: {"text": kept_bytes(data, a, b).decode("utf-8", "ignore"), "n_removed": int((b - a).sum())}
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_doc"))
    kind = T.StructType([T.StructField("doc_id", whole.schema["doc_id"].dataType), T.StructField("_doc", whole.schema["_doc"].dataType), T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType())])
    cut = _judged(whole, keep, kind, length, **how)
    added = "n_removed"
    while added in docs.columns:
        added += "_"
    return cut.select(*[F.col("text") if c == "text" else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns], F.col("n_removed").alias(added))


def digests(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def keep(data, a, b):
        return {"n_bytes": len(data), "n_removed": int((b - a).sum()), "n_spans": len(a), "kept_sha256": hashlib.sha256(kept_bytes(data, a, b)).hexdigest()}

    return _judged(docs.select(F.col("doc_id").cast("long"), "text"), keep, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", length, **how)


def op9_suffix_dedup(spark, sf_dir):
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
SQL: dict[str, str] = {}
