"""MinHash near-duplicates: minima of many universal hashes, bands, verification, star components.

1. One pass over the texts gives each document's shingle-set hash (128 bits), minima (one byte
   of each, for estimates) and band keys. Documents with one set are a class; its least
   doc_id stands for it from here on, so thousands of copies are one row.
2. Band buckets: each representative is tried against the least of all its buckets. Tries pass
   a signature estimate first, then the exact test on full shingle sets of the texts.
3. Components by alternating large-star and small-star. In every bucket that still has more
   than one, all documents are compared with one reference, the least document of the bucket's largest
   component. Two of them can only be linked (while one isn't linked to the reference) if they
   share enough of their differences from it; an index over the rarest differences, by classes of how far
   documents are from the reference, finds all such pairs (see _sharing). So no link between candidates is lost, and a large group of near
   copies isn't expanded into its pairs.
4. Components again over all links.

With 36 bands of 5 rows a pair at similarity 0.85 shares no bucket with probability 7e-10.

Cases: null or empty text, or one of white space: n_shingles 0, linked with nothing; repeated
rows (and doc_ids): each row is returned, with the component of its doc_id; doc_id null: kept,
linked with nothing; fewer words than a shingle: the whole sequence is one; very long texts: whole;
empty table: no rows; extra columns: ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import bounded, forget, packed, scratch, store
from .components import components

WORDS, PERCENT, BANDS, ROWS = 3, 85, 36, 5
#: Standard errors below the threshold at which an estimate still goes on to the exact test.
SLACK = 6.5


def _signatures(words: int, bands: int, rows: int):
    minima = kernels.Minima(bands * rows)
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            n, s1, s2, sig, keys = [], [], [], [], []
            for items in kernels.shingle_sets(batch.column(1), words):
                n.append(len(items))
                if not len(items):
                    s1.append(None), s2.append(None), sig.append(None), keys.append(None)
                    continue
                m = minima(items)
                s1.append(int(np.add.reduce(items).view(np.int64)))
                s2.append(int(np.add.reduce(kernels.mix(items ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)))
                sig.append((m & np.uint32(255)).astype(np.uint8).tobytes())
                keys.append(kernels.band_keys(m, bands, rows).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=schema
            )

    return run, "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, sig binary, bands array<bigint>"


def _likely(percent: int):
    """Keeps pairs whose signatures agree well enough; columns u, v, sig_u, sig_v."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                same = float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())
                least = percent / 100 - SLACK * (percent / 100 * (1 - percent / 100) / len(a)) ** 0.5
                keep.append((same - 1 / 256) / (1 - 1 / 256) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _exact(words: int, percent: int):
    """Keeps pairs linked by their full shingle sets; columns u, v, text_u, text_v."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(kernels.shingle_sets(batch.column(2), words), kernels.shingle_sets(batch.column(3), words)):
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) that hold, stored: by signature first, then on full sets."""
    side = lambda k: sigs.select(F.col("doc_id").alias(f"id_{k}"), F.col("sig").alias(f"sig_{k}"), F.col("n_shingles").alias(f"n_{k}"))
    pairs = store(pairs, "pairs")
    with_u = store(side("u").join(bounded(pairs), F.col("u") == F.col("id_u")).select("u", "v", "sig_u", "n_u"), "pairs")
    with_sigs = side("v").join(with_u, F.col("v") == F.col("id_v"))
    sized = with_sigs.filter(F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent)
    likely = store(sized.select("u", "v", "sig_u", "sig_v").mapInArrow(_likely(percent), "u bigint, v bigint"), "likely")
    forget(pairs)
    forget(with_u)
    if likely.isEmpty():
        return likely
    joined, found = _paired(likely, texts, ["u", "v"])
    out = store(joined.mapInArrow(_exact(words, percent), "u bigint, v bigint"), "links")
    forget(likely)
    forget(found)
    return out


def _paired(pairs: DataFrame, texts: DataFrame, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """pairs (stored; u, v, ...) with the texts of both, and the table of texts that is read for it."""
    asked = store(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "ids")
    found = store(texts.join(bounded(asked), F.col("doc_id") == F.col("id"), "left_semi").select("doc_id", "text"), "texts")
    side = lambda k: found.select(F.col("doc_id").alias(f"id_{k}"), F.col("text").alias(f"text_{k}"))
    with_u = side("u").join(bounded(pairs), F.col("u") == F.col("id_u"))
    return with_u.join(side("v"), F.col("v") == F.col("id_v")).select(*carried, "text_u", "text_v"), found


def _differences(words: int, percent: int):
    """(u, v, part_u, text_u, text_v) -> sizes of both sets, whether they are linked, and the elements in one of them only."""

    def run(batches):
        for batch in batches:
            n_u, n_v, linked, diff = [], [], [], []
            for a, b in zip(kernels.shingle_sets(batch.column(3), words), kernels.shingle_sets(batch.column(4), words)):
                odd = np.setxor1d(a, b, assume_unique=True)
                both = (len(a) + len(b) - len(odd)) // 2
                n_u.append(len(a)), n_v.append(len(b)), diff.append(odd.view(np.int64))
                linked.append(100 * both >= percent * (len(a) + len(b) - both))
            cols = [*batch.columns[:3], pa.array(n_u, pa.int64()), pa.array(n_v, pa.int64()), pa.array(linked, pa.bool_()), pa.array(diff, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["u", "v", "part_u", "n_u", "n_v", "linked", "diff"])

    return run


def _div(a: Column, b) -> Column:
    """Floor division of whole numbers by positive ones."""
    b = F.lit(b) if isinstance(b, int) else b
    return ((a - F.pmod(a, b)) / b).cast("long")


def _sharing(gaps: DataFrame, percent: int) -> DataFrame:
    """Pairs that may be linked among documents compared with one reference v, given their differences from it.

    Let D(x) be the symmetric difference of x and v, t = (100 - percent) / (100 + percent) and g(x) = |D(x)| - t |x|.
    x and y are linked iff |x ^ y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)| <= t (|x| + |y|), so iff they share at least
    o = (g(x) + g(y)) / 2 of their differences. That is over 0 where x isn't linked to v. With the elements in one
    order, rarest first, the first that both have stands among the first |D| - o + 1 of each, and leaves either side enough
    to make up o. Documents are put into classes of g as wide as t |v|, and each gives its first elements once for
    each class that a partner may be in, as many as the least g there asks for. So the lists are about as short as if each pair
    had its own: edits that no document of another component has count first and meet none, and what many have
    (the reference's own words, or a passage that all share) comes last and is seldom reached. No pair that is linked is lost.
    """
    over, under = 100 + percent, 100 - percent
    size = F.size("diff").cast("long")
    each = gaps.select("u", "v", "part_u", "diff", (~F.col("linked") & (F.col("part_u") != F.col("v"))).alias("probe"), (size * over - F.col("n_u") * under).alias("g"), F.greatest(F.lit(1), F.col("n_v") * under).alias("width"))
    each = each.withColumn("class", _div(F.col("g"), F.col("width")))
    # of a reference: the classes there are, and those with documents that ask; their number is bounded by the texts' sizes
    classes = each.groupBy(F.col("v").alias("v3")).agg(F.collect_set("class").alias("all"), F.collect_set(F.when(F.col("probe"), F.col("class"))).alias("asking")).filter(F.size("asking") > 0)
    flat = each.select("u", "v", "part_u", F.explode("diff").alias("e"))
    often = flat.groupBy(F.col("v").alias("v2"), F.col("e").alias("e2")).agg(F.count("*").alias("n"), F.min("part_u").alias("a"), F.max("part_u").alias("b")).filter("a < b")
    shared = flat.join(often, (F.col("v") == F.col("v2")) & (F.col("e") == F.col("e2")))
    lists = shared.groupBy(F.col("u").alias("u4"), F.col("v").alias("v4")).agg(F.sort_array(F.collect_list(F.struct("n", "e"))).alias("es"))
    plain = each.select("u", "v", "part_u", "probe", "g", "width", "class", size.alias("size"))
    lists = plain.join(lists, (F.col("u") == F.col("u4")) & (F.col("v") == F.col("v4")))
    lists = lists.join(bounded(classes), F.col("v") == F.col("v3")).withColumn("es", F.transform("es", lambda x: x["e"]))

    def first(partners):
        """For each class of partners, the elements that count: (e, class, elements from it on)."""
        alone = F.col("size") - F.size("es")
        needed = lambda k: F.greatest(F.lit(1), -_div(-(F.col("g") + k * F.col("width")), 2 * over))
        many = lambda k: F.greatest(F.lit(0), F.col("size") - needed(k) + 1 - alone).cast("int")
        return F.flatten(F.transform(partners, lambda k: F.transform(F.slice("es", F.lit(1), many(k)), lambda e, i: F.struct(e.alias("e"), k.alias("k"), (F.size("es") - i).alias("left")))))

    lists = store(lists.select("u", "v", "part_u", "g", "class", F.when(F.col("probe"), first(F.col("all"))).alias("probes"), first(F.col("asking")).alias("members")), "differences")
    probes = lists.select("u", F.col("v").alias("ref"), "part_u", F.col("g").alias("g_u"), F.col("class").alias("c"), F.explode("probes").alias("x")).select("u", "ref", "part_u", "g_u", "c", "x.e", "x.k", F.col("x.left").alias("left_u"))
    members = lists.select(F.col("u").alias("w"), F.col("v").alias("ref2"), F.col("part_u").alias("part_w"), F.col("g").alias("g_w"), F.col("class").alias("k2"), F.explode("members").alias("x")).select(
        "w", "ref2", "part_w", "g_w", "k2", F.col("x.e").alias("e2"), F.col("x.k").alias("c2"), F.col("x.left").alias("left_w")
    )
    same = (F.col("ref") == F.col("ref2")) & (F.col("e") == F.col("e2")) & (F.col("c") == F.col("c2")) & (F.col("k") == F.col("k2"))
    enough = F.col("g_u") + F.col("g_w") <= F.least("left_u", "left_w") * (2 * over)
    met = probes.join(members, same & (F.col("part_u") != F.col("part_w")) & enough)
    return met.select(F.least("u", "w").alias("u"), F.greatest("u", "w").alias("v")).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text); stored."""
    with scratch(docs.sparkSession) as keep:
        return keep(_linked(docs, words, percent, bands, rows), "near-duplicates")


def _linked(docs: DataFrame, words: int, percent: int, bands: int, rows: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    owner = None
    if not texts.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        # a doc_id may have several texts: rows are compared by their place in the order of doc_id, and those of a doc_id linked
        placed = store(texts.orderBy("doc_id", "text").withColumn("place", F.monotonically_increasing_id()), "placed")
        owner = placed.select("place", F.col("doc_id").alias("owner"))
        texts = placed.select(F.when(F.col("doc_id").isNotNull(), F.col("place")).alias("doc_id"), "text")
    run, schema = _signatures(words, bands, rows)
    sigs = store(texts.mapInArrow(run, schema), "signatures")
    full = sigs.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = store(full.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    reps = store(
        full.join(classes.select(F.col("rep"), F.col("s1").alias("c1"), F.col("s2").alias("c2")), (F.col("doc_id") == F.col("rep")) & (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")))
        .select("doc_id", "n_shingles", "sig", "bands"),
        "reps",
    )
    member = full.select("doc_id", F.col("s1").alias("m1"), F.col("s2").alias("m2"), F.col("n_shingles").alias("m3")).join(
        classes, (F.col("m1") == F.col("s1")) & (F.col("m2") == F.col("s2")) & (F.col("m3") == F.col("n_shingles"))
    ).select(F.col("doc_id").alias("id"), "rep")
    # round one: the least of all buckets
    entries = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("u"))
    buckets = entries.groupBy("key").agg(F.min("u").alias("v"), F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("k"), "v")
    tries = entries.join(buckets, F.col("key") == F.col("k")).filter("u <> v").groupBy("u").agg(F.min("v").alias("v"))
    links = _verified(tries, reps, texts, words, percent)
    if owner is not None:
        owned = store(member.join(owner, F.col("id") == F.col("place")).select("owner", F.col("rep").alias("u")), "owned")
        least = owned.groupBy("owner").agg(F.min("u").alias("v")).withColumnRenamed("owner", "o")
        links = links.unionByName(owned.join(least, F.col("owner") == F.col("o")).filter("u <> v").select("u", "v").distinct())
    parts = components(links)
    # round two: pairs across components in one bucket
    tagged = reps.join(parts, F.col("doc_id") == F.col("node"), "left").select("doc_id", "bands", F.coalesce("component", "doc_id").alias("part"))
    entries = tagged.select(F.explode("bands").alias("key"), F.col("doc_id").alias("u"), F.col("part").alias("part_u"))
    mixed = entries.groupBy("key").agg(F.min("part_u").alias("a"), F.max("part_u").alias("b")).filter("a < b").select(F.col("key").alias("k"))
    rest = store(entries.join(mixed, F.col("key") == F.col("k")).select("key", "u", "part_u"), "rest")
    sizes = rest.groupBy("key", "part_u").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "part_u")).alias("top")).select(F.col("key").alias("k"), F.col("top.part_u").alias("main"))
    asked = store(rest.join(main, F.col("key") == F.col("k")).select("u", F.col("main").alias("v"), "part_u").distinct(), "asked")
    more = links
    if not asked.isEmpty():
        joined, found = _paired(asked.filter("u <> v"), texts, ["u", "v", "part_u"])
        gaps = store(joined.mapInArrow(_differences(words, percent), "u bigint, v bigint, part_u bigint, n_u bigint, n_v bigint, linked boolean, diff array<bigint>"), "gaps")
        forget(found)
        more = more.unionByName(gaps.filter("linked").select("u", "v"))
        more = more.unionByName(_verified(_sharing(gaps, percent), reps, texts, words, percent))
        parts = components(more)
    label = member.join(parts, F.col("rep") == F.col("node"), "left").select("id", F.coalesce("component", "rep").alias("label"))
    if owner is not None:
        # back from places to doc_ids, and one label for all rows of a doc_id
        first = owner.select(F.col("place").alias("p"), F.col("owner").alias("first"))
        named = label.join(owner, F.col("id") == F.col("place")).join(first, F.col("label") == F.col("p"))
        label = named.groupBy(F.col("owner").alias("id")).agg(F.min("first").alias("label"))
        sigs = sigs.join(owner, F.col("doc_id") == F.col("place"), "left").select(F.col("owner").alias("doc_id"), "n_shingles")
    out = sigs.select("doc_id", "n_shingles").join(label, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("label", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs without the documents that are near copies of one with a smaller id; columns as they are."""
    gone = near_duplicates(docs.select("doc_id", "text"), **how).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return packed(docs, "doc_id").join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select("_doc.*")


def op3_minhash_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_minhash_dedup": op3_minhash_dedup}
SQL: dict[str, str] = {}
