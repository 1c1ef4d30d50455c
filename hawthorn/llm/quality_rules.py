"""Quality rules: base rules on each text, and robust multivariate outliers by group. DataFrame functions only.

Base: a text fails with fewer than 10 words, or with over 20 % of its words in five-word windows
that occur twice or more in it.

Outliers: each text gives a vector of transformed statistics (log mean word length; square
roots of the shares of symbols, capitals and punctuation in its word characters; shares are
drawn towards the corpus's own share as by 200 more characters, so that short texts aren't
outliers by chance). For each language and source the minimum-covariance-determinant
estimate is taken. It has three starts, all at the medians with absolute deviations as scales: without correlation, with
that of the rows' directions from the medians, and with that of hyperbolic tangents. From each, concentration steps keep
the three quarters of rows nearest by Mahalanobis distance, the distance's quantile being read
off a histogram of fixed bins (so a group of any size is bounded counts), until no determinant moves; the start with the least
determinant is taken, then one reweighting step. Rows over the cutoff are rejected. Variances have a floor, since
most texts have no symbol at all.

Groups under `least` rows are pooled within their language, then over all; fewer than that in all:
nothing is rejected as an outlier. Cases: null or empty text: no words, base_failed; null lang or
source: a group of its own; repeated rows: each judged; very long texts: whole; empty table:
no rows; extra columns: ignored by judge(), kept by keep_good().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gathered, keyed_join, let, packed, release, scratch, store

SPACE = r"[\x20\x09-\x0D]+"
DIMS = 4
#: Share of rows that a concentration step keeps; tail of the chi-square distribution at which a row is rejected.
SHARE, TAIL = 0.75, 1e-3
FLOOR = (0.03, 0.03, 0.03, 0.03)
#: Most concentration steps; rows that a group has at least; characters of the corpus's own shares that each text is given.
STEPS, LEAST, PRIOR = 12, 50, 200
#: Bins that a group has about; groups' tables are written by as many tasks as their number asks for.
BINS = 1000
Z = [f"z{i}" for i in range(DIMS)]
KEYS = ["g_lang", "g_source"]
PLACES = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _chi2_cdf(x: float, dof: int) -> float:
    """For an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def _chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, dof) < p else (low, mid)
    return low


def repeat_words(words: Column) -> Column:
    """Words in five-word windows that occur twice or more. Hashes only rule out repeats; texts decide them."""

    def marked(windows):
        same = lambda a, b: a["k"] == b["k"]
        twice = F.filter(windows, lambda x, j: ((j > 0) & F.coalesce(same(x, F.get(windows, j - 1)), F.lit(False))) | F.coalesce(same(x, F.get(windows, j + 1)), F.lit(False)))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(5), F.coalesce(F.get(p, j + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x))

    def of(w):
        at = F.sequence(F.lit(1), F.size(w) - 4)
        exact = let(F.sort_array(F.transform(at, lambda i: F.struct(F.array_join(F.slice(w, i, 5), " ").alias("k"), i.alias("i")))), marked)
        hashes = F.transform(at, lambda i: F.xxhash64(F.slice(w, i, 5)))
        some = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
        return F.when(F.size(w) < 5, F.lit(0)).when(some, exact).otherwise(F.lit(0))

    return let(words, of)


def statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_punct (prefix q_)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.filter(F.split(text, SPACE), lambda x: x != "")
    only = lambda keep: F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")
    facts = let(
        words,
        lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeat_words(w).cast("long").alias("repeat")),
    )
    return docs.withColumn("_facts", facts).select(
        *docs.columns,
        F.col("_facts.n").alias("q_n_words"), F.col("_facts.chars").alias("q_word_chars"), F.col("_facts.repeat").alias("q_n_repeat_words"),
        only(r"#*$%&|<>").alias("q_n_symbols"), only("A-Z").alias("q_n_upper"), only(r"!?.,;:").alias("q_n_punct"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("q_n_dup_lines"),
    )


def _base_failed() -> Column:
    return (F.col("q_n_words") < 10) | (F.col("q_n_repeat_words") * 100 > F.col("q_n_words") * 20)


def _vectors(stats: DataFrame, shares: dict[str, float]) -> DataFrame:
    """stats with z0..z3."""
    share = lambda c: F.sqrt((F.col(c) + PRIOR * shares[c]) / (F.col("q_word_chars") + PRIOR))
    length = F.log((F.col("q_word_chars") + PRIOR) / (F.col("q_n_words") + PRIOR / shares["length"]))
    return stats.withColumns({"z0": length, "z1": share("q_n_symbols"), "z2": share("q_n_upper"), "z3": share("q_n_punct")})


def _quantile(rows: DataFrame, keys: list[str], bin_col: str, q: float, n: int) -> DataFrame:
    """keys (of n values), cut: the first bin that with those below holds the share q of the rows."""
    counts = rows.groupBy(*keys, bin_col).agg(F.count("*").alias("n"))
    total = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(bin_col, "n"))).alias("bins"), F.sum("n").alias("total"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("cut"))
    step = lambda a, x: F.struct((a["sum"] + x["n"]).alias("sum"), F.coalesce(a["cut"], F.when(a["sum"] + x["n"] >= F.ceil(F.col("total") * q), x[bin_col])).alias("cut"))
    return gathered(total.select(*keys, F.aggregate("bins", start, step)["cut"].alias("cut")), n * BINS)


def _whitened(groups: DataFrame, keys: list[str]) -> DataFrame:
    """keys, m0.., w00.., logdet from keys, m0.., c00..: the inverse of the covariance's Cholesky factor."""
    g = groups
    for i, j in PLACES:
        s = F.col(f"c{i}{j}")
        for k in range(j):
            s = s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        g = g.withColumn(f"l{i}{j}", F.sqrt(F.greatest(s, F.lit(FLOOR[i] ** 2 / 100))) if i == j else s / F.col(f"l{j}{j}"))
    for i, j in PLACES:
        if i == j:
            g = g.withColumn(f"w{i}{j}", 1 / F.col(f"l{i}{i}"))
        else:
            s = F.lit(0.0)
            for k in range(j, i):
                s = s + F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
            g = g.withColumn(f"w{i}{j}", -s / F.col(f"l{i}{i}"))
    logdet = sum((F.log(f"l{i}{i}") * 2 for i in range(1, DIMS)), F.log("l00") * 2)
    return g.select(*keys, *[f"m{i}" for i in range(DIMS)], *[f"w{i}{j}" for i, j in PLACES], logdet.alias("logdet"))


def _distance() -> Column:
    total = F.lit(0.0)
    for i in range(DIMS):
        s = F.lit(0.0)
        for j in range(i + 1):
            s = s + F.col(f"w{i}{j}") * (F.col(Z[j]) - F.col(f"m{j}"))
        total = total + s * s
    return total


def _moments(rows: DataFrame, keys: list[str], factor: float, n: int) -> DataFrame:
    """keys (of n values), m0.., c00.. of the rows, covariances times factor and with the floor."""
    sums = [F.count("*").alias("n"), *[F.sum(z).alias(f"s{i}") for i, z in enumerate(Z)]]
    sums += [F.sum(F.col(Z[i]) * F.col(Z[j])).alias(f"p{i}{j}") for i, j in PLACES]
    g = gathered(rows.groupBy(*keys).agg(*sums), n)
    out = [(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(DIMS)]
    for i, j in PLACES:
        c = (F.col(f"p{i}{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * F.col(f"s{j}") / F.col("n")) * factor
        out.append((c + F.lit(FLOOR[i] ** 2) if i == j else c).alias(f"c{i}{j}"))
    return g.select(*keys, *out)


def _starts(rows: DataFrame, wide: DataFrame, n: int) -> DataFrame:
    """keys, start, m0.., c00..: three first estimates for each group; wide: keys, m0.. (medians), d0.. (deviations), n rows."""
    near = keyed_join(rows, wide, KEYS, "inner", known=n).withColumns({f"y{i}": (F.col(Z[i]) - F.col(f"m{i}")) / F.sqrt(F.col(f"d{i}") ** 2 + FLOOR[i] ** 2) for i in range(DIMS)})
    square = sum((F.col(f"y{i}") ** 2 for i in range(DIMS)), F.lit(0.0))
    kinds = [("a", lambda i: F.col(f"y{i}") / F.sqrt(square + 1e-12)), ("b", lambda i: F.tanh(f"y{i}"))]
    sums = near.groupBy(*KEYS).agg(*[F.sum(x(i) * x(j)).alias(f"{k}{i}{j}") for k, x in kinds for i, j in PLACES])
    both = wide.join(gathered(sums, n), KEYS)
    scale = lambda i: F.sqrt(F.col(f"d{i}") ** 2 + FLOOR[i] ** 2)
    out = None
    for start, k in enumerate(("", "a", "b")):
        r = lambda i, j: F.coalesce(F.col(f"{k}{i}{j}") / F.sqrt(F.col(f"{k}{i}{i}") * F.col(f"{k}{j}{j}")), F.lit(0.0)) * 0.99 if k else F.lit(0.0)  # noqa: B023, E731
        c = [((F.lit(1.0) if i == j else r(i, j)) * scale(i) * scale(j)).alias(f"c{i}{j}") for i, j in PLACES]
        one = both.select(*KEYS, F.lit(start).alias("start"), *[f"m{i}" for i in range(DIMS)], *c)
        out = one if out is None else out.unionByName(one)
    return out


class Estimate:
    """Corpus shares, pooled groups and robust estimates of each group; all tables are small and stored."""

    def __init__(self, stats: DataFrame, steps: int = STEPS, least: int = LEAST):
        sums = stats.agg(*[F.sum(c).alias(c) for c in ("q_word_chars", "q_n_words", "q_n_symbols", "q_n_upper", "q_n_punct")]).first()
        chars = max(1, sums.q_word_chars or 0)
        self.shares = {c: (sums[c] or 0) / chars for c in ("q_n_symbols", "q_n_upper", "q_n_punct")} | {"length": chars / max(1, sums.q_n_words or 0)}
        sizes = stats.groupBy("lang", "source").agg(F.count("*").alias("n"))
        one = sizes.withColumn("g_source", F.when(F.col("n") >= least, F.concat(F.lit("="), F.coalesce("source", F.lit("\0")))).otherwise("*"))
        two = one.groupBy("lang", "g_source").agg(F.sum("n").alias("n2")).withColumnsRenamed({"lang": "lang2", "g_source": "source2"})
        both = one.join(two, one.lang.eqNullSafe(two.lang2) & (one.g_source == two.source2))
        self.pools = store(
            both.select("lang", "source", F.when(F.col("n2") >= least, F.concat(F.lit("="), F.coalesce("lang", F.lit("\0")))).otherwise("*").alias("g_lang"), F.when(F.col("n2") >= least, F.col("g_source")).otherwise("*").alias("g_source")), "pools"
        )
        rows = self.vectors(stats.select("lang", "source", *[c for c in stats.columns if c.startswith("q_")])).filter("q_n_words > 0").select(*KEYS, *Z)
        rows = store(rows, "vectors")
        enough = store(rows.groupBy(*KEYS).agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(*KEYS), "enough")
        n = enough.count()
        # medians and absolute deviations, dimension by dimension, in bins of 1/2000
        long = rows.select(*KEYS, F.posexplode(F.array(*Z)).alias("dim", "z")).withColumn("bin", F.floor(F.col("z") * 2000))
        mids = store(_quantile(long, [*KEYS, "dim"], "bin", 0.5, DIMS * n).select(*KEYS, "dim", ((F.col("cut") + 0.5) / 2000).alias("mid")), "mids")
        away = keyed_join(long.drop("bin"), mids, [*KEYS, "dim"], "inner").withColumn("bin", F.floor(F.abs(F.col("z") - F.col("mid")) * 2000))
        mads = _quantile(away, [*KEYS, "dim"], "bin", 0.5, DIMS * n).select(*KEYS, "dim", ((F.col("cut") + 0.5) / 2000 * 1.4826).alias("mad"))
        wide = mids.join(mads, [*KEYS, "dim"]).groupBy(*KEYS).agg(
            *[F.max(F.when(F.col("dim") == i, F.col("mid"))).alias(f"m{i}") for i in range(DIMS)],
            *[F.max(F.when(F.col("dim") == i, F.col("mad"))).alias(f"d{i}") for i in range(DIMS)],
        )
        tried = [*KEYS, "start"]
        groups = store(_whitened(_starts(rows, store(gathered(wide.join(enough, KEYS), n), "wide"), n), tried), "groups")
        kept_cov = SHARE / _chi2_cdf(_chi2_quantile(SHARE, DIMS), DIMS + 2)
        for step in range(steps):
            far = keyed_join(rows, groups, KEYS, "inner", 3 * n).select(*tried, *Z, F.floor(F.log(_distance() + 1e-4) * 64).alias("bin"))
            cuts = store(_quantile(far, tried, "bin", SHARE, 3 * n), "cuts")
            near = keyed_join(far, cuts, tried, "inner", 3 * n).filter("bin <= cut")
            before = groups.select(*[F.col(k).alias(f"b_{k}") for k in tried], F.col("logdet").alias("b_logdet"))
            groups = store(_whitened(_moments(near, tried, kept_cov, 3 * n), tried), "groups")
            if step % 3 == 2:
                moved = groups.join(before, [F.col(k) == F.col(f"b_{k}") for k in tried]).filter(F.abs(F.col("logdet") - F.col("b_logdet")) > 1e-9)
                if moved.isEmpty():
                    break
                release(rows.sparkSession)
        least_det = groups.groupBy(*KEYS).agg(F.min(F.struct("logdet", "start", *[c for c in groups.columns if c[0] in "mw"])).alias("g")).select(*KEYS, "g.*")
        least_det = gathered(least_det, n)
        near = keyed_join(rows, store(least_det, "groups"), KEYS, "inner", n).filter(_distance() <= _chi2_quantile(0.975, DIMS))
        self.groups = store(_whitened(_moments(near, KEYS, 0.975 / _chi2_cdf(_chi2_quantile(0.975, DIMS), DIMS + 2), n), KEYS).drop("logdet"), "groups")
        self.n = n
        release(rows.sparkSession)

    def vectors(self, stats: DataFrame) -> DataFrame:
        return _vectors(keyed_join(stats, self.pools, ["lang", "source"]), self.shares)

    def distances(self, stats: DataFrame) -> DataFrame:
        """stats with base_failed, distance (null: no estimate or no words) and kept."""
        far = keyed_join(self.vectors(stats), self.groups, KEYS, known=self.n)
        far = far.withColumn("distance", F.when(F.col("q_n_words") > 0, _distance())).withColumn("base_failed", _base_failed())
        return far.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= _chi2_quantile(1 - TAIL, DIMS), F.lit(True)))


def judge(docs: DataFrame) -> DataFrame:
    """One row for each of docs (doc_id, text, lang, source); stored."""
    plain = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    with scratch(docs.sparkSession) as keep:
        stats = store(statistics(docs.select("doc_id", "text", "lang", "source")).drop("text"), "statistics")
        judged = Estimate(stats).distances(stats)
        return keep(judged.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in plain], "base_failed", "kept", "distance"), "judged")


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the rejected ones; columns as they are. Rows are stored once beside their statistics, so that texts are judged in one pass."""
    stats = store(statistics(packed(docs, "text", "lang", "source")).drop("text"), "statistics", "zstd")
    return Estimate(stats).distances(stats).filter("kept").select("_doc.*")


def op7_quality_rules(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_quality_rules": op7_quality_rules}
SQL: dict[str, str] = {}
