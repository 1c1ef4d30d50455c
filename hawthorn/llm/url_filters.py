"""URL filters: explicit rules, and trust and distrust carried over host links. DataFrame functions only.

A rule (host, path) fits its host and all subdomains of it where the url's path starts
with the rule's path; the longest rule wins. What no rule decides, the link graph does:
personalised PageRank from trusted seeds (hosts with allowed pages) along the links, and the
same from blocked seeds (hosts with blocked pages) against the links. Both masses are counted in
seed pages: a host is blocked if its distrust, times all blocked pages, exceeds its trust, times all allowed pages, and
reaches what a host without inflow has whose pages are blocked to `percent` in a hundred. So a host
is held against its own size, whatever the share of blocked pages in the corpus; distrust that comes over links adds to its own.
What flows to a host without links ends there.

Each round moves at most damping/100 of what the round before moved, so after `rounds` at most 0.6 % of
all mass can still move; rounds end earlier where four of them changed nothing at all, which gives the same masses.

Mass is kept in whole units of 2**-40 and divided exactly in decimals, so that
results don't depend on the order of summing, on retried tasks or on the engine.

Links are absolute or //-relative href/src addresses in the html, and one link from each
page to its host's parent domain (a.b.c -> b.c). Cases: null url or one without "://": host
and path empty, no rule, allowed unless the empty host is thresholded (it has no links, so never);
null html: no links; repeated rows: each judged, each counts; empty table: no rows; extra
columns: ignored. Rule lists are parameters of at most a few hundred entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_join, scratch, store

UNIT = 1 << 40
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)(?:href|src)\s*=\s*[\"']?(?:https?:)?//([^\"'\s>/?#]+)"
#: Rounds in all, and those between two looks at whether anything still moves.
ROUNDS, STEP = 32, 4
#: The rules of the query.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    tail = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(tail, r"^[^/?#]*", 0)
    path = F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, or null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts; pages has host and html."""
    parent = F.regexp_extract("host", r"^[^.]+\.([^.]+\..+)$", 1)
    found = F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER))
    targets = F.concat(F.coalesce(found, F.array().cast("array<string>")), F.array(parent))
    rows = pages.filter(F.col("host") != "").select(F.col("host").alias("src"), F.explode(targets).alias("dst"))
    return rows.filter((F.col("dst") != "") & (F.col("dst") != F.col("src"))).groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(links: DataFrame, seeds: DataFrame, hosts: DataFrame, rounds: int, damping: int) -> DataFrame:
    """host, mass after so many rounds; links: src, dst, n; seeds: host, seed (units, summing to at most UNIT)."""
    totals = links.groupBy("src").agg(F.sum("n").alias("total"))
    edges = store(links.join(totals, "src").select("src", "dst", "n", "total"), "links")
    base = store(hosts.join(seeds, "host", "left").select("host", F.coalesce("seed", F.lit(0)).cast("long").alias("seed")), "seeds")
    settled = mass = base.select("host", F.col("seed").alias("mass"))
    for i in range(rounds):
        sent = edges.join(mass, edges.src == mass.host).select(F.col("dst").alias("host"), F.expr("(cast(mass as decimal(19,0)) * cast(n as decimal(19,0))) div total").alias("share"))
        got = sent.groupBy("host").agg(F.sum("share").alias("got"))
        mass = base.join(got, "host", "left").select("host", F.expr(f"(seed * {100 - damping} + coalesce(got, 0) * {damping}) div 100").alias("mass"))
        if i % STEP == STEP - 1:
            mass = store(mass, "mass")
            before = settled.select(F.col("host").alias("h"), F.col("mass").alias("m"))
            if mass.join(before, (F.col("host") == F.col("h")) & (F.col("mass") == F.col("m")), "left_anti").isEmpty():
                break
            settled = mass
    return mass


def judge(pages: DataFrame, rules=RULES, rounds: int = ROUNDS, damping: int = 85, percent: int = 50) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each row of pages (page_id, url, html); stored."""
    with scratch(pages.sparkSession) as keep:
        return keep(_judged(pages, rules, rounds, damping, percent), "judged")


def _judged(pages: DataFrame, rules, rounds: int, damping: int, percent: int) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", "url", "html", host.alias("host"), path.alias("path"))
    split = split.withColumn("hit", longest_rule(F.col("host"), F.col("path"), rules))
    links = store(host_links(split), "hostlinks")
    own = store(
        split.filter("host != ''").groupBy("host").agg(
            F.count("*").alias("pages"), F.count_if(F.col("hit.verdict") == "allow").alias("good"), F.count_if(F.col("hit.verdict") == "block").alias("bad")
        ),
        "hosts",
    )
    hosts = own.select("host").union(links.select("src")).union(links.select("dst")).distinct()
    good, bad = (x or 0 for x in own.agg(F.sum("good"), F.sum("bad")).first())

    def seeds(col: str, total: int) -> DataFrame:
        return own.filter(F.col(col) > 0).select("host", F.expr(f"(cast({col} as decimal(19,0)) * {UNIT}) div {max(1, total)}").alias("seed"))

    trust = spread(links, seeds("good", good), hosts, rounds, damping).withColumnRenamed("mass", "trust")
    distrust = spread(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), seeds("bad", bad), hosts, rounds, damping).withColumnRenamed("mass", "distrust")
    over = F.expr(f"cast(distrust as decimal(19,0)) * {bad} > cast(trust as decimal(19,0)) * {good}") & F.expr(
        f"cast(distrust as decimal(19,0)) * {bad} >= (cast(pages as decimal(19,0)) * {(100 - damping) * percent * UNIT}) div 10000"
    )
    verdicts = own.join(trust, "host").join(distrust, "host").select("host", "trust", "distrust", over.alias("over"))
    verdicts = store(verdicts, "verdicts")
    judged = keyed_join(split.drop("html", "url"), verdicts, ["host"])
    return judged.select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.when(F.col("over"), F.lit("block")), F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0)).cast("long").alias("trust"), F.coalesce("distrust", F.lit(0)).cast("long").alias("distrust"),
    )


def op1_url_filters(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def sql(rules=RULES, rounds: int = ROUNDS, damping: int = 85, percent: int = 50) -> str:
    """The same in DuckDB SQL, rounds unrolled."""
    case = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{what(h, p, v)}'" for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))) + " END"
    ctes = [
        "tails AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM pages)",
        f"parts AS (SELECT page_id, html, translate(regexp_extract(tail, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM tails)",
        f"hits AS (SELECT *, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS said FROM parts)",
        f"found AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{LINK.replace(chr(39), chr(39) * 2)}', 1)), '{UPPER}', '{LOWER}') AS dst FROM parts WHERE host <> '' UNION ALL SELECT host, regexp_extract(host, '^[^.]+\\.([^.]+\\..+)$', 1) FROM parts WHERE host <> '')",
        "links AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM found WHERE dst <> '' AND dst <> src GROUP BY 1, 2)",
        "own AS MATERIALIZED (SELECT host, count(*) AS pages, count(*) FILTER (said = 'allow') AS good, count(*) FILTER (said = 'block') AS bad FROM hits WHERE host <> '' GROUP BY 1)",
        "tot AS (SELECT coalesce(sum(good), 0)::HUGEINT AS g, coalesce(sum(bad), 0)::HUGEINT AS b FROM own)",
        "allhosts AS MATERIALIZED (SELECT host FROM own UNION SELECT src FROM links UNION SELECT dst FROM links)",
    ]
    for name, col, total, src, dst in (("t", "good", "g", "src", "dst"), ("d", "bad", "b", "dst", "src")):
        ctes.append(f"{name}e AS MATERIALIZED (SELECT {src} AS src, {dst} AS dst, n, sum(n) OVER (PARTITION BY {src}) AS total FROM links)")
        ctes.append(f"{name}s AS MATERIALIZED (SELECT h.host, coalesce((o.{col}::HUGEINT * {UNIT}) // (SELECT greatest({total}, 1) FROM tot), 0)::HUGEINT AS seed FROM allhosts h LEFT JOIN own o ON h.host = o.host)")
        ctes.append(f"{name}0 AS MATERIALIZED (SELECT host, seed AS mass FROM {name}s)")
        for i in range(rounds):
            ctes.append(
                f"{name}{i + 1} AS MATERIALIZED (SELECT s.host, (s.seed * {100 - damping} + coalesce(g.got, 0) * {damping}) // 100 AS mass FROM {name}s s LEFT JOIN "
                f"(SELECT e.dst, sum((m.mass * e.n) // e.total)::HUGEINT AS got FROM {name}e e JOIN {name}{i} m ON e.src = m.host GROUP BY 1) g ON s.host = g.dst)"
            )
    return "WITH " + ", ".join(ctes) + (
        f" SELECT h.page_id, h.host, h.path, h.rule, coalesce(h.said, CASE WHEN d.mass * (SELECT b FROM tot) > t.mass * (SELECT g FROM tot) AND d.mass * (SELECT b FROM tot) >= (o.pages::HUGEINT * {(100 - damping) * percent * UNIT}) // 10000 THEN 'block' END, 'allow') AS verdict, "
        f"coalesce(t.mass, 0)::BIGINT AS trust, coalesce(d.mass, 0)::BIGINT AS distrust FROM hits h LEFT JOIN own o ON h.host = o.host LEFT JOIN t{rounds} t ON h.host = t.host AND o.host IS NOT NULL LEFT JOIN d{rounds} d ON h.host = d.host AND o.host IS NOT NULL"
    )


QUERIES = {"op1_url_filters": op1_url_filters}
SQL = {"op1_url_filters": sql()}
