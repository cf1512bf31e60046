"""URL filters: rules on hosts and paths, and link-graph propagation for what no rule decides.

Trust flows along host edges from hosts whose pages the rules allow, distrust flows against them from
hosts whose pages the rules block (who links to bad hosts is suspect). Both are personalised PageRanks
over one table of edges between hosts; each host's verdict comes from its two scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longitrack.llm.common import remove, small, written

#: (verdict, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
DAMPING = 0.85
TOLERANCE = 1e-6
#: A host is blocked if its distrust is above its trust and at least that of a host without links, half of whose pages are blocked.
THRESHOLD = 0.5 * (1 - DAMPING)
#: Hosts in a page's absolute links.
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#"'\s>@]*@)?([^/?#"'\s>:]+)"""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ? or #, A to Z lower-cased; empty for null or without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules=None) -> DataFrame:
    return spark.createDataFrame([(v, h, p) for v, h, p in rules or RULES], "rule_verdict string, rule_host string, rule_path string")


def matched(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, rule_verdict) for the distinct (host, path) that a rule fits; the longest rule wins.

    A rule fits its host and all subdomains, if the path starts with the rule's. Every host meets the
    rules on its own suffixes by equality, so a blocklist of any length is one join. Of equal length
    and fit only one rule can exist, but for conflicting verdicts, of which block wins.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    ends = targets.where("host <> ''").select("host", "path", F.explode(suffixes).alias("rule_host"))
    fits = ends.join(small(rules), "rule_host").where(F.expr("startswith(path, rule_path)"))
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("l"), F.col("rule_verdict").alias("v"), rule.alias("rule"))).alias("b")
    return fits.groupBy("host", "path").agg(best).select("host", "path", "b.rule", F.col("b.v").alias("rule_verdict"))


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, n) between different hosts, from absolute links; pages needs a host column."""
    links = F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))
    found = pages.where(F.contains(F.col(html), F.lit("//"))).select(F.col("host").alias("src"), F.explode(links).alias("dst"))
    return found.select("src", lower_ascii(F.col("dst")).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust): score = (1 - damping) * seed + damping * inflow, trust forwards, distrust backwards.

    seeds: (host, trust, distrust) between 0 and 1. Scores of a host without outflow are not passed on.
    Every round is written to the shared folder, until no score moves by tolerance: each round's moves add up to at most
    `damping` times those of the one before, so that ends.
    """
    if not 0 <= damping < 1:
        raise ValueError("damping must be at least 0 and below 1")
    flow = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("u"), F.col("dst").alias("v"), "n").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("u"), F.col("src").alias("v"), "n"))
    out = flow.groupBy("kind", "u").agg(F.sum("n").alias("total"))
    flow = written(flow.join(out, ["kind", "u"]).select("kind", "u", "v", (F.col("n") / F.col("total")).alias("share")), "flow")
    start = seeds.select("host", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("seed")) for k in ("trust", "distrust")))).alias("s")).select("host", "s.kind", "s.seed")
    known = start.unionByName(flow.select(F.col("v").alias("host"), "kind", F.lit(0.0).alias("seed"))).groupBy("host", "kind").agg(F.max("seed").alias("seed"))
    now = written(known.withColumn("score", F.col("seed") * (1 - damping)), "scores")
    moved = tolerance
    while moved >= tolerance:
        inflow = now.where("score > 0").join(flow, (F.col("host") == F.col("u")) & (now["kind"] == flow["kind"])).groupBy(F.col("v").alias("host"), flow["kind"]).agg(F.sum(F.col("score") * F.col("share")).alias("inflow"))
        after = now.withColumnRenamed("score", "was").join(inflow, ["host", "kind"], "left").select("host", "kind", "seed", "was", (F.col("seed") * (1 - damping) + damping * F.coalesce("inflow", F.lit(0.0))).alias("score"))
        after = written(after, "scores")
        remove(now)
        moved = after.agg(F.max(F.abs(F.col("score") - F.col("was")))).first()[0] or 0.0
        now = after.drop("was")
    score = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k)
    return now.groupBy("host").agg(score("trust"), score("distrust"))


def judge(pages: DataFrame, rules: DataFrame | None = None, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of every row: the rule's verdict, else the host's.

    A host's seeds are the shares of its pages that rules allow and block. Null or hostless URLs have
    empty host and path, no rule and no score, and are allowed. Null html has no links. Repeated rows are
    judged alike; other columns are not read.
    """
    spark = pages.sparkSession
    rules = rules_table(spark) if rules is None else rules
    own = pages.select(F.col(id_column).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html"))
    edges = written(host_edges(own), "host-edges")
    urls = written(own.drop("html"), "urls")
    each = urls.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    hits = written(matched(each, rules), "rules-hit")
    share = lambda v: F.coalesce(F.sum(F.when(F.col("rule_verdict") == v, F.col("n"))), F.lit(0)) / F.sum("n")
    seeds = each.where("host <> ''").join(hits, ["host", "path"], "left").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = written(propagate(seeds, edges), "host-scores")
    found = urls.join(hits, ["host", "path"], "left").join(small(scores), "host", "left")
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= THRESHOLD)
    method = F.when(bad, "block").otherwise("allow")
    return found.select(F.col("id").alias(id_column), "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "trust", "distrust")
