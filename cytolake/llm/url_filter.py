"""URL filters: rules by host and path, and for what no rule covers, trust and distrust spread over the link graph.

Hosts whose pages are mostly allowed by rules are trusted seeds, mostly blocked ones are distrust seeds. Trust runs along
links by personalised PageRank; distrust runs against them, since a host answers for what it links to. Edges are host
pairs from absolute links in the pages. A host's pages without a rule are blocked if distrust outweighs trust: the share of
distrust in both is at least ``BLOCK_SHARE``; a host that neither reaches is allowed.

Rounds go on until no new host is reached and no host's score grows by ``TOLERANCE`` of itself or more, so the depth does not hang on
the number of seeds. All of it is joins and sums on host tables; pages meet their host's verdict through a join that splits hot hosts.

Edge cases: a null url, or one without "://", has empty host and path, no rule, and is allowed; null html has no links; links
within a host and repeated links of one page add nothing new; repeated rows stay; no seeds or no links leave verdicts to the rules;
clashing extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cytolake.runtime import cut_lineage, salted_join

DAMPING, TOLERANCE, BLOCK_SHARE = 0.85, 1e-4, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return (F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def _suffixes(host: Column) -> Column:
    """The host and all domains above it."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def with_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Add host, path, rule and rule_verdict; ``rules``: (host, path, verdict). The longest fitting rule wins, of equal ones the first by name."""
    host, path = host_and_path(F.col("url"))
    placed = pages.withColumns({"host": host, "path": path})
    hosts = placed.select("host").distinct()
    wide = hosts.select("host", F.explode(_suffixes(F.col("host"))).alias("on"))
    named = rules.select(F.col("host").alias("on"), F.struct(
        (-F.length(F.concat("host", "path"))).alias("size"), F.concat("host", "path").alias("rule"), "path", F.col("verdict").alias("rule_verdict")).alias("r"))
    fitting = wide.join(named, "on").groupBy("host").agg(F.sort_array(F.collect_set("r")).alias("_rules"))
    found = F.get(F.filter("_rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    return (salted_join(placed, fitting, ["host"], ["page_id", "url"], "left").withColumn("_hit", found)
            .withColumns({"rule": F.col("_hit.rule"), "rule_verdict": F.col("_hit.rule_verdict")}).drop("_hit", "_rules"))


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): hosts and the pages of one that link to the other; weights of a source sum to 1."""
    host, _ = host_and_path(F.col("url"))
    to = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER)))).alias("dst")
    pairs = (pages.select(host.alias("src"), "html").filter("src <> ''").select("src", to).filter("src <> dst")
             .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))
    return pairs


def _pagerank(edges: DataFrame, seeds: DataFrame, name: str) -> DataFrame:
    """Personalised PageRank: edges (src, dst, n), seeds (host, share) -> (host, ``name``), in units of one seed.

    Every seed starts with its share, so seeds without links change no other host. Each round sends on only what came in
    by the round before. Without cycles the last round moves nothing.
    """
    total = edges.groupBy("src").agg(F.sum("n").alias("total"))
    flow = cut_lineage(edges.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("w")))
    rank = cut_lineage(seeds.select("host", F.col("share").alias("r"), F.col("share").alias("new")))
    while True:
        moved = (rank.filter("new > 0").join(flow, F.col("host") == F.col("src")).groupBy("dst").agg((F.sum(F.col("new") * F.col("w")) * DAMPING).alias("in"))
                 .select(F.col("dst").alias("host"), "in"))
        got = F.coalesce("in", F.lit(0.0))
        rank = cut_lineage(rank.join(moved, "host", "full").select("host", (F.coalesce("r", F.lit(0.0)) + got).alias("r"), got.alias("new")))
        most = rank.agg(F.max(F.col("new") / F.col("r"))).first()[0]      # 1 for a host not met before
        if (most or 0.0) < TOLERANCE:
            return rank.select("host", F.col("r").alias(name))


def host_scores(ruled: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, trust, distrust) of all hosts that either reaches."""
    share = lambda v: F.sum(F.when(F.col("rule_verdict") == v, 1).otherwise(0)) / F.count(F.lit(1))
    counts = cut_lineage(ruled.filter("host <> ''").groupBy("host").agg(share("allow").alias("a"), share("block").alias("b")))

    def seeds(column: str) -> DataFrame:
        return counts.filter(F.col(column) > 0.5).select("host", F.lit(1.0).alias("share"))

    trust = _pagerank(edges, seeds("a"), "trust")
    distrust = _pagerank(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), seeds("b"), "distrust")
    return trust.join(distrust, "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's scores for every page."""
    spark = pages.sparkSession
    table = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    edges = cut_lineage(links(pages))
    ruled = cut_lineage(with_rules(pages.select("page_id", "url"), table))
    scores = host_scores(ruled, edges)
    joined = salted_join(ruled, scores, ["host"], ["page_id", "url"], "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    own = F.when((distrust > 0) & (distrust >= BLOCK_SHARE * (trust + distrust)), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
