"""URL filters: rules, then link-graph propagation (operator 6).

Rules (host suffix, path prefix, verdict) are matched by an equi-join on every
suffix of a host; the longest that fits wins. Where none fits, the host's place
in the link graph decides: personalised PageRank spreads trust from hosts along
their links, and on the reversed links distrust from blocked ones. A host seeds
either by the share of its pages that allow or block rules cover. A host is
blocked where distrust exceeds trust by more than ``threshold``. Both count in
units of the restart mass, so a threshold means the same with and without links,
and no host falls below its own seed:

    score(h) = seed(h) + damping * sum over links g -> h of score(g) * weight(g, h) / out(g)

``propagate`` also gives the usual form, (1 - damping) * seed(h) instead of the
seed, where hosts without links keep what they have (a loop). Pages are counted per host
and links per pair of hosts before any join, so a host with a third of all
pages costs one row. Defined results: a null url or one without ``://`` has an
empty host and path and no rule, and is allowed by the method; null or empty
html has no links; relative links stay on their host, those that begin with
``//`` name another; an empty table gives no
rows; repeated pages count each time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING = 0.85
ROUNDS = 20
THRESHOLD = 0.5
_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]*)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _A, _Z)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def with_rules(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(page_id, host, path, rule, ruled): the longest rule that fits, and its verdict. The rules are a parameter, at most a few MB."""
    spark = pages.sparkSession
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    table = spark.createDataFrame(list(rules), "rule_host string, rule_path string, verdict string")
    by_host = table.groupBy("rule_host").agg(F.collect_list(F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), F.concat("rule_host", "rule_path").alias("rule"), "rule_path", "verdict")).alias("rules"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = base.select("host").distinct().withColumn("suffix", F.explode(suffixes))
    fits = (hosts.join(F.broadcast(by_host), hosts["suffix"] == by_host["rule_host"]).groupBy("host").agg(F.flatten(F.collect_list("rules")).alias("rules")))
    best = F.array_max(F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"])))
    return base.join(fits, "host", "left").withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruled"))


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts, counted."""
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), 1)).alias("link"))
    whole = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    return (found.select("src", host_of(whole).alias("dst")).where((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != ""))
            .groupBy("src", "dst").agg(F.count("*").alias("weight")))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, in_seeds: bool = False) -> DataFrame:
    """(host, trust, distrust) for hosts with a seed or a link; ``seeds`` has host, trust, distrust in [0, 1]. ``in_seeds``: in units of the restart mass."""
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(edges.select(F.lit("distrust"), "dst", "src", "weight"))
    seed = seeds.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("trust").alias("seed")), F.struct(F.lit("distrust").alias("kind"), F.col("distrust").alias("seed")))).alias("s")).select("host", "s.kind", "s.seed")
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    nodes = (both.select("kind", F.col("src").alias("host")).union(both.select("kind", "dst")).union(seed.select("kind", "host")).distinct()
             .join(seed, ["kind", "host"], "left").join(out.withColumnRenamed("src", "host"), ["kind", "host"], "left")
             .select("kind", "host", F.coalesce("seed", F.lit(0.0)).alias("seed"), F.col("total").isNull().alias("sink")))
    nodes = cut_lineage(nodes)
    moves = cut_lineage(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("part")))
    rank = nodes.select("kind", "host", F.col("seed").alias("score"), "seed", "sink")
    if moves.isEmpty():
        rounds = 0  # every host keeps its seed
    base, loop = (1.0, 0.0) if in_seeds else (1 - damping, damping)
    for i in range(rounds):
        came = (moves.join(rank.select("kind", F.col("host").alias("src"), "score"), ["kind", "src"])
                .groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("part")).alias("came")))
        rank = rank.join(came, ["kind", "host"], "left").select(
            "kind", "host", (base * F.col("seed") + damping * F.coalesce("came", F.lit(0.0)) + loop * F.when(F.col("sink"), F.col("score")).otherwise(0.0)).alias("score"), "seed", "sink")
        if i % 4 == 3:
            rank = cut_lineage(rank)
    pick = lambda kind: F.round(F.sum(F.when(F.col("kind") == kind, F.col("score"))), 9).alias(kind)
    return rank.groupBy("host").agg(pick("trust"), pick("distrust"))


def judge_pages(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row."""
    ruled = with_rules(pages, rules)
    share = lambda v: F.avg(F.when(F.col("ruled") == v, 1.0).otherwise(0.0))
    seeds = ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = propagate(seeds, links(pages), damping, rounds, in_seeds=True)
    return ruled.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.coalesce("distrust", F.lit(0.0)) - F.coalesce("trust", F.lit(0.0)) > threshold, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
