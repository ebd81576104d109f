"""URL filter: path rules by host suffix, and trust and distrust carried over the link graph, in DataFrame operations only.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's; the longest rule wins. Urls
without a rule are judged by host: personalised PageRank from hosts that allow rules name (trusted), along links, and
from hosts that block rules name (blocked) along reversed links, since who links to a blocked host is suspect. A host is a seed
when rules of one kind decide most of its pages, or, where it has none and is only linked to, when a rule covers all of it; it
then counts as one page. Both run at once over one table of host edges, (kind, src, dst, share), until the summed change of
either kind, whose scores sum to at most one, is SETTLED or less, or ROUNDS have passed, and in any case until no host is reached
for the first time; so neither the number of hosts nor their distance decides who gets a score.
A host is blocked when its distrust exceeds THRESHOLD times its trust. Mass that reaches a host without edges ends there.

Edges are links to another host (href, src, action and cite, a page's base included, absolute or without a scheme), and in both
directions that of a host with its direct parent (m.example.org and example.org) where the parent has pages or is linked to. A table
whose links are all relative has no other edges; its seeds alone score then.

Edges and scores are aggregated by host before each join, and the joins along edges split hosts with very many of them: a thousandth of
all edges or more, at most a thousand hosts a kind, whose scores are broadcast. Verdicts are joined with the pages in the same way.

A null url, or one without "://", has an empty host and path, no rule, and the method's verdict for the empty host: allow.
A null html has no links. Repeated rows stay; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import ascii_lower, join_skewed, table

#: Fixed rules: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING = 0.85
ROUNDS = 30
SETTLED = 1e-6
THRESHOLD = 1.0
#: Weight of the edge between a host and its parent, in links.
KINSHIP = 1
#: Hosts of absolute and of scheme-less links.
_LINK = r"""(?i)\b(?:href|src|action|cite)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    known = F.contains(F.coalesce(url, F.lit("")), F.lit("://"))
    rest = F.when(known, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts."""
    host, _ = host_and_path(F.col("url"))
    links = pages.where(F.contains("html", F.lit("//"))).select(host.alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("dst"))
    return links.withColumn("dst", ascii_lower(F.col("dst"))).where("src != dst AND src != ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def with_parents(edges: DataFrame, hosts: DataFrame) -> DataFrame:
    """`edges` and those between a host and its direct parent, both of which have pages (hosts) or are linked to."""
    known = table(hosts.select("host").union(edges.select("dst")).where("host != ''").distinct(), "url-known")
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    kin = known.select("host", parent.alias("parent")).where(F.contains("parent", F.lit("."))).join(known.select(F.col("host").alias("parent")), "parent").where("host != parent")
    n = F.lit(KINSHIP).cast("long").alias("n")
    every = edges.unionByName(kin.select(F.col("host").alias("src"), F.col("parent").alias("dst"), n)).unionByName(kin.select(F.col("parent").alias("src"), F.col("host").alias("dst"), n))
    return every.groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, score) from seeds (kind, host, mass) over edges (src, dst, n); trust runs along links, distrust against them."""
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(edges.select(F.lit("distrust"), F.col("dst"), F.col("src"), "n"))
    # One key of kind and host, so that hosts with very many edges can be split from the rest.
    key = lambda host: F.concat("kind", F.lit("|"), host).alias("key")
    both = table(both.select("kind", key("src"), "dst", "n"), "url-both")
    out = table(both.groupBy("key").agg(F.sum("n").alias("all"), F.count("*").alias("group_size")), "url-out")
    n_edges = both.count()
    along = lambda rows, right: join_skewed(rows, right, "key", out.select("key", "group_size"), n_edges)
    both = table(along(both, out.select("key", "all")).select("kind", "key", "dst", (F.col("n") / F.col("all")).alias("share")), "url-edges")
    totals = seeds.groupBy("kind").agg(F.sum("mass").alias("all"))
    seeds = table(seeds.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("mass") / F.col("all")).alias("seed")), "url-seeds")
    if both.isEmpty():  # nothing is carried anywhere
        return seeds.select("kind", "host", ((1 - DAMPING) * F.col("seed")).alias("score"))
    scores = seeds.withColumnRenamed("seed", "score")
    for done in itertools.count(1):
        carried = along(both, scores.select(key("host"), "score")).where("score IS NOT NULL")
        carried = carried.select("kind", F.col("dst").alias("host"), (DAMPING * F.col("share") * F.col("score")).alias("new"), F.lit(0.0).alias("old"))
        given = seeds.select("kind", "host", ((1 - DAMPING) * F.col("seed")).alias("new"), F.lit(0.0).alias("old"))
        before = scores.select("kind", "host", F.lit(0.0).alias("new"), F.col("score").alias("old"))
        summed = carried.unionByName(given).unionByName(before).groupBy("kind", "host").agg(F.sum("new").alias("score"), F.sum("old").alias("old"))
        summed = table(summed, "url-scores")
        by_kind = summed.groupBy("kind").agg(F.sum(F.abs(F.col("score") - F.col("old"))).alias("moved"), F.count_if((F.col("score") > 0) & (F.col("old") == 0)).alias("fresh")).collect()
        scores = summed.select("kind", "host", "score")
        settled = all(r["moved"] <= SETTLED for r in by_kind)
        if (settled or done >= rounds) and not any(r["fresh"] for r in by_kind):
            return scores


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of `pages`."""
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    split = table(split.select("*", name.alias("rule"), verdict.alias("ruling")), "url-pages", scan=True)
    hosts = table(split.groupBy("host").agg(F.count("*").alias("group_size"), F.count_if(F.col("ruling") == "allow").alias("allowed"), F.count_if(F.col("ruling") == "block").alias("blocked")), "url-hosts")
    # A seed is a host most of whose pages a rule decides one way; its mass is their number.
    seeds = hosts.where("2 * allowed > group_size").select(F.lit("trust").alias("kind"), "host", F.col("allowed").cast("double").alias("mass"))
    seeds = seeds.union(hosts.where("2 * blocked > group_size").select(F.lit("distrust"), "host", F.col("blocked").cast("double")))
    links = table(host_edges(pages), "url-links")
    edges = table(with_parents(links, hosts), "url-all-links")
    # A rule that fits the path "/" covers the whole host.
    covered = links.select(F.col("dst").alias("host")).distinct().join(hosts, "host", "left_anti").select("host", ruled(F.col("host"), F.lit("/"), rules)[1].alias("ruling"))
    seeds = seeds.union(covered.where("ruling IS NOT NULL").select(F.when(F.col("ruling") == "allow", "trust").otherwise("distrust"), "host", F.lit(1.0)))
    scores = propagate(seeds, edges)
    flat = scores.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("score"))).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("score"))).alias("distrust"))
    flat = table(flat.na.fill(0.0), "url-verdicts")
    total = hosts.agg(F.sum("group_size")).first()[0] or 0
    joined = join_skewed(split, flat, "host", hosts.select("host", "group_size"), total)
    by_host = F.when(F.coalesce("distrust", F.lit(0.0)) > THRESHOLD * F.coalesce("trust", F.lit(0.0)), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("ruling", by_host).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
