"""URL filters by path-template trees.

1. A url's path becomes template segments: digits and long hexadecimal runs of
   a segment are wildcards; what lies beyond ``max_depth`` segments is the last
   level of the tree, one segment as it stands, and is generalised like the others.
2. Per host the templates form a tree. Level by level, children of a node that
   has about as many children as urls become one wildcard; of the others,
   siblings with the same commonest sub-template are merged, but for those whose
   share of bad labels differs from the siblings' by more than the Hoeffding
   bound (each branch is compared to its siblings' pool, never to each sibling).
3. A template's share of bad labels is smoothed towards its host's, and that
   towards the share of all; templates at ``reject_at`` or above are rejected.

Rules (host, path, verdict) come before the method, the longest that fits wins;
the pages that rules judge are the labelled examples.

The tree lives in a table of distinct (host, segments) with counts, so that a
host with a third of all pages is summed up before it is moved.

Nulls: a null url, or one without ``://``, has an empty host and path and is
judged by the method as such. Repeated rows are judged each, and each counts as
an example. Of rules of equal length that fit, the one named last decides. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import join_anew, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    rest = F.expr(f"CASE WHEN locate('://', `{url}`) > 0 THEN substring(`{url}`, locate('://', `{url}`) + 3) ELSE '' END")
    return (F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER),
            F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def rule_that_fits(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits columns host and
    path, else nulls. ``rules``: a short list of (host, path, verdict)."""
    name = verdict = F.lit(None).cast("string")
    for host, path, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):  # the longest decides last
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def segments(path: str, max_depth: int) -> Column:
    """Segments of a path with digits and hexadecimal runs as wildcards."""
    raw = F.filter(F.split(F.col(path), "/", -1), lambda s, i: i > 0)
    plain = F.transform(raw, lambda s: F.regexp_replace(F.regexp_replace(
        s, "[0-9a-fA-F]{16,}", "{h}"), "[0-9]+", "{n}"))
    rest = F.array_join(F.slice(plain, max_depth + 1, 1_000_000_000), "/")
    return F.when(F.size(plain) > max_depth, F.concat(F.slice(plain, 1, max_depth), F.array(rest))).otherwise(plain)


def _generalised(tree: DataFrame, level: int, least_children: int, least_ratio: float, alpha: float) -> DataFrame:
    """The tree with the segments of one level (from 1) generalised."""
    here = tree.filter(F.size("template") >= level)
    node = F.slice("template", 1, level - 1) if level > 1 else F.array().cast("array<string>")
    suffix = F.slice("segments", level + 1, 1_000_000)
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "good")]
    keyed = here.withColumn("node", node).withColumn("child", F.element_at("template", level))
    kids = (keyed.groupBy("host", "node", "child", suffix.alias("suffix")).agg(*sums)
            .groupBy("host", "node", "child").agg(
                *sums, F.max_by("suffix", F.struct("n", F.xxhash64("suffix"))).alias("main")))
    kids = stored(kids, "branches")
    parents = kids.groupBy("host", "node").agg(F.count("*").alias("children"), F.sum("n").alias("urls"))
    variable = (F.col("children") >= least_children) & (F.col("children") >= least_ratio * F.col("urls"))
    pools = kids.groupBy("host", "node", "main").agg(F.sum("bad").alias("pool_bad"), F.sum("good").alias("pool_good"))
    seen, pool = F.col("bad") + F.col("good"), F.col("pool_bad") + F.col("pool_good")
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    differs = F.coalesce(F.abs(F.try_divide("bad", seen) - F.try_divide("pool_bad", pool))
                         > bound * (1 / F.sqrt(seen) + 1 / F.sqrt(pool)), F.lit(False))
    judged = (join_anew(join_anew(kids, parents, ["host", "node"]), pools, ["host", "node", "main"])
              .withColumn("variable", variable).withColumn("own", differs))
    merged = (judged.filter("not variable and not own").groupBy("host", "node", "main")
              .agg(F.min("child").alias("least"), F.count("*").alias("together")))
    name = (F.when(F.col("variable"), F.lit("*")).when(F.col("own") | (F.col("together") < 2), F.col("child"))
            .otherwise(F.concat(F.lit("~"), F.col("least"))))
    names = (join_anew(judged, merged, ["host", "node", "main"], "left")
             .select("host", "node", "child", F.coalesce(name, "child").alias("name")))
    out = join_anew(tree.withColumn("node", F.when(F.size("template") >= level, node))
                    .withColumn("child", F.when(F.size("template") >= level, F.try_element_at("template", F.lit(level)))),
                    names, ["host", "node", "child"], "left")
    return stored(out.withColumn("template", F.when(F.col("name").isNull(), F.col("template")).otherwise(
        F.concat("node", F.array("name"), F.slice("template", level + 1, 1_000_000)))).select(tree.columns), "tree")


def template_tree(urls: DataFrame, max_depth: int = 8, least_children: int = 16, least_ratio: float = 0.2,
                  alpha: float = 0.05) -> DataFrame:
    """(host, segments, template, n, bad, good) for each distinct host and
    segments of ``urls`` (host, segments, label 1 bad, 0 good or null)."""
    tree = stored(urls.groupBy("host", "segments").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("bad"), F.count_if(F.col("label") == 0).alias("good"))
        .withColumn("template", F.col("segments")), "tree")
    deepest = tree.agg(F.max(F.size("segments"))).first()[0] or 0   # max_depth + 1 at most
    for level in range(1, deepest + 1):
        tree = _generalised(tree, level, least_children, least_ratio, alpha)
    return tree


def template_shares(tree: DataFrame, weight: float = 8.0) -> DataFrame:
    """(host, segments, template, share): the smoothed share of bad labels."""
    counts = [F.sum("bad").alias("bad"), F.sum("good").alias("good")]
    total = tree.agg(*counts).select(((F.coalesce("bad", F.lit(0)) + 1) / (
        F.coalesce("bad", F.lit(0)) + F.coalesce("good", F.lit(0)) + 2)).alias("all_share")).first()[0]

    def smooth(prior):
        return (F.col("bad") + weight * prior) / (F.col("bad") + F.col("good") + weight)

    hosts = tree.groupBy("host").agg(*counts).select("host", smooth(F.lit(total)).alias("host_share"))
    shares = (join_anew(tree.groupBy("host", "template").agg(*counts), hosts, ["host"])
              .select("host", "template", smooth(F.col("host_share")).alias("share")))
    return join_anew(tree.select("host", "segments", "template"), shares, ["host", "template"])


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], reject_at: float = 0.8,
               max_depth: int = 8) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, share) for every row of
    ``pages`` (page_id, url)."""
    host, path = host_and_path()
    name, verdict = rule_that_fits(rules)
    rows = (pages.select("page_id", host.alias("host"), path.alias("path"))
            .withColumns({"rule": name, "by_rule": verdict, "segments": segments("path", max_depth)})
            .withColumn("label", F.when(F.col("by_rule") == "block", 1).when(F.col("by_rule") == "allow", 0)))
    shares = template_shares(template_tree(rows.select("host", "segments", "label"), max_depth))
    known = shares.select(F.xxhash64("host", "segments").alias("key"), F.col("host").alias("h"), F.col("segments").alias("s"),
                          F.array_join(F.concat(F.array(F.lit("")), "template"), "/").alias("template"), "share")
    judged = rows.join(known, (F.xxhash64("host", "segments") == F.col("key")) & (F.col("host") == F.col("h"))
                       & (F.col("segments") == F.col("s")), "left")
    by_method = F.when(F.col("share") >= reject_at, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), "template", "share")
