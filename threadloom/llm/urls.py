"""URL filters: suffix rules first, then a path-template tree per host, with DataFrame functions alone.

Paths become templates: digit runs, long hexadecimal runs and long or slug-like segments are replaced by wildcards.
The urls are reduced to counts per host and template before anything else, so a very common host is a few rows.  The
templates' prefixes are the nodes of the host's tree, whatever their depth.  A node whose labelled share of blocks
agrees with its parent's (by a two-sided test of proportions; unlabelled nodes agree) is merged with the siblings that
do so too: its segment becomes `*`, and what is below is pooled where the rest of the path is the same.  A template is
rejected by the share of blocked labels at its branch, smoothed with the host's share, which is smoothed with the share
over all hosts.  The labels are the verdicts of the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

#: (verdict, host, start of the path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labels that a parent's share counts for, and the bound of the test of proportions.
WEIGHT, BOUND = 2.0, 1.96
REJECT_FROM = 0.5


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def template_of(path: Column) -> Column:
    """The generalised segments of a path, as an array."""
    slug = lambda s: (F.length(s) > 40) | (F.length(s) - F.length(F.replace(s, F.lit("-"), F.lit(""))) >= 3)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(
        segments,
        lambda s: F.when(slug(s), F.lit("{v}")).otherwise(
            F.regexp_replace(F.regexp_replace(s, "[0-9a-f]{12,}", "{h}"), "[0-9]+", "{n}")
        ),
    )


def template_tree(urls: DataFrame) -> DataFrame:
    """urls(host, template, label 1 blocked, 0 allowed or null) to: host, template, branch, purity."""
    rate = lambda b, n, prior: (b + F.lit(WEIGHT) * prior) / (n + F.lit(WEIGHT))
    leaves = save(
        urls.groupBy("host", "template").agg(F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("b")),
        "url-templates",
    )
    total = leaves.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    overall = (total["b"] + 1.0) / (total["n"] + 2.0)
    upto = lambda level: F.array_join(F.slice("template", F.lit(1), level), "/")
    levels = leaves.select("host", "template", "n", "b", F.explode(F.sequence(F.lit(0), F.size("template"))).alias("level"))
    nodes = save(
        levels.groupBy("host", upto(F.col("level")).alias("node"), F.when(F.col("level") > 0, upto(F.col("level") - 1)).alias("parent")).agg(
            F.sum("n").alias("n"), F.sum("b").alias("b")
        ),
        "url-nodes",
    )
    above = nodes.select("host", F.col("node").alias("parent"), rate(F.col("b"), F.col("n"), F.lit(0.5)).alias("p"))
    apart = F.abs(F.col("b") - F.col("n") * F.col("p")) > F.lit(BOUND) * F.sqrt(F.col("n") * F.col("p") * (1 - F.col("p")))
    judged = save(nodes.join(above, ["host", "parent"]).select("host", "node", apart.alias("apart")), "url-nodes")
    steps = levels.filter("level > 0").withColumn("node", upto(F.col("level"))).join(judged, ["host", "node"])
    own = F.when(F.col("apart"), F.element_at("template", F.col("level"))).otherwise("*")
    branches = steps.groupBy("host", "template").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", own.alias("to")))), lambda x: x["to"]), "/").alias("branch")
    )
    tree = save(leaves.join(branches, ["host", "template"], "left").withColumn("branch", F.coalesce("branch", F.lit(""))), "url-branches")
    ends = save(tree.groupBy("host", "branch").agg(F.sum("n").alias("bn"), F.sum("b").alias("bb")), "url-branches")
    hosts = save(tree.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("b").alias("hb")), "url-hosts")
    host_rate = rate(F.col("hb"), F.col("hn"), F.lit(overall))
    return tree.join(ends, ["host", "branch"]).join(hosts, "host").select(
        "host", "template", "branch", rate(F.col("bb"), F.col("bn"), host_rate).alias("purity")
    )


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per row of pages(page_id, url): page_id, host, path, rule, verdict, branch, purity.

    A null url, or one without `://`, has an empty host and path and is judged like any other.  Paths of any depth are
    judged whole.  Repeated rows stay.  Other columns are ignored.  An empty table gives an empty result.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = parts.select(
        "page_id", "host", "path", longest_rule(F.col("host"), F.col("path"), rules).alias("r"), template_of(F.col("path")).alias("template")
    )
    label = F.when(F.col("r.verdict") == "block", 1).when(F.col("r.verdict") == "allow", 0).cast("long")
    tree = save(template_tree(judged.select("host", "template", label.alias("label"))), "url-tree")
    return judged.join(tree, ["host", "template"]).select(
        "page_id",
        "host",
        "path",
        "r.rule",
        F.coalesce("r.verdict", F.when(F.col("purity") >= REJECT_FROM, "block").otherwise("allow")).alias("verdict"),
        "branch",
        "purity",
    )
