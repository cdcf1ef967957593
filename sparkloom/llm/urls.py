"""URL filter by a path-template tree, in DataFrame operations only.

Each host has a tree of path segments. Segments that vary (those with digits, and the rare ones of a node with many children)
are generalised into wildcards, level by level. Labelled pages give each branch, from the templates up to the host, its share of
blocked pages; sibling branches at any level whose shares don't differ significantly are merged. A branch's share is smoothed
towards that of the branch above, the host's towards the prior, so that a branch without labels has the share of the closest one
above that has some. A template is rejected if its smoothed share exceeds the threshold (which the prior alone never does).

The tree is split at its first LEVELS levels, and below them wherever a branch holds more different paths than a node may have
children; the paths of a smaller branch are its leaves, whole. Everything is counted by template before it is shuffled, so a host with a third of all pages costs one row
for each template and task.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_skewed, settled

#: The base rules (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Levels at which every branch is split.
LEVELS = 4


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url and one without `://`."""
    whole = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(whole, PARTS, 1), UPPER, LOWER), F.regexp_extract(whole, PARTS, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null. Of rules as long, block goes before allow, then text order."""
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r[0] + r[1]))
    if not order:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    known = F.array(*(F.struct(F.lit(h).alias("h"), F.lit(p).alias("p"), F.lit(v).alias("v")) for h, p, v in order))
    fits = F.filter(known, lambda r: ((host == r["h"]) | host.endswith(F.concat(F.lit("."), r["h"]))) & path.startswith(r["p"]))
    first = F.get(fits, F.lit(0))
    return F.when(F.size(fits) > 0, F.struct(F.concat(first["h"], first["p"]).alias("rule"), first["v"].alias("verdict")))


def shape(path: Column) -> Column:
    """The path's segments with runs of digits and long hex generalised."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    return F.transform(segments, lambda s: F.regexp_replace(F.regexp_replace(F.translate(s, UPPER, LOWER), r"[0-9a-f]*[0-9][0-9a-f]{7,}", "#"), r"[0-9]+", "#"))


def templates(counts: DataFrame, fanout: int = 16, share: float = 0.02) -> DataFrame:
    """counts (host, shape, n, labelled, blocked) with `template`: a node with more than `fanout` children has those under
    `share` of its pages generalised into `*`, level by level. From LEVELS on, a branch of at most `fanout` different shapes is split no
    more: what is left of each shape is one last segment."""
    none = F.array().cast("array<string>")
    open_, level, done = settled(counts.withColumn("template", none), "templates"), 0, []
    while True:
        rest = F.slice("shape", F.lit(level + 1), F.greatest(F.size("shape") - level, F.lit(0)))
        ended = F.size("shape") <= level
        if level >= LEVELS:
            paths = open_.where(~ended).groupBy("host", "template").agg(F.count(F.lit(1)).alias("paths")).where(F.col("paths") > fanout)
            marked = open_.join(paths, ["host", "template"], "left")
            closed = ended | F.col("paths").isNull()
            done.append(marked.where(closed).drop("paths").withColumn("template", F.concat("template", F.when(ended, none).otherwise(F.array(F.array_join(rest, "/"))))))
            open_ = marked.where(~closed).drop("paths")
            if open_.isEmpty():
                break
        else:
            done.append(open_.where(ended))
            open_ = open_.where(~ended)
        step = open_.withColumn("seg", F.get("shape", F.lit(level)))
        child = step.groupBy("host", "template", "seg").agg(F.sum("n").alias("own"))
        node = child.groupBy("host", "template").agg(F.count(F.lit(1)).alias("children"), F.sum("own").alias("all"))
        rare = child.join(node.where(F.col("children") > fanout), ["host", "template"]).where(F.col("own") < share * F.col("all")).select("host", "template", "seg", F.lit(True).alias("rare"))
        out = step.join(rare, ["host", "template", "seg"], "left").withColumn("template", F.concat("template", F.array(F.when(F.col("rare"), F.lit("*")).otherwise(F.col("seg")))))
        open_ = settled(out.drop("seg", "rare"), "templates")  # a row for each host and shape that is split further
        level += 1
    return functools.reduce(DataFrame.unionByName, done)


def judged(known: DataFrame, pull: float = 4.0, prior: float | None = None, z: float = 1.96) -> DataFrame:
    """(host, template, branch, purity) for each template (of a segment or more) of `known` (host, template, n, labelled, blocked).

    Counts go up through all levels of a host's tree. branch: the template, with `*` at each level where its labelled branch
    doesn't differ from its labelled siblings together (z test of two proportions, the branch's and the others', with their pooled
    variance); branches merged that way share their counts. From
    the host down, purity = (blocked + pull * purity above) / (labelled + pull), so a branch without labels has that of the closest
    one above with some. Above the host stands the prior, by default half the share of blocked among all labelled pages.
    """
    each = known.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    # a row for each template and level
    at = each.withColumn("level", F.explode(F.sequence(F.lit(1), F.size("template")))).withColumn("node", F.slice("template", F.lit(1), F.col("level")))
    node = at.groupBy("host", "level", "node").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    node = node.withColumn("parent", F.slice("node", F.lit(1), F.col("level") - 1))
    total = node.groupBy("host", "parent").agg(F.sum("labelled").alias("l_all"), F.sum("blocked").alias("b_all"))
    both = node.join(total, ["host", "parent"])
    mine, others = F.col("labelled"), F.col("l_all") - F.col("labelled")
    gap = F.abs(F.col("blocked") / F.greatest(mine, F.lit(1)) - (F.col("b_all") - F.col("blocked")) / F.greatest(others, F.lit(1)))
    p = F.col("b_all") / F.greatest("l_all", F.lit(1))
    error = F.sqrt(p * (1 - p) * (1 / F.greatest(mine, F.lit(1)) + 1 / F.greatest(others, F.lit(1))))
    alike = (mine > 0) & (others > 0) & (gap <= z * error)
    marks = both.select("host", "node", F.when(alike, "*").otherwise(F.element_at("node", -1)).alias("mark"))
    in_order = lambda *c: F.array_sort(F.collect_list(F.struct("level", *c)))  # noqa: E731  (one template's levels)
    named = at.join(marks, ["host", "node"]).groupBy("host", "template", "labelled", "blocked").agg(in_order("mark").getField("mark").alias("branch"))
    steps = named.withColumn("level", F.explode(F.sequence(F.lit(0), F.size("branch")))).withColumn("stem", F.slice("branch", F.lit(1), F.col("level")))
    summed = steps.groupBy("host", "stem").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    chains = steps.join(summed, ["host", "stem"]).groupBy("host", "template", "branch").agg(in_order("l", "b").alias("chain"))
    if prior is None:
        whole = each.agg((F.sum("blocked") / F.greatest(F.sum("labelled"), F.lit(1)) / 2).alias("prior"))
        chains = chains.join(F.broadcast(whole), F.lit(True))  # one row
    else:
        chains = chains.withColumn("prior", F.lit(prior))
    first = F.coalesce(F.col("prior").cast("double"), F.lit(0.0))
    purity = F.aggregate("chain", first, lambda above, x: (x["b"] + pull * above) / (x["l"] + pull))
    return chains.select("host", "template", "branch", purity.alias("purity"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = 0.5, **options) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for each page (page_id, url).

    The verdict is the longest fitting rule's; without one, block if the page's template exceeds the threshold, else allow. The
    rules' verdicts are the labels. Null, empty and broken urls have empty host and path and go by their template like others;
    repeated rows and null ids each keep their row. Other columns of pages are left out, whatever their names. A path of any length
    is looked at whole. An empty table gives an empty result.
    """
    host, path = parts(F.col("url"))
    ruled = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = ruled.withColumns({"_rule": rule_of(F.col("host"), F.col("path"), rules), "shape": shape(F.col("path"))})
    verdict = F.col("_rule.verdict")
    counts = ruled.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count(verdict).alias("labelled"), F.count(F.when(verdict == "block", 1)).alias("blocked"))
    placed = settled(templates(counts), "templates")
    found = settled(placed.select("host", "shape", "template", "n").join(judged(placed, **options), ["host", "template"]).select("host", "shape", F.array_join("branch", "/").alias("template"), "purity", "n"), "judged")
    both = joined_skewed(ruled, found, ["host", "shape"], "n")
    method = F.when(F.col("purity") > threshold, "block").otherwise("allow")
    return both.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template", "purity")
