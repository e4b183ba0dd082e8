"""URL filters by a path-template tree [native: DataFrame and SQL functions only].

Rules (action, host, path) judge first; the longest rule that fits wins.  The pages that a rule judged are the
labelled sample for all others.  From them every host gets a tree of path templates:

1. *Generalise.*  Path segments are cut into shapes (digit runs become ``0``).  A shape stays a constant if its
   branch (host, the shapes before it, the shape) holds ``min_pages`` pages, or if ``min_hosts`` hosts have that
   branch; any other shape is variable and becomes ``*``.
2. *Merge.*  Templates of a host that differ in their last segment only are siblings.  A sibling whose
   share of blocked labels is within ``z`` standard errors of the siblings' pooled share (so each one without
   labels too) is judged by the pooled counts of these similar ones; another keeps its own counts.
3. *Reject.*  The blocked share of a template is smoothed with ``strength`` pseudo-labels towards the share of the
   same template over all hosts, that one towards the share of all labels (1 of 2 when there are none).  A
   share above one half rejects the template: its pages are blocked.

Every step is an aggregate with partial sums or an equi-join of aggregates; paths are first reduced to
distinct (host, shapes), so copies of a hot path are one row.  Only the last join brings a hot template's
pages together, and those are two narrow columns which adaptive skew join may split.

Defined results: a url that is null or has no ``://`` has an empty host and path and is judged as the template of
the empty path; a path without ``/`` at its start fits no rule; repeated pages count as often as they are
there; an empty table gives no rows; other columns are ignored.  A path of s segments is s rows of hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: The rules of the contract, (action, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) between the first ``://`` and ``/``, ``?``, ``#`` or the end, and the path after it."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.char_length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its action) of the longest rule that fits, null without one; of equally long rules the first."""
    name = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, action = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def shapes(path: Column) -> Column:
    """The path's segments without the empty ones at its two ends, digit runs as ``0``."""
    inner = F.regexp_replace(F.regexp_replace(path, "[0-9]+", "0"), "^/+|/+$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "/", -1))


def _share(blocked: Column, labels: Column, towards: Column, strength: float) -> Column:
    return (blocked + F.lit(float(strength)) * towards) / (labels + F.lit(float(strength)))


def path_templates(judged: DataFrame, min_pages: int = 8, min_hosts: int = 3) -> DataFrame:
    """(host, shaped, template, parent, pages, labels, blocked) per host and distinct shaped path."""
    distinct = (judged.groupBy("host", F.array_join(shapes(F.col("path")), "/").alias("shaped"))
                .agg(F.count(F.lit(1)).alias("pages"), F.count("action").alias("labels"),
                     F.count_if(F.col("action") == "block").alias("blocked")))
    distinct = materialize(distinct)
    names = F.when(F.col("shaped") == "", F.array().cast("array<string>")).otherwise(F.split("shaped", "/", -1))
    # a branch is named by the xor of the hashes of its shapes and their depths
    above = Window.partitionBy("host", "shaped").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    nodes = (distinct.select("host", "shaped", "pages", F.posexplode(names).alias("depth", "shape"))
             .withColumn("branch", F.bit_xor(F.xxhash64("shape", "depth")).over(above)))
    counts = nodes.groupBy("host", "depth", "branch").agg(F.sum("pages").alias("pages"))
    wide = counts.groupBy("depth", "branch").agg(F.count(F.lit(1)).alias("hosts")).where(F.col("hosts") >= min_hosts)
    constant = (counts.join(wide, ["depth", "branch"], "left")
                .where((F.col("pages") >= min_pages) | F.col("hosts").isNotNull())
                .select("host", "depth", "branch", F.lit(True).alias("constant")))
    named = nodes.join(constant, ["host", "depth", "branch"], "left").groupBy("host", "shaped").agg(
        F.array_sort(F.collect_list(F.struct("depth", F.when(F.col("constant"), F.col("shape")).otherwise("*").alias("s"))))
        .alias("parts"))
    labels = F.transform("parts", lambda p: p["s"])
    joined = distinct.join(named, ["host", "shaped"], "left")
    parts = F.coalesce(labels, F.array().cast("array<string>"))
    return joined.select(
        "host", "shaped", F.concat(F.lit("/"), F.array_join(parts, "/")).alias("template"),
        F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/"),
                 F.lit(" "), F.size(parts).cast("string")).alias("parent"), "pages", "labels", "blocked")


def judge_templates(templates: DataFrame, z: float = 2.0, strength: float = 4.0) -> DataFrame:
    """(host, template, labels, blocked, share, verdict): merged and smoothed, one row per host and template."""
    sums = [F.sum(c).alias(c) for c in ("pages", "labels", "blocked")]
    own = templates.groupBy("host", "parent", "template").agg(*sums)
    pool = own.groupBy("host", "parent").agg(F.sum("labels").alias("all_labels"), F.sum("blocked").alias("all_blocked"))
    pooled = F.col("all_blocked") / F.col("all_labels")
    error = F.sqrt(pooled * (1 - pooled) / F.col("labels"))
    near = F.when(F.col("labels") == 0, F.lit(True)).otherwise(
        F.abs(F.col("blocked") / F.col("labels") - pooled) <= F.lit(float(z)) * error)
    marked = own.join(pool, ["host", "parent"]).select(own["*"], near.alias("similar"))
    merged = (marked.where("similar").groupBy("host", "parent")
              .agg(F.sum("labels").alias("merged_labels"), F.sum("blocked").alias("merged_blocked")))
    counts = marked.join(merged, ["host", "parent"], "left").select(
        "host", "template",
        F.when(F.col("similar"), F.col("merged_labels")).otherwise(F.col("labels")).alias("labels"),
        F.when(F.col("similar"), F.col("merged_blocked")).otherwise(F.col("blocked")).alias("blocked"))
    wide = templates.groupBy("template").agg(F.sum("labels").alias("t_labels"), F.sum("blocked").alias("t_blocked"))
    total = templates.agg(F.coalesce(F.sum("labels"), F.lit(0)).alias("n"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b"))
    prior = F.when(F.col("n") > 0, F.col("b") / F.col("n")).otherwise(F.lit(0.5))
    wide = wide.crossJoin(F.broadcast(total)).select(  # one row
        "template", _share(F.col("t_blocked"), F.col("t_labels"), prior, strength).alias("towards"))
    share = _share(F.col("blocked"), F.col("labels"), F.col("towards"), strength)
    return counts.join(wide, "template").select("host", "template", "labels", "blocked", share.alias("share")).withColumn(
        "verdict", F.when(F.col("share") > 0.5, F.lit("block")).otherwise(F.lit("allow")))


def filter_urls(pages: DataFrame, rules=RULES, min_pages: int = 8, min_hosts: int = 3, z: float = 2.0,
                strength: float = 4.0) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, share) of every page; the last two are null where a rule judged."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    judged = parsed.select("*", rule.alias("rule"), action.alias("action"))
    templates = materialize(path_templates(judged, min_pages, min_hosts))
    verdicts = (templates.select("host", "shaped", "template")
                .join(judge_templates(templates, z, strength), ["host", "template"])
                .select("host", "shaped", "template", "share", "verdict"))
    ruled = judged.where("rule is not null").select(
        "page_id", "host", "path", "rule", F.col("action").alias("verdict"),
        F.lit(None).cast("string").alias("template"), F.lit(None).cast("double").alias("share"))
    others = (judged.where("rule is null")
              .withColumn("shaped", F.array_join(shapes(F.col("path")), "/"))
              .join(verdicts, ["host", "shaped"])
              .select("page_id", "host", "path", "rule", "verdict", "template", "share"))
    return ruled.unionByName(others)
