"""Operator 4: URL filter by path-template trees.

Rules decide the pages they fit, and so label them.  For the others, paths
become templates: digit runs turn into ``<n>``, and a tree per host grows from
one branching segment to the next (segments that all pages of a node share are
passed at once).  Values of a segment with too few pages share the wildcard
``<*>``; so do those of a variable segment, one with many values in effect,
unless their labelled share of blocked pages differs from that of the segment's
other values.  A node with too few pages for a branch keeps one ``<**>`` for all
that is below it, so depth needs no limit.

Branches of one parent are merged pairwise by their labelled shares: they stand
in classes of equal share, and the two neighbours that differ least (two-proportion
z test) merge until all that are left differ.  A template's purity, its merged
branches' blocked share smoothed towards the template's share over all hosts,
decides its verdict.

Pages are summed per host and digit-free path first; the trees are built on
those sums, so a host with a third of all pages costs no more than others.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import written

#: Pages that a branch of its own needs.
LEAST_PAGES = 8
#: A segment is variable from this many values in effect (the inverse of the
#: chance that two of its pages have the same value).
VARIABLE_FROM = 32.0
#: Classes of the labelled share in which siblings meet before they merge.
SHARE_CLASSES = 64
#: Pseudo-pages of the smoothing, and the z value below which branches merge.
PRIOR_PAGES, SAME_Z = 4.0, 1.96
REJECT_FROM = 0.5


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
         Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def matched(host: Column, path: Column, rules: list[Rule], field: str) -> Column:
    """``name`` or ``verdict`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, field))).otherwise(out)
    return out


def _z(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    """Two-proportion z value of the blocked shares; 0 where nothing can be told."""
    n1, n2 = (a1 + b1).cast("double"), (a2 + b2).cast("double")
    pooled = F.try_divide(b1 + b2, n1 + n2)
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    return F.coalesce(F.try_divide(F.abs(F.try_divide(b1, n1) - F.try_divide(b2, n2)), spread), F.lit(0.0))


def _step(at: DataFrame) -> DataFrame:
    """``at`` (host, template, rest, ...) one branching segment further; ``rest``
    is null where a path has found its template."""
    node = ["host", "template"]
    # the segments that a node's least and greatest rest share are shared by all
    nodes = at.groupBy(*node).agg(F.sum("n").alias("node_n"), F.min("rest").alias("lo"), F.max("rest").alias("hi"))
    differ = F.array_position(F.zip_with("lo", "hi", lambda x, y: x.eqNullSafe(y)), F.lit(False))
    nodes = nodes.select(*node, "node_n", F.when(differ > 0, differ - 1).otherwise(F.size("lo")).cast("int").alias("k"))
    passed = F.when(F.col("k") > 0, F.concat("template", F.lit("/"), F.array_join(F.slice("rest", F.lit(1), F.col("k")), "/"))
                    ).otherwise(F.col("template"))
    small = F.col("node_n") < LEAST_PAGES
    here = written(
        at.join(nodes, node).select(
            "host", "shape", "n", "good", "bad",
            F.when(small & (F.size("rest") > 0), F.col("template")).otherwise(F.col("parent")).alias("parent"),
            F.when(~small, passed).when(F.size("rest") > 0, F.concat("template", F.lit("/<**>")))
             .otherwise(F.col("template")).alias("template"),
            F.when(~small & (F.size("rest") > F.col("k")),
                   F.slice("rest", F.col("k") + 1, F.size("rest") - F.col("k"))).alias("rest"))
        .withColumn("seg", F.get("rest", F.lit(0))), "branching")
    values = (here.filter("seg is not null").groupBy(*node, "seg")
              .agg(F.sum("n").alias("sn"), F.sum("good").alias("sa"), F.sum("bad").alias("sb")))
    size = F.col("sn").cast("double")
    slots = values.groupBy(*node).agg(
        F.count("*").alias("values"), F.sum("sa").alias("ta"), F.sum("sb").alias("tb"),
        (F.sum(size) * F.sum(size) / F.sum(size * size)).alias("in_effect"))
    # of many values some differ by chance: the bar rises with their number
    bar = F.sqrt(SAME_Z ** 2 + 2 * F.log(F.col("values").cast("double")))
    told = _z(F.col("sa"), F.col("sb"), F.col("ta") - F.col("sa"), F.col("tb") - F.col("sb")) >= bar
    own = (values.join(slots, node)
           .filter((F.col("sn") >= LEAST_PAGES) & ((F.col("in_effect") <= VARIABLE_FROM) | told))
           .select(*node, "seg", F.lit(True).alias("own")))
    name = F.when(F.col("own"), F.col("seg")).otherwise(F.lit("<*>"))
    return written(
        here.join(own, [*node, "seg"], "left").select(
            "host", "shape", "n", "good", "bad",
            F.when(F.col("seg").isNotNull(), F.col("template")).otherwise(F.col("parent")).alias("parent"),
            F.when(F.col("seg").isNotNull(), F.concat("template", F.lit("/"), name))
             .otherwise(F.col("template")).alias("template"),
            F.when(F.col("seg").isNotNull(), F.slice("rest", F.lit(2), F.size("rest"))).alias("rest")), "branches")


def _branches(leaves: DataFrame) -> DataFrame:
    """``leaves`` (host, shape, segments, n, ...) with their ``template`` and its
    ``parent``.  As many steps as a path has branching segments, each with
    ``LEAST_PAGES`` pages or more."""
    at = leaves.withColumnRenamed("segments", "rest").withColumns({"template": F.lit(""), "parent": F.lit("")})
    done = []
    while at.head(1):
        stepped = _step(at)
        done.append(stepped.filter("rest is null").drop("rest"))
        at = stepped.filter("rest is not null")
    out = at.drop("rest")
    for part in done:
        out = out.unionByName(part)
    return out


def merge_classes(classes: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(class, allowed, blocked) of one family's branches -> per class the sums of
    the group it ends in: the neighbours that differ least merge while their z
    value is under ``SAME_Z``."""
    groups = [([c], a, b) for c, a, b in sorted(classes)]

    def z(x, y) -> float:
        n1, n2 = x[1] + x[2], y[1] + y[2]
        pooled = (x[2] + y[2]) / (n1 + n2)
        spread = (pooled * (1 - pooled) * (1 / n1 + 1 / n2)) ** 0.5
        return abs(x[2] / n1 - y[2] / n2) / spread if spread else 0.0

    while len(groups) > 1:
        least, i = min((z(groups[i], groups[i + 1]), i) for i in range(len(groups) - 1))
        if least >= SAME_Z:
            break
        x, y = groups[i:i + 2]
        groups[i:i + 2] = [(x[0] + y[0], x[1] + y[1], x[2] + y[2])]
    return [(c, a, b) for of, a, b in groups for c in of]


def _merged(families: pd.Series) -> pd.Series:
    return families.map(lambda f: [dict(zip(("class", "a", "b"), g))
                                   for g in merge_classes([(r["class"], r["a"], r["b"]) for r in f])])


def _purity(leaves: DataFrame) -> DataFrame:
    """(host, parent, template, purity): smoothed blocked share per template.  A
    branch without a labelled page takes its family's sums."""
    family = ["host", "parent"]
    own = leaves.groupBy(*family, "template").agg(F.sum("good").alias("a"), F.sum("bad").alias("b"))
    share = F.floor(F.try_divide(F.col("b") * SHARE_CLASSES, F.col("a") + F.col("b"))).cast("int")
    own = written(own.withColumn("class", share), "templates")
    # a family has at most SHARE_CLASSES + 1 classes
    classes = own.filter("class is not null").groupBy(*family, "class").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    families = classes.groupBy(*family).agg(F.collect_list(F.struct("class", "a", "b")).alias("classes"),
                                            F.sum("a").alias("fa"), F.sum("b").alias("fb"))
    merged = F.pandas_udf(_merged, "array<struct<class:int,a:bigint,b:bigint>>")
    sums = families.select(*family, F.explode(merged("classes")).alias("g")).select(
        *family, "g.class", F.col("g.a").alias("ma"), F.col("g.b").alias("mb"))
    everywhere = own.groupBy("template").agg(F.sum("a").alias("ga"), F.sum("b").alias("gb"))
    total = own.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).head()
    labelled = (total["a"] or 0) + (total["b"] or 0)
    prior = float(total["b"] or 0) / labelled if labelled else 0.0
    a = F.coalesce("ma", "fa", F.lit(0))
    b = F.coalesce("mb", "fb", F.lit(0))
    wide = (F.col("gb") + PRIOR_PAGES * F.lit(prior)) / (F.col("ga") + F.col("gb") + PRIOR_PAGES)
    return (own.join(sums, [*family, "class"], "left").join(families.drop("classes"), family, "left")
            .join(everywhere, "template")
            .select(*family, "template", ((b + PRIOR_PAGES * wide) / (a + b + PRIOR_PAGES)).alias("purity")))


def judge(pages: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) per row of
    ``pages`` (page_id, url).

    Null url or none with ``://``: empty host and path, which form a template
    like any other.  Without labelled pages every purity is 0 and what no rule
    fits is allowed.  Repeated rows get equal verdicts; an empty table gives no
    rows; other columns are ignored.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({
        "rule": matched(F.col("host"), F.col("path"), rules, "name"),
        "ruled": matched(F.col("host"), F.col("path"), rules, "verdict"),
        "shape": F.regexp_replace("path", r"[0-9]+", "<n>")})
    leaves = written(rows.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("good"),
        F.count_if(F.col("ruled") == "block").alias("bad")), "leaves")
    leaves = leaves.withColumn("segments", F.split(F.regexp_replace("shape", "^/", ""), "/"))
    placed = _branches(leaves)
    scored = (placed.join(_purity(placed), ["host", "parent", "template"])
              .select(F.col("host").alias("h"), F.col("shape").alias("s"), "template", "purity"))
    return (rows.join(scored, (F.col("host") == F.col("h")) & (F.col("shape") == F.col("s")), "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("ruled", F.when(F.col("purity") > REJECT_FROM, F.lit("block"))
                               .otherwise(F.lit("allow"))).alias("verdict"),
                    "template", "purity"))
