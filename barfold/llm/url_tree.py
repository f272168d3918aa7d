"""URL filters: rules by host and path, and for the rest a path-template tree for each host.

Each host's paths form a tree of segments. Level by level from the root, a segment becomes the wildcard * if its branch
is statistically like its parent: neither its share of labelled pages nor its share of bad ones among them is less likely
than LEVEL, shared out over the branches (by Chernoff's bound of binomial tails, which holds for single pages, too).
Branches that differ keep their names, however rare they are, so a bad section is neither diluted by others nor does it
spoil them. Pages that share host and template are judged together: a template is rejected
if its share of bad among labelled pages, smoothed towards the share over all pages, is at least REJECT_AT, and it has
enough labels. Labels are those that the rules give, or a table of labelled pages. Built-in functions only.

The tree goes as deep as there is anything to tell apart. A template whose paths are all labelled alike, or none, or that
is a single path, can't split any more: all its further segments are wildcards, which is settled at once, so long paths
cost no levels of their own.

Pages are summed up by host and path before anything else, and each level joins sums with sums. Parents and branches
unlike them, the only ones that paths are joined with, are few and broadcast after a count; beyond it they are joined by
a shuffle with a unique side, whose hot keys Spark can split.

Defined cases: a null url, or one without ://, has empty host and path and falls under no rule; an empty path is a
template of its own; repeated rows are rows of their own; pages without labels are judged by the rules alone; an empty
table gives an empty one. Only id and url are read, so other columns don't clash.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barfold.llm.shared import written

#: Chance to take any branch of a parent for unlike it where all are alike.
LEVEL = 0.05
#: Up to this many parents, or branches unlike them, of a level are broadcast; more are joined by a shuffle.
BROADCAST_PARENTS = 200_000
#: Labels in favour of the overall share, least labels, and the share of bad from which on a template is rejected.
PRIOR_WEIGHT, LEAST_LABELS, REJECT_AT = 5.0, 5, 0.8
#: Rules are part of the plan, so their number is bounded.
MOST_RULES = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


class Rule(NamedTuple):
    """Fits a host and its subdomains where the path begins with path."""

    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def ruled(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits as (rule, allow), else null; of two as long, one that blocks."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,allow:boolean>")
    for r in sorted(rules, key=lambda r: (len(r.name), not r.allow)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.allow).alias("allow"))).otherwise(found)
    return found


def _unlike(part: Column, part_n: Column, whole: Column, whole_n: Column, values: Column) -> Column:
    """Does a branch's share differ from its parent's beyond chance, as one of so many branches?"""

    def term(x: Column, share: Column) -> Column:
        return F.when(x > 0, x * F.ln(x / (part_n * share))).otherwise(0.0)

    share = F.try_divide(whole, whole_n)
    divergence = term(part, share) + term(part_n - part, 1 - share)
    return F.coalesce(divergence > F.ln(2 * values / LEVEL), F.lit(False))


_SUMS = ("n", "m", "bad")


def _settled(n: Column, m: Column, bad: Column, paths: Column) -> Column:
    """Can no branch of these pages differ from the others?"""
    return (paths == 1) | (m == 0) | ((m == n) & ((bad == 0) | (bad == m)))


def templates(paths: DataFrame) -> DataFrame:
    """(host, path, n, m, bad) summed by host and path -> with template: segments generalised level by level."""
    now = written(paths.withColumns({"segments": F.split(F.col("path"), "/"), "template": F.lit("")}))
    done, level = [], 1
    while True:
        parents = now.groupBy("host", "template").agg(F.count("*").alias("paths"), *[F.sum(c).alias(f"all_{c}") for c in _SUMS])
        parents = written(parents.withColumn("settled", _settled(*[F.col(f"all_{c}") for c in _SUMS], F.col("paths"))))
        if parents.count() <= BROADCAST_PARENTS:
            parents = F.broadcast(parents)
        # Whatever follows in these paths is like its parent.
        stars = F.repeat(F.lit("/*"), F.greatest(F.size("segments") - level, F.lit(0)))
        known = now.join(parents, ["host", "template"])
        ends = F.col("settled") | (F.size("segments") <= level)
        done.append(written(known.filter(ends).select("host", "path", *_SUMS, F.concat("template", stars).alias("template"))))
        some = written(known.filter(~ends).withColumn("segment", F.element_at("segments", level + 1)).select("host", "path", *_SUMS, "segments", "template", "segment"))
        if some.isEmpty():
            break
        branches = some.groupBy("host", "template", "segment").agg(*[F.sum(c).alias(c) for c in _SUMS])
        # Shares are those of the branches that go on, as paths that end here have no segment to compare.
        going = written(branches.groupBy("host", "template").agg(F.count("*").alias("values"), *[F.sum(c).alias(f"all_{c}") for c in _SUMS]))
        if going.count() <= BROADCAST_PARENTS:
            going = F.broadcast(going)
        whole = branches.join(going, ["host", "template"])
        labelled = _unlike(F.col("m"), F.col("n"), F.col("all_m"), F.col("all_n"), F.col("values"))
        unlike = labelled | _unlike(F.col("bad"), F.col("m"), F.col("all_bad"), F.col("all_m"), F.col("values"))
        own = written(whole.filter(unlike).select("host", "template", "segment", F.lit(True).alias("own")))
        if own.count() <= BROADCAST_PARENTS:
            own = F.broadcast(own)
        shown = F.when(F.col("own"), F.col("segment")).otherwise(F.lit("*"))
        longer = F.concat("template", F.lit("/"), shown).alias("template")
        now = written(some.join(own, ["host", "template", "segment"], "left").select("host", "path", *_SUMS, "segments", longer))
        level += 1
    for part in done[1:]:
        done[0] = done[0].unionByName(part)
    return done[0]


def judge(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None, page: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule (null if none), verdict (allow or block), template and purity (smoothed share of bad).

    labels: (page_id, bad boolean); without them, the verdicts of the rules are the labels."""
    rows = pages.select(F.col(f"`{page}`").alias("page_id"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    rows = rows.withColumn("ruled", ruled(F.col("host"), F.col("path"), rules))
    if labels is None:
        rows = rows.withColumn("bad", ~F.col("ruled.allow"))
    else:
        one = labels.groupBy("page_id").agg(F.max("bad").alias("bad"))
        rows = rows.join(one, "page_id", "left")
    paths = rows.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count("bad").alias("m"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad")
    )
    known = templates(paths)
    sums = known.groupBy("host", "template").agg(F.sum("m").alias("m"), F.sum("bad").alias("bad"))
    total = known.agg(F.coalesce(F.sum("bad") / F.sum("m"), F.lit(0.0)).alias("overall")).first().overall
    purity = (F.col("bad") + PRIOR_WEIGHT * total) / (F.col("m") + PRIOR_WEIGHT)
    judged = sums.select("host", "template", purity.alias("purity"), ((F.col("m") >= LEAST_LABELS) & (purity >= REJECT_AT)).alias("rejected"))
    per_path = known.join(judged, ["host", "template"]).select("host", "path", "template", "purity", "rejected")
    verdict = F.when(F.coalesce(F.col("ruled.allow"), ~F.col("rejected")), F.lit("allow")).otherwise(F.lit("block"))
    return rows.join(per_path, ["host", "path"], "left").select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
