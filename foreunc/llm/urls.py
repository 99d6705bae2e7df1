"""URL filters: explicit host and path rules, and a path-template tree learned per host.

All urls of a host form a tree of path segments. Level by level a node's children become literal
branches or one wildcard: a segment stays literal if its share of labelled urls, or of blocked ones
among these, differs significantly from that of its siblings together; literal branches whose shares
are alike merge with each other, variable segments and all other branches into the wildcard. A leaf,
a template, is rejected by its smoothed share of blocked urls if most of its urls have labels. The
labels are the verdicts of the rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreunc.llm.common import written

#: A literal branch holds at least so many urls,
MIN_URLS = 5
#: and a share of it lies this many standard errors from its siblings'.
DIFFERENCE = 3.0
#: Literal branches merge if their shares are equal when rounded to this part.
LIKE = 4
#: Pseudo-labels of the parent's share in a smoothed share.
SMOOTHING = 10.0
#: Smoothed blocked share, and share of labelled urls, from which a template is rejected.
REJECT = 0.8
COVERED = 0.5
#: Segments of a template; the rest of a longer path counts as its last segment.
DEPTH = 8


@dataclass(frozen=True)
class Rule:
    """``text`` is a host and a path, as in ``example.org/en/``."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url column; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    whole = F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 1)
    host = F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 2)


def matching_rule(rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits ``host`` and ``path``; null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(
            rule.path
        )
        text, verdict = F.when(fits, F.lit(rule.text)).otherwise(text), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def _segments() -> Column:
    found = F.filter(F.split("path", "/"), lambda s: s != "")
    rest = F.array_join(F.slice(found, DEPTH, F.greatest(F.size(found), F.lit(1))), "/")
    return F.when(F.size(found) > DEPTH, F.concat(F.slice(found, 1, DEPTH - 1), F.array(rest))).otherwise(found)


def _differs(part: Column, size: Column, all_part: Column, all_size: Column) -> Column:
    """Whether the share ``part / size`` of a branch differs from its siblings', by a test of two proportions."""
    rest = F.when(all_size > size, all_size - size)
    pooled = (all_part + 0.5) / (all_size + 1)
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.when(size > 0, size) + 1 / rest))
    gap = part / F.when(size > 0, size) - (all_part - part) / rest
    return F.coalesce(F.abs(gap) >= DIFFERENCE * error, F.lit(False))


def _literals(rows: DataFrame) -> DataFrame:
    """(host, prefix, segment, step) of the branches that stay literal below each node.

    ``step`` names the branches that merge by the first of them and the number of others.
    """
    names = ("n", "labelled", "blocked")
    branch = written(
        rows.select(
            "host", "prefix", "segment", F.lit(1).alias("n"), F.col("label").isNotNull().cast("int").alias("labelled"),
            F.coalesce((F.col("label") == "block").cast("int"), F.lit(0)).alias("blocked"),
        ).filter("segment IS NOT NULL").groupBy("host", "prefix", "segment").agg(*(F.sum(c).alias(c) for c in names)),
        "branches",
    )
    node = branch.groupBy("host", "prefix").agg(*(F.sum(c).alias(f"all_{c}") for c in names))
    n, labelled, blocked = (F.col(c) for c in names)
    all_n, all_labelled, all_blocked = (F.col(f"all_{c}") for c in names)
    literal = written(
        branch.filter(n >= MIN_URLS)
        .join(written(node, "nodes"), ["host", "prefix"])
        .filter(_differs(labelled, n, all_labelled, all_n) | _differs(blocked, labelled, all_blocked, all_labelled))
        .select(
            "host", "prefix", "segment",
            F.round(LIKE * labelled / n).alias("covered"),
            F.round(LIKE * blocked / F.greatest(labelled, F.lit(1))).alias("share"),
        ),
        "literals",
    )
    kind = ["host", "prefix", "covered", "share"]
    alike = literal.groupBy(*kind).agg(F.min("segment").alias("first"), F.count("*").alias("size"))
    more = F.when(F.col("size") > 1, F.concat(F.lit("+"), F.col("size") - 1)).otherwise(F.lit(""))
    return literal.join(alike, kind).select(
        "host", "prefix", "segment", F.concat(F.lit("/="), "first", more).alias("step")
    )


def templates(rows: DataFrame) -> DataFrame:
    """``rows`` (host, path, label, others) with ``prefix``, the template of their path."""
    rows = rows.withColumn("segments", _segments()).withColumn("prefix", F.lit(""))
    deepest = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(deepest):
        rows = written(rows.withColumn("segment", F.get("segments", F.lit(level))), "urls")
        kept = written(_literals(rows), "steps")
        step = F.coalesce("step", F.lit("/*"))
        rows = rows.join(kept, ["host", "prefix", "segment"], "left").withColumn(
            "prefix", F.when(F.col("segment").isNull(), F.col("prefix")).otherwise(F.concat("prefix", step))
        ).drop("step", "segment")
    return rows.drop("segments")


def filter_urls(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, verdict, template) of every row of ``pages`` (page_id, url).

    The longest rule that fits a url's host, or a domain above it, and the start of its path decides
    (of equally long ones the alphabetically last); other urls get the verdict of their template:
    block if at least COVERED of its urls have a rule and the smoothed share of those that the rules
    block is at least REJECT. So a template, or a frequent branch, without labels of its own is never
    rejected. Null urls and urls without ``://`` have an empty host and path. Repeated rows and null
    ids stay, other columns are ignored.
    """
    host, path = host_and_path("url")
    text, verdict = matching_rule(rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.select("page_id", "host", "path", text.alias("rule"), verdict.alias("label"))
    rows = written(templates(rows), "templates")
    labelled = F.count("label").alias("labelled")
    blocked = F.count(F.when(F.col("label") == "block", 1)).alias("blocked")
    by_template = rows.groupBy("host", "prefix").agg(F.count("*").alias("n"), labelled, blocked)
    by_host = by_template.groupBy("host").agg(F.sum("labelled").alias("m"), F.sum("blocked").alias("b"))
    total = by_template.agg(F.sum("labelled").alias("m"), F.sum("blocked").alias("b")).first()
    overall = ((total.b or 0) + 0.5) / ((total.m or 0) + 1)
    of_host = (F.col("b") + SMOOTHING * overall) / (F.col("m") + SMOOTHING)
    purity = (F.col("blocked") + SMOOTHING * of_host) / (F.col("labelled") + SMOOTHING)
    rejected = (purity >= REJECT) & (F.col("labelled") > 0) & (F.col("labelled") >= COVERED * F.col("n"))
    judged = written(by_template.join(by_host, "host").select("host", "prefix", rejected.alias("rejected")), "judged")
    return rows.join(judged, ["host", "prefix"], "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("label", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("prefix").alias("template"),
    )
