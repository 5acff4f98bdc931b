"""URL filter: explicit rules first, then a path-template tree per host (DataFrame functions only).

The tree is grown level by level over distinct (host, path) rows, as deep as
any node has MIN_SUPPORT pages; below smaller nodes no segment can be told
apart, so the rest of their paths is generalised at once. A segment stays literal below
its parent if it has MIN_SUPPORT pages there, however small its part of them,
else it becomes a wildcard of its shape. Literal siblings whose labelled shares
of blocked pages do not differ significantly from the rest of their parent are
merged into one branch. A template is rejected if its share of blocked pages, smoothed towards
its host's and the whole table's, is above one half; the smoothing alone never
rejects, so most of a rejected template's own labels are blocks. The rules'
verdicts are the labels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesight.llm.common import ascii_lower, without
from lakesight.session import materialise

MIN_SUPPORT = 10
CRITICAL = 3.84  # chi-square at 5 %, one degree of freedom
SMOOTHING = 10.0
REJECT_ABOVE = 0.5
RESULT = ["host", "path", "rule", "template", "purity", "verdict"]


@dataclass(frozen=True)
class Rule:
    text: str  # host and path, like "example.org/es/"
    allow: bool

    def fits(self, host: Column, path: Column) -> Column:
        name, slash, rest = self.text.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)


RULES = (
    Rule("org/", True), Rule("example.org/es/", False), Rule("example.org/en/1", False), Rule("com/fr/", True), Rule("com/de/", False),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def with_rules(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Columns rule and verdict from the longest fitting rule, the first one on a tie."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = r.fits(F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, "allow" if r.allow else "block").otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("verdict", verdict)


def wildcard(segment: Column) -> Column:
    """Shape of a variable segment: numbers, words or mixed, with its extension."""
    name, extension = F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z0-9]+)?$", 1), F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z0-9]+)?$", 2)
    kind = F.when(segment == "", "").when(name.rlike("^[0-9]+$"), "<n>").when(name.rlike("[0-9]"), "<m>").otherwise("<w>")
    return F.concat(kind, extension)


def _rest(level: int) -> Column:
    """The segments from ``level`` on as wildcards, each after a slash."""
    left = F.slice("segments", F.lit(level + 1), F.greatest(F.size("segments") - level, F.lit(0)))
    return F.array_join(F.concat(F.array(F.lit("")), F.transform(left, wildcard)), "/")


def _level(paths: DataFrame, level: int) -> DataFrame:
    """``paths`` with the template one segment longer."""
    t = paths.withColumn("_segment", F.get("segments", F.lit(level)))
    here = t.where("_segment IS NOT NULL")
    children = here.groupBy("host", "template", "_segment").agg(
        F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    children = materialise(children)
    parents = children.groupBy("host", "template").agg(
        F.sum("labelled").alias("_labelled"), F.sum("blocked").alias("_blocked"))
    # rare segments need no look at their parent
    literal = children.where(F.col("n") >= MIN_SUPPORT).join(parents, ["host", "template"])
    rest, rest_blocked = F.col("_labelled") - F.col("labelled"), F.col("_blocked") - F.col("blocked")
    pooled = F.col("_blocked") / F.col("_labelled")
    difference = F.col("blocked") / F.col("labelled") - rest_blocked / rest
    variance = pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / rest)
    apart = (F.col("labelled") > 0) & (rest > 0) & (F.col("_blocked") > 0) & (F.col("_blocked") < F.col("_labelled"))
    differs = F.when(apart, difference * difference > CRITICAL * variance).otherwise(False)
    literal = literal.select("host", "template", "_segment", F.when(differs, F.col("_segment")).otherwise("~").alias("_branch"))
    joined = t.join(literal, ["host", "template", "_segment"], "left")
    step = F.concat(F.col("template"), F.lit("/"), F.coalesce("_branch", wildcard(F.col("_segment"))))
    return joined.withColumn("template", F.when(F.col("_segment").isNull(), F.col("template")).otherwise(step)).drop("_segment", "_branch")


def templates(parsed: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(host, path, template, purity) for the distinct hosts and paths of ``parsed`` (host, path, verdict of a rule or null).

    ``max_depth`` ends the tree at that level, with wildcards below; without it the data alone do.
    """
    paths = parsed.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count("verdict").alias("labelled"), F.count(F.when(F.col("verdict") == "block", 1)).alias("blocked"))
    segments = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace("path", "^/", ""), "/", -1))
    paths = materialise(paths.withColumn("segments", segments).withColumn("template", F.lit("")))
    level = 0
    while level != max_depth:
        nodes = paths.where(F.size("segments") > level).groupBy("host", "template").agg(F.sum("n").alias("n"))
        if nodes.where(F.col("n") >= MIN_SUPPORT).isEmpty():
            break
        paths = materialise(_level(paths, level))
        level += 1
    paths = paths.withColumn("template", F.concat("template", _rest(level)))
    by_template = materialise(paths.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")))
    everywhere = by_template.agg(F.coalesce(F.sum("labelled"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    overall = everywhere[1] / everywhere[0] if everywhere[0] else 0.0
    by_host = by_template.groupBy("host").agg(F.sum("labelled").alias("_labelled"), F.sum("blocked").alias("_blocked"))
    host_share = (F.col("_blocked") + F.lit(SMOOTHING * overall)) / (F.col("_labelled") + SMOOTHING)
    # capped, so that a host's other templates cannot reject one whose own labels do not
    prior = F.least(host_share, F.lit(REJECT_ABOVE))
    purity = (F.col("blocked") + SMOOTHING * prior) / (F.col("labelled") + SMOOTHING)
    judged = by_template.join(by_host, "host").select("host", "template", purity.alias("purity"))
    return paths.select("host", "path", "template").join(judged, ["host", "template"])


def filter_urls(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, max_depth: int | None = None) -> DataFrame:
    """``pages`` with host, path, rule, template, purity and verdict (allow or block).

    Defined cases: a null url or one without ``://`` has an empty host and path
    and is judged like any other; without any labelled page everything unruled
    is allowed; repeated rows each get their row; input columns named like a
    result are replaced.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    given = pages.select(F.struct(*[F.col(f"`{c}`") for c in without(pages, [c for c in RESULT if c != url]).columns]).alias("given"),
                         host.alias("host"), path.alias("path"))
    parsed = with_rules(given, rules)
    judged = templates(parsed.select("host", "path", "verdict"), max_depth)
    by_tree = F.when(F.col("purity") > REJECT_ABOVE, "block").otherwise("allow")
    joined = parsed.join(judged, ["host", "path"])
    return joined.select("given.*", "host", "path", "rule", "template", "purity", F.coalesce("verdict", by_tree).alias("verdict"))
