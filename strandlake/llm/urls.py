"""URL filters: rules, and a path-template tree for what no rule decides.

Per host the paths form a tree of segments. A segment's digits and long hex runs become
wildcards; then, level by level from the root to the last segment, a branch becomes "*"
and is merged with its siblings if its labelled share of blocked pages doesn't differ
from theirs. A template is rejected if that share, smoothed towards the share of
all labelled pages, is high. Labels are the pages that the rules decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed values: (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Labelled pages that a branch needs, the deviation that tells it from its siblings, the smoothing's weight, and the share that rejects:
#: nine labelled pages, all bad, reject at a share of 0.37 among all. Chosen on labels held back of one page in five: 0.78 of the
#: bad ones are rejected and no good one, on the larger tables at hand. At a weight of 2 that is 0.91, but on small hosts sections
#: that no rule knows are rejected along with a bad one of five pages.
LEAST = 5
DEVIATION = 2.0
WEIGHT = 4.0
PURITY = 0.8


def host_of(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end; ASCII lower case; empty if there is none."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else null."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, start = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules=RULES, learn: Column | None = None) -> DataFrame:
    """One row per row of pages(page_id, url): page_id, host, path, rule, verdict, template, purity, method.

    verdict is the rule's if one fits, else the method's; method is what the page's template says by
    itself. Templates without labelled pages have the share of all labelled pages. `learn` may keep the labels
    of some pages out, by a condition on page_id and url, to measure the method on them.

    A null url or one without :// has an empty host and path and is allowed unless its
    template is rejected. Repeated rows stay; other columns are ignored; an empty table
    gives an empty result.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), (F.lit(True) if learn is None else learn).alias("learn"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    general = F.regexp_replace(F.regexp_replace("path", "[0-9a-fA-F]{16,}", "{x}"), "[0-9]+", "{n}")
    parts = F.split(general, "/")
    rows = rows.withColumns({"rule": rule, "decided": verdict, "segments": F.slice(parts, F.lit(2), F.size(parts))})
    leaf = stored(
        rows.groupBy("host", "segments").agg(
            F.count(F.when(F.col("learn"), F.col("decided"))).cast("double").alias("n"),
            F.sum((F.col("learn") & (F.col("decided") == "block")).cast("double")).alias("bad"),
        ).select("host", "segments", "n", F.coalesce("bad", F.lit(0.0)).alias("bad"), F.lit("").alias("template"), F.lit(False).alias("done"))
    )
    share = leaf.agg((F.sum("bad") / F.sum("n")).alias("share")).first()["share"]
    prior = min(max(0.5 if share is None else share, 0.01), 0.99)
    level = 0
    while not leaf.where("not done").isEmpty():
        leaf = _generalised(leaf, level, prior)
        level += 1
    purity = (F.sum("bad") + WEIGHT * prior) / (F.sum("n") + WEIGHT)
    scores = stored(leaf.groupBy("host", "template").agg(purity.alias("purity")))
    leaf = stored(leaf.join(scores, ["host", "template"]).select("host", "segments", "template", "purity"))
    method = F.when(F.col("purity") >= PURITY, "block").otherwise("allow")
    return rows.join(leaf, ["host", "segments"]).select("page_id", "host", "path", "rule", F.coalesce("decided", method).alias("verdict"), "template", "purity", method.alias("method"))


def _generalised(leaf: DataFrame, level: int, prior: float) -> DataFrame:
    """Add one level to every leaf's template: the segment or "*". A leaf that is alone below its node gets all that follow."""
    leaf = leaf.withColumn("segment", F.when(~F.col("done"), F.get("segments", F.lit(level))))
    node = ["host", "template"]
    child = stored(leaf.where("segment is not null").groupBy(*node, "segment").agg(F.count(F.lit(1)).alias("leaves"), F.sum("n").alias("own_n"), F.sum("bad").alias("own_bad")))
    # a node's sums come from its branches, so a busy node costs no more than it has branches
    total = stored(child.groupBy(*node).agg(F.count(F.lit(1)).alias("branches"), F.sum("own_n").alias("all_n"), F.sum("own_bad").alias("all_bad")))
    others = (F.col("all_bad") - F.col("own_bad") + WEIGHT * prior) / (F.col("all_n") - F.col("own_n") + WEIGHT)
    differs = F.abs(F.col("own_bad") / F.col("own_n") - others) / F.sqrt(others * (1 - others) / F.col("own_n"))
    single = F.col("branches") == 1
    kept = stored(child.join(total, node).where(single | (F.col("own_n") >= LEAST) & (differs > DEVIATION)).select(*node, "segment", F.lit(True).alias("kept"), (single & (F.col("leaves") == 1)).alias("alone")))
    rest = F.array_join(F.slice("segments", F.lit(level + 1), F.size("segments")), "/")
    step = F.when(F.col("segment").isNull(), "").otherwise(F.concat(F.lit("/"), F.when(F.col("alone"), rest).when(F.col("kept"), F.col("segment")).otherwise("*")))
    done = F.col("done") | (F.size("segments") <= level + 1) | F.coalesce("alone", F.lit(False))
    return stored(leaf.join(kept, [*node, "segment"], "left").withColumns({"template": F.concat("template", step), "done": done}).drop("segment", "kept", "alone"))
