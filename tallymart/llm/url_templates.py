"""URL filter by a tree of path templates for each host, in DataFrame functions only.

A path's segments that by their shape vary (numbers, dates, long hex, very long words) become wildcards first. Then each node's
branches are compared by their labels. A branch without labels, or whose good ones don't differ significantly from the node's share
(exact binomial test up to ``EXACT`` labels, ``Z`` standard errors beyond), goes into the node's ``{any}``. The others are
compared with each other: on either side of the node's share those whose Wilson intervals overlap, directly or through others,
become one branch, ``{any:low1}`` or ``{any:high1}`` and so on; one that is alone keeps its name. This holds at every depth. A node
ends when all its paths have the same segments left; what its paths have in common is passed over at once, so the number of
rounds is that of branchings, not of segments.

A template's purity is its share of good labels, smoothed by its host's, which is smoothed by that of all pages.
Templates below ``PURITY`` are blocked. Lists of (host, path) rules go first. Braces of a path are written as %7B and %7D, so no
literal segment equals a wildcard. A template of more than ``DEPTH`` segments whose labels all agree is written with
``{tail}`` for its end; that is its name only.

All sums go by (host, template, segment), so a host with a third of all pages is combined on the map side; intervals are
compared once for each pair of counts that occurs, not for each branch.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.llm.common import written

DEPTH = 6
Z, EXACT, TAIL = 1.96, 60, 0.025
SMOOTHING, PURITY = 4.0, 0.5

#: Shapes of segments that vary, in the order in which they are tried: pattern and what stands for it.
SHAPES = (
    (r"^[0-9]+$", "{number}"),
    (r"^[0-9]+(\.[A-Za-z]{1,5})$", "{number}$1"),
    (r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "{date}"),
    (r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", "{uuid}"),
    (r"^(?=.*[0-9])[0-9a-fA-F]{8,}$", "{hex}"),
    (r"^.*[-_]?[0-9]{3,}$", "{word}{number}"),
    (r"^.{41,}$", "{long}"),
)


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(length, rule, verdict) of the longest rule that fits, or null. The list is part of the plan, so keep it short."""
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(len(r.host + r.path)).alias("length"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    none = F.lit(None).cast("struct<length: int, rule: string, verdict: string>")
    return F.array_max(F.array_compact(F.array(*fits, none)))


def _shape(segment: Column) -> Column:
    """What stands for a segment: its wildcard, or itself without braces."""
    out = F.replace(F.replace(segment, F.lit("{"), F.lit("%7B")), F.lit("}"), F.lit("%7D"))
    for pattern, name in reversed(SHAPES):
        out = F.when(segment.rlike(pattern), F.regexp_replace(segment, pattern, name.replace("{", r"\{").replace("}", r"\}"))).otherwise(out)
    return out


def _lower_tail(successes: Column, trials: Column, share: Column) -> Column:
    """Probability of at most so many successes; ``share`` above 0 and below 1."""
    first = F.pow(1 - share, trials)
    numbers = F.when(successes > 0, F.sequence(F.lit(1).cast("long"), successes)).otherwise(F.array().cast("array<long>"))
    start = F.struct(first.alias("term"), first.alias("total"))

    def add(held: Column, i: Column) -> Column:
        term = held["term"] * (trials - i + 1) / i * share / (1 - share)
        return F.struct(term.alias("term"), (held["total"] + term).alias("total"))

    return F.aggregate(numbers, start, add, lambda held: held["total"])


def differs(good: Column, labelled: Column, share: Column) -> Column:
    """Whether so many good labels differ significantly from a share; never without labels, or from a share of 0 or 1."""
    below = good <= labelled * share
    exact = _lower_tail(F.when(below, good).otherwise(labelled - good), labelled, F.when(below, share).otherwise(1 - share)) < TAIL
    far = F.abs(good / labelled - share) > Z * F.sqrt(share * (1 - share) / labelled)
    testable = (labelled > 0) & (share > 0) & (share < 1)
    return F.when(~F.coalesce(testable, F.lit(False)), False).when(labelled <= EXACT, exact).otherwise(far)


def _wilson(good: Column, labelled: Column) -> tuple[Column, Column]:
    """The interval in which the true share lies, from so many labels."""
    share, spread = good / labelled, Z * Z / labelled
    middle = (share + spread / 2) / (1 + spread)
    half = Z / (1 + spread) * F.sqrt(share * (1 - share) / labelled + spread / (4 * labelled))
    return middle - half, middle + half


NODE = ["host", "template"]


def _steps(branches: DataFrame, nodes: DataFrame) -> DataFrame:
    """(host, template, branch, step): what each branch of the nodes (host, template, share) is called from here on."""
    named = branches.join(nodes.select(*NODE, "share"), NODE)
    shaped = F.col("branch").startswith("{") | (F.col("branch") == "")
    apart = ~shaped & differs(F.col("g"), F.col("l"), F.col("share"))
    side = F.when(F.col("g") < F.col("l") * F.col("share"), "low").otherwise("high")
    marked = named.withColumn("side", F.when(apart, side)).withColumn("shaped", shaped)
    # One row for each pair of counts, so a node of very many branches is no large group.
    counts = marked.where("side is not null").groupBy(*NODE, "side", "l", "g").agg(F.count(F.lit(1)).alias("many"))
    low, high = _wilson(F.col("g"), F.col("l"))
    counts = counts.withColumns({"least": low, "most": high})
    order = Window.partitionBy(*NODE, "side").orderBy("least", "most", "l")
    reached = F.max("most").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = counts.withColumn("opens", F.coalesce((F.col("least") > reached).cast("int"), F.lit(1)))
    island = opens.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = island.groupBy(*NODE, "side", "island").agg(F.sum("many").alias("members"))
    known = island.join(sizes, [*NODE, "side", "island"]).select(*NODE, "side", "l", "g", "island", "members")
    step = (
        F.when(F.col("shaped"), F.col("branch"))
        .when(F.col("island").isNull(), "{any}")
        .when(F.col("members") == 1, F.col("branch"))
        .otherwise(F.concat(F.lit("{any:"), F.col("side"), F.col("island").cast("string"), F.lit("}")))
    )
    return marked.join(known, [*NODE, "side", "l", "g"], "left").select(*NODE, "branch", step.alias("step"))


def templates(paths: DataFrame) -> DataFrame:
    """(host, path, pages, labelled, good, template) for distinct (host, path, pages, labelled, good)."""
    kept = ["host", "path", "pages", "labelled", "good"]
    left = F.transform(F.split(F.regexp_replace("path", "^/", ""), "/"), _shape)
    now = written(paths.select(*kept, F.lit("").alias("template"), F.lit(0).alias("depth"), left.alias("left")), "paths")
    done = []
    while not now.isEmpty():
        first = F.element_at("left", 1)
        branches = now.groupBy(*NODE, first.alias("branch")).agg(F.sum("labelled").alias("l"), F.sum("good").alias("g"))
        nodes = now.groupBy(*NODE).agg(
            F.sum("labelled").alias("nl"), F.sum("good").alias("ng"), F.count(F.lit(1)).alias("nk"), F.min("left").alias("lo"), F.max("left").alias("hi")
        )
        # The least and the greatest of a node's paths have in common what all have.
        equal = F.transform("lo", lambda x, i: F.coalesce(x == F.get("hi", i), F.lit(False)))
        common = F.when(F.forall(equal, lambda e: e), F.size("lo")).otherwise(F.array_position(equal, F.lit(False)).cast("int") - 1)
        nodes = written(
            nodes.select(
                *NODE, F.try_divide("ng", "nl").alias("share"), common.alias("common"), (F.col("lo") == F.col("hi")).alias("ends"),
                (F.coalesce((F.col("ng") == 0) | (F.col("ng") == F.col("nl")), F.lit(False)) & (F.col("nk") > 1)).alias("agreed"),
            ),
            "nodes",
        )
        steps = _steps(branches.join(nodes.where("common = 0 and not ends"), NODE, "left_semi"), nodes)
        moved = now.join(nodes.drop("share"), NODE).withColumn("branch", first).join(steps, [*NODE, "branch"], "left")
        room = F.greatest(F.lit(0), F.lit(DEPTH) - F.col("depth"))
        tail = F.col("ends") & F.col("agreed") & (F.size("left") > room)
        taken = (
            F.when(tail, F.concat(F.slice("left", F.lit(1), room), F.array(F.lit("{tail}"))))
            .when(F.col("ends"), F.col("left"))
            .when(F.col("common") > 0, F.slice("left", F.lit(1), F.col("common")))
            .otherwise(F.array("step"))
        )
        size = F.greatest(F.col("common"), F.lit(1))
        rest = F.slice("left", size + 1, F.greatest(F.size("left") - size, F.lit(0)))
        moved = written(
            moved.select(
                *kept, F.concat("template", F.lit("/"), F.array_join(taken, "/")).alias("template"), (F.col("depth") + size).alias("depth"),
                F.when(F.col("ends"), F.array().cast("array<string>")).otherwise(rest).alias("left"),
            ),
            "templates",
        )
        done.append(moved.where("size(left) = 0").select(*kept, "template"))
        now = moved.where("size(left) > 0")
    return reduce(DataFrame.union, done) if done else now.select(*kept, "template")


def _smoothed(good: Column, labelled: Column, prior: Column) -> Column:
    return (good + SMOOTHING * prior) / (labelled + SMOOTHING)


def judged(pages: DataFrame, labels: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity for every row of ``pages`` (page_id, url, other columns).

    ``labels`` has (page_id, good), good 0 or 1 or null; of a page with several, the least counts. A null url, or one
    without ``://``, has an empty host and path, which is a template of its own. Without any label nothing is blocked
    but by rules.
    """
    url = F.col("url")
    known = labels.where("good is not null").groupBy(F.col("page_id").alias("page_id")).agg(F.min("good").cast("long").alias("good"))
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = written(rows.join(known, "page_id", "left"), "pages")
    paths = rows.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("pages"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")
    )
    tree = templates(paths)
    every = tree.agg(F.sum("good"), F.sum("labelled")).first()
    overall = (every[0] / every[1]) if every[1] else 1.0
    sums = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
    hosts = sums.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("good").alias("hg"))
    purity = _smoothed(F.col("good"), F.col("labelled"), _smoothed(F.col("hg"), F.col("hl"), F.lit(overall)))
    pure = sums.join(hosts, "host").select("host", "template", purity.alias("purity"))
    found = tree.select("host", "path", "template").join(pure, ["host", "template"])
    rule = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") < PURITY, F.lit("block")).otherwise(F.lit("allow"))
    return (
        rows.select("page_id", "host", "path")
        .join(found, ["host", "path"])
        .withColumn("fit", rule)
        .select(
            "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), own).alias("verdict"),
            "template", "purity",
        )
    )
