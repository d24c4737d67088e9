"""Mixing sources to target sizes by entropy balancing.

Sources in code point order (null last) weigh 5, 2, 1 and so on again, and share ``SHARE`` of all words; a source's
target stops at ``MOST`` times its size, and what it leaves is shared again among the others by weight.

Every document starts with rate 1. The rates nearest to that (in the entropy of a rate between 0 and ``MOST``) that
give each source its target in words are exponentially tilted: rate / (MOST - rate) = exp(b * size / mean size), b the dual of the
source's one constraint. Where a source is to grow, its long documents are repeated first, since they bring most words for a given
change; where it is to shrink, they go first, and short ones stay near rate 1. Newton steps on the convex dual find b, kept within the bracket that
the signs of earlier gradients leave; each step sums gradient and Hessian over a histogram of (source, size) in one distributed aggregation.

Rates become copies by passing the rounding error on from document to document, longest first, in groups of about
``GROUP_ROWS`` documents of a source. So a group's words differ from what its rates ask for by less than a short document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tallymart.llm import common

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
GROUP_ROWS = 4_000
STEPS, PRECISION = 100, 1e-9


def n_words(text: Column) -> Column:
    """Number of runs of bytes other than space and \\x09-\\x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]]) -> dict[str | None, float]:
    """Target words for each (source, words)."""
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {source: WEIGHTS[i % len(WEIGHTS)] for i, (source, _) in enumerate(ordered)}
    size = dict(ordered)
    left, out = SHARE * sum(size.values()), {}
    while True:
        free = [s for s in size if s not in out]
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total > MOST * size[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in free}
        for s in full:
            out[s] = float(MOST * size[s])
        left -= sum(out[s] for s in full)


def duals(histogram: DataFrame, sources: DataFrame) -> DataFrame:
    """(sid, b) of every source: Newton's method on (sid, size, n) and (sid, mean, share), share above 0 and below ``MOST``.

    Raises if a source's words miss their target by more than ``PRECISION`` of it after ``STEPS`` steps.
    """
    none = F.lit(None).cast("double")
    state = sources.select("sid", "mean", "share", F.lit(0.0).alias("b"), none.alias("lo"), none.alias("hi"))
    x = F.col("size") / F.col("mean")
    rate = MOST / (1 + F.exp(-F.col("b") * x))
    b, g, last = F.col("b"), F.col("gradient"), state
    for _ in range(STEPS):
        sums = (
            histogram.join(state, "sid")
            .groupBy("sid", "mean", "share", "b", "lo", "hi")
            .agg(
                F.sum(F.col("n") * x * (F.col("share") - rate)).alias("gradient"),
                F.sum(F.col("n") * x * x * rate * (1 - rate / MOST)).alias("slope"),
                F.sum(F.col("n") * x * F.col("share")).alias("scale"),
            )
        )
        lo, hi = F.when(g > 0, b).otherwise(F.col("lo")), F.when(g < 0, b).otherwise(F.col("hi"))
        # Far out the slope vanishes: a step goes no further than a few times the way so far, and not beyond the bracket.
        reach = 4 * (1 + F.abs(b))
        newton = b + F.when(F.col("slope") > 0, F.greatest(F.least(g / F.col("slope"), reach), -reach)).otherwise(F.signum(g) * reach)
        inside = (lo.isNull() | (newton > lo)) & (hi.isNull() | (newton < hi))
        miss = F.abs(g) / F.col("scale")
        moved = F.when(miss < PRECISION, b).when(inside, newton).otherwise((lo + hi) / 2)
        step = common.written(
            sums.select("sid", "mean", "share", moved.alias("b"), lo.alias("lo"), hi.alias("hi"), miss.alias("miss")), "duals"
        )
        common.dropped(last)
        state, last = step.drop("miss"), step
        if (step.agg(F.max("miss")).first()[0] or 0.0) < PRECISION:
            return state.select("sid", "b")
    raise RuntimeError(f"the mix has not converged in {STEPS} steps")


def _copies(group: pa.Table) -> pa.Table:
    size, rate = group.column("size").to_numpy(), group.column("rate").to_numpy()
    order = np.lexsort((group.column("mark").to_numpy(), -size))
    copies, owed = np.zeros(len(size), np.int32), 0.0
    low, high = np.floor(rate), np.ceil(rate)
    for i in order.tolist():
        n = size[i]
        copies[i] = c = min(max(np.floor(rate[i] + owed / n + 0.5), low[i]), high[i]) if n else low[i]
        owed += n * (rate[i] - c)
    return group.append_column("copies", pa.array(copies))


@common.on_executors
def mixed(docs: DataFrame, size: Column, source: str = "source") -> DataFrame:
    """``row`` (a struct of all columns of ``docs``), size, source_size, target and copies for every row.

    A source without words has target 0. Documents without words have rate 1, or their source's if it takes all or nothing. The result
    is the same in every run. What reaches the driver is one sum for each source.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).alias("source"), size.alias("size"))
    histogram = common.written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    totals = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")), F.sum("n")).collect()
    target = targets([(r[0], r[1]) for r in totals])
    table = [
        (i, r[0], int(r[1]), float(target[r[0]]), r[1] / r[2], target[r[0]] / r[1] if r[1] else 0.0, -(-r[2] // GROUP_ROWS))
        for i, r in enumerate(sorted(totals, key=lambda r: (r[0] is None, r[0] or "")))
    ]
    sources = spark.createDataFrame(
        table, "sid int, name string, source_size long, target double, mean double, share double, parts int"
    )
    named = histogram.join(sources.select("sid", "name"), F.col("source").eqNullSafe(F.col("name"))).select("sid", "size", "n")
    inner = sources.where(f"share > 0 and share < {MOST} * (1 - 1e-9)")
    found = duals(named, inner) if any(0 < t[5] < MOST * (1 - 1e-9) for t in table) else None
    if found is None:
        known = sources.withColumn("b", F.lit(None).cast("double"))
    else:
        known = sources.join(found, "sid", "left")
    tilted = MOST / (1 + F.exp(-F.col("b") * F.col("size") / F.col("mean")))
    rated = (
        rows.join(known, F.col("source").eqNullSafe(F.col("name")))
        .withColumn("rate", F.when(F.col("b").isNotNull(), tilted).otherwise(F.least(F.col("share"), F.lit(float(MOST)))))
        .withColumn("mark", F.xxhash64("row"))
        .withColumn("part", F.pmod("mark", F.col("parts")))
        .select("row", "size", "source_size", "target", "rate", "mark", "sid", "part")
    )
    kinds = StructType([*rated.schema.fields, StructField("copies", IntegerType())])
    return rated.groupBy("sid", "part").applyInArrow(_copies, kinds).select("row", "size", "source_size", "target", "copies")


@common.on_executors
def repeated(docs: DataFrame, source: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, columns as they are.

    Only a hash of the row, its source and its size are mixed; whole rows meet the copies of their hash once and are repeated where they
    are, so no text passes through Python. Rows that are equal in all columns share the copies that fall to them.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    mark = F.xxhash64(F.lit(5), *names)
    slim = docs.select(mark.alias("mark"), F.col(source).alias("source"), n_words(F.col("text")).alias("words"))
    taken = mixed(slim, F.col("words")).select("row.mark", "copies").groupBy("mark").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    taken = common.written(taken.where("copies > 0"), "copies")
    whole = docs.select(F.struct(*names).alias("row"), mark.alias("mark")).join(taken, "mark")
    even = whole.where("copies % rows = 0").withColumn("times", F.expr("copies div rows"))
    # Equal rows whose copies don't divide: the first ones get one more.
    place = F.row_number().over(Window.partitionBy("mark").orderBy("mark"))
    odd = whole.where("copies % rows <> 0").withColumn("place", place).withColumn("times", F.expr("copies div rows") + F.expr("int(place <= copies % rows)"))
    both = even if taken.where("copies % rows <> 0").isEmpty() else even.select("row", "times").union(odd.select("row", "times"))
    numbers = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times").cast("long")))
    return both.where("times > 0").select("row", numbers).select("row.*")
