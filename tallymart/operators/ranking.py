"""Ranking sellers within a store's month, and the incentive that depends on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymart.functions import incentive_amount
from tallymart.operators.joins import null_free

STORE_MONTH = ("store_id", "sales_month")


def with_group_max(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    keyed, plain = null_free(df, keys)
    best = keyed.groupBy(*plain).agg(F.max(value).alias(name))
    return keyed.join(best, plain).drop(*plain)


def top_of_group(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows with the highest value of their group, all ties included (the rows of rank 1)."""
    ranked = with_group_max(df, keys, value, "__best")
    return ranked.where(F.col(value).eqNullSafe(F.col("__best"))).drop("__best")


def incentives(totals: DataFrame, keys: Sequence[str] = STORE_MONTH, total: str = "total_sales") -> DataFrame:
    """The incentive of every seller: a share of the own total for the best of the group, else 0.

    Only rank 1 matters, so the best total is a plain maximum joined back; no group is sorted.
    """
    ranked = with_group_max(totals, keys, total, "__best")
    wins = F.col(total).eqNullSafe(F.col("__best"))
    return ranked.withColumn("incentive", incentive_amount(total, wins)).drop("__best")


def rank_within(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "rnk", bands: int = 256
) -> DataFrame:
    """SQL ``rank()`` over ``keys`` by descending value, nulls last, without one task per group.

    A group is cut into bands of its value range (logarithmic, so a long tail spreads too).
    The rank of a value is one plus the rows in higher bands plus the rows above it in its
    own band. Equal values are counted before they are shuffled, so ties collapse, and the
    window over bands sees at most ``bands`` + 1 rows per group. Bands only spread the
    work: the rank is exact for any cut. ``df`` is gone over several times, so it should be a written table.
    """
    keyed, plain = null_free(df, keys)
    keyed, exact = null_free(keyed, [value], "__value")
    position = F.signum(F.col(value).cast("double")) * F.log1p(F.abs(F.col(value).cast("double")))
    counted = keyed.groupBy(*plain, *exact).agg(F.first(value).alias(value), F.count(F.lit(1)).alias("__n"))
    spans = counted.groupBy(*plain).agg(F.min(position).alias("__lo"), F.max(position).alias("__hi"))
    share = (F.col("__hi") - position) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
    band = F.when(F.col(value).isNull(), F.lit(bands)).otherwise(
        F.coalesce(F.least(F.floor(share * bands), F.lit(bands - 1)), F.lit(0))
    )
    banded = counted.join(spans, plain).select(*plain, *exact, value, "__n", band.cast("int").alias("__band"))

    above = Window.partitionBy(*plain).orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    sizes = banded.groupBy(*plain, "__band").agg(F.sum("__n").alias("__size"))
    offsets = sizes.select(*plain, "__band", F.coalesce(F.sum("__size").over(above), F.lit(0)).alias("__above"))

    inside = (
        Window.partitionBy(*plain, "__band")
        .orderBy(F.col(value).desc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ranks = banded.join(offsets, [*plain, "__band"]).select(
        *plain, *exact, (F.lit(1) + F.col("__above") + F.coalesce(F.sum("__n").over(inside), F.lit(0))).alias(name)
    )
    return keyed.join(ranks, [*plain, *exact]).drop(*plain, *exact)
