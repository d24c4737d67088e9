"""Aggregations. Each one combines on the map side, so a hot key costs one row per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.functions import full_name, month_of, month_start, sum_or_zero
from tallymart.operators.joins import same_keys
from tallymart.operators.sketches import exact_counts


def month_totals(
    sales: DataFrame,
    keys: Sequence[str],
    month: str = "sales_month",
    total: str = "total_sales",
) -> DataFrame:
    """Total cost per key and month. The month is grouped as a date and spelled out once per group."""
    grouped = sales.groupBy(*keys, month_start("sales_date").alias("__month")).agg(
        sum_or_zero("total_cost").alias(total)
    )
    return grouped.select(*keys, month_of("__month").alias(month), total)


def customer_month_totals(customer_mart: DataFrame) -> DataFrame:
    """Customer spend per month from the row-level customer mart."""
    named = customer_mart.withColumn("full_name", full_name("first_name", "last_name"))
    return month_totals(
        named, ["customer_id", "full_name", "address", "phone_number"], month="sales_date_month"
    )


def seller_month_totals(sales_mart: DataFrame) -> DataFrame:
    """Seller totals per store and month from the row-level sales mart."""
    named = sales_mart.withColumn(
        "full_name", full_name("sales_person_first_name", "sales_person_last_name")
    )
    return month_totals(named, ["store_id", "sales_person_id", "full_name"])


def customer_day_totals(sales: DataFrame) -> DataFrame:
    """What each customer bought on each day, with the month it belongs to."""
    daily = sales.groupBy("customer_id", "sales_date").agg(sum_or_zero("total_cost").alias("total_sales"))
    return daily.select("customer_id", month_of("sales_date").alias("sales_month"), "sales_date", "total_sales")


def total_by(df: DataFrame, key: str, value: str, total: str) -> DataFrame:
    """Rounded total per key in ascending order of the total."""
    return df.groupBy(key).agg(F.round(F.sum(value), 2).alias(total)).orderBy(total)


def with_group_total(df: DataFrame, keys: Sequence[str], value: str, total: str) -> DataFrame:
    """Every row with the total of its group, as a window sum over the whole group would give.

    The total is aggregated and joined back: a window would sort one whole group in one
    task, whereas the aggregate is combined before the shuffle and AQE splits a hot group
    in the join.
    """
    totals = df.groupBy(*keys).agg(F.sum(value).alias(total))
    # The totals are dealt again for the null-safe join: only joins of two fresh exchanges are split.
    return same_keys(df, totals, keys)


def distinct_group_totals(df: DataFrame, keys: Sequence[str], value: str, total: str) -> DataFrame:
    """The distinct (keys, total) of ``with_group_total``: the totals themselves, in one pass."""
    return df.groupBy(*keys).agg(F.sum(value).alias(total))


def profile(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Row count and distinct non-null values of each column, as one row.

    Exact counts take one scan and one shuffle for each column, of that column alone; counting them all in one aggregation would
    multiply every row by the number of columns.
    """
    if approximate:
        counts = [F.approx_count_distinct(F.col(f"`{c}`")).alias(f"distinct_{c}") for c in columns]
        return df.agg(F.count(F.lit(1)).alias("n_rows"), *counts)
    rows = df.agg(F.lit(None).cast("string").alias("column_name"), F.count(F.lit(1)).alias("n"))
    counted = exact_counts(df, columns).toDF("column_name", "n").unionByName(rows) if columns else rows
    one = lambda what, name: F.max(F.when(what, F.col("n"))).alias(name)
    return counted.agg(
        one(F.col("column_name").isNull(), "n_rows"), *[one(F.col("column_name") == c, f"distinct_{c}") for c in columns]
    )
