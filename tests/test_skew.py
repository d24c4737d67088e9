"""Hot keys: a third of all rows shares one customer, store, seller or month."""

from __future__ import annotations

from contextlib import contextmanager

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallymart.operators import joins, ranking, totals
from tallymart.plans import marts

N = 300_000


@contextmanager
def settings(spark, **values):
    """Settings under which a small test table behaves like a large one: no broadcast, small partitions."""
    values = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def large(spark):
    return settings(
        spark,
        spark__sql__shuffle__partitions="32",
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="200KB",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="100KB",
    )


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.fixture(scope="module")
def hot_sales(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hot") / "sales")
    hot = F.col("id") % 3 == 0
    (
        spark.range(N)
        .select(
            F.when(hot, 7).otherwise(F.col("id") % 5_000).cast("bigint").alias("customer_id"),
            F.when(hot, 1).otherwise(F.col("id") % 50).cast("bigint").alias("store_id"),
            F.when(hot, F.col("id") % 60_000).otherwise(F.col("id") % 1_000).cast("bigint").alias("sales_person_id"),
            F.date_add(F.lit("2023-01-01").cast("date"), F.when(hot, 0).otherwise(F.col("id") % 300).cast("int")).alias(
                "sales_date"
            ),
            (F.pmod(F.xxhash64("id"), F.lit(10**6)) / 100).cast("decimal(18,2)").alias("total_cost"),
        )
        .repartition(8)
        .write.parquet(path)
    )
    return spark.read.parquet(path)


def customers(spark):
    return spark.range(5_000).select(
        F.col("id").alias("customer_id"),
        *[F.concat(F.lit(c), F.col("id").cast("string")).alias(c)
          for c in ("first_name", "last_name", "address", "pincode", "phone_number")],
    )


def test_hot_customer_is_split_in_the_join(spark, hot_sales):
    with large(spark):
        joined = joins.with_customer(hot_sales, customers(spark))
        assert "SortMergeJoin(skew=true)" in final_plan(joined)
        assert joined.count() == N


def test_hot_group_is_split_when_its_total_is_joined_back(spark, hot_sales):
    with large(spark):
        totalled = totals.with_group_total(hot_sales, ["customer_id"], "total_cost", "t")
        assert "SortMergeJoin(skew=true)" in final_plan(totalled)
        window = hot_sales.withColumn("t", F.sum("total_cost").over(Window.partitionBy("customer_id")))
        assert totalled.groupBy("customer_id", "t").count().exceptAll(
            window.groupBy("customer_id", "t").count()
        ).isEmpty()


def test_hot_customer_reaches_the_join_as_one_row_per_month(spark, hot_sales):
    mart = marts.customer_monthly(hot_sales, customers(spark))
    plan = mart._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")
    assert mart.where("customer_id = 7").count() <= 11
    assert mart.agg(F.sum("total_sales")).first()[0] == hot_sales.agg(F.sum("total_cost")).first()[0]


def test_rank_of_a_hot_store_month_is_exact_and_spread(spark, hot_sales):
    sellers = totals.month_totals(hot_sales, ["store_id", "sales_person_id"])
    with large(spark):
        ranked = ranking.rank_within(sellers, ranking.STORE_MONTH, "total_sales")
        order = Window.partitionBy(*ranking.STORE_MONTH).orderBy(F.desc("total_sales"))
        expected = sellers.withColumn("rnk", F.rank().over(order).cast("long"))
        assert ranked.select(expected.columns).exceptAll(expected).isEmpty()
        assert ranked.count() == expected.count()
    with large(spark):
        paid = ranking.incentives(sellers)
        assert paid.count() == sellers.count()
        assert "Window" not in final_plan(paid)
    assert sellers.where("store_id = 1 and sales_month = '2023-01'").count() > sellers.count() / 4


def test_aggregates_combine_before_the_shuffle(spark, hot_sales):
    plan = final_plan(totals.month_totals(hot_sales, ["customer_id"]))
    assert "partial_sum" in plan


def test_shared_subplan_is_shuffled_once(spark, hot_sales):
    sellers = totals.month_totals(hot_sales, ["store_id", "sales_person_id"])
    assert "ReusedExchange" in final_plan(ranking.incentives(sellers))
