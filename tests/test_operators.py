from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fixtures import customer_frame, rows_of, sale, sales_frame, seller_frame, store_frame
from tallymart import functions as fn
from tallymart.operators import joins, projections, quality, ranking, sketches, totals
from tallymart.plans import marts

D = Decimal


def test_full_name_is_null_when_a_part_is_null(spark):
    df = spark.createDataFrame([("A", "B"), ("A", None)], "f string, l string")
    assert [r[0] for r in df.select(fn.full_name("f", "l")).collect()] == ["A B", None]


def test_month_and_back(spark):
    df = spark.sql("select date'2023-03-31' d union all select cast(null as date)")
    out = df.select(fn.month_of("d").alias("m")).select("m", fn.month_to_date("m").cast("string"))
    assert rows_of(out) == sorted([("2023-03", "2023-03-01"), (None, None)], key=repr)


def test_pack_extras(spark):
    df = spark.createDataFrame([("x", "y"), (None, "y"), (None, None)], "a string, b string")
    packed = [r[0] for r in df.select(fn.pack_extras([F.col("a"), F.col("b")])).collect()]
    assert packed == ["x, y", "y", ""]
    assert df.select(fn.pack_extras([]).alias("p")).schema["p"].dataType.simpleString() == "string"


def test_enrich_keeps_known_sales_with_unique_names(spark, dimensions):
    sales = sales_frame(
        spark, sale(), sale(customer=99), sale(store=124), sale(seller=10), sale(customer=None)
    )
    out = joins.enrich(sales, dimensions.customer, dimensions.store, dimensions.sales_team)
    assert len(set(out.columns)) == len(out.columns)
    assert out.count() == 1
    assert projections.customer_mart(out).columns == [
        "customer_id", "first_name", "last_name", "address", "pincode", "phone_number", "sales_date", "total_cost",
    ]
    row = projections.sales_mart(out).first()
    assert (row.sales_person_first_name, row.store_manager_name, row.sales_month) == (
        "Seller1", "Manager121", "2023-03",
    )


def test_unmatched_report_counts_lost_sales(spark, dimensions):
    sales = sales_frame(spark, sale(), sale(customer=99), sale(customer=99, cost="5.50"), sale(customer=None))
    report = joins.unmatched_report(
        sales, {"customer_id": (dimensions.customer, "customer_id"), "store_id": (dimensions.store, "id")}
    )
    assert rows_of(report) == sorted(
        [("customer_id", "99", 2, D("15.50")), ("customer_id", None, 1, D("10.00"))], key=repr
    )


def test_with_product_keeps_unknown_products(spark):
    product = spark.createDataFrame([(1, "salt", D("2.00"), D("1.00"))], "id long, name string, "
                                    "current_price decimal(10,2), old_price decimal(10,2)")
    out = joins.with_product(sales_frame(spark, sale()), product)
    assert out.first().current_price is None and out.count() == 1


def test_customer_totals_agree_in_all_forms(spark, dimensions):
    sales = sales_frame(
        spark,
        sale(day="2023-03-01", cost="1.10"),
        sale(day="2023-03-31", cost="2.20"),
        sale(day="2023-04-01", cost="4.00"),
        sale(customer=2, cost="8.00"),
        sale(customer=2, day=None, cost="16.00"),
        sale(customer=3, cost=None),
        sale(store=124, cost="32.00"),
    )
    expected = sorted(
        [
            (1, "2023-03", D("3.30")),
            (1, "2023-04", D("4.00")),
            (2, "2023-03", D("8.00")),
            (2, None, D("16.00")),
            (3, "2023-03", D("0.00")),
        ],
        key=repr,
    )
    early = marts.customer_monthly(sales, dimensions.customer, dimensions.store, dimensions.sales_team)
    enriched = joins.enrich(sales, dimensions.customer, dimensions.store, dimensions.sales_team)
    late = totals.customer_month_totals(projections.customer_mart(enriched))
    assert rows_of(early, "customer_id", "sales_date_month", "total_sales") == expected
    assert rows_of(late, "customer_id", "sales_date_month", "total_sales") == expected
    assert set(early.columns) == set(late.columns)


def test_incentive_pays_every_tied_winner_of_its_own_total(spark, dimensions):
    sales = sales_frame(
        spark,
        sale(seller=1, cost="100.50"),
        sale(seller=2, cost="60.25"),
        sale(seller=2, cost="40.25"),
        sale(seller=3, cost="99.00"),
        sale(store=122, seller=4, cost=None),
        sale(store=122, seller=5, cost="0.50"),
    )
    paid = marts.incentive_monthly(sales, dimensions.customer, dimensions.store, dimensions.sales_team)
    assert rows_of(paid, "store_id", "sales_person_id", "total_sales", "incentive") == [
        (121, 1, D("100.50"), D("1.01")),
        (121, 2, D("100.50"), D("1.01")),
        (121, 3, D("99.00"), D("0.00")),
        (122, 4, D("0.00"), D("0.00")),
        (122, 5, D("0.50"), D("0.01")),
    ]
    enriched = joins.enrich(sales, dimensions.customer, dimensions.store, dimensions.sales_team)
    from_rows = ranking.incentives(totals.seller_month_totals(projections.sales_mart(enriched)))
    assert rows_of(from_rows.select(paid.columns)) == rows_of(paid)
    winners = ranking.top_of_group(paid, ranking.STORE_MONTH, "total_sales")
    assert rows_of(winners, "sales_person_id") == [(1,), (2,), (5,)]


def test_incentives_with_a_null_month(spark):
    rows = [(1, 1, None, D("5.00")), (1, 2, None, D("7.00"))]
    df = spark.createDataFrame(
        rows, "store_id long, sales_person_id long, sales_month string, total_sales decimal(18,2)"
    )
    assert rows_of(ranking.incentives(df), "sales_person_id", "incentive") == [(1, D("0.00")), (2, D("0.07"))]


@pytest.mark.parametrize("bands", [1, 3, 256])
def test_rank_within_equals_sql_rank(spark, bands):
    rnd = random.Random(bands)
    tail = lambda: round(rnd.choice([1, -1]) * 10 ** rnd.uniform(-2, 9), 2)
    values = [D(str(v)) for v in [0, 0.01, 5, 5, 5, 7.5]] + [None, None]
    rows = [(1, rnd.choice(["2023-01", None]), i, D(str(tail()))) for i in range(400)]
    rows += [(rnd.choice([2, 3]), "2023-02", 1000 + i, rnd.choice(values)) for i in range(400)]
    rows += [(4, "2023-02", 5000, D("9.00")), (5, "2023-02", 5001, None)]
    df = spark.createDataFrame(rows, "store_id long, sales_month string, sales_person_id long, total decimal(18,2)")
    order = Window.partitionBy("store_id", "sales_month").orderBy(F.col("total").desc())
    expected = df.withColumn("rnk", F.rank().over(order).cast("long"))
    actual = ranking.rank_within(df, ["store_id", "sales_month"], "total", bands=bands)
    assert rows_of(actual, *expected.columns) == rows_of(expected)


def test_group_total_equals_window_sum(spark):
    sales = sales_frame(spark, sale(), sale(cost="2.00"), sale(customer=None, cost="3.00"),
                        sale(customer=None, cost="4.00"), sale(customer=5, cost=None))
    window = Window.partitionBy("customer_id")
    expected = sales.withColumn("t", F.sum("total_cost").over(window))
    actual = totals.with_group_total(sales, ["customer_id"], "total_cost", "t")
    assert rows_of(actual, *expected.columns) == rows_of(expected)


def test_customer_day_totals(spark):
    sales = sales_frame(spark, sale(cost="1.00"), sale(cost="2.00"), sale(day="2023-03-04", cost="4.00"))
    out = totals.customer_day_totals(sales).withColumn("sales_date", F.col("sales_date").cast("string"))
    assert rows_of(out) == [
        (1, "2023-03", "2023-03-03", D("3.00")), (1, "2023-03", "2023-03-04", D("4.00")),
    ]


def test_total_by_is_sorted_and_rounded(spark):
    rows = [("b", D("0.125")), ("a", D("9.004")), ("c", D("1.000"))]
    df = spark.createDataFrame(rows, "k string, v decimal(10,3)")
    assert [tuple(r) for r in totals.total_by(df, "k", "v", "t").collect()] == [
        ("b", D("0.13")), ("c", D("1.00")), ("a", D("9.00")),
    ]


def test_profile_counts_each_column(spark):
    raw = spark.createDataFrame([("x", 1), ("y", 1), (None, 1)], "`Pay Mode` string, Amount int")
    df = projections.rename_columns(raw)
    assert df.columns == ["pay_mode", "amount"]
    assert tuple(totals.profile(df, df.columns).first()) == (3, 2, 1)
    assert tuple(totals.profile(df, df.columns, approximate=True).first()) == (3, 2, 1)


def test_price_mismatch(spark):
    sales = sales_frame(spark, sale(price="5", quantity=2, cost="10.00"), sale(price="5", quantity=2, cost="10.01"))
    assert rows_of(quality.price_mismatch(sales), "total_cost") == [(D("10.01"),)]


def test_marts_share_one_grand_total(spark, dimensions):
    from tallymart.sources.synth import usual_sales

    sales = usual_sales(spark, 2_000, seed=3)
    spent = marts.customer_monthly(sales, dimensions.customer, dimensions.store, dimensions.sales_team)
    paid = marts.incentive_monthly(sales, dimensions.customer, dimensions.store, dimensions.sales_team).cache()
    grand = sales.agg(F.sum("total_cost")).first()[0]
    assert spent.agg(F.sum("total_sales")).first()[0] == grand
    assert paid.agg(F.sum("total_sales")).first()[0] == grand
    winners = ranking.top_of_group(paid, ranking.STORE_MONTH, "total_sales")
    groups = [df.select(*ranking.STORE_MONTH).distinct().count() for df in (winners, paid)]
    assert groups[0] == groups[1]
    assert winners.agg(F.sum("incentive")).first()[0] == paid.agg(F.sum("incentive")).first()[0]
    assert winners.where("incentive <> round(total_sales * 0.01, 2)").isEmpty()


def test_unknown_dimension_rows_do_not_multiply(spark):
    sales = sales_frame(spark, sale(), sale())
    customer, store = customer_frame(spark, range(1, 26)), store_frame(spark, (121, 122, 123, 124))
    assert joins.enrich(sales, customer, store, seller_frame(spark, range(1, 11))).count() == 2


def test_sketches_of_parts_unite_to_the_sketch_of_all(spark):
    df = spark.range(40_000).select(
        (F.col("id") % 4).alias("run"), (F.col("id") % 9_000).alias("few"), F.col("id").cast("decimal(18,2)").alias("all"), F.lit(None).cast("date").alias("none")
    )
    columns = ["few", "all", "none"]
    parts = sketches.column_sketches(df, columns, ["run"])
    united = sketches.estimates(sketches.merged(parts)).first()
    assert united["n_rows"] == 40_000 and united["distinct_none"] == 0
    whole = sketches.estimates(sketches.column_sketches(df, columns)).first()
    for name, n in (("few", 9_000), ("all", 40_000)):
        assert abs(united[f"distinct_{name}"] - n) <= n * sketches.BOUND
        assert abs(united[f"distinct_{name}"] - whole[f"distinct_{name}"]) <= n * sketches.BOUND
    assert rows_of(sketches.exact_counts(df, columns)) == [("all", 40_000), ("few", 9_000), ("none", 0)]
    assert sketches.estimates(sketches.column_sketches(df.where("false"), columns)).first()["distinct_all"] == 0
