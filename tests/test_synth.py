from __future__ import annotations

from pyspark.sql import functions as F

from fixtures import rows_of
from tallymart.schemas import MANDATORY_COLUMNS, PAYMENTS
from tallymart.sources import synth
from tallymart.sources.csv_files import check_headers, list_files, probe_headers
from tallymart.sinks.files import write_csv
from tallymart.sources.tables import read_payments


def test_usual_sales_stay_in_their_domain(spark):
    df = synth.usual_sales(spark).cache()
    assert df.columns == MANDATORY_COLUMNS and df.count() == 10_000
    assert df.where("total_cost <> price * quantity or quantity not between 1 and 10").isEmpty()
    assert df.where("sales_date not between '2023-03-03' and '2023-08-20'").isEmpty()
    span = df.agg(F.min("sales_date").cast("string"), F.max("sales_date").cast("string")).first()
    assert span == ("2023-03-03", "2023-08-20")
    assert df.select("customer_id").distinct().count() == 20
    teams = df.groupBy("store_id").agg(F.sort_array(F.collect_set("sales_person_id")))
    assert rows_of(teams) == [(k, v) for k, v in synth.STORE_SELLERS.items()]
    prices = df.select("product_name", "price").distinct()
    assert {r[0]: r[1] for r in prices.collect()} == synth.PRODUCT_PRICES


def test_rows_do_not_depend_on_partitions(spark):
    a = synth.sales(spark, 500, seed=4)
    b = synth.sales(spark, 500, seed=4).repartition(3)
    assert a.exceptAll(b).isEmpty()
    assert not a.exceptAll(synth.sales(spark, 500, seed=5)).isEmpty()


def test_one_day_and_extra_column(spark):
    assert synth.one_day_sales(spark, "2023-04-01").count() == 400_000
    extra = synth.sales_with_extra_column(spark, "2023-04-01")
    assert extra.columns == [*MANDATORY_COLUMNS, "payment_mode"] and extra.count() == 1_000
    assert rows_of(extra.select("payment_mode", F.col("sales_date").cast("string")).distinct()) == [
        ("UPI", "2023-04-01"), ("cash", "2023-04-01"),
    ]


def test_missing_column_file_is_rejected(spark, tmp_path):
    bad = synth.sales_with_missing_column(spark, "2023-04-01")
    assert bad.count() == 200
    assert rows_of(bad.select("sales_person_id").distinct()) == [("[1, 2, 3]",), ("[4, 5, 6]",), ("[7, 8, 9]",)]
    write_csv(bad, str(tmp_path / "bad"))
    manifest = check_headers(list_files(spark, str(tmp_path)), probe_headers(spark, str(tmp_path)))
    assert rows_of(manifest.select("missing", "extra", "reason").distinct()) == [
        (["store_id"], ["payment_mode"], "missing_columns")
    ]


def test_transactions(spark, tmp_path):
    simple = synth.simple_transactions(spark, "2024-06-30")
    assert simple.count() == 1_000
    assert simple.where("Quantity not between 1 and 5 or Price not between 10 and 100").isEmpty()
    assert simple.where("Total <> Price * Quantity").isEmpty()
    assert simple.where("TransactionDate not between '2023-07-01' and '2024-06-29'").isEmpty()
    payments = synth.payment_transactions(spark, "2024-06-30 12:00:00")
    assert payments.columns == PAYMENTS.fieldNames()
    assert payments.select("Transaction ID").distinct().count() == 1_000
    assert payments.select("Pay Mode").distinct().count() == 5
    assert payments.where("Amount not between 10 and 500").isEmpty()
    write_csv(payments, str(tmp_path / "p"))
    assert rows_of(read_payments(spark, str(tmp_path / "p")), "Amount") == rows_of(payments, "Amount")


def test_customers(spark):
    df = synth.customers(spark)
    assert df.count() == 25 and df.select("customer_id").distinct().count() == 25
    assert df.where("length(phone_number) <> 10").isEmpty()
    assert df.where("customer_joining_date not between '2020-01-01' and '2023-08-20'").isEmpty()
