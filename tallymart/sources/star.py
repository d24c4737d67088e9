"""The order-processing test tables seen as sales, customers, stores, sellers and products.

A line item is a sale, its supplier the seller, the supplier's nation the store. Every
function reads only the columns it names, and joins only the tables it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.functions import money
from tallymart.sinks.files import folder_bytes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored_bytes(spark: SparkSession, sf_dir: str, *names: str) -> int:
    """What the tables take on disk."""
    return sum(folder_bytes(spark, f"{sf_dir.rstrip('/')}/{name}.parquet") for name in names)


def seller_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales as far as the line item alone tells: seller, date and amount."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("sales_person_id"),
        F.col("l_shipdate").cast("date").alias("sales_date"),
        money("l_extendedprice").alias("total_cost"),
    )


def customer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales with the customer of their order."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_shipdate").cast("date").alias("sales_date"),
        money("l_extendedprice").alias("total_cost"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("customer_id"))
    return lines.join(orders, "o_orderkey").select("customer_id", "sales_date", "total_cost")


def sales(spark: SparkSession, sf_dir: str, product: bool = False, extras: bool = False) -> DataFrame:
    """Whole sales lines; product name and price, and the two extra columns, on request."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_suppkey").alias("sales_person_id"),
        F.col("l_partkey").alias("p_partkey"),
        F.col("l_shipdate").cast("date").alias("sales_date"),
        F.col("l_quantity").cast("int").alias("quantity"),
        money("l_extendedprice").alias("total_cost"),
        F.col("l_returnflag").alias("return_flag"),
        F.col("l_linestatus").alias("line_status"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("customer_id"))
    stores = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("sales_person_id"), F.col("s_nationkey").cast("bigint").alias("store_id")
    )
    joined = lines.join(orders, "o_orderkey")
    if product:
        parts = products(spark, sf_dir).select(
            F.col("id").alias("p_partkey"),
            F.col("name").alias("product_name"),
            F.col("current_price").cast("decimal(18,2)").alias("price"),
        )
        joined = joined.join(parts, "p_partkey")
    # The store comes last: what joins sellers next finds the rows partitioned by seller already.
    return joined.join(stores, "sales_person_id").select(
        "customer_id",
        "store_id",
        *(["product_name"] if product else []),
        "sales_date",
        "sales_person_id",
        *(["price"] if product else []),
        "quantity",
        "total_cost",
        *(["return_flag", "line_status"] if extras else []),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first_name"),
        F.split_part("c_name", F.lit("#"), F.lit(2)).alias("last_name"),
        F.col("c_mktsegment").alias("address"),
        F.col("c_nationkey").cast("string").alias("pincode"),
        F.concat(F.lit("91"), F.col("c_custkey").cast("string")).alias("phone_number"),
        F.lit(None).cast("date").alias("customer_joining_date"),
    )


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.col("n_name").alias("address"),
        F.col("n_regionkey").cast("string").alias("store_pincode"),
        F.concat(F.lit("Manager of "), "n_name").alias("store_manager_name"),
        F.lit(None).cast("date").alias("store_opening_date"),
        F.lit(None).cast("string").alias("reviews"),
    )


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.split_part("s_name", F.lit("#"), F.lit(1)).alias("first_name"),
        F.split_part("s_name", F.lit("#"), F.lit(2)).alias("last_name"),
        F.col("s_nationkey").cast("bigint").alias("manager_id"),
        F.when(F.col("s_acctbal") < 0, "Y").otherwise("N").alias("is_manager"),
        F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("address"),
        F.col("s_nationkey").cast("string").alias("pincode"),
        F.lit(None).cast("date").alias("joining_date"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products; the key is part of the name, because part names repeat."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("current_price"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("old_price"),
        F.lit(None).cast("timestamp").alias("created_date"),
        F.lit(None).cast("timestamp").alias("updated_date"),
        F.lit(None).cast("date").alias("expiry_date"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as payment transactions, under the spaced headers such files have."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("Transaction ID"),
        F.col("user_id").alias("Account Number"),
        F.col("event_type").alias("Pay Mode"),
        F.col("ts").alias("Timestamp"),
        money("value").alias("Amount"),
    )
