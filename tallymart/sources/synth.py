"""Synthetic sales, transactions and customers.

Every cell is a hash of the row number, the seed and the column, so rows come out the same
however many partitions make them and whichever task is repeated.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.functions import money

# The catalogue, shops and people that generated sales refer to.
PRODUCT_PRICES = {
    "quaker oats": Decimal("212"),
    "sugar": Decimal("50"),
    "maida": Decimal("20"),
    "besan": Decimal("52"),
    "refined oil": Decimal("110"),
    "clinic plus": Decimal("1.5"),
    "dantkanti": Decimal("100"),
    "nutrella": Decimal("40"),
}
CUSTOMER_IDS = range(1, 21)
STORE_SELLERS = {121: [1, 2, 3], 122: [4, 5, 6], 123: [7, 8, 9]}
FIRST_DAY, LAST_DAY = "2023-03-03", "2023-08-20"
FIRST_JOINING_DAY = "2020-01-01"
EXTRA_PAYMENT_MODES = ["cash", "UPI"]
PAY_MODES = ["Credit Card", "Debit Card", "PayPal", "Bank Transfer", "Cash"]
CUSTOMER_ADDRESS, CUSTOMER_PINCODE, PHONE_PREFIX = "Delhi", "122009", "91"

FIRST_NAMES = ["Asha", "Bela", "Chetan", "Deepa", "Esha", "Farid", "Gita", "Hari", "Indu", "Jai"]
LAST_NAMES = ["Anand", "Bose", "Das", "Ghosh", "Iyer", "Khan", "Mehta", "Nair", "Rao", "Sen"]


def pick(column: str, size: int | Column, seed: int) -> Column:
    """A number from 0 to ``size`` - 1 for this row and column."""
    return F.pmod(F.xxhash64("id", F.lit(column), F.lit(seed)), F.lit(size) if isinstance(size, int) else size)


def one_of(column: str, values: Sequence, seed: int) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (pick(column, len(values), seed) + 1).cast("int"))


def day_between(column: str, first: Column, last: Column, seed: int) -> Column:
    days = F.date_diff(last, first) + 1
    return F.date_add(first, pick(column, days.cast("bigint"), seed).cast("int"))


def sales(
    spark: SparkSession, rows: int, first_day: str = FIRST_DAY, last_day: str = LAST_DAY, seed: int = 0
) -> DataFrame:
    """Sales of random products between two days; the total is price times quantity."""
    prices = F.create_map(*[F.lit(v) for name, price in PRODUCT_PRICES.items() for v in (name, price)])
    sellers = F.create_map(
        *[v for store, ids in STORE_SELLERS.items() for v in (F.lit(store), F.array(*map(F.lit, ids)))]
    )
    team_size = len(next(iter(STORE_SELLERS.values())))
    return (
        spark.range(rows)
        .select(
            one_of("customer_id", CUSTOMER_IDS, seed).cast("bigint").alias("customer_id"),
            one_of("store_id", list(STORE_SELLERS), seed).alias("store_id"),
            one_of("product_name", list(PRODUCT_PRICES), seed).alias("product_name"),
            day_between("sales_date", F.lit(first_day).cast("date"), F.lit(last_day).cast("date"), seed).alias(
                "sales_date"
            ),
            (pick("seller", team_size, seed) + 1).cast("int").alias("seller_no"),
            (pick("quantity", 10, seed) + 1).cast("int").alias("quantity"),
            one_of("payment_mode", EXTRA_PAYMENT_MODES, seed).alias("payment_mode"),
        )
        .select(
            "customer_id",
            F.col("store_id").cast("bigint").alias("store_id"),
            "product_name",
            "sales_date",
            F.element_at(F.element_at(sellers, F.col("store_id")), F.col("seller_no"))
            .cast("bigint")
            .alias("sales_person_id"),
            money(F.element_at(prices, F.col("product_name"))).alias("price"),
            "quantity",
            "payment_mode",
        )
        .select(
            "customer_id",
            "store_id",
            "product_name",
            "sales_date",
            "sales_person_id",
            "price",
            "quantity",
            money(F.col("price") * F.col("quantity")).alias("total_cost"),
            "payment_mode",
        )
    )


def usual_sales(spark: SparkSession, rows: int = 10_000, seed: int = 0) -> DataFrame:
    return sales(spark, rows, seed=seed).drop("payment_mode")


def one_day_sales(spark: SparkSession, day: str, rows: int = 400_000, seed: int = 0) -> DataFrame:
    return sales(spark, rows, day, day, seed).drop("payment_mode")


def sales_with_extra_column(spark: SparkSession, day: str, rows: int = 1_000, seed: int = 0) -> DataFrame:
    return sales(spark, rows, day, day, seed)


def sales_with_missing_column(spark: SparkSession, day: str, rows: int = 200, seed: int = 0) -> DataFrame:
    """A bad file: no store, and the seller cell holds the whole team of a store."""
    teams = [str(ids) for ids in STORE_SELLERS.values()]
    return sales(spark, rows, day, day, seed).select(
        "customer_id",
        "product_name",
        "sales_date",
        F.element_at(
            F.array(*map(F.lit, teams)), F.ceil(F.col("sales_person_id") / 3).cast("int")
        ).alias("sales_person_id"),
        "price",
        "quantity",
        "total_cost",
        "payment_mode",
    )


def simple_transactions(spark: SparkSession, today: str, rows: int = 1_000, seed: int = 0) -> DataFrame:
    """Purchases of the last year by 100 customers of 20 products, at 10 to 100 apiece."""
    last = F.lit(today).cast("date")
    price = money((pick("price", 9_001, seed) + 1_000) / 100)
    quantity = (pick("quantity", 5, seed) + 1).cast("int")
    return (
        spark.range(rows)
        .select(
            F.date_sub(last, (pick("day", 365, seed) + 1).cast("int")).alias("TransactionDate"),
            F.concat(F.lit("Customer_"), pick("customer", 100, seed) + 1).alias("Customer"),
            F.concat(F.lit("Product_"), pick("product", 20, seed) + 1).alias("Product"),
            quantity.alias("Quantity"),
            price.alias("Price"),
        )
        .withColumn("Total", money(F.col("Price") * F.col("Quantity")))
    )


def payment_transactions(spark: SparkSession, now: str, rows: int = 1_000, seed: int = 0) -> DataFrame:
    """Payments of the last 30 days, of 10 to 500, under headers with spaces."""
    seconds_back = pick("second", 31 * 86_400, seed).cast("int")
    return spark.range(rows).select(
        F.concat(F.lit("TID"), (F.col("id") + 1000).cast("string")).alias("Transaction ID"),
        F.concat(F.lit("ACC"), (pick("account", 900_000, seed) + 100_000).cast("string")).alias("Account Number"),
        one_of("pay_mode", PAY_MODES, seed).alias("Pay Mode"),
        (F.lit(now).cast("timestamp") - F.make_dt_interval(secs=seconds_back)).alias("Timestamp"),
        money((pick("amount", 49_001, seed) + 1_000) / 100).alias("Amount"),
    )


def customers(spark: SparkSession, rows: int = 25, seed: int = 0) -> DataFrame:
    joined = day_between("joined", F.lit(FIRST_JOINING_DAY).cast("date"), F.lit(LAST_DAY).cast("date"), seed)
    return spark.range(rows).select(
        (F.col("id") + 1).alias("customer_id"),
        one_of("first_name", FIRST_NAMES, seed).alias("first_name"),
        one_of("last_name", LAST_NAMES, seed).alias("last_name"),
        F.lit(CUSTOMER_ADDRESS).alias("address"),
        F.lit(CUSTOMER_PINCODE).alias("pincode"),
        F.concat(F.lit(PHONE_PREFIX), F.lpad(pick("phone", 10**8, seed).cast("string"), 8, "0")).alias(
            "phone_number"
        ),
        joined.alias("customer_joining_date"),
    )
