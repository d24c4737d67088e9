"""Declared schemas.

Identifiers are bigint rather than int, so the same job holds at key ranges beyond two
billion. Money is an exact decimal, because equality of totals decides who is paid.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
#: Sums of money.
TOTAL = T.DecimalType(28, 2)

# The columns a sales file must have, in canonical order, and the name of
# the catch-all column for everything else.
MANDATORY_COLUMNS = [
    "customer_id",
    "store_id",
    "product_name",
    "sales_date",
    "sales_person_id",
    "price",
    "quantity",
    "total_cost",
]
EXTRAS_COLUMN = "additional_columns"

# The columns of every table and file below.
SALES = T.StructType(
    [
        T.StructField("customer_id", T.LongType()),
        T.StructField("store_id", T.LongType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("sales_date", T.DateType()),
        T.StructField("sales_person_id", T.LongType()),
        T.StructField("price", MONEY),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("total_cost", MONEY),
        T.StructField(EXTRAS_COLUMN, T.StringType()),
    ]
)

CUSTOMER = T.StructType(
    [
        T.StructField("customer_id", T.LongType()),
        T.StructField("first_name", T.StringType()),
        T.StructField("last_name", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("pincode", T.StringType()),
        T.StructField("phone_number", T.StringType()),
        T.StructField("customer_joining_date", T.DateType()),
    ]
)

STORE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("address", T.StringType()),
        T.StructField("store_pincode", T.StringType()),
        T.StructField("store_manager_name", T.StringType()),
        T.StructField("store_opening_date", T.DateType()),
        T.StructField("reviews", T.StringType()),
    ]
)

PRODUCT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("current_price", T.DecimalType(10, 2)),
        T.StructField("old_price", T.DecimalType(10, 2)),
        T.StructField("created_date", T.TimestampType()),
        T.StructField("updated_date", T.TimestampType()),
        T.StructField("expiry_date", T.DateType()),
    ]
)

SALES_TEAM = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("first_name", T.StringType()),
        T.StructField("last_name", T.StringType()),
        T.StructField("manager_id", T.LongType()),
        T.StructField("is_manager", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("pincode", T.StringType()),
        T.StructField("joining_date", T.DateType()),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("file_location", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("changed_at", T.TimestampType()),
    ]
)

CUSTOMER_MART = T.StructType(
    [
        T.StructField("customer_id", T.LongType()),
        T.StructField("first_name", T.StringType()),
        T.StructField("last_name", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("pincode", T.StringType()),
        T.StructField("phone_number", T.StringType()),
        T.StructField("sales_date", T.DateType()),
        T.StructField("total_cost", MONEY),
    ]
)

SALES_MART = T.StructType(
    [
        T.StructField("store_id", T.LongType()),
        T.StructField("sales_person_id", T.LongType()),
        T.StructField("sales_person_first_name", T.StringType()),
        T.StructField("sales_person_last_name", T.StringType()),
        T.StructField("store_manager_name", T.StringType()),
        T.StructField("manager_id", T.LongType()),
        T.StructField("is_manager", T.StringType()),
        T.StructField("sales_person_address", T.StringType()),
        T.StructField("sales_person_pincode", T.StringType()),
        T.StructField("sales_date", T.DateType()),
        T.StructField("total_cost", MONEY),
        T.StructField("sales_month", T.StringType()),
    ]
)

SELLER_REPORT = T.StructType(
    [
        T.StructField("store_id", T.LongType()),
        T.StructField("full_name", T.StringType()),
        T.StructField("total_sales", TOTAL),
        T.StructField("incentive", TOTAL),
        T.StructField("sales_month", T.StringType()),
    ]
)

PAYMENTS = T.StructType(
    [
        T.StructField("Transaction ID", T.StringType()),
        T.StructField("Account Number", T.StringType()),
        T.StructField("Pay Mode", T.StringType()),
        T.StructField("Timestamp", T.TimestampType()),
        T.StructField("Amount", MONEY),
    ]
)


def empty_sales(spark):
    """The typed empty frame, for runs without a single good file."""
    return spark.createDataFrame([], SALES)
