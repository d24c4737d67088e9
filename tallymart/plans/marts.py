"""Monthly marts straight from sales lines.

Sales are totalled per key and month before any dimension is joined: the joins then carry
one row per key and month instead of one per sale, and a hot customer or seller has
shrunk to its months by the time it meets a shuffle. The result equals joining first,
because dimension keys are unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallymart.functions import full_name
from tallymart.operators.joins import customer_side, only_known, seller_side
from tallymart.operators.ranking import incentives
from tallymart.operators.totals import month_totals


def customer_monthly(
    sales: DataFrame,
    customer: DataFrame,
    store: DataFrame | None = None,
    sales_team: DataFrame | None = None,
) -> DataFrame:
    """Spend per customer and month; sales of unknown stores or sellers drop out if those are given."""
    if store is not None:
        sales = only_known(sales, "store_id", store)
    if sales_team is not None:
        sales = only_known(sales, "sales_person_id", sales_team)
    return name_customers(month_totals(sales, ["customer_id"], month="sales_date_month"), customer)


def name_customers(totals: DataFrame, customer: DataFrame) -> DataFrame:
    """Totals of known customers, with name, address and phone number."""
    return totals.join(customer_side(customer), "customer_id").select(
        "customer_id",
        full_name("first_name", "last_name").alias("full_name"),
        "address",
        "phone_number",
        "sales_date_month",
        "total_sales",
    )


def name_sellers(totals: DataFrame, store: DataFrame, sales_team: DataFrame) -> DataFrame:
    """Seller totals of known stores and sellers, with the seller's full name."""
    known = only_known(totals, "store_id", store)
    names = seller_side(sales_team).select(
        "sales_person_id",
        full_name("sales_person_first_name", "sales_person_last_name").alias("full_name"),
    )
    return known.join(names, "sales_person_id").select(
        "store_id", "sales_person_id", "full_name", "sales_month", "total_sales"
    )


def seller_monthly(sales: DataFrame, store: DataFrame, sales_team: DataFrame) -> DataFrame:
    return name_sellers(month_totals(sales, ["store_id", "sales_person_id"]), store, sales_team)


def incentive_monthly(
    sales: DataFrame, customer: DataFrame, store: DataFrame, sales_team: DataFrame
) -> DataFrame:
    """Monthly total of every seller and the incentive of the best in each store and month."""
    return incentives(seller_monthly(only_known(sales, "customer_id", customer, "customer_id"), store, sales_team))
