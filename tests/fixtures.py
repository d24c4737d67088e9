"""Small frames for the tests."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from tallymart import schemas
from tallymart.sources.synth import CUSTOMER_IDS, STORE_SELLERS
from tallymart.sources.tables import from_rows


def sale(customer=1, store=121, seller=1, day="2023-03-03", cost="10.00", price="10", quantity=1, extra=None):
    return (
        customer,
        store,
        "sugar",
        date.fromisoformat(day) if day else None,
        seller,
        Decimal(price),
        quantity,
        None if cost is None else Decimal(cost),
        extra,
    )


def sales_frame(spark, *rows):
    return from_rows(spark, rows, schemas.SALES)


def customer_frame(spark, ids=CUSTOMER_IDS):
    rows = [(i, f"First{i}", f"Last{i}", "Delhi", "122009", f"91{i:08d}", date(2021, 1, 1)) for i in ids]
    return from_rows(spark, rows, schemas.CUSTOMER)


def store_frame(spark, ids=tuple(STORE_SELLERS)):
    rows = [(i, "Delhi", "122009", f"Manager{i}", date(2022, 1, 1), "clean") for i in ids]
    return from_rows(spark, rows, schemas.STORE)


def seller_frame(spark, ids=tuple(s for team in STORE_SELLERS.values() for s in team)):
    rows = [(i, f"Seller{i}", "Name", 10, "N", "Delhi", "122007", date(2020, 5, 1)) for i in ids]
    return from_rows(spark, rows, schemas.SALES_TEAM)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)
