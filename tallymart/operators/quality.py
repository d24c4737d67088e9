"""Checks on the sales lines themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def price_mismatch(sales: DataFrame) -> DataFrame:
    """Sales whose total is not price times quantity."""
    return sales.where(F.col("total_cost") != F.col("price") * F.col("quantity"))
