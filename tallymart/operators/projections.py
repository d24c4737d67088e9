"""Row-level projections of the two marts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallymart.functions import month_of
from tallymart.operators.joins import SOURCE_FILE
from tallymart.schemas import CUSTOMER_MART, SALES_MART


def with_source(enriched: DataFrame, names: list[str]) -> DataFrame:
    return enriched.select(*names, *[c for c in [SOURCE_FILE] if c in enriched.columns])


def customer_mart(enriched: DataFrame) -> DataFrame:
    return with_source(enriched, CUSTOMER_MART.fieldNames())


def sales_mart(enriched: DataFrame) -> DataFrame:
    return with_source(enriched.withColumn("sales_month", month_of("sales_date")), SALES_MART.fieldNames())


def rename_columns(df: DataFrame) -> DataFrame:
    """Column names with spaces become lower snake case (``Pay Mode`` becomes ``pay_mode``)."""
    return df.withColumnsRenamed({c: "_".join(c.split()).lower() for c in df.columns})
