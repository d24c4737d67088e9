"""Joins of sales to their dimensions.

No side carries a broadcast hint. Catalyst broadcasts a dimension only when its size is
below ``spark.sql.autoBroadcastJoinThreshold`` (AQE checks the real size again), and falls
back to a sort-merge join whose skewed partitions AQE splits. Dimensions are cut to the
needed columns and renamed before the join, so every output name is unique.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# The file that a sales line came from: kept beside the columns of the marts, so that its rows can be replaced.
SOURCE_FILE = "source_file"


def customer_side(customer: DataFrame) -> DataFrame:
    return customer.select("customer_id", "first_name", "last_name", "address", "pincode", "phone_number")


def store_side(store: DataFrame) -> DataFrame:
    return store.select(
        F.col("id").alias("store_id"),
        F.col("address").alias("store_address"),
        "store_manager_name",
    )


def seller_side(sales_team: DataFrame) -> DataFrame:
    return sales_team.select(
        F.col("id").alias("sales_person_id"),
        F.col("first_name").alias("sales_person_first_name"),
        F.col("last_name").alias("sales_person_last_name"),
        F.col("address").alias("sales_person_address"),
        F.col("pincode").alias("sales_person_pincode"),
        F.col("joining_date").alias("sales_person_joining_date"),
        "manager_id",
        "is_manager",
    )


def with_customer(sales: DataFrame, customer: DataFrame) -> DataFrame:
    return sales.join(customer_side(customer), "customer_id")


def with_store(sales: DataFrame, store: DataFrame) -> DataFrame:
    return sales.join(store_side(store), "store_id")


def with_seller(sales: DataFrame, sales_team: DataFrame) -> DataFrame:
    return sales.join(seller_side(sales_team), "sales_person_id")


def enrich(sales: DataFrame, customer: DataFrame, store: DataFrame, sales_team: DataFrame) -> DataFrame:
    """One row per sale with its customer, store and seller; sales with an unknown key drop out.

    ``unmatched_report`` counts the ones that do.
    """
    kept = [SOURCE_FILE] if SOURCE_FILE in sales.columns else []
    lines = sales.select("customer_id", "store_id", "sales_person_id", "sales_date", "total_cost", *kept)
    return with_customer(with_store(with_seller(lines, sales_team), store), customer)


def with_product(sales: DataFrame, product: DataFrame) -> DataFrame:
    """Every sale with its product's current price, null where the product is unknown."""
    side = product.select(
        F.col("id").alias("product_id"),
        F.col("name").alias("product_name"),
        "current_price",
        "old_price",
    )
    return sales.join(side, "product_name", "left")


def only_known(sales: DataFrame, key: str, dimension: DataFrame, dimension_key: str = "id") -> DataFrame:
    """Sales whose key exists in the dimension: an inner join that adds no columns."""
    return sales.join(dimension.select(F.col(dimension_key).alias(key)), key, "left_semi")


def unmatched_sales(sales: DataFrame, key: str, dimension: DataFrame, dimension_key: str = "id") -> DataFrame:
    """Rows that an inner join on ``key`` loses, null keys included."""
    return sales.join(dimension.select(F.col(dimension_key).alias(key)), key, "left_anti")


def unmatched_report(sales: DataFrame, dimensions: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Lost sales per dimension key: key column, key value, rows, amount.

    One pass counts the sales per value of each key, so that a hot key travels as one row
    per task; only the counts meet the dimensions, in one anti join for all of them.
    """
    keys = list(dimensions)
    counted = sales.groupingSets([[k] for k in keys], *keys).agg(
        *[F.grouping(k).alias(f"__no_{k}") for k in keys],
        F.count(F.lit(1)).alias("sales_rows"),
        F.sum("total_cost").alias("lost_amount"),
    )
    counted_by = [F.when(F.col(f"__no_{k}") == 0, F.lit(k)) for k in keys]
    per_key = counted.select(
        F.coalesce(*counted_by).alias("key_column"),
        F.coalesce(*[F.col(k).cast("string") for k in keys]).alias("key_value"),
        "sales_rows",
        "lost_amount",
    )
    known = [
        dimension.select(F.lit(k).alias("key_column"), F.col(key).cast("string").alias("key_value"))
        for k, (dimension, key) in dimensions.items()
    ]
    return per_key.join(reduce(DataFrame.unionByName, known), ["key_column", "key_value"], "left_anti")


def null_free(df: DataFrame, keys: Sequence[str], mark: str = "__key") -> tuple[DataFrame, list[str]]:
    """``df`` with columns that are equal where the keys are, and never null; their names.

    Grouping and joining by them is partitioned alike, so a total joined back needs no second exchange, which a
    null-safe condition would.
    """
    plain = {T.StringType: "", T.DateType: datetime.date(1970, 1, 1), T.BooleanType: False}
    columns = {}
    for i, key in enumerate(keys):
        kind = df.schema[key].dataType
        columns[f"{mark}{i}"] = F.coalesce(F.col(key), F.lit(plain.get(type(kind), 0)).cast(kind))
        columns[f"{mark}{i}_null"] = F.col(key).isNull()
    return df.withColumns(columns), list(columns)


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys that may be null. Where they can't be, a plain join needs no second exchange."""
    renamed = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    condition: Column = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])
