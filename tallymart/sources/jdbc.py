"""Database tables over JDBC."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Split:
    """How to cut a table into parallel reads: a numeric, date or timestamp column and its bounds."""

    column: str
    lower: str | int
    upper: str | int
    partitions: int


@dataclass(frozen=True)
class JdbcReader:
    """Reads whole tables; with a split, one connection per partition instead of one in all."""

    url: str
    properties: dict[str, str]

    def table(self, spark: SparkSession, name: str, split: Split | None = None) -> DataFrame:
        if split is None:
            return spark.read.jdbc(url=self.url, table=name, properties=self.properties)
        return spark.read.jdbc(
            url=self.url,
            table=name,
            column=split.column,
            lowerBound=split.lower,
            upperBound=split.upper,
            numPartitions=split.partitions,
            properties=self.properties,
        )


# Names of the dimension tables.
DIMENSION_TABLES = ["customer", "store", "sales_team", "product"]


def dimension_tables(
    spark: SparkSession, reader: JdbcReader, splits: Mapping[str, Split] | None = None
) -> dict[str, DataFrame]:
    """The dimension tables by name, each read in parallel if it has a split."""
    return {name: reader.table(spark, name, (splits or {}).get(name)) for name in DIMENSION_TABLES}
