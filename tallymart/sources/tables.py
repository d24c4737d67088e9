"""Parquet and CSV tables, and small frames from memory."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart.operators.joins import same_keys
from tallymart.schemas import PAYMENTS


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table; with a schema given, partition columns keep their declared types."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table with a header, under a declared schema: no inference pass."""
    return spark.read.schema(schema).option("header", "true").option("escape", '"').csv(path)


def read_payments(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, PAYMENTS)


def from_rows(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def latest_run(df: DataFrame, keys: Sequence[str] = (), run_column: str = "run_id") -> DataFrame:
    """Rows of the newest run, or of the newest run of each key, of a run-stamped table.

    Without keys the newest run is a single row and is broadcast.
    """
    newest = df.groupBy(*keys).agg(F.max(run_column).alias(run_column))
    return same_keys(df, newest if keys else F.broadcast(newest), [*keys, run_column], "left_semi")
