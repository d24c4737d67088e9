"""Distinct counts that can be stored and merged: a small sketch for each group and column, and exact counts on demand.

A sketch of 2**LG_K buckets takes some 2 kB whatever it has seen, so a run writes down one for each column, and the distinct
values of any span of runs are a union of sketches instead of another pass over the rows. The estimate's standard error is
about 0.83 / sqrt(2**LG_K); ``BOUND`` is four times that.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LG_K = 12
BOUND = 4 * 0.83 / 2 ** (LG_K / 2)

#: What the sketch functions take as it is; other types are sketched by their text.
_DIRECT = (T.IntegerType, T.LongType, T.StringType, T.BinaryType)


def _sketchable(df: DataFrame, column: str) -> Column:
    cell = F.col(f"`{column}`")
    return cell if isinstance(df.schema[column].dataType, _DIRECT) else cell.cast("string")


def column_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """For each group its rows and one sketch of the non-null values of each column."""
    sketches = [F.hll_sketch_agg(_sketchable(df, c), F.lit(LG_K)).alias(f"sketch_{c}") for c in columns]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *sketches)


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stored sketches united over coarser groups, or over all."""
    names = [c for c in sketches.columns if c.startswith("sketch_")]
    return sketches.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), *[F.hll_union_agg(c).alias(c) for c in names])


def estimates(sketches: DataFrame) -> DataFrame:
    """The sketches as approximate distinct counts, ``distinct_<column>``."""
    counts = [F.hll_sketch_estimate(c).alias(f"distinct_{c.removeprefix('sketch_')}") for c in sketches.columns if c.startswith("sketch_")]
    others = [c for c in sketches.columns if not c.startswith("sketch_")]
    return sketches.select(*others, *counts)


def exact_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n_distinct) of the non-null values, exactly.

    Each column is a scan of its own with one shuffle of its values: rows are not multiplied by the number of columns, as they are
    where one aggregation counts them all.
    """
    def one(column: str) -> DataFrame:
        values = df.select(F.col(f"`{column}`").alias("value")).where("value is not null").distinct()
        return values.agg(F.lit(column).alias("column_name"), F.count(F.lit(1)).alias("n_distinct"))

    return reduce(DataFrame.unionByName, [one(c) for c in columns])
