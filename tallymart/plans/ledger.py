"""The run ledger: an append-only table of file states.

A file is opened with status ``A`` before it is loaded and closed with ``I`` after its run
has published. A state is never updated in place; the current one is the newest row.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.schemas import LEDGER
from tallymart.sinks.files import exists, run_path

# The one-letter states of a file.
OPEN = "A"
CLOSED = "I"

#: A row without a time is older than all others.
NO_TIME = 2**60


class FailedRunError(RuntimeError):
    """An earlier run opened files and did not close them."""


def ledger_rows(files: DataFrame, run_id: int, status: str) -> DataFrame:
    return files.select(
        F.lit(run_id).cast("bigint").alias("run_id"),
        "file_name",
        F.col("path").alias("file_location"),
        F.lit(status).alias("status"),
        F.current_timestamp().alias("changed_at"),
    )


def record(files: DataFrame, root: str, run_id: int, status: str) -> None:
    """Add one state per file. A repeated run replaces its own rows, so a retry adds none twice."""
    rows = ledger_rows(files, run_id, status).drop("run_id", "status")
    rows.write.mode("overwrite").parquet(f"{run_path(root, run_id)}/status={status}")


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(root) if exists(spark, root) else spark.createDataFrame([], LEDGER)


def current_status(ledger: DataFrame) -> DataFrame:
    """The newest state of each file, which is its place: names repeat across folders. At equal times a close follows its open.

    Time and state are one number, and with the run id another, so the newest row is found by hash aggregation on numbers alone.
    """
    closed = (F.col("status") == CLOSED).cast("bigint")
    moment = F.coalesce(F.unix_micros("changed_at") * 2 + closed, closed - F.lit(NO_TIME)).alias("moment")
    rows = ledger.select("file_location", "file_name", "run_id", moment)
    order = F.col("moment").cast("decimal(38,0)") * F.lit(Decimal(2**63)) + F.col("run_id").cast("decimal(19,0)")
    newest = rows.groupBy("file_location", "file_name").agg(F.max("moment").alias("moment"), F.max_by("run_id", order).alias("run_id"))
    state = F.when(F.col("moment") % 2 == 0, OPEN).otherwise(CLOSED)
    changed = F.when(F.col("moment") >= -NO_TIME // 2, F.timestamp_micros(F.shiftright("moment", 1)))
    return newest.select("file_location", "file_name", "run_id", state.alias("status"), changed.alias("changed_at"))


def files_with_status(ledger: DataFrame, status: str) -> DataFrame:
    """Places and names of the files whose current state is the given one."""
    return current_status(ledger).where(F.col("status") == status).select("file_location", "file_name")


def failed_files(ledger: DataFrame, listing: DataFrame) -> DataFrame:
    """Listed files (``path``) that an earlier run opened and never closed."""
    open_ = files_with_status(ledger, OPEN).select(F.col("file_location").alias("path"))
    return listing.join(open_, "path", "left_semi")
