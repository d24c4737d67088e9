"""File arrivals: every version of every file is loaded by exactly one complete run.

A file is known by its path, length and modification time. What is new is what no complete run has listed, however
old the file is; a repaired file, or an empty one that was filled later, is a new version. A run that dies has not
completed, so its files are new again.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart.functions import new_run_id
from tallymart.plans import ledger, runs
from tallymart.plans.ingest import Dimensions, Layout, process_run, set_empty_files_aside, settle_runs
from tallymart.sinks.files import write_run
from tallymart.sinks.jdbc import JdbcWriter
from tallymart.sources.csv_files import NoInputError, list_files, require_files

log = logging.getLogger(__name__)

ARRIVED = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("modified", T.TimestampType()),
    ]
)


def new_files(spark: SparkSession, listing: DataFrame, layout: Layout) -> DataFrame:
    """Listed files, or versions of files, that no complete run has taken."""
    seen = runs.read_runs(spark, layout.arrived, ARRIVED, runs.completed_runs(spark, layout.completed))
    return listing.join(seen.select("path", "length", "modified"), ["path", "length", "modified"], "left_anti")


def check_previous_run(spark: SparkSession, listing: DataFrame, layout: Layout, on_failed_run: str) -> None:
    """Look for listed files that an earlier run left open; they are loaded again."""
    failed = ledger.failed_files(ledger.read_ledger(spark, layout.ledger), listing)
    if failed.isEmpty():
        log.info("no failed run")
    elif on_failed_run == "fail":
        raise ledger.FailedRunError("files left open by a failed run")
    else:
        log.warning("the last run failed; its files are loaded again")


def ingest_arrivals(
    spark: SparkSession,
    landing: str,
    root: str,
    dimensions: Dimensions,
    *,
    max_files: int = 10_000,
    archive: str | None = None,
    on_failed_run: str = "retry",
    jdbc: JdbcWriter | None = None,
    by_store: bool = False,
    report_empty: bool = True,
) -> None:
    """Process everything that has arrived since the last call, in runs of about ``max_files`` files.

    With ``archive``, the files of a complete run are moved there, below its id and ``loaded`` or ``rejected``. Runs that died between
    their commit and that are settled first.
    Raises if the landing folder has no file with content, or if there were new files and none was usable.
    ``report_empty`` lists zero-byte files, for which the driver goes through all file names
    of the landing folder; switch it off for a folder of millions that is not archived.
    """
    layout = Layout(root)
    settled = settle_runs(spark, layout)
    listing = list_files(spark, landing)
    if settled and listing.isEmpty():
        return
    if report_empty:
        set_empty_files_aside(spark, landing, layout)
    check_previous_run(spark, require_files(listing, f"files in {landing}"), layout, on_failed_run)
    found = spark.read.parquet(write_run(new_files(spark, listing, layout), layout.arrivals, new_run_id()))
    count = found.count()
    shares = -(-count // max_files)
    loaded = []
    for share in range(shares):
        run_id = new_run_id()
        own = found.where(F.pmod(F.xxhash64("path"), F.lit(shares)) == share)
        taken = spark.read.schema(ARRIVED).parquet(write_run(own.select(*ARRIVED.fieldNames()), layout.arrived, run_id))
        if not taken.isEmpty():
            loaded.append(process_run(spark, taken, run_id, layout, dimensions, jdbc, by_store, landing, archive))
    if loaded and not any(loaded):
        raise NoInputError("no arrived file has all mandatory columns")
