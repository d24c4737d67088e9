"""From arrived files to published marts, one run at a time.

Every step writes below ``root`` under the id of its run; one record then commits the run. Readers take committed runs
only, and of each month the newest committed run that rebuilt it, so a run that died is never seen in part.

Two small tables carry history from run to run, so that a run never reads the row marts of others. ``versions`` has a row for
each version of a file that was accepted, and one more when another version took its place: which rows count follows from it,
through merges as well. The deltas hold signed sums for each file, key and month: those that a run added, and those that it took back
because a file was replaced. A month's totals are the sum of its deltas.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart.functions import month_of, month_start, new_run_id, sum_or_zero
from tallymart.operators.joins import SOURCE_FILE, enrich, unmatched_report
from tallymart.operators.projections import customer_mart, sales_mart
from tallymart.operators.ranking import incentives
from tallymart.plans import ledger, marts, runs
from tallymart.schemas import CUSTOMER_MART, MANDATORY_COLUMNS, SALES, SALES_MART
from tallymart.sinks.files import delete_folder, exists, has_match, move_files, run_path, write_packed, write_parquet, write_record, write_run
from tallymart.sinks.jdbc import JdbcWriter
from tallymart.sources.csv_files import (
    NO_HEADER,
    WHOLE_ROW,
    accepted,
    check_headers,
    empty_files,
    has_bad_cells,
    read_sales,
    rejected,
    stage_lines,
    staged_headers,
    with_file_type,
)

log = logging.getLogger(__name__)

# The monthly marts, by the name of their month.
_TEXT, _KEY, _TOTAL = T.StringType(), T.LongType(), T.DecimalType(28, 2)
MONTHLY = {
    "sales_date_month": T.StructType(
        [T.StructField("customer_id", _KEY), T.StructField("full_name", _TEXT), T.StructField("address", _TEXT),
         T.StructField("phone_number", _TEXT), T.StructField("total_sales", _TOTAL), T.StructField("sales_date_month", _TEXT)]
    ),
    "sales_month": T.StructType(
        [T.StructField("store_id", _KEY), T.StructField("sales_person_id", _KEY), T.StructField("full_name", _TEXT),
         T.StructField("total_sales", _TOTAL), T.StructField("incentive", _TOTAL), T.StructField("sales_month", _TEXT)]
    ),
}

# The verdict on a sales line.
ACCEPTED, REJECTED = "accepted", "rejected"

FILE = T.StructField(SOURCE_FILE, T.StringType())
MONTH = T.StructField("sales_month", T.StringType())
CUSTOMER_ROWS = T.StructType([*CUSTOMER_MART.fields, FILE, MONTH])
SALES_ROWS = T.StructType([*SALES_MART.fields, FILE])
SALES_LINES = T.StructType([*SALES.fields, FILE, T.StructField("verdict", T.StringType())])

# A version of a file: the run that holds its rows, and the runs from which and until which they count.
VERSIONS = T.StructType(
    [T.StructField("uri", _TEXT), T.StructField("rows_in", _KEY), T.StructField("valid_from", _KEY), T.StructField("valid_to", _KEY)]
)
CUSTOMER_KEYS, SELLER_KEYS = ("customer_id",), ("store_id", "sales_person_id")


def delta_schema(keys: tuple[str, ...]) -> T.StructType:
    """Signed sums for a file, month and key. ``rows_in`` is the run that holds the rows that were added or taken back."""
    fields = [FILE, T.StructField("rows_in", _KEY), MONTH, *[T.StructField(k, _KEY) for k in keys]]
    return T.StructType([*fields, T.StructField("amount", _TOTAL), T.StructField("n_rows", _KEY)])


@dataclass(frozen=True)
class Dimensions:
    customer: DataFrame
    store: DataFrame
    sales_team: DataFrame


class Layout:
    """Where a job keeps its tables."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.arrivals = f"{self.root}/arrivals"
        self.arrived = f"{self.root}/arrived"
        self.completed = f"{self.root}/completed"
        self.settled = f"{self.root}/settled"
        self.dimensions = f"{self.root}/dimensions"
        self.enriched = f"{self.root}/enriched"
        self.versions = f"{self.root}/versions"
        self.customer_deltas = f"{self.root}/customer_deltas"
        self.seller_deltas = f"{self.root}/seller_deltas"
        self.months = f"{self.root}/months"
        self.staged = f"{self.root}/staged"
        self.manifest = f"{self.root}/manifest"
        self.quarantine = f"{self.root}/quarantine"
        self.empty_files = f"{self.root}/empty_files"
        self.ledger = f"{self.root}/ledger"
        self.sales = f"{self.root}/sales"
        self.file_counts = f"{self.root}/file_counts"
        self.unmatched = f"{self.root}/unmatched"
        self.customer_mart = f"{self.root}/customer_mart"
        self.sales_mart = f"{self.root}/sales_mart"
        self.customer_monthly = f"{self.root}/customer_monthly"
        self.seller_monthly = f"{self.root}/seller_monthly"

    def merged(self) -> list[str]:
        """The tables whose rows a merged run holds as well, so that those of the runs it replaced may go."""
        rows = [self.arrived, self.versions, self.manifest, self.sales, self.customer_mart, self.sales_mart]
        totals = [self.customer_deltas, self.seller_deltas, self.months, self.customer_monthly, self.seller_monthly]
        return rows + totals + [self.enriched, *[f"{self.dimensions}/{n}" for n in ("customer", "store", "sales_team")]]


def set_empty_files_aside(spark: SparkSession, landing: str, layout: Layout) -> bool:
    """List the zero-byte files of the landing folder, which never reach a run."""
    empty = empty_files(spark, landing).withColumn("reason", F.lit(NO_HEADER))
    write_parquet(empty, layout.empty_files)
    return not spark.read.schema(empty.schema).parquet(layout.empty_files).isEmpty()


STAGED = T.StructType(
    [T.StructField("uri", _TEXT), T.StructField("block_start", _KEY), T.StructField("place", _KEY), T.StructField("value", _TEXT)]
)


def staged(spark: SparkSession, layout: Layout, run_id: int) -> DataFrame:
    """The lines of a run's CSV files as written down."""
    return runs.read_runs(spark, layout.staged, STAGED, [run_id]).drop("run_id")


def check_files(spark: SparkSession, listing: DataFrame, layout: Layout, run_id: int) -> DataFrame:
    """Stage the lines of a run's files, set the bad files aside, and return the written manifest."""
    csv_paths = [f["path"] for f in with_file_type(listing).where("is_csv").select("path").toLocalIterator()]
    if csv_paths:
        write_run(stage_lines(spark, csv_paths), layout.staged, run_id)
    headers = staged_headers(staged(spark, layout, run_id))
    manifest = spark.read.parquet(write_run(check_headers(listing, headers), layout.manifest, run_id))
    write_run(rejected(manifest), layout.quarantine, run_id, ["reason"])
    return manifest


def line_metrics() -> list[Column]:
    """Lines read, accepted and rejected, and how often each cell was the reason (``row``: another number of cells)."""
    bad = has_bad_cells()
    reasons = [F.count_if(bad & F.array_contains("bad_cells", c)).alias(f"bad_{c}") for c in [*MANDATORY_COLUMNS, WHOLE_ROW]]
    return [F.count(F.lit(1)).alias("lines_read"), F.count_if(~bad).alias("lines_accepted"), F.count_if(bad).alias("lines_rejected"), *reasons]


def load_sales(spark: SparkSession, manifest: DataFrame, layout: Layout, run_id: int) -> tuple[DataFrame, dict[str, int]]:
    """Parse the staged lines of the accepted files into the run's sales table; returns the rows that parsed, and counts of the same pass.

    The stage has served then and is deleted.
    """
    verdict = F.when(has_bad_cells(), REJECTED).otherwise(ACCEPTED)
    typed = read_sales(spark, manifest, staged(spark, layout, run_id)).withColumn("verdict", verdict)
    counted = Observation(f"lines of run {run_id}")
    # Two folders need no shuffle: each task writes its lines into both, and files are as large as the splits of the stage.
    target = run_path(layout.sales, run_id)
    typed.observe(counted, *line_metrics()).write.mode("overwrite").partitionBy("verdict").parquet(target)
    delete_folder(spark, run_path(layout.staged, run_id))
    return spark.read.schema(typed.schema).parquet(target).where(F.col("verdict") == ACCEPTED), counted.get


def write_file_counts(spark: SparkSession, layout: Layout, run_id: int) -> None:
    """The same counts for each file, from three narrow columns of the run's sales table."""
    columns = T.StructType([FILE, T.StructField("bad_cells", T.ArrayType(_TEXT))])
    lines = spark.read.schema(columns).parquet(run_path(layout.sales, run_id))
    write_run(lines.groupBy(SOURCE_FILE).agg(*line_metrics()), layout.file_counts, run_id)


def in_months(months: list[str | None], month: str = "sales_month") -> Column:
    """A filter on a few literals, so that it reaches the scan; null is a month of its own."""
    named = F.col(month).isin([m for m in months if m is not None])
    return named | F.col(month).isNull() if None in months else named


def landed(spark: SparkSession, dimensions: Dimensions, layout: Layout, run_id: int) -> Dimensions:
    """The dimensions as written once for a run, so that all its marts see the same rows."""
    names = ("customer", "store", "sales_team")
    runs.together(*[lambda n=n: write_run(getattr(dimensions, n), f"{layout.dimensions}/{n}", run_id) for n in names])
    return Dimensions(*[spark.read.parquet(run_path(f"{layout.dimensions}/{n}", run_id)) for n in names])


def write_sales_rows(spark: SparkSession, rows: DataFrame, layout: Layout, run_id: int, by_store: bool) -> None:
    """The sales mart: a folder for each month, in it files of whole stores, or with ``by_store`` a folder for each store.

    All runs of a mart have one layout, that of its first, because a table's folders must be alike.
    """
    begun = [r for r in runs.completed_runs(spark, layout.completed) if has_match(spark, f"{run_path(layout.sales_mart, r)}/sales_month=*")]
    if begun:
        by_store = has_match(spark, f"{run_path(layout.sales_mart, begun[0])}/sales_month=*/store_id=*")
    if by_store:
        write_run(rows, layout.sales_mart, run_id, ["sales_month", "store_id"])
    else:
        write_packed(rows, run_path(layout.sales_mart, run_id), "sales_month", ["store_id"])


def added_sums(enriched: DataFrame, keys: tuple[str, ...], run_id: int) -> DataFrame:
    sums = enriched.groupBy(SOURCE_FILE, month_start("sales_date").alias("__month"), *keys).agg(
        sum_or_zero("total_cost").alias("amount"), F.count(F.lit(1)).alias("n_rows")
    )
    sums = sums.withColumns({"rows_in": F.lit(run_id).cast("bigint"), "sales_month": month_of("__month")})
    schema = delta_schema(keys)
    return sums.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def write_deltas(spark: SparkSession, enriched: DataFrame, retired: DataFrame, layout: Layout, run_id: int) -> None:
    """What the run adds to each month, and what it takes back of file versions that it replaces: their sums, not their rows."""
    held_by = [r["rows_in"] for r in retired.select("rows_in").distinct().collect()]
    sides = ((layout.customer_deltas, CUSTOMER_KEYS), (layout.seller_deltas, SELLER_KEYS))
    jobs = []
    for path, keys in sides:
        deltas = added_sums(enriched, keys, run_id)
        if held_by:
            earlier = runs.read_runs(spark, path, delta_schema(keys), held_by).where("run_id = rows_in").drop("run_id")
            lost = earlier.join(retired.select(F.col("uri").alias(SOURCE_FILE), "rows_in"), [SOURCE_FILE, "rows_in"])
            taken = lost.withColumns({"amount": (-F.col("amount")).cast(_TOTAL), "n_rows": -F.col("n_rows")})
            deltas = deltas.unionByName(taken)
        jobs.append(lambda d=deltas, p=path: write_run(d.sortWithinPartitions("sales_month"), p, run_id))
    runs.together(*jobs)


def write_unmatched(sales: DataFrame, dimensions: Dimensions, layout: Layout, run_id: int) -> None:
    lost = unmatched_report(
        sales,
        {
            "customer_id": (dimensions.customer, "customer_id"),
            "store_id": (dimensions.store, "id"),
            "sales_person_id": (dimensions.sales_team, "id"),
        },
    )
    write_run(lost, layout.unmatched, run_id)


def all_versions(spark: SparkSession, layout: Layout, run_ids: list[int]) -> DataFrame:
    return runs.read_runs(spark, layout.versions, VERSIONS, run_ids).drop("run_id")


def valid_versions(spark: SparkSession, layout: Layout, run_ids: list[int]) -> DataFrame:
    """(uri, rows_in, valid_from) of the file versions that no other has replaced within the runs."""
    held = all_versions(spark, layout, run_ids).groupBy("uri", "rows_in")
    return held.agg(F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to")).where("valid_to is null").drop("valid_to")


def retired_versions(spark: SparkSession, layout: Layout, run_ids: list[int]) -> DataFrame:
    """(uri, rows_in) of the file versions that others have replaced within the runs."""
    return all_versions(spark, layout, run_ids).where("valid_to is not null").select("uri", "rows_in")


def record_versions(spark: SparkSession, files: DataFrame, layout: Layout, run_id: int) -> DataFrame:
    """Writes down the versions that a run's accepted ``files`` open and those they close, and returns the closed ones.

    A file that is rejected closes nothing: its last good version counts on.
    """
    own = F.lit(run_id).cast("bigint")
    opened = files.select("uri", own.alias("rows_in"), own.alias("valid_from"), F.lit(None).cast("bigint").alias("valid_to"))
    earlier = valid_versions(spark, layout, runs.completed_runs(spark, layout.completed))
    closed = earlier.join(files.select("uri").distinct(), "uri", "left_semi").withColumn("valid_to", own)
    write_run(opened.distinct().unionByName(closed), layout.versions, run_id)
    return retired_versions(spark, layout, [run_id])


def current_rows(rows: DataFrame, retired: DataFrame) -> DataFrame:
    """Rows without those of file versions that were replaced."""
    old = (F.col(SOURCE_FILE) == F.col("uri")) & (F.col("run_id") == F.col("rows_in"))
    return rows.join(retired, old, "left_anti").drop("run_id")


def month_sums(spark: SparkSession, path: str, keys: tuple[str, ...], run_ids: list[int], months: list[str | None], month: str) -> DataFrame:
    """Totals of the keys in some months from the deltas of all runs; a key whose rows were all taken back is gone."""
    deltas = runs.read_runs(spark, path, delta_schema(keys), run_ids).where(in_months(months))
    sums = deltas.groupBy(*keys, F.col("sales_month").alias(month)).agg(
        F.sum("amount").cast(_TOTAL).alias("total_sales"), F.sum("n_rows").alias("n_rows")
    )
    return sums.where("n_rows > 0").drop("n_rows")


def rebuild_months(
    spark: SparkSession,
    dimensions: Dimensions,
    layout: Layout,
    run_id: int,
    jdbc: JdbcWriter | None = None,
    tables: tuple[str, str] = ("customers_data_mart", "sales_team_data_mart"),
) -> None:
    """Recompute the months this run touched from the deltas of all runs, as this run's version of them.

    A late file can change who won a month, so a month's totals are always rebuilt whole; its rows are not read again. A
    month is touched by rows that the run adds, and by rows that it takes back. ``tables`` are the names of the database tables.
    """
    every = [*runs.completed_runs(spark, layout.completed), run_id]
    touched = runs.read_runs(spark, layout.customer_deltas, delta_schema(CUSTOMER_KEYS), [run_id]).select("sales_month").distinct()
    write_run(touched, layout.months, run_id)
    months = [r[0] for r in spark.read.schema(T.StructType([MONTH])).parquet(run_path(layout.months, run_id)).collect()]
    if not months:
        return
    spent = marts.name_customers(
        month_sums(spark, layout.customer_deltas, CUSTOMER_KEYS, every, months, "sales_date_month"), dimensions.customer
    )
    totals = month_sums(spark, layout.seller_deltas, SELLER_KEYS, every, months, "sales_month")
    paid = incentives(marts.name_sellers(totals, dimensions.store, dimensions.sales_team))
    runs.together(
        lambda: write_run(spent.sortWithinPartitions("sales_date_month"), layout.customer_monthly, run_id),
        lambda: write_run(paid.sortWithinPartitions("sales_month"), layout.seller_monthly, run_id),
    )
    if jdbc is not None:
        for path, frame, table in zip((layout.customer_monthly, layout.seller_monthly), (spent, paid), tables, strict=True):
            jdbc.append(spark.read.schema(frame.schema).parquet(run_path(path, run_id)), table, run_id)


def read_monthly(spark: SparkSession, layout: Layout, path: str, month: str) -> DataFrame:
    """A monthly mart: of each month the newest complete run that rebuilt it.

    Which run that is comes from a small table of months; the runs and months are literals of the filter, so only
    the folders of those runs are opened, and row groups of other months are passed over.
    """
    ids = runs.completed_runs(spark, layout.completed)
    rebuilt = runs.read_runs(spark, layout.months, T.StructType([MONTH]), ids)
    newest: dict[int, list[str | None]] = {}
    for row in rebuilt.groupBy("sales_month").agg(F.max("run_id").alias("run_id")).collect():
        newest.setdefault(row["run_id"], []).append(row["sales_month"])
    wanted = F.lit(False)
    for run_id, months in newest.items():
        wanted |= (F.col("run_id") == run_id) & in_months(months, month)
    schema = MONTHLY[month]
    return runs.read_runs(spark, path, schema, sorted(newest)).where(wanted).drop("run_id")


def customer_monthly_mart(spark: SparkSession, layout: Layout) -> DataFrame:
    return read_monthly(spark, layout, layout.customer_monthly, "sales_date_month")


def seller_monthly_mart(spark: SparkSession, layout: Layout) -> DataFrame:
    return read_monthly(spark, layout, layout.seller_monthly, "sales_month")


def merge_runs(spark: SparkSession, layout: Layout, by_store: bool = False) -> int | None:
    """Rewrite the rows, versions, sums and months of all complete runs as one run, so that folders and files stay few.

    Rows of replaced file versions are left out. Returns its id, or None if there is nothing to merge. The replaced runs' folders stay
    for readers that still use them; ``drop_merged`` deletes them.
    """
    settle_runs(spark, layout)
    old = runs.completed_runs(spark, layout.completed)
    if len(old) < 2:
        return None
    run_id, retired = new_run_id(), retired_versions(spark, layout, old)
    own = F.lit(run_id).cast("bigint")

    def current(path: str, schema: T.StructType) -> DataFrame:
        return current_rows(runs.read_runs(spark, path, schema, old), retired)

    def sums(path: str, keys: tuple[str, ...]) -> None:
        added = runs.read_runs(spark, path, delta_schema(keys), old).groupBy(SOURCE_FILE, "sales_month", *keys).agg(
            F.sum("amount").cast(_TOTAL).alias("amount"), F.sum("n_rows").alias("n_rows")
        )
        held = added.where("n_rows > 0").withColumn("rows_in", own).select(*delta_schema(keys).fieldNames())
        write_run(held.sortWithinPartitions("sales_month"), path, run_id)

    def newest_verdicts() -> None:
        """The last verdict on each file, if the runs loaded files at all."""
        verdict = runs.read_runs(spark, layout.manifest, stored_schema(spark, layout.manifest), old)
        if "uri" in verdict.columns:
            newest = verdict.groupBy("uri").agg(F.max("run_id").alias("newest")).withColumnRenamed("uri", "u")
            kept = verdict.join(newest, (F.col("uri") == F.col("u")) & (F.col("run_id") == F.col("newest")))
            write_run(kept.drop("run_id", "u", "newest"), layout.manifest, run_id)

    def arrivals() -> None:
        taken = runs.read_runs(spark, layout.arrived, stored_schema(spark, layout.arrived), old).drop("run_id")
        if taken.columns:
            write_run(taken.distinct(), layout.arrived, run_id)

    valid = valid_versions(spark, layout, old).select("uri", own.alias("rows_in"), "valid_from", F.lit(None).cast("bigint").alias("valid_to"))
    months = runs.read_runs(spark, layout.months, T.StructType([MONTH]), old).select("sales_month").distinct()
    runs.together(
        arrivals,
        newest_verdicts,
        lambda: write_run(valid, layout.versions, run_id),
        lambda: write_run(months, layout.months, run_id),
        lambda: write_run(current(layout.sales, SALES_LINES), layout.sales, run_id, ["verdict"]),
        lambda: write_run(current(layout.customer_mart, CUSTOMER_ROWS), layout.customer_mart, run_id),
        lambda: write_sales_rows(spark, current(layout.sales_mart, SALES_ROWS), layout, run_id, by_store),
        lambda: sums(layout.customer_deltas, CUSTOMER_KEYS),
        lambda: sums(layout.seller_deltas, SELLER_KEYS),
        lambda: write_run(customer_monthly_mart(spark, layout), layout.customer_monthly, run_id),
        lambda: write_run(seller_monthly_mart(spark, layout), layout.seller_monthly, run_id),
    )
    runs.complete(spark, layout.completed, run_id, replaces=old)
    return run_id


def drop_merged(spark: SparkSession, layout: Layout, older_than: float) -> list[int]:
    """Deletes the tables of runs that were merged into another at least ``older_than`` seconds ago, and returns their ids.

    The time must be longer than any reader takes. Ledger, quarantine and unmatched reports are history and stay.
    """
    gone = runs.replaced_runs(spark, layout.completed, older_than)
    runs.delete_runs(spark, layout.merged(), gone)
    return gone


def stored_schema(spark: SparkSession, path: str) -> T.StructType:
    """Schema of a run-stamped table without its stamp; no fields if no run has written it."""
    fields = spark.read.parquet(path).schema.fields if exists(spark, path) else []
    return T.StructType([f for f in fields if f.name != "run_id"])


def settle_runs(spark: SparkSession, layout: Layout) -> list[int]:
    """Does what is left to do for committed runs that loaded files: closes the files in the ledger and archives them.

    What a run's files are, and where they go, stands in its commit record and manifest, so a run that died after its commit is
    settled by the next call. Every step can be repeated. Returns the ids of the runs.
    """
    settled = {r["run_id"] for r in runs.records(spark, layout.settled)}
    waiting = [r for r in runs.records(spark, layout.completed) if r["has_files"] and r["run_id"] not in settled]
    for record in waiting:
        run_id = record["run_id"]
        manifest = spark.read.parquet(run_path(layout.manifest, run_id))
        good = accepted(manifest)
        if not good.isEmpty():
            ledger.record(good, layout.ledger, run_id, ledger.CLOSED)
        if record["archive"]:
            for name, files in (("loaded", good), ("rejected", rejected(manifest))):
                move_files(spark, files, record["landing"], run_path(record["archive"], run_id) + "/" + name)
        write_record(spark, runs.record_path(layout.settled, run_id), f'{{"run_id": {run_id}}}')
    return [r["run_id"] for r in waiting]


def publish_sales(
    spark: SparkSession,
    sales: DataFrame,
    dimensions: Dimensions,
    layout: Layout,
    run_id: int | None = None,
    jdbc: JdbcWriter | None = None,
    by_store: bool = True,
) -> int:
    """All marts of one run from typed sales, which is complete afterwards. An id that was completed before is refused.

    The sales mart has a folder per month, and with ``by_store`` one per store in it. That suits a few large stores; with many
    small ones it makes a tiny file for each, and without it stores share files.
    """
    if run_id is None:
        run_id = new_run_id()
    write_marts(spark, sales, dimensions, layout, run_id, jdbc, by_store)
    runs.complete(spark, layout.completed, run_id)
    return run_id


def write_marts(
    spark: SparkSession,
    sales: DataFrame,
    dimensions: Dimensions,
    layout: Layout,
    run_id: int,
    jdbc: JdbcWriter | None = None,
    by_store: bool = False,
    retired: DataFrame | None = None,
) -> None:
    """All tables of a run but its commit.

    The sales are joined once; row marts and sums are cut from the written result. Jobs that don't wait for each other run side by side.
    """
    runs.refuse_repeat(spark, layout.completed, run_id)
    if SOURCE_FILE not in sales.columns:
        sales = sales.withColumn(SOURCE_FILE, F.lit(None).cast("string"))
    if retired is None:
        retired = spark.createDataFrame([], VERSIONS)
    tables = landed(spark, dimensions, layout, run_id)

    def from_joined() -> None:
        joined = enrich(sales, tables.customer, tables.store, tables.sales_team)
        enriched = spark.read.schema(joined.schema).parquet(write_run(joined, layout.enriched, run_id))
        bought = customer_mart(enriched).withColumn("sales_month", month_of("sales_date"))

        def months() -> None:
            write_deltas(spark, enriched, retired, layout, run_id)
            rebuild_months(spark, tables, layout, run_id, jdbc)

        runs.together(
            months,
            lambda: write_sales_rows(spark, sales_mart(enriched), layout, run_id, by_store),
            lambda: write_run(bought, layout.customer_mart, run_id),
        )

    runs.together(from_joined, lambda: write_unmatched(sales, tables, layout, run_id))


def process_run(
    spark: SparkSession,
    listing: DataFrame,
    run_id: int,
    layout: Layout,
    dimensions: Dimensions,
    jdbc: JdbcWriter | None = None,
    by_store: bool = False,
    landing: str | None = None,
    archive: str | None = None,
) -> bool:
    """One run over newly arrived files. Returns whether any file was good enough to load.

    Its commit record is the only write that counts: before it nothing of the run is seen, and after it closing and
    archiving follow, in this call or in the next one.
    """
    commit = {"has_files": True, "landing": landing, "archive": archive}
    manifest = check_files(spark, listing, layout, run_id)
    good = accepted(manifest)
    if good.isEmpty():
        log.error("run %s: no file with all mandatory columns", run_id)
        runs.complete(spark, layout.completed, run_id, **commit)
        settle_runs(spark, layout)
        return False
    ledger.record(good, layout.ledger, run_id, ledger.OPEN)
    retired = record_versions(spark, good, layout, run_id)
    sales, metrics = load_sales(spark, manifest, layout, run_id)
    runs.together(
        lambda: write_marts(spark, sales, dimensions, layout, run_id, jdbc, by_store, retired),
        lambda: write_file_counts(spark, layout, run_id),
    )
    runs.complete(spark, layout.completed, run_id, metrics=metrics, **commit)
    settle_runs(spark, layout)
    return True
