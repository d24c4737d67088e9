"""The named queries: each takes a session and a folder of test tables and returns a frame.

Money is summed as exact decimals and shown as doubles, the type both engines print alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart.functions import full_name, month_of, month_to_date
from tallymart.operators import joins, projections, quality, ranking, sketches, totals
from tallymart.plans import ledger, marts, runs
from tallymart.plans.ingest import (
    CUSTOMER_ROWS,
    Dimensions,
    Layout,
    customer_monthly_mart,
    publish_sales,
    seller_monthly_mart,
)
from tallymart.schemas import MANDATORY_COLUMNS, SALES_MART, SELLER_REPORT
from tallymart.session import scratch_dir
from tallymart.sinks.files import write_csv, write_packed, write_parquet, write_partitioned, write_run
from tallymart.sources import csv_files, star
from tallymart.sources.tables import read_csv, read_parquet, read_payments
from tallymart.streaming.arrivals import ingest_arrivals

Query = Callable[[SparkSession, str], DataFrame]

#: Parquet bytes of lines and orders for each task that joins and groups them by customer (some 0.7 M lines).
JOINED_BYTES = 16 << 20


def as_doubles(df: DataFrame) -> DataFrame:
    decimals = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({c: F.col(c).cast("double") for c in decimals})


def known(spark: SparkSession, sf_dir: str) -> Dimensions:
    """Dimensions that lack one customer segment and one region, so that some sales have no match."""
    return Dimensions(
        star.customers(spark, sf_dir).where("address <> 'MACHINERY'"),
        star.stores(spark, sf_dir).where("store_pincode <> '1'"),
        star.sellers(spark, sf_dir),
    )


def known_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales of known customers, as every seller mart counts them."""
    customers = known(spark, sf_dir).customer
    return joins.only_known(star.sales(spark, sf_dir), "customer_id", customers, "customer_id")


def seller_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly totals of named sellers over sales with a known customer, store and seller."""
    tables = known(spark, sf_dir)
    return marts.seller_monthly(known_sales(spark, sf_dir), tables.store, tables.sales_team)


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = known(spark, sf_dir)
    customer = dealt_customers(spark, sf_dir, tables.customer)
    return joins.enrich(star.sales(spark, sf_dir), customer, tables.store, tables.sales_team)


def dealt_customers(spark: SparkSession, sf_dir: str, customer: DataFrame) -> DataFrame:
    """Customers dealt over as many tasks as the sales they meet need.

    Joined lines are grouped where they were joined, so a task holds the groups of all its lines. With a fixed number of shuffle
    partitions they would grow with the input; this way a task gets lines of some ``JOINED_BYTES`` of the tables. Smaller inputs are left to AQE.
    """
    tasks = -(-star.stored_bytes(spark, sf_dir, "lineitem", "orders") // JOINED_BYTES)
    return customer.repartition(tasks, "customer_id") if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else customer


def incentive_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = known(spark, sf_dir)
    sales = star.sales(spark, sf_dir)
    return as_doubles(marts.incentive_monthly(sales, tables.customer, tables.store, tables.sales_team))


def tied_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incentives on the number of sales as the total: many sellers share the first place of their store's month."""
    counted = known_sales(spark, sf_dir).withColumn("total_cost", F.lit(1).cast("decimal(18,2)"))
    tables = known(spark, sf_dir)
    return as_doubles(ranking.incentives(marts.seller_monthly(counted, tables.store, tables.sales_team)))


def seller_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_doubles(seller_totals(spark, sf_dir))


def seller_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "seller-totals")  # ranking goes over its input several times
    write_parquet(seller_totals(spark, sf_dir), path)
    ranked = ranking.rank_within(read_parquet(spark, path), ranking.STORE_MONTH, "total_sales")
    return as_doubles(ranked.select("store_id", "sales_month", "sales_person_id", "total_sales", "rnk"))


def top_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_doubles(
        ranking.top_of_group(seller_totals(spark, sf_dir), ranking.STORE_MONTH, "total_sales")
    )


def sales_with_seller_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sale with its seller's total of that month."""
    lines = star.sales(spark, sf_dir).select(
        "store_id", "sales_person_id", "sales_date", "total_cost", month_of("sales_date").alias("sales_month")
    )
    keys = ["store_id", "sales_person_id", "sales_month"]
    return as_doubles(totals.with_group_total(lines, keys, "total_cost", "total_sales"))


def customer_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend per customer and month over sales with a known customer, store and seller."""
    tables = known(spark, sf_dir)
    sales = star.sales(spark, sf_dir)
    return as_doubles(marts.customer_monthly(sales, tables.customer, tables.store, tables.sales_team))


def customer_monthly_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mart as distinct rows of all sales with their group's total, which is what the totals alone hold."""
    tables = known(spark, sf_dir)
    lines = joins.only_known(star.sales(spark, sf_dir), "store_id", tables.store)
    lines = joins.only_known(lines, "sales_person_id", tables.sales_team)
    month = month_of("sales_date").alias("sales_date_month")
    distinct = totals.distinct_group_totals(
        lines.select("customer_id", month, "total_cost"), ["customer_id", "sales_date_month"], "total_cost", "total_sales"
    )
    return as_doubles(
        joins.with_customer(distinct, tables.customer).select(
            "customer_id",
            full_name("first_name", "last_name").alias("full_name"),
            "address",
            "phone_number",
            "sales_date_month",
            "total_sales",
        )
    )


def customer_monthly_of_all_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend per customer and month whatever the store or seller."""
    lines = star.customer_lines(spark, sf_dir)
    return as_doubles(marts.customer_monthly(lines, star.customers(spark, sf_dir)))


def customer_monthly_of_known_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend per customer and month where only the customer may be unknown, joined before the totals are taken."""
    customer = dealt_customers(spark, sf_dir, known(spark, sf_dir).customer)
    lines = joins.with_customer(star.customer_lines(spark, sf_dir), customer)
    return as_doubles(totals.customer_month_totals(lines))


def customer_monthly_from_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mart from the row-level customer mart."""
    return as_doubles(totals.customer_month_totals(projections.customer_mart(enriched(spark, sf_dir))))


def incentive_from_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seller totals and incentives from the row-level sales mart."""
    per_seller = totals.seller_month_totals(projections.sales_mart(enriched(spark, sf_dir)))
    return as_doubles(ranking.incentives(per_seller))


def customer_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend per customer and day over sales with a known customer, store and seller."""
    daily = totals.customer_day_totals(enriched(spark, sf_dir))
    return as_doubles(daily.withColumn("sales_date", F.col("sales_date").cast("string")))


def enriched_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enriched(spark, sf_dir).drop("sales_person_joining_date")
    return as_doubles(rows.withColumn("sales_date", F.col("sales_date").cast("string")))


def customer_mart_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = projections.customer_mart(enriched(spark, sf_dir))
    return as_doubles(rows.withColumn("sales_date", F.col("sales_date").cast("string")))


def sales_mart_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = projections.sales_mart(enriched(spark, sf_dir))
    return as_doubles(rows.withColumn("sales_date", F.col("sales_date").cast("string")))


def sales_partitioned_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales mart written by month, and by store within it, and read back."""
    path = scratch_dir(spark, "sales-partitioned")
    write_parquet(projections.sales_mart(enriched(spark, sf_dir)), f"{path}/rows")
    write_packed(read_parquet(spark, f"{path}/rows"), f"{path}/mart", "sales_month", ["store_id"])
    rows = read_parquet(spark, f"{path}/mart", SALES_MART)
    return as_doubles(rows.withColumn("sales_date", F.col("sales_date").cast("string")))


def seller_report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly seller report as CSV files, one folder per month, from the published mart, and read back."""
    base = scratch_dir(spark, "seller-report")
    layout = Layout(f"{base}/marts")
    publish_sales(spark, star.sales(spark, sf_dir), known(spark, sf_dir), layout, by_store=False)
    write_csv(seller_monthly_mart(spark, layout).select(*SELLER_REPORT.fieldNames()), f"{base}/report", ["sales_month"])
    return as_doubles(read_csv(spark, f"{base}/report", SELLER_REPORT))


def versioned_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales published in two runs, with a half run and a run that died between: the monthly mart counts complete runs.

    The months of the second run come from it, all others from the first.
    """
    layout, tables = Layout(scratch_dir(spark, "versions")), known(spark, sf_dir)
    sales = star.sales(spark, sf_dir)
    early = F.month("sales_date") <= 6
    publish_sales(spark, sales.where(early), tables, layout, run_id=1, by_store=False)
    half = sales.where(~early & (F.col("store_id") % 2 == 0)).withColumn(joins.SOURCE_FILE, F.lit(None).cast("string"))
    rows = projections.customer_mart(joins.enrich(half, tables.customer, tables.store, tables.sales_team))
    write_run(rows.withColumn("sales_month", month_of("sales_date")), layout.customer_mart, 2)
    publish_sales(spark, sales.where(~early), tables, layout, run_id=3, by_store=False)
    spent = customer_monthly_mart(spark, layout).groupBy("sales_date_month").agg(F.sum("total_sales").alias("total_sales"))
    kept = runs.read_runs(spark, layout.customer_mart, CUSTOMER_ROWS, runs.completed_runs(spark, layout.completed))
    counted = kept.groupBy("sales_month", "run_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return as_doubles(spent.join(counted, F.col("sales_date_month") == F.col("sales_month")).drop("sales_month"))


def pay_mode_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments written as CSV under headers with spaces, loaded and totalled."""
    path = scratch_dir(spark, "payments")
    write_csv(star.payments(spark, sf_dir), path)
    payments = projections.rename_columns(read_payments(spark, path))
    return as_doubles(totals.total_by(payments, "pay_mode", "amount", "total_amount"))


def monthly_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = totals.month_totals(star.seller_lines(spark, sf_dir), [])
    return as_doubles(
        months.withColumn("month_start", month_to_date("sales_month").cast("string")).orderBy("sales_month")
    )


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    payments = projections.rename_columns(star.payments(spark, sf_dir))
    return totals.profile(payments, payments.columns)


def sketched_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of each payment column: exact, and whether the union of stored monthly sketches is within its error bound."""
    payments = projections.rename_columns(star.payments(spark, sf_dir)).withColumn("month", month_of("timestamp"))
    columns = [c for c in payments.columns if c != "month"]
    path = scratch_dir(spark, "sketches")
    write_parquet(sketches.column_sketches(payments, columns, ["month"]), path)
    total = sketches.estimates(sketches.merged(read_parquet(spark, path)))
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(f"distinct_{c}").alias("estimate")) for c in columns]
    guessed = total.select("n_rows", F.inline(F.array(*pairs)))
    found = sketches.exact_counts(payments, columns).join(guessed, "column_name")
    near = F.abs(F.col("estimate") - F.col("n_distinct")) <= F.ceil(F.col("n_distinct") * sketches.BOUND)
    return found.select("column_name", "n_rows", "n_distinct", near.alias("within_bound"))


def product_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = star.sales(spark, sf_dir, product=True).select(
        "customer_id", "sales_person_id", "product_name", "quantity", "total_cost"
    )
    return as_doubles(joins.with_product(lines, star.products(spark, sf_dir).where("id % 7 <> 0")))


def price_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales whose price and quantity do not make the total; every fourth part is sold at exactly its price."""
    lines = star.sales(spark, sf_dir, product=True)
    exact = F.pmod(F.length("product_name"), F.lit(4)) == 0
    total = F.when(exact, (F.col("price") * F.col("quantity")).cast("decimal(18,2)")).otherwise(F.col("total_cost"))
    lines = quality.price_mismatch(lines.withColumn("total_cost", total))
    return as_doubles(
        lines.select("customer_id", "sales_person_id", "product_name", "price", "quantity", "total_cost")
    )


def unmatched_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales lost against dimensions that lack one customer segment and one region."""
    return as_doubles(
        joins.unmatched_report(
            star.sales(spark, sf_dir),
            {
                "customer_id": (star.customers(spark, sf_dir).where("address <> 'MACHINERY'"), "customer_id"),
                "store_id": (star.stores(spark, sf_dir).where("store_pincode <> '1'"), "id"),
                "sales_person_id": (star.sellers(spark, sf_dir), "id"),
            },
        )
    )


def write_layouts(spark: SparkSession, sf_dir: str, landing: str) -> DataFrame:
    """All sales as CSV in three header layouts: usual, reversed, and with two extra columns.

    The tables are joined once; the layouts are cut from the written rows.
    """
    path = scratch_dir(spark, "lines")
    write_partitioned(star.sales(spark, sf_dir, product=True, extras=True).withColumn("flag", F.col("return_flag")), path, ["flag"])
    lines = read_parquet(spark, path).drop("flag")
    stored = read_parquet(spark, path)
    usual = [c for c in lines.columns if c not in ("return_flag", "line_status")]
    write_csv(stored.where("flag = 'N'").select(*usual), f"{landing}/usual")
    write_csv(stored.where("flag = 'A'").select(*reversed(usual)), f"{landing}/reversed")
    write_csv(stored.where("flag not in ('N', 'A')").drop("flag"), f"{landing}/extra")
    return lines


def show_sales(sales: DataFrame) -> DataFrame:
    return as_doubles(sales.withColumn("sales_date", F.col("sales_date").cast("string")))


def written_manifest(spark: SparkSession, landing: str) -> tuple[DataFrame, DataFrame]:
    """The verdict on every file of a landing folder, and the lines of its CSV files, which are read once and written down."""
    listing = csv_files.require_files(csv_files.list_files(spark, landing), "files")
    path = scratch_dir(spark, "manifest")
    write_parquet(csv_files.stage_lines(spark, landing), f"{path}/lines")
    lines = read_parquet(spark, f"{path}/lines")
    write_parquet(csv_files.check_headers(listing, csv_files.staged_headers(lines)), f"{path}/files")
    return read_parquet(spark, f"{path}/files"), lines


def load_landing(spark: SparkSession, landing: str) -> DataFrame:
    return csv_files.read_sales(spark, *written_manifest(spark, landing))


def normalise_extra_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales files with two extra columns, loaded with the extras packed into one."""
    landing = scratch_dir(spark, "extra-columns")
    write_csv(star.sales(spark, sf_dir, product=True, extras=True), landing)
    return show_sales(csv_files.good_rows(load_landing(spark, landing)))


def union_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of three header layouts as one typed frame."""
    landing = scratch_dir(spark, "three-layouts")
    write_layouts(spark, sf_dir, landing)
    return show_sales(csv_files.good_rows(load_landing(spark, landing)))


def with_bad_cells(lines: DataFrame, *more: Column | str) -> DataFrame:
    """Sales as text cells; returned goods have a unit in the quantity, a third decimal or a day left out."""
    returned, none = F.col("return_flag") == "R", F.lit("")
    month_only = returned & (F.col("quantity") % 2 == 0)
    cells = {
        **{c: F.col(c).cast("string") for c in MANDATORY_COLUMNS},
        "sales_date": F.when(month_only, F.date_format("sales_date", "yyyy-MM")).otherwise(F.col("sales_date").cast("string")),
        "price": F.concat(F.col("price").cast("string"), F.when(returned & (F.col("quantity") % 3 == 0), "5").otherwise(none)),
        "quantity": F.concat(F.col("quantity").cast("string"), F.when(returned, " pcs").otherwise(none)),
    }
    return lines.select(*[cells[c].alias(c) for c in MANDATORY_COLUMNS], *more)


def rejected_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows set aside: returned goods come with a unit in the quantity, a third decimal and a day left out.

    Lines with flag A lack their last cells, lines with flag N and an open status have one too many.
    """
    landing = scratch_dir(spark, "bad-cells")
    sales = star.sales(spark, sf_dir, product=True, extras=True)
    lines = with_bad_cells(sales, "return_flag", "line_status", F.col("quantity").alias("n"))
    whole = F.array(*MANDATORY_COLUMNS)
    extra = F.array(F.lit("more"))
    line = (
        F.when(F.col("return_flag") == "A", F.slice(whole, 1, 6))
        .when((F.col("return_flag") == "N") & (F.col("line_status") == "O") & (F.col("n") % 5 == 0), F.concat(whole, extra))
        .otherwise(whole)
    )
    text = lines.select(F.array_join(line, ",").alias("value"))
    text.write.text(landing)
    raw = csv_files.read_layout(spark, [landing], MANDATORY_COLUMNS, header=False)
    bad = csv_files.bad_rows(csv_files.typed_sales(raw, MANDATORY_COLUMNS))
    return bad.withColumn("bad_cells", F.array_join("bad_cells", ","))


def schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every file of a mixed landing folder, with the data lines it concerns."""
    landing = scratch_dir(spark, "schema-check")
    lines = write_layouts(spark, sf_dir, landing)
    write_csv(lines.select("customer_id", "sales_date", "quantity"), f"{landing}/short")
    star.products(spark, sf_dir).select("name").write.text(f"{landing}/notes")
    manifest, _ = written_manifest(spark, landing)
    per_file = (
        spark.read.option("recursiveFileLookup", "true")
        .text(landing)
        .groupBy(F.col("_metadata.file_path").alias("uri"))
        .agg(F.count(F.lit(1)).alias("lines"))
    )
    data_lines = F.col("lines") - F.when(F.col("header").isNotNull(), 1).otherwise(0)
    return (
        manifest.join(per_file, "uri")
        .groupBy(
            F.coalesce("reason", F.lit("accepted")).alias("verdict"),
            F.coalesce(F.array_join("missing", ","), F.lit("")).alias("missing"),
            F.coalesce(F.array_join("extra", ","), F.lit("")).alias("extra"),
        )
        .agg(F.sum(data_lines).alias("n_rows"))
    )


def load_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one run counted while it loaded a CSV file of all sales, some of whose cells are bad.

    The counts come from the pass that writes the sales table and stand in the run's commit record.
    """
    base = scratch_dir(spark, "load-metrics")
    layout = Layout(f"{base}/marts")
    write_csv(with_bad_cells(star.sales(spark, sf_dir, product=True, extras=True)), f"{base}/landing")
    ingest_arrivals(spark, f"{base}/landing", layout.root, known(spark, sf_dir))
    (record,) = runs.records(spark, layout.completed)
    return spark.createDataFrame(sorted(record["metrics"].items()), "metric string, n bigint")


def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each file of two folders: read, accepted, rejected, and how often a cell was the reason."""
    base = scratch_dir(spark, "file-metrics")
    layout = Layout(f"{base}/marts")
    lines = with_bad_cells(star.sales(spark, sf_dir, product=True, extras=True), "line_status")
    write_parquet(lines, f"{base}/lines")
    written = read_parquet(spark, f"{base}/lines")
    for folder, which in (("finished", "line_status = 'F'"), ("open", "line_status <> 'F'")):
        write_csv(written.where(which), f"{base}/landing/{folder}")
    ingest_arrivals(spark, f"{base}/landing", layout.root, known(spark, sf_dir))
    counts = spark.read.parquet(layout.file_counts).drop("run_id")
    folder = F.regexp_extract(joins.SOURCE_FILE, "/([^/]+)/[^/]+$", 1).alias("folder")
    return counts.groupBy(folder).agg(*[F.sum(c).alias(c) for c in counts.columns if c != joins.SOURCE_FILE])


def order_file(customer: Column, priority: Column) -> tuple[Column, Column]:
    """Place and name of a customer's file: a folder for each priority, a name for each customer."""
    name = F.concat(F.lit("sales_"), customer.cast("string"), F.lit(".csv"))
    return F.concat(F.lit("/landing/"), F.substring(priority, 1, 1), F.lit("/"), name), name


def order_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as staged files: opened on the order date, closed the day after if finished.

    A file name occurs in several folders, and a customer's orders of one priority are runs of one file.
    """
    place, name = order_file(F.col("o_custkey"), F.col("o_orderpriority"))
    orders = star.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        name.alias("file_name"),
        place.alias("file_location"),
        F.col("o_orderstatus").alias("state"),
        F.col("o_orderdate").cast("timestamp").alias("opened_at"),
    )
    opened = orders.withColumn("status", F.lit(ledger.OPEN)).withColumn("changed_at", F.col("opened_at"))
    closed = (
        orders.where("state = 'F'")
        .withColumn("status", F.lit(ledger.CLOSED))
        .withColumn("changed_at", F.col("opened_at") + F.expr("interval 1 day"))
    )
    return opened.unionByName(closed).drop("state", "opened_at")


def ledger_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = ledger.current_status(order_ledger(spark, sf_dir))
    return status.withColumn("changed_at", F.date_format("changed_at", "yyyy-MM-dd"))


def failed_run_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed files that an earlier run opened and did not close; the files of every other customer are listed."""
    orders = star.table(spark, sf_dir, "orders").where("o_custkey % 2 = 0")
    place, name = order_file(F.col("o_custkey"), F.col("o_orderpriority"))
    listing = orders.select(place.alias("path"), name.alias("file_name")).distinct()
    return ledger.failed_files(order_ledger(spark, sf_dir), listing)


def two_arrivals(spark: SparkSession, sf_dir: str) -> Layout:
    """All sales arrived as CSV files in two runs that share their months, with a file that lacks columns."""
    base = scratch_dir(spark, "incremental")
    landing, layout = f"{base}/landing", Layout(f"{base}/marts")
    write_parquet(star.sales(spark, sf_dir, product=True, extras=True), f"{base}/lines")
    lines = read_parquet(spark, f"{base}/lines")
    usual = lines.drop("return_flag", "line_status")
    write_csv(lines.where("line_status = 'F'").select(*usual.columns), f"{landing}/first")
    write_csv(star.products(spark, sf_dir).select("id", "name"), f"{landing}/products")
    ingest_arrivals(spark, landing, layout.root, known(spark, sf_dir))
    write_csv(lines.where("line_status <> 'F'"), f"{landing}/second")
    ingest_arrivals(spark, landing, layout.root, known(spark, sf_dir))
    return layout


def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both monthly marts after two runs over arrived files."""
    layout = two_arrivals(spark, sf_dir)
    spent = customer_monthly_mart(spark, layout).select(
        F.lit("customer").alias("mart"),
        F.col("customer_id").alias("key"),
        F.col("sales_date_month").alias("sales_month"),
        "total_sales",
        F.lit(None).cast("decimal(28,2)").alias("incentive"),
    )
    paid = seller_monthly_mart(spark, layout).select(
        F.lit("seller").alias("mart"),
        F.col("sales_person_id").alias("key"),
        "sales_month",
        "total_sales",
        "incentive",
    )
    return as_doubles(spent.unionByName(paid))


def ingest_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the runs of ``incremental_ingest`` wrote down: ledger, quarantine, unmatched rows and row marts."""
    layout = two_arrivals(spark, sf_dir)
    states = ledger.current_status(ledger.read_ledger(spark, layout.ledger))
    folder = F.regexp_extract(F.col("file_location"), "/([^/]+)/[^/]+$", 1)
    count = F.count(F.lit(1)).cast("double").alias("n")
    closed = states.groupBy(F.concat(F.lit("ledger "), folder, F.lit(" "), "status").alias("what")).agg(F.lit(1.0).alias("n"))
    aside = spark.read.parquet(layout.quarantine).groupBy(F.concat(F.lit("quarantine "), "reason").alias("what")).agg(F.lit(1.0).alias("n"))
    lost = spark.read.parquet(layout.unmatched).groupBy(F.concat(F.lit("unmatched "), "key_column").alias("what")).agg(
        F.sum("sales_rows").cast("double").alias("n")
    )
    rows = spark.read.parquet(layout.customer_mart).groupBy(F.lit("customer mart").alias("what")).agg(count)
    sold = spark.read.parquet(layout.sales_mart).groupBy(F.concat(F.lit("store "), F.col("store_id").cast("string")).alias("what")).agg(count)
    return closed.union(aside).union(lost).union(rows).union(sold)


QUERIES: dict[str, Query] = {
    "incentive_monthly": incentive_monthly,
    "seller_monthly": seller_monthly,
    "seller_rank": seller_rank,
    "top_sellers": top_sellers,
    "tied_sellers": tied_sellers,
    "sales_with_seller_total": sales_with_seller_total,
    "customer_monthly": customer_monthly,
    "customer_monthly_window": customer_monthly_window,
    "customer_monthly_of_all_sales": customer_monthly_of_all_sales,
    "customer_monthly_of_known_sales": customer_monthly_of_known_sales,
    "customer_monthly_from_rows": customer_monthly_from_rows,
    "incentive_from_rows": incentive_from_rows,
    "customer_daily": customer_daily,
    "enriched_sales": enriched_sales,
    "customer_mart_rows": customer_mart_rows,
    "sales_mart_rows": sales_mart_rows,
    "sales_partitioned_readback": sales_partitioned_readback,
    "seller_report_csv": seller_report_csv,
    "versioned_publish": versioned_publish,
    "pay_mode_totals": pay_mode_totals,
    "monthly_total": monthly_total,
    "column_profile": column_profile,
    "sketched_profile": sketched_profile,
    "product_enrich": product_enrich,
    "price_mismatch": price_mismatch,
    "unmatched_keys": unmatched_keys,
    "normalise_extra_columns": normalise_extra_columns,
    "union_files": union_files,
    "rejected_cells": rejected_cells,
    "schema_check": schema_check,
    "load_metrics": load_metrics,
    "file_metrics": file_metrics,
    "ledger_status": ledger_status,
    "failed_run_check": failed_run_check,
    "incremental_ingest": incremental_ingest,
    "ingest_books": ingest_books,
}
