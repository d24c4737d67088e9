"""What the plans of the table queries must and must not contain."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry_point

SF_DIR = "/root/testdata/sf0.001"
WRITING = {
    "sales_partitioned_readback", "seller_report_csv", "versioned_publish", "normalise_extra_columns",
    "union_files", "rejected_cells", "schema_check", "incremental_ingest", "ingest_books", "pay_mode_totals", "load_metrics", "file_metrics",
}
QUERIES = sorted(set(entry_point.QUERIES) - WRITING)


def plan_of(spark, name):
    df = entry_point.queries()[name](spark, SF_DIR)
    return df._jdf.queryExecution().executedPlan().toString()


def lineitem_columns(plan):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    return {frozenset(re.findall(r"(l_\w+):", s)) for s in schemas if "l_" in s}


@pytest.mark.parametrize("name", QUERIES)
def test_no_pairwise_join_and_no_python(spark, name):
    plan = plan_of(spark, name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas", "ExistingRDD"):
        assert operator not in plan


@pytest.mark.parametrize(
    "name, columns",
    [
        ("incentive_monthly", {"l_orderkey", "l_suppkey", "l_extendedprice", "l_shipdate"}),
        ("monthly_total", {"l_extendedprice", "l_shipdate"}),
        ("customer_monthly_of_all_sales", {"l_orderkey", "l_extendedprice", "l_shipdate"}),
    ],
)
def test_scans_read_only_the_columns_used(spark, name, columns):
    assert lineitem_columns(plan_of(spark, name)) == {frozenset(columns)}


def test_filter_reaches_the_scan(spark):
    assert "Not(EqualTo(c_mktsegment,MACHINERY))" in plan_of(spark, "customer_mart_rows")


def test_window_only_over_bands(spark):
    for name in QUERIES:
        if name != "seller_rank":
            assert "Window" not in plan_of(spark, name)


@pytest.fixture()
def no_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(plan):
    """Exchanges of the first plan; AQE shows the same node again only after it ran."""
    return len(re.findall(r"Exchange hashpartitioning", plan))


@pytest.mark.parametrize("name", ["customer_monthly_window", "customer_monthly", "seller_monthly"])
def test_each_table_is_scanned_once(spark, no_broadcasts, name):
    plan = plan_of(spark, name)
    assert len(re.findall(r"FileScan parquet[^\n]*lineitem", plan)) == 1
    assert len(re.findall(r"FileScan parquet[^\n]*orders", plan)) == 1


def test_maximum_is_joined_back_without_further_exchanges(spark, no_broadcasts):
    totals = exchanges(plan_of(spark, "seller_monthly"))
    # Both sides of the join start from the totals, whose exchanges the engine reuses when it runs.
    assert exchanges(plan_of(spark, "top_sellers")) <= 2 * totals + 3


def test_newest_state_is_found_by_hash_aggregation(spark):
    for name in ("ledger_status", "failed_run_check"):
        plan = plan_of(spark, name)
        assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_a_cut_dimension_thins_sales_before_the_shuffle(spark, no_broadcasts):
    """With tables of the size for which it pays, a Bloom filter of the known keys is applied to the scan of the sales."""
    keys = {
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1KB",
    }
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        plan = plan_of(spark, "enriched_sales")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "might_contain" in plan


def test_grouped_lines_are_dealt_by_the_size_of_the_input(spark, monkeypatch):
    """A task's groups must not grow with the input: the join that they follow has as many tasks as the tables need."""
    from tallymart.plans import queries
    from tallymart.sources import star

    small = queries.customer_monthly_of_known_sales(spark, SF_DIR)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(queries, "JOINED_BYTES", 4096)
    try:
        df = queries.customer_monthly_of_known_sales(spark, SF_DIR)
        plan = df._jdf.queryExecution().executedPlan().toString()
        tasks = -(-star.stored_bytes(spark, SF_DIR, "lineitem", "orders") // 4096)
        assert tasks > 8
        assert len(re.findall(rf"Exchange hashpartitioning\(customer_id#\d+L?, {tasks}\)", plan)) == 2
        assert df.exceptAll(small).isEmpty() and df.count() == small.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
