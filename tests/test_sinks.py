from __future__ import annotations

from decimal import Decimal
from types import SimpleNamespace

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fixtures import rows_of
from tallymart.schemas import SELLER_REPORT
from tallymart.sinks import files
from tallymart.sinks.jdbc import JdbcWriter
from tallymart.sources import tables
from tallymart.sources.jdbc import DIMENSION_TABLES, JdbcReader, Split, dimension_tables

D = Decimal


def totals(spark, *rows):
    return spark.createDataFrame(rows, "sales_month string, store_id long, total decimal(18,2)")


def test_partitions_not_written_survive(spark, tmp_path):
    path = str(tmp_path / "mart")
    columns = ["sales_month", "store_id"]
    first = totals(spark, ("2023-01", 1, D("1")), ("2023-02", 1, D("2")), (None, 1, D("3")))
    files.write_partitioned(first, path, columns)
    files.write_partitioned(totals(spark, ("2023-02", 1, D("5")), (None, 1, D("6"))), path, columns)
    back = tables.read_parquet(spark, path, totals(spark, ("", 0, D(0))).schema)
    assert rows_of(back, "sales_month", "store_id", "total") == sorted(
        [("2023-01", 1, D("1.00")), ("2023-02", 1, D("5.00")), (None, 1, D("6.00"))], key=repr
    )


def test_partition_filter_prunes(spark, tmp_path):
    path = str(tmp_path / "mart")
    files.write_partitioned(totals(spark, ("2023-01", 1, D("1")), ("2023-02", 1, D("2"))), path, ["sales_month"])
    february = spark.read.parquet(path).where("sales_month = '2023-02'")
    plan = february._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sales_month" in plan


def test_hot_partition_is_split_over_tasks(spark, tmp_path):
    other = F.concat(F.lit("2022-0"), (F.col("id") % 9 + 1).cast("string"))
    hot = spark.range(400_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("2023-01")).otherwise(other).alias("sales_month"),
        F.xxhash64("id").alias("v"),
    )
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256KB")
    try:
        files.write_partitioned(hot, str(tmp_path / "hot"), ["sales_month"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(list((tmp_path / "hot" / "sales_month=2023-01").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "hot")).count() == 400_000


def stores(spark, n, months=3, hot=False):
    """Rows of 20 stores in some months; of the hot kind, half of them are of one store and month."""
    month = F.when(F.lit(hot) & (F.col("id") % 2 == 0), 1).otherwise(F.col("id") % months + 1)
    store = F.when(F.lit(hot) & (F.col("id") % 2 == 0), 7).otherwise(F.col("id") % 20)
    return spark.range(n).select(
        F.format_string("2023-%02d", month).alias("sales_month"), store.cast("long").alias("store_id"), F.xxhash64("id").alias("v")
    )


def row_groups(folder):
    """(least store, greatest store, rows) of every row group below a folder."""
    found = []
    for file in sorted(folder.glob("*.parquet")):
        held = pq.ParquetFile(file)
        stores = [held.read_row_group(i, columns=["store_id"]).column(0).to_pylist() for i in range(held.num_row_groups)]
        assert sum(stores, []) == sorted(sum(stores, []))
        found += [(min(s), max(s), len(s)) for s in stores]
    return found


def test_packed_files_follow_the_bytes_and_hold_whole_stores(spark, tmp_path):
    stores(spark, 60_000).write.parquet(str(tmp_path / "rows"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")}
    counts = []
    try:
        for size in ("64KB", "64MB"):
            for k in before:
                spark.conf.set(k, size)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
            path = tmp_path / size
            files.write_packed(spark.read.parquet(str(tmp_path / "rows")), str(path), "sales_month", ["store_id"])
            folders = sorted(p.name for p in path.glob("sales_month=*"))
            assert folders == ["sales_month=2023-01", "sales_month=2023-02", "sales_month=2023-03"]
            counts.append(len(list(path.rglob("*.parquet"))))
            for folder in folders:
                # Files of a month hold ranges of stores that meet in one store at most.
                spans = sorted(row_groups(path / folder))
                assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
            back = spark.read.parquet(str(path))
            assert back.count() == 60_000 and back.exceptAll(stores(spark, 60_000).select(back.columns)).isEmpty()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")
        for k, v in before.items():
            spark.conf.set(k, v)
    assert counts[1] == 3 < counts[0]


def test_packed_files_are_pruned_by_month_and_store(spark, tmp_path):
    stores(spark, 20_000).write.parquet(str(tmp_path / "rows"))
    files.write_packed(spark.read.parquet(str(tmp_path / "rows")), str(tmp_path / "mart"), "sales_month", ["store_id"], file_rows=1_000)
    some = spark.read.parquet(str(tmp_path / "mart")).where("sales_month = '2023-02' and store_id = 7")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sales_month" in plan and "EqualTo(store_id,7)" in plan
    assert some.count() == stores(spark, 20_000).where("sales_month = '2023-02' and store_id = 7").count()
    spans = row_groups(tmp_path / "mart" / "sales_month=2023-02")
    assert len(spans) > 4 and sum(a <= 7 <= b for a, b, _ in spans) <= 2 and max(n for *_, n in spans) <= 1_000


def test_a_hot_store_is_cut_over_packed_files(spark, tmp_path):
    stores(spark, 40_000, hot=True).write.parquet(str(tmp_path / "rows"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_packed(spark.read.parquet(str(tmp_path / "rows")), str(tmp_path / "mart"), "sales_month", ["store_id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [n for a, b, n in row_groups(tmp_path / "mart" / "sales_month=2023-01") if a <= 7 <= b]
    assert len(sizes) >= 3 and max(sizes) < 12_000


def test_runs_are_versions_and_a_repeat_replaces_its_own(spark, tmp_path):
    path = str(tmp_path / "versions")
    files.write_run(totals(spark, ("2023-01", 1, D("1")), ("2023-02", 1, D("2"))), path, 1, ["sales_month"])
    files.write_run(totals(spark, ("2023-02", 1, D("9"))), path, 2, ["sales_month"])
    files.write_run(totals(spark, ("2023-02", 1, D("3"))), path, 2, ["sales_month"])
    back = tables.read_parquet(spark, path)
    assert rows_of(tables.latest_run(back), "sales_month", "total") == [("2023-02", D("3.00"))]
    assert rows_of(tables.latest_run(back, ["sales_month"]), "sales_month", "total") == [
        ("2023-01", D("1.00")), ("2023-02", D("3.00")),
    ]


def test_csv_report_per_month(spark, tmp_path):
    report = spark.createDataFrame(
        [(1, 'A "B", C', D("1.10"), D("0.01"), "2023-01"), (1, "D", D("2.20"), D("0.00"), "2023-02")], SELLER_REPORT
    )
    files.write_csv(report, str(tmp_path / "report"), ["sales_month"])
    folders = sorted(p.name for p in (tmp_path / "report").glob("sales_month=*"))
    assert folders == ["sales_month=2023-01", "sales_month=2023-02"]
    assert rows_of(tables.read_csv(spark, str(tmp_path / "report"), SELLER_REPORT)) == rows_of(report)


class Recorder:
    """Stands in for a reader or writer and keeps what it was asked."""

    def __init__(self):
        self.calls = []
        self.options = {}

    def option(self, key, value):
        self.options[key] = value
        return self

    def jdbc(self, **arguments):
        self.calls.append(arguments)
        return "frame"


def test_jdbc_reader_asks_for_parallel_partitions():
    reader = Recorder()
    source = JdbcReader("jdbc:x", {"user": "u"})
    session = SimpleNamespace(read=reader)
    assert source.table(session, "store") == "frame"
    source.table(session, "customer", Split("customer_id", 1, 1000, 8))
    assert reader.calls[0] == {"url": "jdbc:x", "table": "store", "properties": {"user": "u"}}
    assert reader.calls[1]["column"] == "customer_id" and reader.calls[1]["numPartitions"] == 8
    assert (reader.calls[1]["lowerBound"], reader.calls[1]["upperBound"]) == (1, 1000)


def test_dimension_tables_are_read_by_name():
    reader = Recorder()
    found = dimension_tables(
        SimpleNamespace(read=reader), JdbcReader("jdbc:x", {}), {"customer": Split("customer_id", 1, 100, 4)}
    )
    assert list(found) == DIMENSION_TABLES == [call["table"] for call in reader.calls]
    assert [call.get("numPartitions") for call in reader.calls] == [4, None, None, None]


def test_jdbc_writer_appends_stamped_rows_and_raises():
    writer = Recorder()
    stamped = []

    class Frame:
        write = writer

        def withColumn(self, name, _):
            stamped.append(name)
            return self

    JdbcWriter("jdbc:x", {"user": "u"}, connections=4).append(Frame(), "customers_data_mart")
    assert writer.calls == [
        {"url": "jdbc:x", "table": "customers_data_mart", "mode": "append", "properties": {"user": "u"}}
    ]
    assert writer.options == {"numPartitions": "4"}


def test_jdbc_errors_reach_the_caller(spark):
    df = spark.range(1)
    with pytest.raises(Exception, match="(?i)driver"):
        JdbcWriter("jdbc:nosuch:x", {}).append(df, "t", run_id=1)
    with pytest.raises(Exception, match="(?i)driver"):
        JdbcReader("jdbc:nosuch:x", {}).table(spark, "t")
