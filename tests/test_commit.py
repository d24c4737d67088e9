"""One record commits a run: versions through merges, and a job that dies between any two of its writes."""

from __future__ import annotations

import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from fixtures import rows_of, sale, sales_frame
from tallymart.plans import ingest, ledger, runs
from tallymart.plans.ingest import Layout, customer_monthly_mart, drop_merged, merge_runs, publish_sales, seller_monthly_mart
from tallymart.schemas import MANDATORY_COLUMNS
from tallymart.sinks import files
from tallymart.sources.csv_files import list_files
from tallymart.streaming.arrivals import ingest_arrivals

D = Decimal
HEADER = ",".join(MANDATORY_COLUMNS) + "\n"
BROKEN = "customer_id\n1\n"


def line(cost, day="2023-03-03", store=121, seller=1, customer=1):
    return f"{customer},{store},sugar,{day},{seller},10,1,{cost}\n"


@pytest.fixture()
def job(spark, tmp_path, dimensions):
    landing, layout = tmp_path / "landing", Layout(str(tmp_path / "marts"))
    landing.mkdir()

    def run(**options):
        ingest_arrivals(spark, str(landing), layout.root, dimensions, **options)

    def put(name, *lines, text=None):
        (landing / name).write_text(text or HEADER + "".join(lines))
        time.sleep(0.01)

    return landing, layout, run, put


def total(spark, layout):
    spent = customer_monthly_mart(spark, layout).agg(F.sum("total_sales")).first()[0]
    paid = seller_monthly_mart(spark, layout).agg(F.sum("total_sales")).first()[0]
    assert spent == paid
    return spent


def row_total(spark, layout):
    """The same from the row marts of the runs that count."""
    ids = runs.completed_runs(spark, layout.completed)
    retired = ingest.retired_versions(spark, layout, ids)
    held = ingest.current_rows(runs.read_runs(spark, layout.customer_mart, ingest.CUSTOMER_ROWS, ids), retired)
    return held.agg(F.sum("total_cost")).first()[0]


def test_a_version_repaired_after_a_merge_replaces_its_rows(spark, job):
    landing, layout, run, put = job
    put("a.csv", line(10))
    put("b.csv", line(5))
    run()
    put("a.csv", text=BROKEN)
    put("c.csv", line(1))
    run()
    assert total(spark, layout) == D("16.00")
    first = merge_runs(spark, layout)
    assert total(spark, layout) == row_total(spark, layout) == D("16.00")
    put("a.csv", line(20))
    run()
    assert total(spark, layout) == row_total(spark, layout) == D("26.00")
    second = merge_runs(spark, layout)
    assert total(spark, layout) == row_total(spark, layout) == D("26.00")
    versions = ingest.valid_versions(spark, layout, [second])
    held = {r["uri"].rsplit("/", 1)[1]: (r["rows_in"], r["valid_from"]) for r in versions.collect()}
    assert {r for r, _ in held.values()} == {second} and len(held) == 3
    assert held["b.csv"][1] < first < held["a.csv"][1] < second
    put("b.csv", line(7, day="2023-07-01"))
    put("c.csv", text=BROKEN)
    run()
    assert total(spark, layout) == row_total(spark, layout) == D("28.00")
    months = rows_of(customer_monthly_mart(spark, layout), "sales_date_month", "total_sales")
    assert months == [("2023-03", D("21.00")), ("2023-07", D("7.00"))]


def test_versions_replaced_over_and_over_and_moved_to_other_months(spark, job):
    landing, layout, run, put = job
    for n, day in enumerate(["2023-03-03", "2023-05-01", "", "2023-05-02"]):
        put("a.csv", line(10 + n, day=day), line(1, day="2023-03-09", seller=2))
        run()
        assert total(spark, layout) == row_total(spark, layout) == D(11 + n)
        if n == 2:
            assert [r[0] for r in rows_of(customer_monthly_mart(spark, layout), "sales_date_month")] == ["2023-03", None]
            merge_runs(spark, layout)
    assert rows_of(seller_monthly_mart(spark, layout), "sales_month", "sales_person_id", "total_sales", "incentive") == [
        ("2023-03", 2, D("1.00"), D("0.01")), ("2023-05", 1, D("13.00"), D("0.13")),
    ]


def test_merged_runs_are_deleted_once_they_are_old_enough(spark, job):
    landing, layout, run, put = job
    for n in range(3):
        put(f"{n}.csv", line(n))
        run()
    old = runs.completed_runs(spark, layout.completed)
    kept = merge_runs(spark, layout)
    assert drop_merged(spark, layout, older_than=3600) == []
    assert files.exists(spark, files.run_path(layout.sales_mart, old[0]))
    assert drop_merged(spark, layout, older_than=0) == old
    assert not any(files.exists(spark, files.run_path(p, r)) for p in layout.merged() for r in old)
    assert runs.completed_runs(spark, layout.completed) == [kept] and total(spark, layout) == D("3.00")
    put("1.csv", line(10))
    run()
    assert total(spark, layout) == D("12.00")


def test_late_and_replaced_files_read_no_row_mart(spark, job, dimensions, monkeypatch):
    landing, layout, run, put = job
    put("a.csv", line(10))
    run()
    put("b.csv", line(1, day="2023-04-01"))
    run()
    put("a.csv", line(30))
    read = []
    whole = runs.read_runs
    monkeypatch.setattr(runs, "read_runs", lambda s, path, schema, ids: read.append(path) or whole(s, path, schema, ids))
    plans = []
    write = ingest.write_run

    def seen(df, path, run_id, columns=()):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, path, run_id, columns)

    monkeypatch.setattr(ingest, "write_run", seen)
    run()
    assert total(spark, layout) == D("31.00")
    history = {layout.sales, layout.enriched, layout.customer_mart, layout.sales_mart}
    assert read and not history & set(read)
    ids = runs.completed_runs(spark, layout.completed)
    for plan in plans:
        assert not any(f"{p}/run_id={r}" in plan for p in history for r in ids[:-1])
    months = rows_of(spark.read.parquet(files.run_path(layout.months, ids[-1])), "sales_month")
    assert months == [("2023-03",)]


class Died(Exception):
    pass


def test_a_job_that_dies_between_any_two_writes(spark, job, tmp_path, monkeypatch):
    landing, layout, run, put = job
    archive = tmp_path / "archive"
    archive.mkdir()
    left = [10**6]

    def counted(function):
        def write(*args, **kwargs):
            left[0] -= 1
            if left[0] < 0:
                raise Died("executor lost")
            return function(*args, **kwargs)

        return write

    monkeypatch.setattr(DataFrameWriter, "parquet", counted(DataFrameWriter.parquet))
    for module in (ingest, runs):
        monkeypatch.setattr(module, "write_record", counted(files.write_record))
    monkeypatch.setattr(ingest, "move_files", counted(files.move_files))
    expected, writes, died = D(0), 0, 0
    put("warm.csv", line(1))
    run(archive=str(archive))
    writes = 10**6 - left[0]
    expected += 1
    for n in range(writes):
        put(f"{n}.csv", line(n + 2, seller=1 + n % 3))
        if n % 5 == 0:
            put(f"bad{n}.csv", text=BROKEN)
        expected += n + 2
        # What a run that died has left is recovered by the next one, which dies one write later.
        left[0] = n
        try:
            run(archive=str(archive))
        except Died:
            died += 1
        left[0] = 10**6
        if n % 8 == 7 or n == writes - 1:
            run(archive=str(archive))
            assert not list(landing.iterdir())
            assert total(spark, layout) == row_total(spark, layout) == expected
            states = ledger.current_status(ledger.read_ledger(spark, layout.ledger))
            # A file that was opened by a run that died was opened again, and closed, by a later one.
            assert states.where(F.col("status") == ledger.OPEN).isEmpty()
            merge_runs(spark, layout)
    assert died == writes
    names = sorted(p.name for p in archive.rglob("*.csv"))
    assert names == sorted([f"{n}.csv" for n in range(writes)] + [f"bad{n}.csv" for n in range(0, writes, 5)] + ["warm.csv"])


def test_a_run_that_dies_after_its_commit_is_no_failed_run(spark, job, tmp_path, monkeypatch):
    landing, layout, run, put = job
    put("a.csv", line(10))
    put("b.csv", line(5))

    def die(*args):
        raise Died

    monkeypatch.setattr(ingest, "settle_runs", die)
    with pytest.raises(Died):
        run(archive=str(tmp_path / "archive"))
    monkeypatch.undo()
    assert total(spark, layout) == D("15.00")
    put("b.csv", line(6))  # a new version in the meantime must not be archived unread
    run(on_failed_run="fail")
    assert total(spark, layout) == D("16.00")
    assert [p.name for p in landing.iterdir()] == ["b.csv"]
    states = ledger.current_status(ledger.read_ledger(spark, layout.ledger))
    assert rows_of(states, "file_name", "status") == [("a.csv", "I"), ("b.csv", "I")]


def test_files_gone_or_changed_are_not_moved(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    for name in "abc":
        (landing / name).write_text(name)
    listing = list_files(spark, str(landing)).collect()
    frame = spark.createDataFrame(listing)
    (landing / "a").unlink()
    (landing / "b").write_text("longer")
    files.move_files(spark, frame, str(landing), str(tmp_path / "out"))
    files.move_files(spark, frame, str(landing), str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["c"] and [p.name for p in landing.iterdir()] == ["b"]


def test_a_mart_keeps_the_layout_of_its_first_run(spark, tmp_path, dimensions):
    layout = Layout(str(tmp_path / "marts"))
    for cost, by_store in (("5.00", True), ("7.00", False)):
        publish_sales(spark, sales_frame(spark, sale(cost=cost)), dimensions, layout, by_store=by_store)
    merge_runs(spark, layout)
    assert spark.read.parquet(layout.sales_mart).count() == 4 and total(spark, layout) == D("12.00")
    assert all(p.parent.name.startswith("store_id=") for p in (tmp_path / "marts" / "sales_mart").rglob("*.parquet"))


def test_counts_of_lines_stand_in_the_commit_record(spark, job):
    landing, layout, run, put = job
    put("a.csv", line(10), line("x"), line(5, day="2023-13-01"), "1,2\n", line("1.234", customer="z"))
    put("b.csv", line(1))
    run()
    (record,) = runs.records(spark, layout.completed)
    held = record["metrics"]
    assert (held["lines_read"], held["lines_accepted"], held["lines_rejected"]) == (6, 2, 4)
    assert (held["bad_total_cost"], held["bad_sales_date"], held["bad_customer_id"], held["bad_row"]) == (2, 1, 1, 1)
    assert held["bad_price"] == 0
    counts = rows_of(spark.read.parquet(layout.file_counts), "lines_read", "lines_accepted", "bad_row")
    assert counts == [(1, 1, 0), (5, 1, 1)]
