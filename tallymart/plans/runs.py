"""Runs: their ids, the record that commits them, and reading only what is committed.

A run writes everything below its own id, which no other run ever gets. One small file commits it: it appears whole or
not at all, and everything that follows from completion (closed files, what is to be archived) is derived from it and
from the tables the run wrote before. Readers take committed runs only, so what a dead run has left is never seen, and
its retry is simply another run.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart.sinks.files import delete_folder, exists, run_path, write_record

_ID, _TEXT = T.LongType(), T.StringType()
COMPLETED = T.StructType(
    [
        T.StructField("run_id", _ID),
        T.StructField("completed_at", T.TimestampType()),
        T.StructField("replaces", T.ArrayType(_ID)),
        T.StructField("has_files", T.BooleanType()),
        T.StructField("landing", _TEXT),
        T.StructField("archive", _TEXT),
        T.StructField("metrics", T.MapType(_TEXT, _ID)),
    ]
)


class RepeatedRunError(RuntimeError):
    """A run id that has been completed before."""


def record_path(record: str, run_id: int) -> str:
    return f"{record}/run-{run_id}.json"


def records(spark: SparkSession, record: str) -> list[T.Row]:
    """All commit records. There is one for each run, and merging runs keeps their number small."""
    return spark.read.schema(COMPLETED).json(record).collect() if exists(spark, record) else []


def completed_runs(spark: SparkSession, record: str) -> list[int]:
    """Ids of the committed runs that no other has replaced, oldest first."""
    rows = records(spark, record)
    return sorted({r["run_id"] for r in rows} - {old for r in rows for old in r["replaces"] or ()})


def refuse_repeat(spark: SparkSession, record: str, run_id: int) -> None:
    if exists(spark, record_path(record, run_id)):
        raise RepeatedRunError(f"run {run_id} is complete; a new run needs an id of its own")


def complete(
    spark: SparkSession,
    record: str,
    run_id: int,
    replaces: list[int] | None = None,
    has_files: bool = False,
    landing: str | None = None,
    archive: str | None = None,
    metrics: dict[str, int] | None = None,
) -> None:
    """Commits a run. ``replaces`` names runs whose rows it holds as well, and which are read no more.

    ``has_files`` says that it loaded files, which are to be closed in the ledger and, with ``archive``, moved there out of ``landing``.
    """
    held = {
        "run_id": run_id,
        "completed_at": datetime.now(UTC).isoformat(),
        "replaces": replaces or [],
        "has_files": has_files,
        "landing": landing,
        "archive": archive,
        "metrics": metrics or {},
    }
    write_record(spark, record_path(record, run_id), json.dumps(held))


def read_runs(spark: SparkSession, path: str, schema: T.StructType, run_ids: Iterable[int]) -> DataFrame:
    """A run-stamped table over some runs. Only their folders are listed and opened; a run need not have written the table."""
    stamped = schema if "run_id" in schema.fieldNames() else T.StructType([*schema.fields, T.StructField("run_id", _ID)])
    held = [r for r in run_ids if exists(spark, run_path(path, r))]
    if not held:
        return spark.createDataFrame([], stamped)
    folders = [run_path(path, r) for r in held]
    return spark.read.schema(stamped).option("basePath", path).parquet(*folders).where(F.col("run_id").isin(held))


def newest_run(spark: SparkSession, path: str, schema: T.StructType, record: str) -> DataFrame:
    """The rows of the newest complete run."""
    return read_runs(spark, path, schema, completed_runs(spark, record)[-1:])


def replaced_runs(spark: SparkSession, record: str, older_than: float = 0.0) -> list[int]:
    """Runs that others have replaced at least ``older_than`` seconds ago."""
    now = datetime.now(UTC).timestamp()
    return sorted({old for r in records(spark, record) if now - r["completed_at"].replace(tzinfo=UTC).timestamp() >= older_than for old in r["replaces"] or ()})


def delete_runs(spark: SparkSession, paths: Iterable[str], run_ids: Iterable[int]) -> None:
    """Deletes what the runs wrote below the paths."""
    for path in paths:
        for run_id in run_ids:
            delete_folder(spark, run_path(path, run_id))


def together(*jobs: Callable[[], object]) -> None:
    """Runs independent jobs at the same time, so that a small one doesn't wait for the last task of a large one."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        for job in [pool.submit(j) for j in jobs]:
            job.result()
