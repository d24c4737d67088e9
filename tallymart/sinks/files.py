"""Parquet and CSV output.

Partitioned output is rebalanced on its partition columns first. The rebalance lets AQE
merge small partitions and split a hot month or store over several tasks, so the number
of files follows the data and no task writes a third of it. ``write_packed`` does the same
by ranges, for tables that are read by a column inside the folders.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a packed file at most: some 128 MB of the widest mart.
FILE_ROWS = 4_000_000


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_partitioned(df: DataFrame, path: str, columns: Sequence[str], replace_all: bool = False) -> None:
    """Parquet partitioned by columns. Only partitions that occur in ``df`` are replaced."""
    (
        df.hint("rebalance", *columns)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static" if replace_all else "dynamic")
        .partitionBy(*columns)
        .parquet(path)
    )


def write_packed(df: DataFrame, path: str, folder: str, within: Sequence[str], file_rows: int = FILE_ROWS) -> None:
    """Parquet with one folder for each value of ``folder`` and files sorted by ``within``, as large as the data allow.

    Rows are dealt by ranges of (folder, within): AQE packs neighbouring ranges into tasks of the advisory size, so a file
    holds a run of whole stores, say, and a filter on the store opens few files and skips row groups in them. The row's
    place comes last in the range, so one hot store is cut over several tasks. ``df`` is read once more for the sample that the ranges
    are cut by, so it should be a written table. The folder's column stands last in the files' schema.
    """
    order = [folder, *within]
    placed = df.withColumn("__place", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(*order, "__place").sortWithinPartitions(*order).drop("__place")
    dealt.write.mode("overwrite").option("maxRecordsPerFile", file_rows).partitionBy(folder).parquet(path)


def run_path(path: str, run_id: int) -> str:
    return f"{path.rstrip('/')}/run_id={run_id}"


def write_run(df: DataFrame, path: str, run_id: int, columns: Sequence[str] = ()) -> str:
    """A version of a table under ``run_id=<run>``; repeating a run replaces just its version."""
    target = run_path(path, run_id)
    if columns:
        write_partitioned(df, target, columns, replace_all=True)
    else:
        write_parquet(df, target)
    return target


def _hadoop(spark: SparkSession, path: str):
    """The path and its file system, whichever that is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _hadoop(spark, path)
    return system.exists(place)


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder."""
    place, system = _hadoop(spark, path)
    return system.getContentSummary(place).getLength()


def has_match(spark: SparkSession, pattern: str) -> bool:
    """Whether any path fits a pattern."""
    place, system = _hadoop(spark, pattern)
    return len(system.globStatus(place) or ()) > 0


def write_record(spark: SparkSession, path: str, text: str) -> None:
    """One small file that appears whole or not at all: written under a name that no reader looks at, then renamed."""
    place, system = _hadoop(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f"_{place.getName()}-{uuid.uuid4().hex}")
    stream = system.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not system.rename(draft, place):
        raise OSError(f"cannot write {path}")


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder and all below it; a folder that isn't there is no error."""
    place, system = _hadoop(spark, path)
    system.delete(place, True)


def move_files(spark: SparkSession, files: DataFrame, base: str, target: str) -> None:
    """Move the files (``path``, ``length``, ``modified``) below ``base`` to the same places below ``target``.

    The driver renames; no content is read. A file that is gone, because it was moved before, is passed over, and so is one
    that has changed since it was listed: that is another version, which stays to be loaded. So a move
    that was cut short can be repeated.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder, system = _hadoop(spark, base)
    prefix = system.makeQualified(folder).toUri().getPath().rstrip("/") + "/"
    for row in files.select("path", "length", F.unix_millis("modified").alias("modified")).toLocalIterator():
        source = path(row["path"])
        if not system.exists(source):
            continue
        status = system.getFileStatus(source)
        if (status.getLen(), status.getModificationTime()) != (row["length"], row["modified"]):
            continue
        place = path(f"{target.rstrip('/')}/{source.toUri().getPath().removeprefix(prefix)}")
        system.mkdirs(place.getParent())
        if not system.rename(source, place):
            raise OSError(f"cannot move {row['path']} to {place}")


def write_csv(df: DataFrame, path: str, columns: Sequence[str] = (), mode: str = "overwrite") -> None:
    """CSV with a header line in each file, optionally one folder per value of the partition columns."""
    if columns:
        df = df.hint("rebalance", *columns)
    writer = df.write.mode(mode).option("header", "true").option("escape", '"')
    (writer.partitionBy(*columns) if columns else writer).csv(path)
