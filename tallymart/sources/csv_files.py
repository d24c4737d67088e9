"""Sales CSV files: listing, header check, and one typed scan per header layout.

Files are probed and loaded by Spark tasks, never one job per file. ``stage_lines`` reads the new files once, as lines with
their file and place; written down, they give the headers and then the rows, so header and rows come from the same version
of a file, and a slow or distant landing folder is read once. Without staging, ``probe_headers`` is one text scan and
``read_sales`` one CSV scan for each distinct header line. Either way a record is a line.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart.functions import base_name, pack_extras, try_typed
from tallymart.operators.joins import SOURCE_FILE
from tallymart.schemas import EXTRAS_COLUMN, MANDATORY_COLUMNS, SALES, empty_sales

# Why a file is set aside.
NOT_CSV = "not_csv"
NO_HEADER = "no_header"
MISSING_COLUMNS = "missing_columns"
REPEATED_COLUMNS = "repeated_columns"

# What ``bad_cells`` says of a line with more or fewer cells than its header.
WHOLE_ROW = "row"
RAGGED = "_ragged_line"


class NoInputError(RuntimeError):
    """There is nothing to process."""


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """Every file with content below a directory. The content column is pruned, so nothing is read."""
    return as_listing(all_files(spark, directory))


def all_files(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)


def as_listing(files: DataFrame) -> DataFrame:
    """Name, place, size and time of the files of a ``binaryFile`` source; ``uri`` is the escaped path."""
    return files.select(
        "path",
        F.col("_metadata.file_path").alias("uri"),
        base_name("path").alias("file_name"),
        "length",
        F.col("modificationTime").alias("modified"),
    )


def empty_files(spark: SparkSession, directory: str) -> DataFrame:
    """Zero-byte files below a directory. No scan returns them, so they are the names in the
    driver's file list that the listing lacks.
    """
    names = spark.createDataFrame([(uri,) for uri in all_files(spark, directory).inputFiles()], "uri string")
    path = F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B")))
    without_slashes = F.regexp_replace("uri", "^([^:/]+):/*", "$1:").alias("place")
    listed = list_files(spark, directory).select(without_slashes)
    return (
        names.select("uri", without_slashes)
        .join(listed, "place", "left_anti")
        .select(
            path.alias("path"),
            "uri",
            base_name(path).alias("file_name"),
            F.lit(0).cast("bigint").alias("length"),
            F.lit(None).cast("timestamp").alias("modified"),
        )
    )


def require_files(listing: DataFrame, what: str) -> DataFrame:
    """The listing itself, or an error when it is empty."""
    if listing.isEmpty():
        raise NoInputError(f"no {what} to process")
    return listing


def with_file_type(listing: DataFrame) -> DataFrame:
    return listing.withColumn("is_csv", F.col("file_name").endswith(".csv"))


def literal(path: str) -> str:
    """A path to be read as it is, not as a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def probe_headers(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The header line of each CSV file: the first non-blank line of its first block.

    Files without such a line do not appear.
    """
    lines = (
        spark.read.option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", "true")
        .text(paths if isinstance(paths, str) else [literal(p) for p in paths])
        .select(
            F.col("_metadata.file_path").alias("uri"),
            F.col("_metadata.file_block_start").alias("block_start"),
            "value",
        )
        .where((F.col("block_start") == 0) & (F.length(F.trim("value")) > 0))
        .withColumn("line_no", F.monotonically_increasing_id())
    )
    return lines.groupBy("uri").agg(F.min_by("value", "line_no").alias("header"))


def stage_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Every line of the CSV files, with its file, the block it was read in, and its place among the lines of that block.

    To be written once and read from there. Blank lines are left out, as a CSV scan leaves them out.
    """
    lines = (
        spark.read.option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", "true")
        .text(paths if isinstance(paths, str) else [literal(p) for p in paths])
    )
    return lines.select(
        F.col("_metadata.file_path").alias("uri"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    ).where(F.length(F.trim("value")) > 0)


def staged_headers(lines: DataFrame) -> DataFrame:
    """The header line of each file and its place, from staged lines: the first one of the first block.

    The places are compared as numbers; only the lines found are looked up by their text. One row for each file is broadcast, so that no
    line is shuffled: a size that Spark learns while it runs comes too late, when the lines have been dealt already.
    """
    first = lines.where("block_start = 0").groupBy("uri").agg(F.min("place").alias("place"))
    found = lines.where("block_start = 0").join(F.broadcast(first), ["uri", "place"])
    return found.select("uri", F.col("value").alias("header"), F.col("place").alias("header_place"))


def header_columns(header: Column | str) -> Column:
    """Column names of a header line; names in double quotes may contain commas."""
    clean = F.regexp_replace(header, r"^\uFEFF", "")
    cells = F.regexp_extract_all(F.concat(F.lit(","), clean), F.lit(',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    return F.transform(cells, lambda c: F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), '""', '"'))


def check_headers(listing: DataFrame, headers: DataFrame) -> DataFrame:
    """One row per listed file: its columns, what is missing, what is extra, and a reason if rejected.

    ``headers`` comes from ``probe_headers`` or ``staged_headers``.
    """
    mandatory = F.array(*[F.lit(c) for c in MANDATORY_COLUMNS])
    columns = F.when(F.col("header").isNotNull(), header_columns("header"))
    checked = (
        with_file_type(listing)
        .join(headers, "uri", "left")
        .withColumn("columns", columns)
        .withColumn("missing", F.array_except(mandatory, "columns"))
        .withColumn("extra", F.array_except("columns", mandatory))
        .withColumn(
            "repeated",
            F.size(F.filter("columns", lambda c: F.array_contains(mandatory, c)))
            > F.size(F.array_intersect("columns", mandatory)),
        )
    )
    reason = (
        F.when(~F.col("is_csv"), NOT_CSV)
        .when(F.col("columns").isNull(), NO_HEADER)
        .when(F.size("missing") > 0, MISSING_COLUMNS)
        .when(F.col("repeated"), REPEATED_COLUMNS)
    )
    places = ["header_place"] if "header_place" in headers.columns else []
    return checked.select(
        "path", "uri", "file_name", "length", "modified", "header", *places, "columns", "missing", "extra", reason.alias("reason")
    )


def accepted(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.col("reason").isNull())


def rejected(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.col("reason").isNotNull())


def typed_sales(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns of one layout, named by position, as typed sales with their ``source_file``.

    ``bad_cells`` names the cells that hold text which does not parse, or is ``row`` alone if the line has more or fewer
    cells than the header; such a row is to be rejected rather than let one cell change the type of its column.
    ``raw_line`` keeps the text of those rows.
    """
    places = raw.columns[: len(columns)]
    cells = dict(zip(columns, places))
    extras = [F.col(p) for c, p in zip(columns, places) if c not in MANDATORY_COLUMNS]
    # Cells are typed in a step of their own: the checks below name the results, so that no cell is parsed anew for each check.
    typed = raw.select("*", *[try_typed(F.col(cells[c]), SALES[c].dataType).alias(c) for c in MANDATORY_COLUMNS])
    ragged = F.col(RAGGED).isNotNull()
    bad = {c: F.col(cells[c]).isNotNull() & F.col(c).isNull() for c in MANDATORY_COLUMNS}
    # Only a bad line pays for the list of its bad cells.
    any_bad = reduce(or_, bad.values(), ragged)
    names = F.array_compact(F.array(*[F.when(bad[c], F.lit(c)) for c in MANDATORY_COLUMNS]))
    unparsed = F.when(any_bad, F.when(ragged, F.array(F.lit(WHOLE_ROW))).otherwise(names)).otherwise(F.array().cast("array<string>"))
    line = F.when(ragged, F.col(RAGGED)).otherwise(F.to_csv(F.struct(*places), {"escape": '"', "emptyValue": ""}))
    return typed.select(
        *MANDATORY_COLUMNS,
        pack_extras(extras).alias(EXTRAS_COLUMN),
        unparsed.alias("bad_cells"),
        F.when(any_bad, line).alias("raw_line"),
        F.col(SOURCE_FILE),
    )


CSV_OPTIONS = {"escape": '"', "columnNameOfCorruptRecord": RAGGED}


def layout_schema(columns: Sequence[str]) -> T.StructType:
    """Text columns named by position, and one for a line with another number of cells."""
    return T.StructType([T.StructField(n, T.StringType()) for n in [*[f"_c{i}" for i in range(len(columns))], RAGGED]])


def read_layout(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], header: bool = True) -> DataFrame:
    """Files that share one header line, as text columns named by their position in it.

    Two more columns hold the text of a line with another number of cells, and the file.
    """
    reader = (
        spark.read.schema(layout_schema(columns))
        .option("header", header)
        .options(**CSV_OPTIONS)
        .option("columnPruning", "false")  # else cells are only counted as far as they are used
    )
    return reader.csv(list(map(literal, paths))).withColumn(SOURCE_FILE, F.col("_metadata.file_path"))


def parse_layout(lines: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same from staged lines of files that share one header line.

    The cells are unpacked by ``inline``, through which no filter is pushed: one on the cells would parse the line anew for each cell it names.
    """
    parsed = F.from_csv("value", F.lit(layout_schema(columns).toDDL()), {**CSV_OPTIONS, "mode": "PERMISSIVE"})
    # A line without quotes and with as many cells as columns is cut at its commas, which gives the same cells at half the time.
    cut = lines.withColumn("parts", F.when(~F.contains("value", F.lit('"')), F.split("value", ",")))
    whole = [F.nullif(F.get("parts", F.lit(i)), F.lit("")).alias(f"_c{i}") for i in range(len(columns))]
    cells = F.when(F.size("parts") == len(columns), F.struct(*whole, F.lit(None).cast("string").alias(RAGGED))).otherwise(parsed)
    return cut.select(F.inline(F.array(cells)), F.col("uri").alias(SOURCE_FILE))


def read_sales(spark: SparkSession, manifest: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """All accepted files as one typed frame with ``bad_cells`` and ``raw_line``.

    The manifest is read once per layout, so it should be a written table.
    The union has one branch per distinct header line, whatever the number of files. With staged ``lines``, rows come from them
    and the landing folder is not read again; the files of a layout are joined to them by their uri. Else the
    driver holds the file paths, as it does for any file scan, and nothing of their content.
    """
    good = accepted(manifest)
    frames = []
    for layout in good.select("header", "columns").distinct().orderBy("header").collect():
        files = good.where(F.col("header") == layout["header"])
        if lines is not None:
            own = lines.join(files.select("uri", "header_place"), "uri").where("place <> header_place")
            raw = parse_layout(own, layout["columns"])
        else:
            raw = read_layout(spark, [f["path"] for f in files.select("path").toLocalIterator()], layout["columns"])
        frames.append(typed_sales(raw, layout["columns"]))
    if not frames:
        return (
            empty_sales(spark)
            .withColumn("bad_cells", F.lit(None).cast("array<string>"))
            .withColumn("raw_line", F.lit(None).cast("string"))
            .withColumn(SOURCE_FILE, F.lit(None).cast("string"))
        )
    return reduce(DataFrame.unionByName, frames)


def good_rows(sales: DataFrame) -> DataFrame:
    return sales.where(~has_bad_cells()).drop("bad_cells", "raw_line", SOURCE_FILE)


def bad_rows(sales: DataFrame) -> DataFrame:
    return sales.where(has_bad_cells()).select("raw_line", "bad_cells")


def has_bad_cells() -> Column:
    return F.size("bad_cells") > 0
