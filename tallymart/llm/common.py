"""Helpers shared by the operators: written stages, byte-level word splitting, bounded Arrow slices."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tallymart.session import scratch_dir
from tallymart.sinks.files import delete_folder

# The six bytes that separate words: space and \x09-\x0D.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

#: Lower-cases A-Z and leaves all other bytes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower-cases A-Z and blanks every ASCII byte but digits and letters.
ALNUM = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

SLICE_BYTES = 2 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="package-")  # the driver serves the archive from here until it ends
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
        _shipped.add(context.applicationId)


def on_executors(function: Callable) -> Callable:
    """Ships the package before ``function`` runs, whose first argument is a session or a frame."""

    @functools.wraps(function)
    def run(first: SparkSession | DataFrame, *args, **kwargs):
        ship(first.sparkSession if isinstance(first, DataFrame) else first)
        return function(first, *args, **kwargs)

    return run


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again: later steps start from files, not from lineage."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    stage = spark.read.schema(df.schema).parquet(path)
    stage.stage_path = path
    return stage


def dropped(stage: DataFrame) -> None:
    """Deletes what ``written`` wrote for ``stage``, once everything that reads it has been written itself. Other frames are left alone."""
    path = getattr(stage, "stage_path", None)
    if path:
        delete_folder(stage.sparkSession, path)


def _give_back() -> None:
    """Returns freed memory of this worker process to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``task`` for mapInArrow, after which its worker process keeps no freed memory: workers live on through many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            _give_back()

    return run


def filled_binary(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """A text column as one binary array; null becomes empty."""
    return column.cast(pa.binary()).fill_null(b"")


def slices(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about ``limit`` text bytes, at least one row each."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def document_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary array in one run, and where each document starts (one more entry for the end)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


class Coded(NamedTuple):
    codes: np.ndarray  # one per word: its place in ``distinct``
    starts: np.ndarray  # per document the place of its first word; one more entry for the end
    distinct: pa.Array  # the distinct words as bytes


def coded_pieces(data: np.ndarray, keep: np.ndarray | None, first: np.ndarray, doc_offsets: np.ndarray) -> Coded:
    """Dictionary-codes pieces of ``data``: bytes where ``keep`` (None: all), a new piece at each of the positions ``first``."""
    if keep is None:
        bounds, packed = np.append(first, len(data)).astype(np.int32), np.ascontiguousarray(data)
    else:
        # Kept bytes are counted by piece: running sums would take eight bytes for each byte of text.
        held = np.add.reduceat(keep.view(np.uint8), first, dtype=np.int32) if len(first) else np.zeros(0, np.int32)
        bounds, packed = np.concatenate(([0], np.cumsum(held, dtype=np.int64))).astype(np.int32), data[keep]
    pieces = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(packed)])
    coded = pieces.dictionary_encode()
    return Coded(coded.indices.to_numpy(), np.searchsorted(first, doc_offsets), coded.dictionary)


def coded_words(texts: pa.Array, table: bytes) -> Coded:
    """Words of every text after mapping its bytes by ``table``, split at blanks."""
    raw, offsets = document_bytes(texts)
    data = np.frombuffer(table, np.uint8)[raw]
    keep = ~_BLANK[data]
    begins = keep.copy()
    begins[1:] &= ~keep[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    begins[at] = keep[at]
    return coded_pieces(data, keep, np.flatnonzero(begins), offsets)


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between successive ``starts``; empty segments give 0."""
    total = np.concatenate((np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[starts[1:]] - total[starts[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers (multiply and shift, twice)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
