"""Filter interaction audit: what each of five filters removes in every order, from one table of counts.

Five yes-or-no filters cut a part of the corpus into at most 32 cells. Documents are counted by cell first; a part is then a
2x2x2x2x2 tensor (axis per filter; 0 passes, 1 fails), and every figure of every order and step is one contraction of
it, whose vector along each axis selects pass (1, 0), fail (0, 1) or all (1, 1). The corpus is read once, whatever the
number of orders.

The filters: A fewer than 100 words; B less than 80 distinct words in 100; C more than 10 of 100 code points in A-Z;
D holds one of #$%&*|; E identical to the text of a smaller id. Words are runs of other bytes than space and \\x09-\\x0D.

Odd input: a null text is empty; a null language is the part "" (as an empty one is). Rows of one id and one text are no
copies of each other, as neither id is smaller. A row without id is no copy and has none, and has no label. An id
with several label rows is good, or toxic, if one of them says so. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymart.llm import common

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ["n", "good", "toxic"]
SLICE = 2 << 20

_AS_IT_IS = bytes(range(256))
_MARKS = np.zeros(256, bool)
_MARKS[list(b"#$%&*|")] = True


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of true bytes of each document."""
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def failures(texts: pa.Array) -> np.ndarray:
    """Bits 0 to 3 of each text: whether it fails A, B, C, D."""
    words = common.coded_words(texts, _AS_IT_IS)
    many = np.diff(words.starts)
    base = max(1, len(words.distinct))
    pairs = np.unique(np.repeat(np.arange(len(texts)), many) * base + words.codes)
    distinct = np.bincount(pairs // base, minlength=len(texts))
    data, offsets = common.document_bytes(texts)
    points = _sums((data & 0xC0) != 0x80, offsets)
    capitals = _sums((data >= 65) & (data <= 90), offsets)
    fails = [many < 100, 100 * distinct < 80 * many, 100 * capitals > 10 * points, _sums(_MARKS[data], offsets) > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in common.slices(batch, 2, SLICE):
            texts = common.filled_binary(rows.column(2))
            digests = pa.array([hashlib.blake2b(t.as_buffer(), digest_size=16).digest() for t in texts], pa.binary())
            codes = pa.array(failures(texts), pa.int32())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), codes, digests], names=["doc_id", "part", "code", "digest"])


def selectors() -> np.ndarray:
    """(3, orders * steps, axis, 2): the vectors for kept, removed and failing this filter only."""
    chosen = np.ones((3, len(ORDERS) * 5, 5, 2), np.int64)
    passes, fails = (1, 0), (0, 1)
    for line, (order, step) in enumerate((o, s) for o in ORDERS for s in range(5)):
        axes = [FILTERS.index(f) for f in order]
        chosen[0, line, axes[: step + 1]] = passes
        chosen[1, line, axes[:step]] = passes
        chosen[2, line] = passes
        chosen[1:, line, axes[step]] = fails
    return chosen


def contractions(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Figures of all orders and steps from (3, 2, 2, 2, 2, 2) counts of all, good and toxic documents."""
    chosen = selectors()
    kept, removed, alone = (np.einsum("kabcde,xa,xb,xc,xd,xe->xk", counts, *np.moveaxis(c, 1, 0)) for c in chosen)
    filters = np.array([FILTERS.index(f) for o in ORDERS for f in o])
    failing = np.array([np.take(counts[0], 1, axis=i).sum() for i in range(5)])
    shapley = np.zeros(5, np.int64)
    np.add.at(shapley, filters, removed[:, 0])
    return {
        "kept": kept[:, 0],
        "removed": removed[:, 0],
        "redundant": failing[filters] - removed[:, 0],
        "unique_fails": alone[:, 0],
        "good_lost": removed[:, 1],
        "toxic_lost": removed[:, 2],
        "shapley": shapley[filters],
    }


def _audited(cells: pa.Table) -> pa.Table:
    """All rows of one part from its cells, of which there are 16 at most."""
    tensor = np.zeros((3, 32), np.int64)
    codes = cells.column("code").to_numpy()
    for i, name in enumerate(COUNTS):
        for offset, suffix in ((0, ""), (16, "_copies")):
            np.add.at(tensor[i], codes + offset, cells.column(name + suffix).to_numpy())
    # Bit i of a cell's number is axis i.
    figures = contractions(tensor.reshape(3, 2, 2, 2, 2, 2).transpose(0, 5, 4, 3, 2, 1))
    rows = len(ORDERS) * 5
    return pa.table(
        {
            "part": pa.array([cells.column("part")[0].as_py()] * rows, pa.string()),
            "filter_order": pa.array([o for o in ORDERS for _ in o]),
            "step": pa.array(list(range(1, 6)) * len(ORDERS), pa.int32()),
            **{k: pa.array(v, pa.int64()) for k, v in figures.items()},
        }
    )


@common.on_executors
def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, code (bits of A to D), and counts of rows that pass E (n, good, toxic) and that fail it (n_copies, ...)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))
    rows = rows.mapInArrow(common.tidy(_checked), "doc_id long, part string, code int, digest binary")
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic"))
    labelled = rows.join(marks, "doc_id", "left").select(
        "digest", "part", "code", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "doc_id"
    )
    # One row for each id, then for each text: a text that a third of all rows share is counted before it is sent.
    kind = ["digest", "part", "code", "good", "toxic"]
    ids = labelled.groupBy(*kind, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    texts = ids.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n"))), F.lit(0)).alias("with_id"),
        F.min("doc_id").alias("first"),
        F.min_by("n", "doc_id").alias("n_first"),
    )
    # At most a few rows of one text are left: one for each language and pair of labels.
    least = F.min("first").over(Window.partitionBy("digest"))
    copies = F.col("with_id") - F.when(F.col("first") == least, F.col("n_first")).otherwise(0)
    found = texts.withColumn("copies", F.coalesce(copies, F.lit(0)))
    kept, of = F.col("n") - F.col("copies"), {"n": F.lit(1), "good": F.col("good"), "toxic": F.col("toxic")}
    return found.groupBy("part", "code").agg(
        *[F.sum(kept * of[c]).alias(c) for c in COUNTS], *[F.sum(F.col("copies") * of[c]).alias(f"{c}_copies") for c in COUNTS]
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    ``docs`` has doc_id, text and lang, ``labels`` doc_id, quality and toxic; other columns are not read.
    """
    names = "kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return cells(docs, labels).groupBy("part").applyInArrow(_audited, f"part string, filter_order string, step int, {names}")
