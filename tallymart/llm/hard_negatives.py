"""Hard negatives by exact integer inner products, several candidates to one multiplication.

Components become integers. Those of several candidates are biased to be non-negative and laid into separated fields of
one wide integer (Kronecker packing): sum a_i * (c_i + d_i * 2^w + ...) = sum a_i c_i + 2^w * sum a_i d_i + ..., and the fields can't
run into each other if w bits hold the largest sum. One multiplication for each anchor component thus scores all of them, and
shifts and masks unpack the sums; the bias is taken off by row sums. A double is such an integer of 53 bits, so
where two fields or one fit, BLAS multiplies; wider sums are packed into Python's integers of any width. Both are exact.

Anchors are a stated query set and are searched against all rows in blocks: candidates are packed into blocks where they
are read, anchors into blocks that are dealt to groups of them. The first pass finds each anchor's positives, the second its
negatives between bounds that follow from the positives' scores. Only the best few of each block leave it.

Odd input: rows with a null id, label or vector, with a null or non-finite component, or of another width than most take no part.
Rows that repeat an id are candidates of their own, but no positives for an anchor of that id; anchors that
repeat a whole row are searched once. A score beyond 64 bits raises OverflowError. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.llm import common

BLOCK_CELLS = 1 << 18  # components of a block
SCORES_AT_ONCE = 1 << 21
EXACT_BITS = 53  # of a double
WIDE_FIELDS = 8

_COLUMNS = ("size", "kind", "ids", "labels", "vectors")
_BLOCK = "size int, kind string, ids binary, labels binary, vectors binary"
_PASS1 = "q int, i int, anchor_id long, positive_id long, positive_score long"
_PASS2 = "q int, i int, j int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
_ARROW_BLOCK = pa.schema([("size", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())])
_LEAST = np.iinfo(np.int64).min


def packed_scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """(anchors, candidates) exact inner products of integers given as doubles."""
    n, width = candidates.shape
    if not len(anchors) or not n:
        return np.zeros((len(anchors), n), np.int64)
    low = anchors.min(), candidates.min()
    top = anchors.max() - low[0], candidates.max() - low[1]
    reach = max(abs(low[0]), abs(low[0] + top[0]), 1.0) * max(abs(low[1]), abs(low[1] + top[1]), 1.0) * width
    bits = max(1, int(width * top[0] * top[1]).bit_length()) if reach < 2.0**62 else 0
    if not 0 < bits <= EXACT_BITS:
        return _wide_scores(anchors, candidates)
    fields = min(EXACT_BITS // bits, n)
    words = -(-n // fields)
    biased = np.zeros((fields * words, width))
    biased[:n] = candidates - low[1]
    packed = biased[:words].copy()
    for f in range(1, fields):
        packed += biased[f * words : (f + 1) * words] * 2.0 ** (bits * f)
    own = anchors - low[0]
    sums = (own @ packed.T).astype(np.int64)
    unpacked = np.concatenate([(sums >> (bits * f)) & ((1 << bits) - 1) for f in range(fields)], axis=1)[:, :n]
    low_a, low_c = int(low[0]), int(low[1])
    of_anchors = own.sum(axis=1).astype(np.int64) * low_c + width * low_a * low_c
    return unpacked + of_anchors[:, None] + biased[:n].sum(axis=1).astype(np.int64) * low_a


def _wide_scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """The same with integers of any width."""
    whole = lambda rows: np.array([[int(x) for x in row] for row in rows], object)
    a, c = whole(anchors), whole(candidates)
    low_a, low_c = a.min(), c.min()
    a, c, width = a - low_a, c - low_c, a.shape[1]
    bits = max(1, int(width * a.max() * c.max()).bit_length())
    out = np.empty((len(a), len(c)), np.int64)
    for at in range(0, len(c), WIDE_FIELDS):
        own = c[at : at + WIDE_FIELDS]
        packed = sum(row * (1 << (bits * f)) for f, row in enumerate(own))
        sums = a.dot(packed)
        for f, row in enumerate(own):
            scores = [(int(s) >> (bits * f)) & ((1 << bits) - 1) for s in sums]
            off = int(row.sum()) * low_a + width * low_a * low_c
            out[:, at + f] = [s + int(r.sum()) * low_c + off for s, r in zip(scores, a, strict=True)]
    return out


def best(scores: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest valid scores of each row, best first; ties go to the lower column."""
    masked = np.where(valid, scores, _LEAST)
    if scores.shape[1] > k:
        reach = np.partition(masked, scores.shape[1] - k, axis=1)[:, -k]
        valid = valid & (masked >= reach[:, None])
    row, column = np.nonzero(valid)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


class Block:
    """Rows in the order of label and id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors

    @staticmethod
    def of(row: dict, prefix: str = "") -> Block:
        size, kind, ids, labels, vectors = (row[prefix + c] for c in _COLUMNS)
        whole = np.frombuffer(vectors, kind).astype(np.float64).reshape(size, -1)
        return Block(np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), whole)

    def columns(self) -> dict[str, list]:
        """The block as one row; components take two bytes where they fit."""
        kind = "<i2" if np.abs(self.vectors).max(initial=0) < 1 << 15 else "<f8"
        held = [len(self.ids), kind, self.ids.tobytes(), self.labels.tobytes(), self.vectors.astype(kind).tobytes()]
        return {c: [v] for c, v in zip(_COLUMNS, held, strict=True)}


def _rows(batch: pa.RecordBatch | pa.Table, scale: float) -> Block:
    """Rows (id, label, vector) with components floor(scale * x)."""
    ids, labels = (batch.column(c).to_numpy() for c in ("id", "label"))
    flat = batch.column("vector")
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    vectors = np.floor(scale * flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(ids), -1)
    order = np.lexsort((ids, labels))
    return Block(ids[order], labels[order], vectors[order])


def _packed(scale: float, most: int):
    """Packs the rows of a task into blocks."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                block = _rows(batch.slice(at, most), scale)
                yield pa.RecordBatch.from_pydict(block.columns(), schema=_ARROW_BLOCK)

    return blocks


def _anchor_block(scale: float):
    def block(rows: pa.Table) -> pa.Table:
        packed = pa.Table.from_pydict(_rows(rows, scale).columns(), schema=_ARROW_BLOCK)
        return packed.add_column(0, "q", pa.array([rows.column("q")[0].as_py()], pa.int32()))

    return block


def _runs(labels: np.ndarray) -> dict[int, tuple[int, int]]:
    """First and last place of every label in sorted labels."""
    edges = np.flatnonzero(np.append(True, np.diff(labels) != 0)) if len(labels) else np.zeros(0, np.int64)
    ends = np.append(edges[1:], len(labels))
    return {int(labels[a]): (int(a), int(b)) for a, b in zip(edges, ends, strict=True)}


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block, Block, dict]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            yield row["q"], Block.of(row, "a_"), Block.of(row), row


def _positives(k: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, anchors, others, _ in _pairs(batches):
            theirs = _runs(others.labels)
            for label, (a, b) in _runs(anchors.labels).items():
                low, high = theirs.get(label, (0, 0))
                step = max(1, SCORES_AT_ONCE // max(1, high - low))
                for at in range(a, b if high > low else a, step):
                    own = slice(at, min(at + step, b))
                    scores = packed_scores(anchors.vectors[own], others.vectors[low:high])
                    row, column = best(scores, anchors.ids[own][:, None] != others.ids[None, low:high], k)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "q": pa.array(np.full(len(row), q), pa.int32()),
                            "i": pa.array(at + row, pa.int32()),
                            "anchor_id": anchors.ids[own][row],
                            "positive_id": others.ids[low + column],
                            "positive_score": scores[row, column],
                        }
                    )

    return found


def _with_bounds(low: int, high: int):
    """An anchor block with its positives: place, id, score, and the least and largest score of a negative."""

    def block(anchors: pa.Table, positives: pa.Table) -> pa.Table:
        positives = positives.sort_by([("i", "ascending"), ("j", "ascending")])
        scores = positives.column("positive_score").to_pylist()
        bounds = {"least": [-(-low * s // 100) for s in scores], "most": [high * s // 100 for s in scores]}
        columns = {n: positives.column(n).to_numpy().astype(np.int64).tobytes() for n in ("i", "j", "positive_id", "positive_score")}
        columns |= {n: np.array(v, np.int64).tobytes() for n, v in bounds.items()}
        for name, value in columns.items():
            anchors = anchors.append_column(f"p_{name}", pa.array([value] * anchors.num_rows, pa.binary()))
        return anchors

    return block


def _negatives(k: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, anchors, others, row in _pairs(batches):
            by_id = np.argsort(others.ids, kind="stable")  # ties go to the smaller id
            ids, labels, vectors = others.ids[by_id], others.labels[by_id], others.vectors[by_id]
            p = {n: np.frombuffer(row[f"p_{n}"], np.int64) for n in ("i", "j", "positive_id", "positive_score", "least", "most")}
            step = max(1, SCORES_AT_ONCE // max(1, len(ids)))
            for at in range(0, len(anchors.ids), step):
                own = slice(at, at + step)
                scores = packed_scores(anchors.vectors[own], vectors)
                differs = anchors.labels[own][:, None] != labels[None]
                for j in np.unique(p["j"]):
                    line = np.flatnonzero((p["j"] == j) & (p["i"] >= at) & (p["i"] < at + step))
                    mine = p["i"][line] - at
                    near = scores[mine]
                    valid = differs[mine] & (near >= p["least"][line, None]) & (near <= p["most"][line, None])
                    r, column = best(near, valid, k)
                    at_line = line[r]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "q": pa.array(np.full(len(r), q), pa.int32()),
                            "i": pa.array(p["i"][at_line], pa.int32()),
                            "j": pa.array(np.full(len(r), j), pa.int32()),
                            "anchor_id": anchors.ids[p["i"][at_line]],
                            "positive_id": p["positive_id"][at_line],
                            "positive_score": p["positive_score"][at_line],
                            "negative_id": ids[column],
                            "negative_score": near[r, column],
                        }
                    )

    return found


def usable(width: int) -> Column:
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size("vector") == width) & finite, F.lit(False))


@common.on_executors
def mined(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of rows (vec_id, label, embedding).

    An anchor is a row where ``anchors``. Its positives are its first ``positives`` other rows of the same label; for each, the first
    ``negatives`` rows of other labels follow whose score is from ``low`` to ``high`` hundredths of the positive's.
    """
    spark = rows.sparkSession
    base = rows.where("vec_id is not null and label is not null").select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("asked")
    )
    widths = base.where("size(vector) > 0").groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("asked"))
    counted = widths.orderBy(F.desc("n"), "width").first()
    width, count, asked = (counted["width"], counted["n"], counted["asked"]) if counted else (0, 0, 0)
    base = base.where(usable(width))
    per_block = max(64, BLOCK_CELLS // max(1, width))
    blocks = max(1, -(-asked // per_block))
    # Candidate blocks are dealt to as many groups as keep all cores busy; each group meets every block of anchors.
    groups = max(spark.sparkContext.defaultParallelism, -(-count // (64 * per_block)))
    place = F.pmod(F.xxhash64("id", "label", "vector"), F.lit(blocks)).cast("int").alias("q")
    chosen = base.where("asked").select("id", "label", "vector").distinct().select("id", "label", "vector", place)
    asking = chosen.groupBy("q").applyInArrow(_anchor_block(scale), f"q int, {_BLOCK}")
    asking = asking.select("q", *[F.col(c).alias(f"a_{c}") for c in _COLUMNS])
    held = base.select("id", "label", "vector").mapInArrow(common.tidy(_packed(scale, per_block)), _BLOCK)
    held = held.select("*", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("q"))
    dealt = lambda b: b.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))

    near = held.join(dealt(asking), ["q", "g"]).mapInArrow(common.tidy(_positives(positives)), _PASS1)
    order = Window.partitionBy("q", "i").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("j", F.row_number().over(order)).where(F.col("j") <= positives)
    bounds = [f"p_{n}" for n in ("i", "j", "positive_id", "positive_score", "least", "most")]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in asking.schema.fields), *(f"{b} binary" for b in bounds)])
    bounded = asking.groupBy("q").cogroup(near.groupBy("q")).applyInArrow(_with_bounds(low, high), schema)
    found = held.join(dealt(bounded), ["q", "g"]).mapInArrow(common.tidy(_negatives(negatives)), _PASS2)
    order = Window.partitionBy("q", "i", "j").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
