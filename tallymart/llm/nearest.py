"""Approximate nearest neighbours with randomly rotated one-bit codes.

Every vector is padded with zeros to a whole number of 64-bit words, rotated by a fixed random rotation and cut to its signs:
one packed bit per dimension. With the code go two scalars, the vector's length |o| and s, the inner product of the unit
vector with its own code. A query is rotated as well and rounded to ``PLANES`` bits a component, which are laid out as bit planes;
the inner product of query and code is then a sum of bit counts of (code & plane), and that of query and vector is estimated
as |o| * <code, q'> / (s * sqrt(bits)). It strays from that by more than

    EPSILON * |o| * (|q| * sqrt((1 - s^2) / (bits - 1)) + step / sqrt(12)) / s

only with a small probability; the second term is the rounding of the query, whose step it names.

A search keeps, for each query, the exact score of the k-th best so far; of a block of codes only the vectors whose
estimate plus bound reaches it are reranked on the original vectors in double precision. Where most of a block does, as in
the first one, the block is scored whole. Queries are searched against all rows in blocks: a cell is one block of queries
by one block of vectors, so no task holds more than two blocks. Recall on the test tables is 0.99 or better (tests).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.llm import common

PLANES = 4
EPSILON = 2.6
VECTORS_PER_BLOCK, QUERIES_PER_BLOCK = 1 << 15, 1 << 13
CODES_AT_ONCE, QUERIES_AT_ONCE = 2048, 256
#: Beyond this share of a block it is scored whole.
WHOLE = 0.2


def rotation(dimensions: int, seed: int = 17) -> np.ndarray:
    """(dimensions, bits) with orthonormal rows: zero padding and rotation in one step."""
    bits = -(-dimensions // 64) * 64
    drawn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, dimensions)))
    return drawn.T


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    return np.packbits(bits, axis=-1).view(np.uint64)


class Codes:
    """Packed codes and correction scalars of a block of vectors."""

    def __init__(self, vectors: np.ndarray, turn: np.ndarray):
        self.bits = turn.shape[1]
        self.length = np.linalg.norm(vectors, axis=1)
        turned = vectors @ turn
        self.packed = _words(turned > 0)
        self.ones = np.bitwise_count(self.packed).sum(axis=1, dtype=np.int64)
        self.own = np.abs(turned).sum(axis=1) / np.sqrt(self.bits) / np.maximum(self.length, 1e-300)


class Planes:
    """Rotated queries as bit planes."""

    def __init__(self, queries: np.ndarray, turn: np.ndarray):
        turned = queries @ turn
        self.length, self.sum = np.linalg.norm(queries, axis=1), turned.sum(axis=1)
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / (2**PLANES - 1), 1e-300)
        levels = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.words = [_words((levels >> p) & 1) for p in range(PLANES)]

    def estimates(self, codes: Codes, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(queries, vectors) estimated inner products, and their bounds."""
        packed = codes.packed[low:high]
        counts = np.zeros((len(self.sum), len(packed)), np.int32)
        for p, words in enumerate(self.words):
            for w in range(packed.shape[1]):
                counts += np.bitwise_count(words[:, w, None] & packed[None, :, w]).astype(np.int32) << p
        scale = codes.length[low:high] / (codes.own[low:high] * np.sqrt(codes.bits))
        held = self.low[:, None] * codes.ones[None, low:high] + self.step[:, None] * counts
        spread = np.sqrt(np.maximum(0.0, 1 - codes.own[low:high] ** 2) / max(1, codes.bits - 1)) * codes.length[low:high] / codes.own[low:high]
        rounding = codes.length[low:high] / codes.own[low:high] / np.sqrt(12)
        bound = EPSILON * (self.length[:, None] * spread + self.step[:, None] * rounding)
        return (2 * held - self.sum[:, None]) * scale, bound


def search(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, score) of at most ``k`` best rows for each query, other than those of its id; ties go to the smaller id."""
    turn = rotation(vectors.shape[1])
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    codes = Codes(vectors, turn)
    out = []
    for q0 in range(0, len(queries), QUERIES_AT_ONCE):
        own, names = queries[q0 : q0 + QUERIES_AT_ONCE], query_ids[q0 : q0 + QUERIES_AT_ONCE]
        planes = Planes(own, turn)
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # query, place, score
        worst = np.full(len(own), -np.inf)
        for low in range(0, len(vectors), CODES_AT_ONCE):
            high = min(low + CODES_AT_ONCE, len(vectors))
            if low:
                guess, bound = planes.estimates(codes, low, high)
                maybe = guess + bound >= worst[:, None]
            if not low or maybe.mean() > WHOLE:
                score = own @ vectors[low:high].T
                score[names[:, None] == ids[None, low:high]] = -np.inf
                reach = np.partition(score, high - low - k, axis=1)[:, -k] if high - low > k else worst
                # Sums of another order may differ in their last digits.
                slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(reach), reach, 0.0)))
                row, column = np.nonzero(score >= (np.maximum(worst, reach) - slack)[:, None])
            else:
                row, column = np.nonzero(maybe)
            place = low + column
            keep = ids[place] != names[row]
            row, place = row[keep], place[keep]
            # The score is summed alike for all rows, however they were chosen.
            exact = np.einsum("ij,ij->i", own[row], vectors[place])
            best = _firsts(*(np.concatenate(x) for x in zip(best, (row, place, exact), strict=True)), k)
            edge = np.searchsorted(best[0], np.arange(len(own) + 1))
            full = np.flatnonzero(np.diff(edge) == k)
            worst[full] = best[2][edge[full + 1] - 1]
        out.append((best[0] + q0, ids[best[1]], best[2]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _firsts(row: np.ndarray, place: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each row, in order."""
    order = np.lexsort((place, -score, row))
    row, place, score = row[order], place[order], score[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], place[first], score[first]


def usable(column: Column, dimensions: int) -> Column:
    """True for vectors of ``dimensions`` finite components that aren't all zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(column) == dimensions) & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def _cell(k: int):
    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = {"query_id": pa.int64(), "key": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in kinds.items()})

        def side(t):
            ids, flat = t.column("id").to_numpy(), t.column("vector").combine_chunks()
            flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
            return ids, flat.flatten().to_numpy().reshape(len(ids), -1)

        query_ids, queries = side(left)
        ids, vectors = side(right)
        query, found, score = search(vectors, ids, queries, query_ids, k)
        columns = query_ids[query], left.column("key").to_numpy()[query], found, score
        return pa.table({n: pa.array(x, t) for (n, t), x in zip(kinds.items(), columns, strict=True)})

    return of


@common.on_executors
def nearest(rows: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products for every row of (vec_id, embedding) where ``queries``.

    Null or zero vectors, those with null or non-finite components, of another width than most, or without an id
    take no part. Rows that repeat an id are candidates of their own, but for queries of that id. Query rows that repeat another whole
    are searched once; those that repeat an id alone are queries of their own.
    """
    spark = rows.sparkSession
    vector = F.transform(F.col("embedding"), lambda x: x.cast("double")).alias("vector")
    base = rows.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("id"), vector, queries.alias("asked"))
    widths = base.where("size(vector) > 0").groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    base = base.where(usable(F.col("vector"), widths["width"] if widths else 0))
    # Places are numbers of rows in a written table: repeated rows are dealt like all others.
    base = common.written(common.written(base, "vectors").withColumn("row", F.monotonically_increasing_id()), "numbered")
    n = base.agg(F.count(F.lit(1)), F.count(F.when(F.col("asked"), 1))).first()
    vector_blocks, query_blocks = max(1, -(-n[0] // VECTORS_PER_BLOCK)), max(1, -(-n[1] // QUERIES_PER_BLOCK))
    # Small inputs are still cut, so that the work is spread.
    vector_blocks = max(vector_blocks, min(spark.sparkContext.defaultParallelism, -(-n[0] // 1024)))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    place = lambda name, count: F.pmod(F.xxhash64(name), F.lit(count)).cast("int")
    key = F.xxhash64("id", "vector")
    asked = base.where("asked").groupBy("id", "vector").agg(F.min("row").alias("row")).select(
        "id", "vector", key.alias("key"), place("row", query_blocks).alias("q"), every(vector_blocks).alias("v")
    )
    against = base.select("id", "vector", every(query_blocks).alias("q"), place("row", vector_blocks).alias("v"))
    found = asked.groupBy("q", "v").cogroup(against.groupBy("q", "v")).applyInArrow(_cell(k), "query_id long, key long, vec_id long, score double")
    # At most k rows for each query and block of vectors.
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
