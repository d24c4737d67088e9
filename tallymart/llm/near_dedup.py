"""Near-duplicate documents by HyperMinHash registers, banding and exact verification.

A document's set is that of its distinct two-word shingles (words split at blanks, A-Z lower-cased); a document
of one word has that word as its set, a document without words is linked with nothing. Shingles are held as
64-bit hashes.

1. Rows of equal sets form one class; only one row of a class goes on, so copies never meet in a bucket.
2. Each class gets ``REGISTERS`` registers: a shingle's hash chooses the register, a second hash is minimised in it,
   and the register keeps that minimum's count of leading zeros (6 bits) and the next 10 bits (mantissa). An empty
   register borrows from others in a fixed order of probes.
3. Bands of ``ROWS`` registers make buckets. Every member of a bucket is compared with one member (the hub); hubs are
   chosen by one global order, so a group meets the same hub in all its bands.
4. Where the members of a bucket are still in several components, all its pairs across components are compared, in cells
   of two blocks of members that hold the whole sets. So no pair that shares a bucket stays untested unless it is
   connected already, and a cell gives back fewer links than it has members.
5. A pair is verified on its whole sets if either has fewer than ``SMALL`` shingles, or else if the Jaccard estimate
   from the registers, corrected for chance agreement, is within ``MARGIN`` of the limit.

A pair at the limit of 0.8 shares no band with probability (1 - 0.8**5)**32 = 3e-6, if registers are independent, and
the estimate strays by more than the margin, almost four standard deviations, with up to 1e-4. The registers of a few
shingles borrow from each other, so their estimate strays far more often (one pair in ten at 4 of 5 shingles) and is
not asked below ``SMALL``; their bands were missed by none of 20,000 simulated pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm import common
from tallymart.llm.graph import components

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
MANTISSA_BITS = 10
PROBES = 24
MARGIN = 0.12
SMALL = 64
BLOCK, GROUP = 512, 1 << 16
SALTS = 16
MOST_BITS = 1 << 25

_U = np.uint64
_SIGNATURE = ["sig1", "sig2", "n_shingles"]
_TEXT_SKETCH = "doc_id long, n_shingles long, sig1 long, sig2 long, registers binary, bands array<long>"


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    words = common.coded_words(texts, common.LOWER)
    of_word = np.array([xxhash.xxh64_intdigest(w) for w in words.distinct.to_pylist()], np.uint64)
    h = of_word[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    single = common.mix64(h ^ _U(0x5851F42D4C957F2D))
    pair = common.mix64(h[:-1] * _U(0x9E3779B97F4A7C15) + common.mix64(h[1:])) if len(h) else h
    starts = words.starts
    return [
        np.unique(pair[a : b - 1]) if b - a > 1 else single[a:b]
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)
    ]


def _probes() -> np.ndarray:
    order = np.random.default_rng(7)
    return np.stack([order.permutation(REGISTERS) for _ in range(PROBES)])


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, REGISTERS) of 16 bits: 6 for leading zeros, 10 of mantissa. Rows of empty sets are all ones."""
    counts = np.array([len(s) for s in sets], np.int64)
    lowest = np.full(len(sets) * REGISTERS, 2**64 - 1, np.uint64)
    if counts.sum():
        h = np.concatenate(sets)
        which = ((h >> _U(32)) * _U(REGISTERS)) >> _U(32)
        at = np.repeat(np.arange(len(sets)) * REGISTERS, counts) + which.astype(np.int64)
        np.minimum.at(lowest, at, common.mix64(h + _U(0xA0761D6478BD642F)) >> _U(1))
    lowest = lowest.reshape(len(sets), REGISTERS)
    held = lowest != _U(2**64 - 1)
    part, power = np.frexp(lowest.astype(np.float64))
    zeros = np.clip(63 - power, 0, 62)
    mantissa = np.minimum((part - 0.5) * 2 ** (MANTISSA_BITS + 1), 2**MANTISSA_BITS - 1).clip(0)
    out = ((zeros << MANTISSA_BITS) + mantissa.astype(np.int64)).astype(np.uint16)
    rows = np.flatnonzero(~held.all(axis=1) & held.any(axis=1))
    if len(rows):
        own, has = out[rows], held[rows]
        filled, value = has.copy(), own.copy()
        for probe in _probes():
            take = ~filled & has[:, probe]
            value[take] = own[:, probe][take]
            filled |= take
            if filled.all():
                break
        else:  # what no probe has filled takes the next held register to the right, in a circle
            places = np.where(np.concatenate((has, has), axis=1), np.arange(2 * REGISTERS), 2 * REGISTERS)
            after = np.minimum.accumulate(places[:, ::-1], axis=1)[:, ::-1][:, :REGISTERS] % REGISTERS
            value = np.where(filled, value, np.take_along_axis(own, after, axis=1))
        out[rows] = value
    out[~held.any(axis=1)] = 0xFFFF
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(documents, BANDS) 64-bit keys."""
    grouped = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15), grouped.shape[:2]).copy()
    for r in range(ROWS):
        key = common.mix64(key * _U(65599) + grouped[:, :, r] + _U(1))
    return key.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch, 1):
            sets = shingle_sets(common.filled_binary(part.column(1)))
            regs = registers(sets)
            keys = band_keys(regs)
            keys = [k if len(s) else k[:0] for s, k in zip(sets, keys, strict=True)]
            sums = [_signature(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([int(s[0]) for s in sums], pa.int64()),
                    pa.array([int(s[1]) for s in sums], pa.int64()),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "sig1", "sig2", "registers", "bands"],
            )


def _bits(ids: np.ndarray, size: int) -> np.ndarray:
    """Two places for every id in a Bloom filter of ``size`` bits."""
    h = common.mix64(ids.astype(np.int64).view(np.uint64) + _U(0xC2B2AE3D27D4EB4F))
    return np.concatenate((h & _U(size - 1), (h >> _U(32)) & _U(size - 1)))


def _bloom_words(size: int):
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size // 64, np.uint64)
        for batch in batches:
            at = _bits(batch.column(0).to_numpy(), size)
            np.bitwise_or.at(held, at >> _U(6), _U(1) << (at & _U(63)))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some].view(np.int64))], names=["word", "bits"])

    return words


def _signature(s: np.ndarray) -> np.ndarray:
    """Two sums over a set, which with its size tell it from others."""
    return np.array([s.sum(), common.mix64(s).sum()], np.uint64).view(np.int64)


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, sig1, sig2, n_shingles, shingles) of the rows with a wanted ``doc_id``, and of a few others.

    A Bloom filter of the ids, of at most ``MOST_BITS`` however many there are, is broadcast, so that the texts are read
    where they lie and only the wanted sets are shuffled by the join that follows. More ids only make it less sharp.
    """
    size = 1 << 10
    while size < min(16 * wanted.count(), MOST_BITS):
        size *= 2
    rows = wanted.mapInArrow(_bloom_words(size), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bloom = np.zeros(size // 64, np.uint64)
    bloom[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            at = _bits(batch.column(0).fill_null(0).to_numpy(), size)
            hit = ((held[at >> _U(6)] >> (at & _U(63))) & _U(1)).astype(bool).reshape(2, -1).all(axis=0)
            for part in common.slices(batch.filter(pa.array(hit)), 1):
                found = shingle_sets(common.filled_binary(part.column(1)))
                sums = np.array([_signature(s) for s in found], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        *[pa.array(sums[:, i]) for i in (0, 1)],
                        pa.array([len(s) for s in found], pa.int64()),
                        pa.array([s.tobytes() for s in found], pa.binary()),
                    ],
                    names=["doc_id", "sig1", "sig2", "n_shingles", "shingles"],
                )

    return docs.mapInArrow(common.tidy(sets), "doc_id long, sig1 long, sig2 long, n_shingles long, shingles binary")


def _sets_of_classes(docs: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, shingles) of the classes of ``nodes``, each from the row that represents it."""
    wanted = common.written(classes.join(nodes, "node", "left_semi").withColumnRenamed("rep", "doc_id"), "wanted")
    sets = _sets_of(docs, wanted.select("doc_id").distinct())
    return sets.join(wanted, ["doc_id", *_SIGNATURE]).select("node", "shingles").dropDuplicates(["node"])


def chance_agreement(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of two unrelated sets of ``n`` and ``m`` shingles agree.

    Within one count of leading zeros the mantissas agree by chance once in 2**MANTISSA_BITS.
    """
    level = np.arange(40)[None, :]

    def shares(count):
        load = np.maximum(count[:, None] / REGISTERS, 1.0)
        return (1 - 0.5 ** (level + 1)) ** load - (1 - 0.5**level) ** load

    return (shares(n) * shares(m)).sum(axis=1) / 2**MANTISSA_BITS


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimate of register rows ``a`` and ``b``, corrected for chance agreement."""
    chance = chance_agreement(n.astype(float), m.astype(float))
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _promising(limit: float):
    """Keeps the pairs (a, b, na, nb, ra, rb) whose estimate is near the limit or above, and all with a small set."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                na, nb = (batch.column(i).to_numpy() for i in (2, 3))
                near = estimate(_matrix(batch.column(4)), _matrix(batch.column(5)), na, nb) >= limit - MARGIN
                near |= np.minimum(na, nb) < SMALL
                near &= np.minimum(na, nb) >= limit * np.maximum(na, nb) - 1e-9
                yield batch.select([0, 1]).filter(pa.array(near))

    return pairs


def _confirmed(limit: float):
    """Keeps the pairs (a, b, sa, sb) whose whole sets reach the limit."""
    share = round(100 * limit)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both > 0 and 100 * both >= share * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs


def _verified(pairs: DataFrame, reps: DataFrame, classes: DataFrame, docs: DataFrame, limit: float) -> DataFrame:
    """The pairs (a, b) of classes that are linked."""
    side = reps.select("node", "n_shingles", "registers")
    joined = (
        pairs.join(side.toDF("a", "na", "ra"), "a").join(side.toDF("b", "nb", "rb"), "b").select("a", "b", "na", "nb", "ra", "rb")
    )
    near = common.written(joined.mapInArrow(common.tidy(_promising(limit)), "a long, b long"), "near-pairs")
    nodes = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = common.written(_sets_of_classes(docs, nodes, classes), "sets")
    whole = near.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    found = common.written(whole.mapInArrow(common.tidy(_confirmed(limit)), "a long, b long").distinct(), "links")
    common.dropped(near)
    common.dropped(sets)
    return found


def _rest(limit: float):
    """Links of one cell (two blocks of a group) that connect what isn't connected yet.

    Pairs are verified on their whole sets, most promising first (those with a small set have no estimate but their
    similarity); a pair that earlier ones have connected is left out,
    so a cell gives fewer links than it has members.
    """
    share = round(100 * limit)

    def cell(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        left, right = key[-2].as_py(), key[-1].as_py()
        ids, comp, n, block = (rows.column(c).to_numpy() for c in ("rep", "component", "n_shingles", "block"))
        regs = _matrix(rows.column("registers").combine_chunks())
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        # All that a set below SMALL can be linked with, their shingles numbered and in one run.
        held = np.array([len(s) for s in sets])
        few = np.flatnonzero((held > 0) & (held * share < 100 * SMALL))
        first = np.cumsum(held[few]) - held[few]
        codes = np.unique(np.concatenate([sets[k] for k in few]), return_inverse=True)[1] if len(few) else np.zeros(0, int)
        at = np.full(len(sets), -1)
        at[few] = np.arange(len(few))

        def shared(i: int, j: np.ndarray) -> np.ndarray:
            mark = np.zeros(len(codes), np.int64)
            mark[codes[first[at[i]] : first[at[i]] + held[i]]] = 1
            return np.add.reduceat(mark[codes], first)[at[j]]

        x, y = np.flatnonzero(block == left), np.flatnonzero(block == right)
        found = []
        for i in x.tolist():
            j = y[comp[y] != comp[i]]
            j = j[j > i] if left == right else j
            j = j[np.minimum(n[j], n[i]) * 100 >= share * np.maximum(n[j], n[i])]
            if len(j):
                guess = estimate(regs[j], regs[i][None, :], n[j], np.full(len(j), n[i]))
                small = (np.minimum(n[j], n[i]) < SMALL) & (at[j] >= 0) & (at[i] >= 0)
                if small.any():
                    both = shared(i, j[small])
                    guess[small] = both / (held[i] + held[j[small]] - both)
                near = guess >= np.where(small, limit - 1e-9, limit - MARGIN)
                found.append((guess[near], np.full(near.sum(), i), j[near]))
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                parent[c] = c = parent.get(parent[c], parent[c])
            return c

        links = []
        if found:
            guess, i, j = (np.concatenate(f) for f in zip(*found, strict=True))
            order = np.argsort(-guess, kind="stable")
            for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
                u, v = root(int(comp[a])), root(int(comp[b]))
                if u != v:
                    both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    if 100 * both >= share * (len(sets[a]) + len(sets[b]) - both):
                        parent[max(u, v)] = min(u, v)
                        links.append((int(min(ids[a], ids[b])), int(max(ids[a], ids[b]))))
        return pa.table({"a": pa.array([p[0] for p in links], pa.int64()), "b": pa.array([p[1] for p in links], pa.int64())})

    return cell


@common.on_executors
def links(docs: DataFrame, limit: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches of all rows, the classes (sig1, sig2, n_shingles, rep, node), and verified links (a, b) that connect the nodes.

    ``docs`` has doc_id and text. A class is named by its number, its ``node``, since one id may stand for several texts; ``rep``
    is the least id among its rows. A null id is linked with nothing.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sketches = common.written(docs.mapInArrow(common.tidy(_sketch), _TEXT_SKETCH), "sketches")
    filled = sketches.where("n_shingles > 0 and doc_id is not null")
    grouped = common.written(filled.groupBy(*_SIGNATURE).agg(F.min("doc_id").alias("rep")), "grouped")
    # Numbers are given to a written table and written in their turn, so that they are the same whoever reads them.
    classes = common.written(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    reps = filled.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", *_SIGNATURE]).dropDuplicates(["node"])
    reps = common.written(reps.select("node", "n_shingles", "registers", "bands"), "representatives")
    member = reps.select("node", F.posexplode("bands").alias("band", "key"))
    place = F.xxhash64("node")
    buckets = member.groupBy("band", "key").agg(F.min_by("node", place).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    # A bucket may hold a third of all members: they are dealt over SALTS tasks, each of which gets the bucket's one row.
    salt = F.pmod(place, F.lit(SALTS)).cast("int").alias("salt")
    dealt = buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    shared = common.written(member.select("*", salt).join(dealt, ["band", "key", "salt"]).drop("salt"), "buckets")
    stars = shared.where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    first = _verified(stars, reps, classes, docs, limit)

    # Buckets of three or more that the first round has not made one component.
    label = components(first.toDF("u", "v"))
    labelled = shared.where("size > 2").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sides = labelled.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    open_ = sides.select("band", "key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    left = common.written(labelled.select("*", salt).join(open_, ["band", "key", "salt"], "left_semi").drop("salt"), "open")
    # A document shares most of its open buckets with the same others: they are compared once, as one group, unless
    # the group has grown far beyond its buckets.
    group = components(left.select(F.col("node").alias("u"), F.col("hub").alias("v"))).toDF("node", "group")
    size = group.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    small = group.join(size.where(F.col("n") <= GROUP), "group").select("node", "group", "n")
    wide = left.join(small.select("node"), "node", "left_anti")
    member = small.select(F.xxhash64(F.lit(1), "group").alias("group"), "node", "n").union(
        wide.select(F.xxhash64(F.lit(2), "band", "key").alias("group"), "node", F.col("size").alias("n"))
    )
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    member = common.written(
        member.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .join(left.select("node", "component").distinct(), "node"),
        "members",
    )
    sets = _sets_of_classes(docs, member.select("node").distinct(), classes)
    cells = (
        member.join(reps.select("node", "n_shingles", "registers"), "node")
        .join(sets, "node")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("left", F.least("block", "other"))
        .withColumn("right", F.greatest("block", "other"))
        .withColumnRenamed("node", "rep")
    )
    second = common.written(cells.groupBy("group", "left", "right").applyInArrow(_rest(limit), "a long, b long"), "more-links")
    for stage in (grouped, reps, shared, left, member):
        common.dropped(stage)
    return sketches, classes, first.union(second).distinct()


def _labelled(sketches: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the least id of the rows whose classes are connected by ``found``.

    Rows without words or id are their own component.
    """
    label = components(found.toDF("u", "v"))
    named = classes.join(label, "node", "left")
    # Classes without a link are done; of the others a component may hold very many, so it is dealt over SALTS tasks.
    linked = named.where("component is not null").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    dealt = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    by_class = linked.join(dealt, ["component", "salt"]).select(*_SIGNATURE, "component_id").union(
        named.where("component is null").select(*_SIGNATURE, "rep")
    )
    rows = sketches.join(by_class, _SIGNATURE, "left")
    own = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return rows.select(
        "doc_id", "n_shingles", "sig1", "sig2", F.when(own, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def near_duplicates(docs: DataFrame, limit: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text and any other columns).

    Repeated rows stay repeated; an id that occurs with several texts is one document, which links what they are linked with, so its
    rows share a component. Blank texts without another row of their id and null ids are their own component (null for a null id, which is kept).
    """
    sketches, classes, found = links(docs, limit)
    # The classes of one id are linked with the least of them. Nearly all ids have one class and send nothing on.
    held = sketches.where("n_shingles > 0 and doc_id is not null").join(classes.select(*_SIGNATURE, "node"), _SIGNATURE).select("doc_id", "node")
    least = held.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("most")).where("u <> most").select("doc_id", "u")
    same = held.join(least, "doc_id").where("node <> u").select("u", F.col("node").alias("v"))
    rows = _labelled(sketches, classes, common.written(found.toDF("u", "v").union(same).distinct(), "all-links"))
    # A blank text of an id that has others belongs to their component.
    filled = rows.where("n_shingles > 0 and doc_id is not null").select("doc_id", F.col("component_id").alias("other"))
    blank = rows.where("n_shingles = 0 and doc_id is not null").select("doc_id").distinct()
    other = filled.join(blank, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("other").alias("other"))
    rows = rows.join(other, "doc_id", "left").withColumn("component_id", F.coalesce("other", "component_id"))
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@common.on_executors
def deduplicated(docs: DataFrame, limit: float = 0.8) -> DataFrame:
    """Rows of ``docs`` that are kept: of each group of near copies those of the least id. Columns stay as they are.

    Here a text counts for itself, whatever other texts its id has: a row goes only if its group keeps a row of a smaller id. Rows
    with blank texts or null ids stay.
    """
    names = list(docs.columns)
    sketches, classes, found = links(docs, limit)
    # Not made distinct here: the join with a class of very many rows can be split then.
    gone = _labelled(sketches, classes, found).where("doc_id <> component_id").select("doc_id", *_SIGNATURE)
    # Texts are sketched again only for ids that lose a row and occur with several sets; all others go by their id.
    several = sketches.where("doc_id is not null").groupBy("doc_id").agg(
        F.min(F.xxhash64(*_SIGNATURE)).alias("lo"), F.max(F.xxhash64(*_SIGNATURE)).alias("hi")
    ).where("lo <> hi").select("doc_id")
    plain = gone.join(several, "doc_id", "left_anti").select("doc_id").distinct()
    mixed = common.written(gone.join(several, "doc_id", "left_semi"), "mixed")
    rest = docs.join(plain, "doc_id", "left_anti")
    if not mixed.isEmpty():
        ids = mixed.select("doc_id").distinct()
        doubtful = rest.join(ids, "doc_id", "left_semi").select(*names)
        keyed = doubtful.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
        signed = keyed.mapInArrow(common.tidy(_signed), f"row {doubtful.select(F.struct(*names).alias('r')).schema['r'].dataType.simpleString()}, doc_id long, sig1 long, sig2 long, n_shingles long")
        kept = signed.join(mixed, ["doc_id", *_SIGNATURE], "left_anti").select("row.*")
        rest = rest.join(ids, "doc_id", "left_anti").select(*names).union(kept.select(*names))
    return rest.select(*names)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, doc_id, text) with the signature of their text in its place."""
    for batch in batches:
        for part in common.slices(batch, 2):
            sets = shingle_sets(common.filled_binary(part.column(2)))
            sums = np.array([_signature(s) for s in sets], np.int64).reshape(-1, 2)
            columns = [part.column(0), part.column(1), *[pa.array(sums[:, i]) for i in (0, 1)], pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", *_SIGNATURE])
