"""Token files: documents as ids of a public tokenizer, compressed by a grammar for each block.

Documents are dealt by ranges of doc_id (null first), so the files' order is the order of ids, and each task encodes
its range and writes blocks of about ``BLOCK_TOKENS`` ids: a row with the counts and a binary payload (see grammar). A
block knows its place among its task's ids; where a task's ids begin follows from the sums of the tasks before it.

A text is cut into pieces where the tokenizer's own pattern always begins a new match: before a space between two
characters that aren't white space, around a line feed between two such, and between an ASCII letter and an ASCII sign
after it; never inside an added token. So pieces encode alone as they do in the text. Each distinct piece is encoded
once for a slice of documents (and kept for later ones and later tasks of the worker; beyond ``CACHED_PIECES`` those that were met again), many in one string.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymart.llm import common, grammar

BLOCK_TOKENS = 1 << 20
CACHED_PIECES, PIECES_AT_ONCE, GROUPS_AT_ONCE = 250_000, 500, 32
END_ID = 2

_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
#: Bytes that may be, or belong to, white space.
_ENDS = np.zeros(256, bool)
_ENDS[[*range(33), 127, *range(0x80, 0xC0), 0xC2, 0xE1, 0xE2, 0xE3]] = True
BLOCKS = "part int, block int, start_in_part long, n_tokens long, n_documents long, payload binary"


class PieceEncoder:
    """Encodes batches of texts by distinct pieces."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.base = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.uint16 if self.base <= 65_536 else np.uint32
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.binary())
        self.flat, self.sizes = np.zeros(0, self.kind), np.zeros(0, np.int64)
        self.met = np.zeros(0, bool)  # looked up again since the last clearing

    def _clear(self) -> None:
        """Keeps the pieces that were met again; all go if those are most of them."""
        kept = self.met
        if 4 * kept.sum() > 3 * len(kept):
            return self._forget()
        self.flat = self.flat[np.repeat(kept, self.sizes)]
        self.known, self.sizes = self.known.filter(pa.array(kept)), self.sizes[kept]
        self.met = np.zeros(len(self.sizes), bool)

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Adds the ids of new pieces and returns where they are.

        A piece that is a space and a word, say, may follow any other such piece, and one without white space at either
        end may follow a line feed, so these are encoded in long strings and told apart by the ids' places.
        """
        data, offsets = common.document_bytes(pieces)
        size = np.diff(offsets)
        head, last = data[offsets[:-1]], data[offsets[1:] - 1]
        wide = data[np.maximum(offsets[1:] - 2, 0)]  # a two-byte letter ends in a byte that white space may end in as well
        closed = ~_ENDS[last] | ((last >= 0x80) & (size > 1) & (wide >= 0xC3) & (wide < 0xE0))
        second = data[np.minimum(offsets[:-1] + 1, len(data) - 1)]
        special = np.zeros(len(pieces), bool)
        for token in self.added:
            special |= pc.match_substring(pieces.cast(pa.large_binary()), token).to_numpy(zero_copy_only=False)
        spaced = (head == 32) & (size > 1) & ~_ENDS[second] & closed & ~special
        bare = ~_ENDS[head] & closed & ~special
        kinds = [np.flatnonzero(k) for k in (spaced, bare, ~spaced & ~bare)]
        known, flat, sizes = [self.known], [self.flat], [self.sizes]
        for order, prefix, together in zip(kinds, (b"", b"\n", b""), (PIECES_AT_ONCE, PIECES_AT_ONCE, 1), strict=True):
            own = pieces.take(pa.array(order))
            for i in range(0, len(own), together * GROUPS_AT_ONCE):
                part = own.slice(i, together * GROUPS_AT_ONCE)
                ids, counts = self._group(part, prefix, together)
                known.append(part)
                flat.append(ids)
                sizes.append(counts)
        place = np.empty(len(pieces), np.int64)
        place[np.concatenate(kinds)] = np.arange(len(self.known), len(self.known) + len(pieces))
        self.known, self.flat, self.sizes = pa.concat_arrays(known), np.concatenate(flat), np.concatenate(sizes)
        return place

    def _group(self, pieces: pa.Array, prefix: bytes, together: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces and each one's number of ids, from strings of ``together`` pieces with ``prefix`` before each."""
        data, offsets = common.document_bytes(pieces)
        raw = data.tobytes()
        if prefix:
            raw = b"".join(prefix + p for p in pieces.to_pylist())
            offsets = offsets + np.arange(len(offsets)) * len(prefix)
        chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))[offsets]
        edges = [*range(0, len(pieces), together), len(pieces)]
        texts = [raw[offsets[a] : offsets[b]].decode("utf-8", "replace") for a, b in zip(edges, edges[1:], strict=False)]
        ids, counts = [], []
        for found, a, b in zip(self.tokenizer.encode_batch(texts, add_special_tokens=False), edges, edges[1:], strict=False):
            own = np.array(found.ids, self.kind)
            if together == 1:
                ids.append(own)
                counts.append(np.array([len(own)]))
                continue
            places = np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0]
            piece = np.searchsorted(chars[a : b + 1] - chars[a], places, "right") - 1
            if prefix:  # its id is the first one of every piece
                keep = np.append(False, piece[1:] == piece[:-1])
                own, piece = own[keep], piece[keep]
            ids.append(own)
            counts.append(np.bincount(piece, minlength=b - a))
        return np.concatenate(ids), np.concatenate(counts)

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where the pieces are among the known ones."""
        if len(self.known) > CACHED_PIECES:
            self._clear()
        at = pc.index_in(pieces, value_set=self.known) if len(self.known) else pa.nulls(len(pieces), pa.int32())
        out = at.fill_null(0).to_numpy().astype(np.int64)
        new = at.is_null()
        fresh = new.to_numpy(zero_copy_only=False)
        self.met[out[~fresh]] = True
        if at.null_count:
            out[fresh] = self._learn(pieces.filter(new))
            self.met = np.append(self.met, np.zeros(at.null_count, bool))
        return out

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (binary), ``end_id`` after each, and each text's number of ids."""
        data, offsets = common.document_bytes(texts)
        blank = (data <= 32) | (data == 127)
        for lead, wide in ((0xC2, 1), (0xE1, 2), (0xE2, 2), (0xE3, 2)):  # all white space beyond ASCII begins so
            at = np.flatnonzero(data == lead)
            for k in range(wide + 1):
                blank[np.minimum(at + k, len(data) - 1)] = True
        cut = np.zeros(len(data), bool)
        if len(data) > 2:
            between = ~blank[:-2] & ~blank[2:]
            feed = (data[1:-1] == 10) & between
            cut[1:-1] = ((data[1:-1] == 32) & between) | feed
            cut[2:] |= feed
            cut[1:] |= _LETTER[data[:-1]] & _SIGN[data[1:]]
            whole = data.tobytes()
            for token in self.added:
                at = whole.find(token)
                while at >= 0:
                    cut[at + 1 : at + len(token)] = False
                    at = whole.find(token, at + 1)
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        first = np.flatnonzero(cut)
        pieces = common.coded_pieces(data, None, first, offsets)
        place = self._places(pieces.distinct)
        size, flat = self.sizes[place], self.flat
        at = (np.cumsum(self.sizes) - self.sizes)[place]
        n = size[pieces.codes] if len(pieces.codes) else np.zeros(0, np.int64)
        stops = np.cumsum(n)
        total = int(stops[-1]) if len(n) else 0
        body = flat[np.repeat(at[pieces.codes] - stops + n, n) + np.arange(total)] if total else np.zeros(0, self.kind)
        ends = np.concatenate(([0], stops))[pieces.starts[1:]]
        counts = np.diff(ends, prepend=0) + 1
        return np.insert(body, ends, end_id), counts


_encoders: dict[int, PieceEncoder] = {}


def _encoder(tokenizer_json: str) -> PieceEncoder:
    """This worker process's encoder for the tokenizer: what one task has learnt serves the next."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = PieceEncoder(tokenizer_json)
    return _encoders[key]


def _blocks(shared, end_id: int, block_tokens: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        part, number, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            nonlocal number, start
            ids, counts, names, nulls = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            payload = grammar.packed(grammar.compress(ids, counts, names, nulls, encoder.base))
            row = {"part": part, "block": number, "start_in_part": start, "n_tokens": len(ids), "n_documents": len(names), "payload": payload}
            number, start = number + 1, start + len(ids)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in batches:
            for cut in common.slices(batch, 1, 2 * block_tokens):
                ids, counts = encoder.encode(common.filled_binary(cut.column(1)), end_id)
                name = cut.column(0)
                held.append((ids, counts, name.fill_null(0).to_numpy(), np.asarray(name.is_null())))
                if sum(len(h[0]) for h in held) >= block_tokens:
                    yield block()
        if held:
            yield block()

    return rows


@common.on_executors
def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes token files of all rows of ``docs`` (doc_id, text, other columns) in ascending order of doc_id below ``path``.

    A null text is empty and so holds the end id alone. Rows of one doc_id are ordered by text; null ids come first.
    ``tokenizer`` is the path of a tokenizer file.
    """
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(common.tidy(_blocks(shared, end_id, block_tokens)), BLOCKS).write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for before, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held = grammar.unpacked(payload)
            ids = grammar.Decoder(held).expand(held.symbols).astype("<u4")
            stops = np.cumsum(held.doc_tokens.astype(np.int64))
            starts = stops - held.doc_tokens
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(held.doc_ids, mask=held.doc_null), pa.array(starts + before), pa.array(held.doc_tokens.astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def _with_place(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with the number of ids before each. One row for each writing task goes through the window."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return blocks.join(parts.select("part", F.coalesce(before, F.lit(0)).alias("before")), "part").withColumn(
        "start", F.col("before") + F.col("start_in_part")
    )


@common.on_executors
def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""
    return _with_place(spark, path).select("start", "payload").mapInArrow(
        common.tidy(_documents), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for before, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held = grammar.unpacked(payload)
            decoder = grammar.Decoder(held)
            starts = np.cumsum(held.doc_tokens.astype(np.int64)) - held.doc_tokens
            for k, start in enumerate(starts.tolist()):
                ids = decoder.document(k).astype(np.int32)
                name = None if held.doc_null[k] else int(held.doc_ids[k])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name], pa.int64()), pa.array([start + before], pa.int64()), pa.array([ids], pa.list_(pa.int32()))],
                    names=["doc_id", "start", "ids"],
                )


@common.on_executors
def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start and ids of the documents, of all or of some."""
    found = _with_place(spark, path).select("start", "payload").mapInArrow(_ids, "doc_id long, start long, ids array<int>")
    return found if doc_ids is None else found.where(F.col("doc_id").isin(doc_ids))
