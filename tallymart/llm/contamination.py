"""Benchmark decontamination by a generalised suffix automaton over the words of the benchmark's items.

Words are runs of ASCII digits and letters (A-Z lower-cased) and of any bytes from 0x80 on. A window is ``WINDOW``
consecutive words of an item; an item of fewer words, but not none, is one window. Documents are streamed through the
automaton, which tells for every word the longest run ending there that occurs in some item. The run's last ``WINDOW``
words are then a window of all items that pass through that state, and a shorter item is found among the run's suffixes.

An automaton holds at most ``WORDS_PER_AUTOMATON`` words of items and is broadcast. A larger benchmark is cut by a hash
of the item into several automata; the documents then pass through one after the other, by way of written stages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.llm import common

WINDOW = 13
WORDS_PER_AUTOMATON = 200_000
SPANS = "array<struct<first: int, last: int>>"


def item_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(common.ALNUM).split()


class SuffixAutomaton:
    """All word runs of some items, with the items that hold each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.windows: dict[int, set[str]] = {}
        self.shorter: dict[int, list[tuple[int, str]]] = {}
        pairs: set[tuple[int, int]] = set()
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        for _, codes in coded:
            last = 0
            for code in codes:
                last = self._extend(last, code)
            pairs.update(zip(codes, codes[1:], strict=False))
        for name, codes in coded:
            state = 0
            for i, code in enumerate(codes):
                state = self.next[state][code]
                if i + 1 >= window:
                    self.windows.setdefault(self._cut(state, window), set()).add(name)
            if len(codes) < window:
                self.shorter.setdefault(self._cut(state, len(codes)), []).append((len(codes), name))
        self.least = min([min(len(codes), window) for _, codes in coded], default=window)
        self.pairs = np.array(sorted(a * max(1, len(self.vocabulary)) + b for a, b in pairs), np.int64)

    def _extend(self, last: int, code: int) -> int:
        """Appends one word to the item that ended in state ``last``."""
        if code in self.next[last]:
            return self._of_length(last, self.next[last][code], code)
        state = self._new({}, self.length[last] + 1)
        at = last
        while at >= 0 and code not in self.next[at]:
            self.next[at][code] = state
            at = self.link[at]
        self.link[state] = 0 if at < 0 else self._of_length(at, self.next[at][code], code)
        return state

    def _of_length(self, source: int, target: int, code: int) -> int:
        """``target``, or a copy of it that only stands for runs up to one word longer than ``source``."""
        if self.length[target] == self.length[source] + 1:
            return target
        copy = self._new(dict(self.next[target]), self.length[source] + 1)
        self.link[copy], self.link[target] = self.link[target], copy
        while source >= 0 and self.next[source].get(code) == target:
            self.next[source][code] = copy
            source = self.link[source]
        return copy

    def _new(self, following: dict[int, int], length: int) -> int:
        self.next.append(following)
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def _cut(self, state: int, words: int) -> int:
        """The state of the last ``words`` words of a run in ``state``."""
        while self.length[self.link[state]] >= words:
            state = self.link[state]
        return state

    def scan(self, codes: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit places (first, last) among known words, and the items with windows there."""
        spans, names = [], set()
        state = run = 0
        for i, code in enumerate(codes):
            while state and code not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if code not in self.next[state]:
                run = 0
                continue
            state, run = self.next[state][code], run + 1
            if run >= self.window:
                spans.append((i - self.window + 1, i))
                names |= self.windows.get(self._cut(state, self.window), set())
            if self.shorter:
                at = state
                while at > 0:
                    for n, name in self.shorter.get(at, ()):
                        if n <= run:
                            spans.append((i - n + 1, i))
                            names.add(name)
                    at = self.link[at]
        return spans, names


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def find(texts: pa.Array, automaton: SuffixAutomaton) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], set[str]]]]:
    """Words of every text, and spans and items of the texts with any."""
    words = common.coded_words(texts, common.ALNUM)
    known = np.array([automaton.vocabulary.get(w, -1) for w in words.distinct.to_pylist()], np.int64)
    codes = known[words.codes] if len(words.codes) else np.zeros(0, np.int64)
    counts, hits = np.diff(words.starts), {}
    # A run can only go on from one word to the next if the pair occurs in some item.
    document = np.repeat(np.arange(len(counts)), counts)
    pair = codes[:-1] * max(1, len(automaton.vocabulary)) + codes[1:]
    goes = (codes[:-1] >= 0) & (codes[1:] >= 0) & (document[:-1] == document[1:])
    goes[goes] = np.isin(pair[goes], automaton.pairs)
    opens = codes >= 0
    opens[1:] &= ~goes
    firsts = np.flatnonzero(opens)
    stops = np.flatnonzero((codes >= 0) & ~np.append(goes, False)[: len(codes)])
    long = stops - firsts + 1 >= automaton.least
    for a, b in zip(firsts[long].tolist(), stops[long].tolist(), strict=True):
        spans, names = automaton.scan(codes[a : b + 1].tolist())
        if spans:
            doc = int(document[a])
            at = a - int(words.starts[doc])
            held = hits.setdefault(doc, ([], set()))
            held[0].extend((x + at, y + at) for x, y in spans)
            held[1].update(names)
    return counts, hits


def _pass(shared):
    """Adds one automaton's spans and items to the rows (row, text, n_words, spans, items)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            for part in common.slices(batch, 1):
                counts, hits = find(common.filled_binary(part.column(1)), automaton)
                spans, items = [], []
                for i, (old, held) in enumerate(zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)):
                    new, names = hits.get(i, ([], set()))
                    spans.append([{"first": a, "last": b} for a, b in _merged([(s["first"], s["last"]) for s in old] + new)])
                    items.append(sorted({*held, *names}))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(spans, part.schema.field(3).type), pa.array(items, pa.list_(pa.string()))],
                    schema=part.schema,
                )

    return rows


def automata(benchmark: DataFrame, words_each: int = WORDS_PER_AUTOMATON) -> Iterator[SuffixAutomaton]:
    """One automaton after the other, each over the items of one share of the benchmark."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), F.col("text").cast("binary").alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shares = max(1, -(-size // (6 * words_each)))
    for share in range(shares):
        own = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(shares)) == share).collect() if shares > 1 else items.collect()
        yield SuffixAutomaton([(r["name"], item_words(r["text"])) for r in sorted(own, key=lambda r: (r["name"], r["text"] or b""))])


@common.on_executors
def scanned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, text, n_words, spans, items) for every row of ``docs``; ``row`` is the whole row as a struct."""
    spark = docs.sparkSession
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("text").cast("binary").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast(SPANS).alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for k, automaton in enumerate(automata(benchmark)):
        if k:
            rows = common.written(rows, "scanned")
        rows = rows.mapInArrow(common.tidy(_pass(spark.sparkContext.broadcast(automaton))), rows.schema)
    return rows


def hit_words() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def over_limits(most_words: int | None = None, share_of: int = 20) -> Column:
    """True where hit words make a ``share_of``-th of the words or more, or a span is longer than ``most_words``."""
    limit = (hit_words() > 0) & (F.lit(share_of) * hit_words() >= F.col("n_words"))
    if most_words is not None:
        limit |= F.exists("spans", lambda s: s["last"] - s["first"] + 1 > most_words)
    return limit


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items, spans and contaminated. A null text has no words."""
    return scanned(docs, benchmark).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", hit_words().alias("n_hit"), "items", "spans", over_limits().alias("contaminated")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, most_words: int | None = None) -> DataFrame:
    """The rows of ``docs`` within the limits, columns as they are."""
    return scanned(docs, benchmark).where(~over_limits(most_words)).select("row.*")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if text is not None and spans:
                one = pa.array([text], pa.binary())
                raw, _ = common.document_bytes(one)
                blank = np.frombuffer(common.ALNUM, np.uint8)[raw] == 32
                begins = np.flatnonzero(~blank & np.append(True, blank[:-1]))
                ends = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
                keep = np.ones(len(raw), bool)
                for s in spans:
                    keep[begins[s["first"]] : ends[s["last"]]] = False
                text = raw[keep].tobytes()
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), *batch.columns[2:]], schema=batch.schema)


def without_spans(docs: DataFrame, benchmark: DataFrame, most_words: int = WINDOW - 1) -> DataFrame:
    """All rows of ``docs``; spans longer than ``most_words`` are cut out of the texts."""
    rows = scanned(docs, benchmark).withColumn("spans", F.filter("spans", lambda s: s["last"] - s["first"] + 1 > most_words))
    cut = rows.mapInArrow(common.tidy(_without), rows.schema)
    return cut.select(*[F.col("text").cast("string").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
