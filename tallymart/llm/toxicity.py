"""Toxicity by subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its hashed character n-grams, so an unseen misspelling shares most
of its vector with the word. A window of ``WINDOW`` words is the mean of its words' vectors; a linear softmax scores
it. A document's score is that of its worst window, so a long text doesn't thin out one insult. In training a toxic
document is represented by its worst window under the model so far, a clean one by its worst and by others drawn anew
in each pass.

The classifier is fitted on a bounded sample: about ``SAMPLE_BYTES`` of text and at most some ``SAMPLE_ROWS`` rows for each label, in one task, so that the
driver only holds what a score needs, a number for each bucket. Scores come from whole texts. A text that is null, empty or without words scores ``EMPTY_SCORE``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm import common
from tallymart.llm.subwords import fold, ngram_buckets, word_totals

SAMPLE_BYTES, SAMPLE_ROWS = 16 << 20, 500_000
WINDOW = 4
LEAST, MOST = 3, 6
BUCKETS, DIMENSIONS = 1 << 20, 8
PASSES, STEPS, BATCH, RATE = 14, 60, 512, 0.5
EMPTY_SCORE = 0.0


class Model(NamedTuple):
    embeddings: np.ndarray  # (BUCKETS, DIMENSIONS)
    output: np.ndarray  # (DIMENSIONS, 2)
    bias: np.ndarray  # (2,)


class Scorer(NamedTuple):
    margins: np.ndarray  # per bucket what it adds to the margin of toxic over clean
    bias: float


class _Bag(NamedTuple):
    words: common.Coded
    window: np.ndarray  # per word the window it is in (32 bits)
    document: np.ndarray  # per window its document
    length: np.ndarray  # per window its words


def _bag(texts: pa.Array) -> _Bag:
    words = common.coded_words(texts, common.ALNUM)
    counts = np.diff(words.starts)
    windows = -(-counts // WINDOW)
    first = np.concatenate(([0], np.cumsum(windows)))
    # Every window but the last of its document is full, so windows follow from the counts alone.
    length = np.full(first[-1], WINDOW, np.int32)
    some = counts > 0
    length[first[1:][some] - 1] = counts[some] - (windows[some] - 1) * WINDOW
    window = np.repeat(np.arange(first[-1], dtype=np.int32), length)
    return _Bag(words, window, np.repeat(np.arange(len(counts), dtype=np.int32), windows), length)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: pa.Array, labels: np.ndarray, seed: int = 5) -> Model:
    """Fits embeddings and softmax to texts (binary) with labels 0 or 1."""
    rng = np.random.default_rng(seed)
    start = (rng.random((BUCKETS, DIMENSIONS), np.float32) - np.float32(0.5)) / np.float32(DIMENSIONS)
    model = Model(start, rng.normal(0, 0.3, (DIMENSIONS, 2)), np.zeros(2))
    bag = _bag(texts)
    if not len(bag.document) or len(np.unique(labels)) < 2:
        rate = float(np.mean(labels)) if len(labels) else 0.0
        return Model(model.embeddings, np.zeros((DIMENSIONS, 2)), np.log([1 - rate + 1e-6, rate + 1e-6]))
    codes, window = bag.words.codes, bag.window
    grams, per_word = ngram_buckets(bag.words.distinct, LEAST, MOST, BUCKETS)
    gram_at = np.concatenate(([0], np.cumsum(per_word)))
    word_at = np.searchsorted(window, np.arange(len(bag.document) + 1))
    toxic = labels[bag.document] == 1
    clean = np.flatnonzero(~toxic)
    positives = int((np.unique(bag.document[toxic])).size)
    squares = [np.full(x.shape, 1e-3, x.dtype) for x in model]

    def worst():
        """The window of each document that the model thinks most toxic."""
        margin = common.segment_sums(window_margins(model)[grams, 0], gram_at) / np.maximum(per_word, 1)
        score = np.bincount(window, margin[codes], len(bag.document)) / bag.length
        order = np.lexsort((score, bag.document))
        return order[np.append(np.diff(bag.document[order]) > 0, True)]

    def step(rows: np.ndarray):
        lengths = word_at[rows + 1] - word_at[rows]
        own = np.repeat(np.arange(len(rows)), lengths)
        place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(word_at[rows], lengths)
        word = codes[place]
        many = per_word[word]
        gram = grams[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(gram_at[word], many)]
        share = np.repeat(1.0 / (np.maximum(many, 1) * lengths[own]), many)
        line = np.repeat(own, many)
        hidden = np.stack([np.bincount(line, model.embeddings[gram, d] * share, len(rows)) for d in range(DIMENSIONS)], axis=1)
        error = _softmax(hidden @ model.output + model.bias)
        error[np.arange(len(rows)), toxic[rows].astype(int)] -= 1
        weight = np.where(toxic[rows], 0.5 / max(1, toxic[rows].sum()), 0.5 / max(1, (~toxic[rows]).sum())) * len(rows)
        error *= weight[:, None]
        back = error @ model.output.T
        used, inverse = np.unique(gram, return_inverse=True)
        slope = np.stack([np.bincount(inverse, back[line, d] * share, len(used)) for d in range(DIMENSIONS)], axis=1)
        squares[0][used] += slope**2
        model.embeddings[used] -= RATE * slope / np.sqrt(squares[0][used])
        for k, g in ((1, hidden.T @ error / len(rows)), (2, error.mean(axis=0))):
            squares[k] += g**2
            model[k][...] -= RATE * g / np.sqrt(squares[k])

    # Every pass makes ``STEPS`` steps at least, so that few labels are learnt as well.
    for turn in range(PASSES):
        if turn < 2:  # no notion of the worst yet: any window stands for its document
            rows = np.concatenate((np.flatnonzero(toxic), rng.choice(clean, min(len(clean), int(toxic.sum())), replace=False)))
        else:
            top = worst()
            rows = np.concatenate((top, rng.choice(clean, min(len(clean), 2 * positives + BATCH), replace=False)))
        rng.shuffle(rows)
        size = min(BATCH, -(-len(rows) // STEPS))
        for at in range(0, len(rows), size):
            step(rows[at : at + size])
    return model


def window_margins(model: Model) -> np.ndarray:
    """Per bucket the margin of toxic over clean that it adds: all a score needs of the embeddings."""
    return (model.embeddings @ (model.output[:, 1] - model.output[:, 0]))[:, None].astype(np.float32)


def scores(texts: pa.Array, margins: np.ndarray, bias: float) -> np.ndarray:
    """Each text's probability of the toxic class."""
    bag = _bag(texts)
    out = np.full(len(texts), EMPTY_SCORE)
    if len(bag.document):
        sums, counts = word_totals(bag.words.distinct, margins, LEAST, MOST)
        margin = sums[:, 0] / np.maximum(counts, 1)
        window = np.bincount(bag.window, margin[bag.words.codes], len(bag.document)) / bag.length
        firsts = np.flatnonzero(np.append(True, np.diff(bag.document) > 0))
        best = np.maximum.reduceat(window, firsts)
        out[bag.document[firsts]] = 1 / (1 + np.exp(-np.clip(best + bias, -60, 60)))
    return out


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = pa.Table.from_batches(batches, schema=_SAMPLE).sort_by([("doc_id", "ascending"), ("text", "ascending")])
    texts = pa.concat_arrays([c.cast(pa.binary()) for c in held.column("text").chunks] or [pa.array([], pa.binary())])
    model = train(texts, held.column("label").to_numpy())
    margins = window_margins(model)[:, 0].tobytes()
    yield pa.RecordBatch.from_arrays([pa.array([margins], pa.binary()), pa.array([float(model.bias[1] - model.bias[0])])], names=["margins", "bias"])


_SAMPLE = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("label", pa.int32())])


@common.on_executors
def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """What scores need, learnt from the labelled rows (doc_id, toxic) whose crc32(doc_id) modulo 3 is not 1."""
    known = labels.where("toxic is not null and doc_id is not null").where(fold(F.col("doc_id"), 3) != 1)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # Labelled ids are chosen by number and the average size of a text, so that texts are never shuffled to the labels.
    count, held = rows.agg(F.count(F.lit(1)), F.sum(F.length("text") + 1)).first()
    most = min(SAMPLE_ROWS, SAMPLE_BYTES * (count or 0) / (held or 1))
    place = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for row in known.groupBy("label").count().collect():
        share = F.when(F.col("label") == row["label"], F.lit(min(1.0, most / row["count"]))).otherwise(share)
    # Some SAMPLE_ROWS ids of each label at most are broadcast.
    sample = rows.join(F.broadcast(known.where(place < share)), "doc_id").select("doc_id", "text", "label")
    sample = common.written(sample, "sample")
    row = sample.repartition(1).mapInArrow(common.tidy(_trained), "margins binary, bias double").first()
    common.dropped(sample)
    return Scorer(np.frombuffer(row["margins"], np.float32)[:, None], row["bias"])


def _scored(model: Scorer, keep_below: float | None, text_at: int):
    """Adds a last column with the score, or keeps the rows that score less."""
    margins, bias = model

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, text_at):
                score = scores(common.filled_binary(part.column(text_at)), margins, bias)
                if keep_below is not None:
                    yield part.filter(pa.array(score < keep_below))
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], names=["doc_id", "score"])

    return rows


@common.on_executors
def toxicity(docs: DataFrame, model: Scorer, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text, other columns). A null id isn't held out."""
    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = pairs.mapInArrow(common.tidy(_scored(model, None, 1)), "doc_id long, score double")
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@common.on_executors
def without_toxic(docs: DataFrame, model: Scorer, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score less than ``threshold``, columns as they are."""
    return docs.mapInArrow(common.tidy(_scored(model, threshold, docs.columns.index("text"))), docs.schema)
