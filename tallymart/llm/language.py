"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The n-grams (1 to 3 characters, inside words with marked ends, lower-cased) are hashed into ``BUCKETS``. The term
frequency is an n-gram's share of the text's n-grams; the document frequencies come from all training documents. The
weights are trained with follow-the-regularised-leader and elastic-net penalties on a bounded sample (about
``SAMPLE_BYTES`` of text for each language), of which a fifth is set aside to fit the temperature. Predictions come
from whole texts. A null text or one without letters is ``und`` with score 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm import common
from tallymart.llm.subwords import bounded_sample, fold, ngram_buckets, word_totals

SAMPLE_BYTES = 4 << 20
LEAST, MOST = 1, 3
BUCKETS = 1 << 14
PASSES = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 2e-4, 1e-4
ROWS_AT_ONCE = 512
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # (BUCKETS, languages), the idf multiplied in
    temperature: float


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task the number of documents that hold each bucket."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in common.slices(batch, 0):
            words = common.coded_words(common.filled_binary(part.column(0)), common.ALNUM)
            if not len(words.distinct):
                continue
            bucket, many = ngram_buckets(words.distinct, LEAST, MOST, BUCKETS)
            at = np.cumsum(many) - many
            for low in range(0, part.num_rows, ROWS_AT_ONCE):
                high = min(low + ROWS_AT_ONCE, part.num_rows)
                a, b = words.starts[low], words.starts[high]
                doc = np.repeat(np.arange(high - low), np.diff(words.starts[low : high + 1]))
                pair = np.unique(doc * len(words.distinct) + words.codes[a:b])
                doc, code = pair // len(words.distinct), pair % len(words.distinct)
                n = many[code]
                gram = bucket[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[code], n)]
                held = np.zeros((high - low, BUCKETS), bool)
                held[np.repeat(doc, n), gram] = True
                total += held.sum(axis=0)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "documents"])


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """Smoothed idf of every bucket over all rows of ``texts`` (one text column)."""
    counted = texts.mapInArrow(common.tidy(_frequencies), "bucket long, documents long").groupBy("bucket").agg(F.sum("documents").alias("documents"))
    rows = counted.toArrow()
    documents = texts.count()
    found = np.zeros(BUCKETS)
    found[rows.column("bucket").to_numpy()] = rows.column("documents").to_numpy()
    return np.log((1 + documents) / (1 + found)) + 1


def _features(texts: pa.Array, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its buckets and their TF-IDF."""
    words = common.coded_words(texts, common.ALNUM)
    if not len(words.distinct):
        return [(np.zeros(0, np.int64), np.zeros(0))] * len(texts)
    bucket, many = ngram_buckets(words.distinct, LEAST, MOST, BUCKETS)
    at = np.cumsum(many) - many
    out = []
    for a, b in zip(words.starts[:-1], words.starts[1:], strict=True):
        code, times = np.unique(words.codes[a:b], return_counts=True)
        n = many[code]
        gram = bucket[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[code], n)]
        own, where = np.unique(gram, return_inverse=True)
        count = np.bincount(where, np.repeat(times, n), len(own)) if len(own) else np.zeros(0)
        out.append((own, count / max(1.0, count.sum()) * idf[own]))
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: pa.Array, labels: list[str], idf: np.ndarray, seed: int = 3) -> Model:
    """Weights by FTRL-proximal with elastic net, then the temperature on the rows set aside."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), 1.0)
    y = np.array([languages.index(x) for x in labels])
    features = _features(texts, idf)
    z, n = np.zeros((BUCKETS, len(languages))), np.zeros((BUCKETS, len(languages)))
    rng = np.random.default_rng(seed)
    aside = rng.random(len(y)) < 0.2 if len(y) >= 50 else np.zeros(len(y), bool)

    def weights(rows):
        zr, nr = z[rows], n[rows]
        return np.where(np.abs(zr) <= L1, 0.0, (np.sign(zr) * L1 - zr) / ((BETA + np.sqrt(nr)) / ALPHA + L2))

    for _ in range(PASSES):
        for i in rng.permutation(np.flatnonzero(~aside)):
            own, value = features[i]
            if not len(own):
                continue
            w = weights(own)
            error = _softmax(value @ w)
            error[y[i]] -= 1
            slope = value[:, None] * error[None, :]
            step = (np.sqrt(n[own] + slope**2) - np.sqrt(n[own])) / ALPHA
            z[own] += slope - step * w
            n[own] += slope**2
    w = weights(slice(None))
    logits = np.array([value @ w[own] if len(own) else np.zeros(len(languages)) for own, value in features])
    held = logits[aside] if aside.any() else logits
    truth = y[aside] if aside.any() else y

    def loss(t):
        return -np.log(_softmax(held / t)[np.arange(len(truth)), truth] + 1e-300).mean()

    temperature = min(np.geomspace(0.02, 20, 121), key=loss)
    return Model(languages, w * idf[:, None], float(temperature))


@common.on_executors
def fit(docs: DataFrame) -> Model:
    """A model from the rows (doc_id, text, lang) whose crc32(doc_id) modulo 5 is not 0 and whose lang is known."""
    known = docs.where("text is not null and lang is not null and doc_id is not null").where(fold(F.col("doc_id"), 5) != 0)
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").alias("label"))
    idf = inverse_frequencies(known.select(F.col("text").cast("binary").alias("text")))
    sample = bounded_sample(known, "label", SAMPLE_BYTES).select("doc_id", F.col("text").cast("binary").alias("text"), "label")
    held = sample.toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending"), ("label", "ascending")])
    texts = held.column("text").combine_chunks()
    return train(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, held.column("label").to_pylist(), idf)


def _predicted(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 1):
                words = common.coded_words(common.filled_binary(part.column(1)), common.ALNUM)
                sums, counts = word_totals(words.distinct, model.weights, LEAST, MOST)
                total = common.segment_sums(sums[words.codes], words.starts)
                grams = common.segment_sums(counts[words.codes], words.starts)
                chance = _softmax(total / np.maximum(grams, 1)[:, None] / model.temperature)
                best = chance.argmax(axis=1)
                lettered = np.array(part.column(2).to_pylist(), bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], pa.string()),
                        pa.array(np.where(lettered, chance.max(axis=1), 0.0)),
                    ],
                    names=["doc_id", "lang_pred", "score"],
                )

    return rows


@common.on_executors
def languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row. Without any language learnt all rows are ``und``."""
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(model.languages))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", letters.alias("lettered"))
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    if not model.languages:
        return rows.select("doc_id", held.alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    found = rows.mapInArrow(common.tidy(_predicted(model)), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
