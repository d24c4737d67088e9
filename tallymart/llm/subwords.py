"""Hashed character n-grams of words, and bounded samples of labelled documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.llm import common


def ngram_buckets(words: pa.Array, least: int, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' character n-grams (``least`` to ``most`` characters), word by word, and each word's number of them.

    A word is lower-cased and set between two marks, so beginnings and ends differ from middles.
    """
    text = b"\n".join(words.to_pylist()).decode("utf-8", "replace").lower()
    symbols = np.frombuffer(f"\n{text}\n".encode("utf-32-le"), np.uint32)
    marks = np.flatnonzero(symbols == 10)
    opens, size = marks[:-1], np.diff(marks) + 1  # a mark closes one word and opens the next
    many = [np.maximum(size - n + 1, 0) for n in range(least, most + 1)]
    counts = np.sum(many, axis=0)
    before = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int32)
    rolled = np.zeros(len(symbols), np.uint64)
    for n in range(1, most + 1):
        rolled = rolled[: len(symbols) - n + 1] * np.uint64(0x100000001B3) + symbols[n - 1 :] + np.uint64(1)
        if n >= least:
            own = many[n - least]
            inside = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            bucket = common.mix64(rolled[np.repeat(opens, own) + inside] + np.uint64(n)) % np.uint64(buckets)
            out[np.repeat(before, own) + inside] = bucket
            before = before + own
    return out, counts


def word_totals(words: pa.Array, weights: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Per word the sum of its n-grams' ``weights`` (buckets, columns), and its number of n-grams."""
    if not len(words):
        return np.zeros((0, weights.shape[1])), np.zeros(0)
    bucket, counts = ngram_buckets(words, least, most, len(weights))
    return common.segment_sums(weights[bucket], np.concatenate(([0], np.cumsum(counts)))), counts.astype(float)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def bounded_sample(labelled: DataFrame, label: str, most_bytes: int) -> DataFrame:
    """Rows (doc_id, text, label) of which each label holds about ``most_bytes`` of text at most.

    A label with more text is thinned by a hash of the row, so the sample is the same in every run.
    """
    size = F.octet_length("text") + 1
    totals = labelled.groupBy(F.col(label)).agg(F.sum(size).alias("bytes_of_label")).collect()
    share = F.lit(0.0)
    for row in totals:
        share = F.when(F.col(label) == F.lit(row[0]), F.lit(min(1.0, most_bytes / max(1, row[1] or 1)))).otherwise(share)
    place = F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    return labelled.where(place < share)
