"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its different words, word stems (first ``STEMS``
characters of longer words), word pairs and pairs with one word left out, each
hashed into ``BUCKETS`` weights and present or not. Per-coordinate rates suit
features of very different frequency, and the L1 term keeps all weights at
exactly zero that the labels do not clearly ask for; what is left is a short
list of (bucket, weight), bounded by ``BUCKETS``, that every task gets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.llm.common import crc_mod, kept, slices, texts_of, trim

#: Hashed weights; index 0 is the bias.
BUCKETS = 1 << 20
STEMS = (4, 5)
#: Most labelled documents that the model is fitted on, those of the smallest hash of their id.
TRAIN_ROWS = 12_000
#: FTRL-proximal: learning rate, smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 1.0
EPOCHS = 6
#: How much a toxic example counts against a clean one, of which there are many more.
POSITIVE = 4.0
THRESHOLD = 0.7
#: Words whose hash a worker keeps.
KEPT_WORDS = 150_000
#: Odd multipliers that tell the kinds of features apart.
PAIR, SKIP, STEM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _bucket(h: np.ndarray) -> np.ndarray:
    """Buckets 1 to BUCKETS - 1 of mixed hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(24)) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1


class Words:
    """Hashes of words and their stems, computed once for each word that a worker meets."""

    def __init__(self):
        self.at: dict[bytes, int] = {}
        self.whole, self.stems = np.zeros(1024, dtype=np.uint64), np.zeros((1024, len(STEMS)), dtype=np.uint64)

    def of(self, words: list[bytes]) -> np.ndarray:
        """Where the words' hashes are."""
        if len(self.at) > KEPT_WORDS:
            self.at.clear()
        found = np.fromiter(map(self.at.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        lacking = np.flatnonzero(found < 0).tolist()
        for w in dict.fromkeys(words[i] for i in lacking):
            k = len(self.at)
            if k == len(self.whole):
                self.whole, self.stems = np.concatenate((self.whole, np.zeros_like(self.whole))), np.concatenate((self.stems, np.zeros_like(self.stems)))
            self.at[w] = k
            self.whole[k] = xxhash.xxh64_intdigest(w)
            chars = w.decode("utf-8", "replace")
            for j, n in enumerate(STEMS):
                self.stems[k, j] = xxhash.xxh64_intdigest(chars[:n], n) if len(chars) > n else 0
        found[lacking] = [self.at[words[i]] for i in lacking]
        return found


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, stem hashes (one column for each length, 0: none) and words of each text."""
    cache = kept("toxicity", Words)
    each = [t.lower().translate(None, b".,;:!?\"'()[]{}*#&%$|<>-_").split() for t in texts]
    at = cache.of([w for x in each for w in x])
    return cache.whole[at], cache.stems[at], np.fromiter(map(len, each), dtype=np.int64, count=len(each))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every different feature of each text; punctuation and A-Z case do not count."""
    whole, stems, n = _words(texts)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), n)
    parts = [(doc, _bucket(whole))]
    for j in range(stems.shape[1]):
        some = stems[:, j] > 0
        parts.append((doc[some], _bucket(stems[some, j] * STEM)))
    for gap, salt in ((1, PAIR), (2, SKIP)):
        if len(whole) > gap:
            same = doc[gap:] == doc[:-gap]
            parts.append((doc[gap:][same], _bucket((whole[:-gap][same] * salt) ^ (whole[gap:][same] + salt))))
    key = np.concatenate([d * BUCKETS + b for d, b in parts])
    key = pd.unique(key)
    return key // BUCKETS, (key % BUCKETS).astype(np.int32)


def ftrl(examples: Iterator[tuple[np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass of FTRL-proximal over (bucket list, label); changes z and n in place."""
    for at, label in examples:
        zi, ni = z[at], n[at]
        root = np.sqrt(ni)
        w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2))
        p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = (p - label) * (POSITIVE if label else 1.0)
        step = (np.sqrt(ni + g * g) - root) / ALPHA
        z[at] = zi + g - step * w
        n[at] = ni + g * g


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(((o, y, t or b"") for b in batches for o, y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.large_binary()).to_pylist())))
    # all examples in one array, each from one edge to the next
    lists, sizes = [np.zeros(0, dtype=np.int32)], [0]
    for a in range(0, len(rows), 100):
        doc, bucket = features([t for _, _, t in rows[a : a + 100]])
        n = len(rows[a : a + 100])
        order = np.argsort(doc, kind="stable")
        lists.append(bucket[order])
        sizes += np.bincount(doc, minlength=n).tolist()
    labels, edges, flat = [y for _, y, _ in rows], np.cumsum(sizes), np.concatenate(lists)
    del rows, lists
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bias = np.zeros(1, dtype=np.int32)
    for _ in range(EPOCHS):
        ftrl(((np.concatenate((bias, flat[x:y])), label) for x, y, label in zip(edges, edges[1:], labels)), z, n)
    w = weights_of(z, n)
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at])], ["bucket", "weight"])
    del flat
    trim()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Dense weights learnt from the labelled documents of the folds that are not ``held``.

    A document's fold is crc32 of its id as text, modulo ``folds``. The model
    is fitted in one task on at most ``rows`` documents, those of the smallest
    hash of their id. Null labels are left out, of an id labelled twice the
    larger label counts, of documents that share an id the least text; a null
    text is empty. Without any labelled document all weights are zero, so every score
    is 0.5.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(crc_mod("doc_id", folds) != held).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    # bounded by `rows`, and therefore fit to be sent to every task
    picked = known.select(F.xxhash64("doc_id", F.lit(7)).alias("o"), "y", F.col("doc_id").alias("l_id")).orderBy("o", "l_id").limit(rows)
    texts = docs.select(F.col("doc_id").alias("d_id"), "text").join(F.broadcast(picked), F.col("d_id") == F.col("l_id")).groupBy("l_id", "o", "y").agg(F.min("text").alias("text"))
    w = np.zeros(BUCKETS)
    for bucket, weight in texts.select("o", "y", "text").repartition(1).mapInArrow(_fit, "bucket long, weight double").collect():
        w[bucket] = weight
    return w


def scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    doc, bucket = features(texts)
    total = np.bincount(doc, weights=weights[bucket], minlength=len(texts)) + weights[0]
    return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def _broadcast(docs: DataFrame, weights: np.ndarray):
    at = np.flatnonzero(weights)
    return docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weights[at].astype(np.float64)))


def _dense(sparse) -> np.ndarray:
    w = np.zeros(BUCKETS)
    w[sparse[0]] = sparse[1]
    return w


def score(docs: DataFrame, weights: np.ndarray, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with their toxicity in [0, 1] as column ``name``, in place of any of that name.

    Null and empty texts have the bias alone; null ids and repeated rows are
    scored like any other; an empty table gives no rows.
    """
    sent = _broadcast(docs, weights)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _dense(sent.value)
        for batch in slices(batches, column=text):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(texts_of(batch, text), w))], [*batch.schema.names, name])

    return docs.mapInArrow(add, docs.select("*", F.lit(0.0).alias(name)).schema)


def reject(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; nothing is joined or shuffled.

    Null and empty texts are judged by the bias alone; repeated rows go or
    stay together; all columns are kept; an empty table gives no rows.
    """
    sent = _broadcast(docs, weights)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _dense(sent.value)
        for batch in slices(batches, column=text):
            yield batch.filter(pa.array(scores(texts_of(batch, text), w) < threshold))

    return docs.mapInArrow(clean, docs.schema)
