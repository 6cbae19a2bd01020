"""Quality classifier: supervised subword embeddings.

Every document becomes the average of learned vectors of its features: its
words, its character n-grams of 3 and 4 bytes (inside words, the neighbouring
separator included), its pairs of a word with itself (one feature, whatever
the word) and one end feature, all hashed into ``buckets`` vectors
of ``dim`` numbers. A softmax over the two labels follows. Both layers are
trained by plain stochastic gradient descent in NumPy.

The training rows are a bounded sample: for each label the ``per_label``
labelled documents with the smallest id hash (a parameter, the same at every
input size). Only their features, at most ``buckets`` per document, reach the
driver, where the small model is trained. Scoring reads every whole text in
one narrow pass: as both layers are linear, the trained vectors fold into one
number per bucket (the margin between the labels), which is what the tasks
receive (4 bytes x ``buckets``).

Defined results: null or empty text has only the end feature and gets a score
like any other; labels with nulls, or with different values for one id, are
not used; without labelled rows all scores are 0.5; repeated rows get the same
score; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardforge.llm.common import prepared, text_or_empty
from shardforge.llm.textarrays import SPACE, U, find_words, hash_words, mix, raw_bytes, slices, string_array

NGRAMS = (3, 4)
REPEAT = U(1)   # any word pair of a word with itself


def features(arr: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every feature of a run of strings."""
    data, offs = raw_bytes(arr)
    n = len(arr)
    lens = np.diff(offs)
    starts, ends, woff = find_words(data, offs)
    words, word_row = hash_words(data, starts, ends), np.repeat(np.arange(n), np.diff(woff))
    again = np.flatnonzero((words[1:] == words[:-1]) & (word_row[1:] == word_row[:-1]))
    rows = [np.arange(n), word_row, word_row[again]]
    ids = [np.zeros(n, U), words, np.full(len(again), REPEAT, U)]
    # one separator before each text, one at the end, every separator a space
    pad = np.full(len(data) + n + 1, 32, np.uint8)
    pad[np.arange(len(data)) + np.repeat(np.arange(n) + 1, lens)] = data
    pad[SPACE[pad]] = 32
    owner = np.repeat(np.arange(n), lens + 1)
    word = pad != 32
    wide = pad.astype(U)
    for k in NGRAMS:
        m = len(pad) - k + 1
        if m <= 0:
            continue
        ok = np.ones(m, bool)
        gram = np.zeros(m, U)
        for j in range(k):
            gram |= wide[j:j + m] << U(8 * j)
            if 0 < j < k - 1:
                ok &= word[j:j + m]
        at = np.flatnonzero(ok)
        rows.append(owner[at])
        ids.append(mix(gram[at] + U(k << 56)))
    row, h = np.concatenate(rows), np.concatenate(ids)
    return row, (h % U(buckets)).astype(np.int64)


def _bags(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(0)
            for lo, part in slices(string_array(batch.column(1)), 1 << 18):
                row, bucket = features(part, buckets)
                key, count = np.unique(row * buckets + bucket, return_counts=True)
                cut = np.searchsorted(key, np.arange(len(part) + 1) * buckets)
                yield pa.RecordBatch.from_arrays([
                    labels.slice(lo, len(part)),
                    pa.array([(key[a:b] % buckets).tolist() for a, b in zip(cut, cut[1:])], pa.list_(pa.int32())),
                    pa.array([count[a:b].tolist() for a, b in zip(cut, cut[1:])], pa.list_(pa.int32())),
                ], names=["label", "bucket", "times"])
    return run


def train(bags: list[tuple[int, np.ndarray, np.ndarray]], buckets: int, dim: int = 16, epochs: int = 6,
          rate: float = 0.5, seed: int = 7) -> np.ndarray:
    """Margin of label 1 over label 0 per bucket, from SGD on the embeddings
    (E) and the output layer (W)."""
    rng = np.random.default_rng(seed)
    if not bags:
        return np.zeros(buckets, np.float32)
    E = rng.uniform(-1.0 / dim, 1.0 / dim, (buckets, dim)).astype(np.float32)
    W = np.zeros((dim, 2), np.float32)
    docs = [(y, b, (t / t.sum()).astype(np.float32)) for y, b, t in bags]
    steps, total = 0, epochs * len(docs)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            y, b, share = docs[i]
            lr = rate * (1.0 - steps / total)
            steps += 1
            h = share @ E[b]
            z = h @ W
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1.0
            back = W @ p
            W -= lr * np.outer(h, p)
            # the averaging factor is folded into the step, as is usual for
            # averaged embeddings; otherwise rare features would hardly move
            E[b] -= (lr * share * len(b))[:, None] * back[None, :] * 0.1
    return (E @ (W[:, 1] - W[:, 0])).astype(np.float32)


def _score(margin: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, part in slices(string_array(batch.column(1))):
                row, bucket = features(part, len(margin))
                z = np.bincount(row, weights=margin[bucket], minlength=len(part)) / np.bincount(row, minlength=len(part))
                out[lo:lo + len(part)] = 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])
    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int, id_col: str, label_col: str, text_col: str) -> DataFrame:
    """label, text of the bounded training sample. At most 2 * per_label ids
    are broadcast to the scan of the documents."""
    clean = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("l_id"))
             .agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("other"))
             .where("label = other"))
    order = [F.xxhash64("l_id"), F.col("l_id")]
    ids = None
    for y in (0, 1):
        part = clean.where(F.col("label") == y).orderBy(*order).limit(per_label).select("l_id", "label")
        ids = part if ids is None else ids.unionByName(part)
    slim = docs.select(F.col(id_col).alias("d_id"), text_or_empty(F.col(text_col)).alias("text"))
    return slim.join(F.broadcast(ids), F.col("d_id") == F.col("l_id")).select("label", "text")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
                   text_col: str = "text", per_label: int = 1500, buckets: int = 1 << 17, dim: int = 16,
                   epochs: int = 6) -> DataFrame:
    """doc_id, score for every document; ``labels`` are the rows that may be
    learned from."""
    prepared(docs.sparkSession)
    sample = labelled_sample(docs, labels, per_label, id_col, label_col, text_col)
    rows = sample.mapInArrow(_bags(buckets), "label int, bucket array<int>, times array<int>").toArrow()
    bags = [(y, np.asarray(b, np.int64), np.asarray(t, np.float64)) for y, b, t in
            zip(rows["label"].to_pylist(), rows["bucket"].to_numpy(zero_copy_only=False), rows["times"].to_numpy(zero_copy_only=False))]
    bags.sort(key=lambda x: (x[0], len(x[1]), x[1].tobytes(), x[2].tobytes()))
    margin = train(bags, buckets, dim, epochs)
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    return base.mapInArrow(_score(margin), "doc_id bigint, score double")
