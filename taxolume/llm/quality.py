"""Quality classification by supervised subword embeddings.

Words and character n-grams are hashed to learned vectors; a document is the mean of the vectors of all its words
and n-grams, and a softmax over that mean gives the classes. Trained by stochastic gradient descent in numpy on a
bounded sample of labelled documents. Because the output layer is linear in the mean, scoring sums, over the whole
text, each bucket's vector already multiplied by the output layer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, releasing, utf8_slices, word_hashes, word_spans

#: Buckets for words, and as many for character n-grams.
BUCKETS = 1 << 15
#: Beyond these, the bucket of a word that follows itself, and the first of those for a text's length in words.
REPEATED, LENGTH = 2 * BUCKETS, 2 * BUCKETS + 1
#: Lengths in bytes of the character n-grams.
GRAMS = (3, 5)
#: Labelled rows that are fitted on, at most, and bytes of their texts.
SAMPLE_ROWS, SAMPLE_BYTES = 4_000, 16 << 20
#: Passes over a full sample; a smaller one is passed over until as many steps are taken.
EPOCHS = 4
DIM = 16


@dataclass
class QualityModel:
    """Vectors of the buckets, the output layer, and their product: what a bucket adds to the log odds of class 1."""

    vectors: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @property
    def odds(self) -> np.ndarray:
        return self.vectors @ (self.out[:, 1] - self.out[:, 0])


def _features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words and each n-gram length: buckets, and where each text's own begin and end in them."""
    starts, ends, counts = word_spans(data, offsets)
    words = np.concatenate([[0], np.cumsum(counts)])
    hashes = word_hashes(data, starts, ends)
    found = [((hashes >> np.uint64(49)).astype(np.int32), words[:-1], words[1:])]
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[words[:-1][counts > 0]] = False
    repeats = np.concatenate([[0], np.cumsum(again)])[words]
    found.append((np.full(repeats[-1], REPEATED, np.int32), repeats[:-1], repeats[1:]))
    each = np.arange(len(counts) + 1)
    found.append((LENGTH + np.minimum(np.log2(counts + 1), 20).astype(np.int32), each[:-1], each[1:]))
    for n in GRAMS:
        k = max(0, len(data) - n + 1)
        h = np.zeros(k, np.uint32)
        for i in range(n):
            h *= np.uint32(16777619)
            h += data[i : i + k]
        h *= np.uint32(2654435761)
        at = (h >> np.uint32(17)).astype(np.int32) + BUCKETS
        last = np.maximum(offsets[1:] - n + 1, offsets[:-1])  # none crosses into the next text
        found.append((at, np.minimum(offsets[:-1], k), np.minimum(last, k)))
    return found


def _totals(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[end] - total[begin]


def fit(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, seed: int = 5) -> QualityModel:
    """A model of a 0/1 label. Rows whose text or label is null teach nothing.

    Learns from at most `sample_rows` rows and `SAMPLE_BYTES` of text, chosen by a hash of the row; rows that agree in
    key, text and label count once. Without rows, or with one class only, the model gives the prior.
    """
    known = labelled.filter(F.col(text).isNotNull() & F.col(label).isin(0, 1)).select(key, text, label)
    return _train(bounded_sample(known, key, text, sample_rows, SAMPLE_BYTES), text, label, key, seed)


def fit_ids(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, seed: int = 5) -> QualityModel:
    """As fit, with the labels in a table of their own: they are sampled first, so only sampled texts are joined."""
    known = bounded_sample(labels.filter(F.col(label).isin(0, 1)).select(key, label), key, label, sample_rows, 1 << 40)
    joined = docs.select(key, text).filter(F.col(text).isNotNull()).join(F.broadcast(known), key)
    return _train(bounded_sample(joined, key, text, sample_rows, SAMPLE_BYTES), text, label, key, seed)


def _train(sample: DataFrame, text: str, label: str, key: str, seed: int) -> QualityModel:

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = [], []
            for _, data, offsets in utf8_slices(batch.column(1)):
                found = _features(data, offsets)
                for i in range(len(offsets) - 1):
                    own, n = np.unique(np.concatenate([f[b[i] : e[i]] for f, b, e in found]), return_counts=True)
                    ids.append(own.astype(np.int32).tobytes())
                    counts.append(n.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2).cast(pa.int32()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["key", "label", "ids", "counts"])

    rows = sorted(sample.select(F.col(key), F.col(text), F.col(label)).mapInArrow(releasing(gather), "key string, label int, ids binary, counts binary").toLocalIterator(), key=lambda r: (r["key"], r["ids"]))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (LENGTH + 21, DIM)).astype(np.float32)
    out = np.zeros((DIM, 2), np.float32)
    labels = np.array([r["label"] for r in rows], dtype=np.int64)
    share = (np.bincount(labels, minlength=2) + 1.0) / (len(rows) + 2.0)
    bias = np.log(share).astype(np.float32)
    if len(set(labels.tolist())) == 2:
        docs = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.float32)) for r in rows]
        steps = EPOCHS * max(len(docs), 3000)
        step = 0
        while step < steps:
            for i in rng.permutation(len(docs)):
                rate = np.float32(0.5 * max(0.0, 1 - step / steps))
                step += 1
                ids, n = docs[i]
                if not len(ids):
                    continue
                w = n / n.sum()
                hidden = w @ vectors[ids]
                z = hidden @ out + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                back = out @ p
                out -= rate * np.outer(hidden, p)
                bias -= np.float32(0.1) * rate * p
                vectors[ids] -= (rate * len(ids) ** 0.5) * np.outer(w, back)
    return QualityModel(vectors, out, bias)


def score(docs: DataFrame, model: QualityModel, text: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns of docs (all but text by default) with the probability of class 1, from 0 to 1.

    Every byte of every text counts. A null or empty text has no features and gets the learned prior. Repeated rows
    stay; other columns pass through untouched, but one that has the new column's name gives way to it.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if (keep is not None or c != text) and c != name]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(name, "double")
    odds, prior = model.odds.astype(np.float32), float(model.bias[1] - model.bias[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.full(batch.num_rows, prior)
            for first, data, offsets in utf8_slices(batch.column(0)):
                total, n = 0.0, 0.0
                for at, begin, end in _features(data, offsets):
                    total = total + _totals(odds[at], begin, end)
                    n = n + (end - begin)
                z[first : first + len(offsets) - 1] += total / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(1 + i) for i in range(len(keep))), pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], [*keep, name])

    return docs.select(F.col(text), *[F.col(f"`{c}`") for c in keep]).mapInArrow(releasing(run), schema)
