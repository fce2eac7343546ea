"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its words (runs of non-blank bytes) and of its character n-grams
(every ``NGRAM`` consecutive bytes, blanks included), both hashed into buckets; a word that repeats the one before it
has a bucket of its own. A softmax over two classes sits on top.
It is trained by numpy gradient descent (one step per document, adaptive step size per bucket) on the bounded sample
of ``training.labelled_sample``; scoring is map-only.

For two classes the logit is linear in the averaged vector, so scoring sums one learned number per word and n-gram.

Defined cases: a null or empty text has no features and gets the bias alone, a score like any other; without usable
labels all scores are 0.5; repeated rows repeat; extra columns (lang, source, labels among them) never enter a score.
Texts of any length are scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import training
from keelson.llm.common import bounded_batches, PrefixHash, byte_class, string_array, text_chunks, word_spans

NGRAM = 3
WORD_BUCKETS = 1 << 16
NGRAM_BUCKETS = 1 << 15
REPEAT = WORD_BUCKETS + NGRAM_BUCKETS          # bucket of a word that repeats the one before it
BUCKETS = REPEAT + 1
DIM = 12
EPOCHS = 8
RATE = 0.3
FOLD = (3, 1)
_NON_BLANK = ~byte_class((0x09, 0x0D), (0x20, 0x20))


def _features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets, first word of each row, n-gram bucket by start byte, usable n-grams of each row)."""
    start, end, first = word_spans(buf, off, _NON_BLANK)
    hashes = PrefixHash(buf).spans(start, end)
    words = (hashes % np.uint64(WORD_BUCKETS)).astype(np.int64)
    again = np.zeros(len(words), bool)               # the word just before, in the same text, was the same
    again[1:] = hashes[1:] == hashes[:-1]
    again[first[:-1][first[:-1] < len(words)]] = False
    words[again] = REPEAT
    n = max(0, len(buf) - NGRAM + 1)
    v = [buf[k:k + n].astype(np.uint32) for k in range(NGRAM)]
    h = (v[0] | (v[1] << np.uint32(8)) | (v[2] << np.uint32(16))) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    grams = ((h * np.uint32(0x85EBCA77)) >> np.uint32(32 - 15)).astype(np.int64) + WORD_BUCKETS
    return words, first, grams, np.maximum(np.diff(off) - NGRAM + 1, 0)


def _sample_rows(batches):
    """Feature counts of each row: bucket ids (int32) and weights (float32) that sum to 1."""
    for b in batches:
        text = string_array(b, "text")
        for at, buf, off in text_chunks(text):
            words, first, grams, usable = _features(buf, off)
            ids, weights = [], []
            for r in range(len(off) - 1):
                u, n = np.unique(np.concatenate([words[first[r]:first[r + 1]], grams[off[r]:off[r] + usable[r]]]),
                                 return_counts=True)
                ids.append(u.astype(np.int32).tobytes())
                weights.append((n / max(1, n.sum())).astype(np.float32).tobytes())
            k = len(ids)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(at, k), b.column(1).slice(at, k), b.column(2).slice(at, k),
                 pa.array(ids, pa.binary()), pa.array(weights, pa.binary())], ["label", "lang", "pick", "ids", "weights"])


@dataclass
class QualityModel:
    weight: np.ndarray                  # one number per bucket: its vector's effect on the logit
    bias: float

    def logits(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        words, first, grams, usable = _features(buf, off)
        sums = np.zeros(len(off) - 1)
        for value, lo, hi in ((self.weight[words], first[:-1], first[1:]),
                              (self.weight[grams], off[:-1], off[:-1] + usable)):
            some = np.flatnonzero(hi > lo)
            if len(some):
                cut = np.stack([lo[some], hi[some]], axis=1).ravel()
                sums[some] += np.add.reduceat(np.append(value, 0.0), cut)[::2]
        n = np.diff(first) + usable
        return sums / np.maximum(n, 1) + self.bias


def train(rows: list, share: float, epochs: int = EPOCHS, seed: int = 5) -> QualityModel:
    """Gradient descent over the sample; the bias is moved so that scores fit the class share of the labels outside the held-out fold."""
    rng = np.random.default_rng(seed)
    size = BUCKETS
    if not rows or len({r["label"] for r in rows}) < 2:
        return QualityModel(np.zeros(size), 0.0)
    vec = rng.normal(0, 0.1, (size, DIM)).astype(np.float32)
    seen = np.full(size, 1e-3, np.float32)              # sum of squared gradients of each bucket
    out = rng.normal(0, 0.5, (2, DIM)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    data = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["weights"], np.float32), r["label"]) for r in rows]
    ones = sum(y for _, _, y in data) / len(data)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for i in rng.permutation(len(data)):
            ids, w, y = data[i]
            doc = w @ vec[ids] if len(ids) else np.zeros(DIM, np.float32)
            z = out @ doc + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1                                    # gradient of the loss by the logits
            back = p @ out
            out -= 0.1 * rate * p[:, None] * doc[None, :]
            bias -= 0.05 * rate * p
            if len(ids):
                scaled = np.sqrt(w)                      # between one step per document and one per feature
                seen[ids] += (scaled * scaled) * float(back @ back)
                vec[ids] -= (rate * scaled / np.sqrt(seen[ids]))[:, None] * back[None, :]
    shift = np.log(share / (1 - share)) - np.log(ones / (1 - ones))
    return QualityModel(vec.astype(np.float64) @ (out[1] - out[0]).astype(np.float64),
                        float(bias[1] - bias[0]) + 0.5 * float(shift))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: tuple[int, int] = FOLD,
        max_rows: int = training.SAMPLE_ROWS, max_bytes: int = training.SAMPLE_BYTES) -> QualityModel:
    """A model from at most ``max_rows`` labelled documents and ``max_bytes`` of their features (8 bytes a distinct bucket: a
    document of any length takes less than a 32nd of the default; with a smaller bound, longer ones are left out)."""
    rows = training.labelled_sample(docs, labels, label, fold, _sample_rows,
                                    "label int, lang string, pick long, ids binary, weights binary", max_rows=max_rows,
                                    max_bytes=max_bytes)
    return train(rows, training.class_shares(labels, label, fold))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (probability of label 1) per document. The model has a fixed size and is broadcast."""
    src = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for at, buf, off in text_chunks(string_array(b, "text")):
                z = np.clip(held.value.logits(buf, off), -40, 40)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(z)), pa.array(1 / (1 + np.exp(-z)))],
                                                 ["doc_id", "score"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")
