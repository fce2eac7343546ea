"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of learned vectors of its hash and of the hashes of its first 4, 5 and 6 bytes (so that a
compound of a known stem has a meaning). Filters over 1, 2 and 3 consecutive words are followed by the maximum over
the document and a logistic output. Everything is trained in numpy (Adagrad over minibatches) on the bounded sample of
``training.labelled_sample``. The first coordinate of each vector starts at the bucket's log-odds in the sample, and
the first one-word filter reads it, so training starts from a useful point.

``score`` never sees the language. ``fit`` also calibrates one threshold per language on a part of the sample that
training does not use; ``reject`` applies them.

Defined cases: a null or wordless text gets the score of an empty document; without usable labels every score is 0.5
and nothing is rejected; a language without enough examples uses the general threshold; repeated rows repeat; extra
columns are ignored by ``score`` and kept by ``reject``. Texts of any length are scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import training
from keelson.llm.common import (PrefixHash, bounded_batches, byte_class, enter_task, lowered_values, release_memory, string_array,
                                text_chunks, word_spans)

WIDTHS = (1, 2, 3)
FILTERS = 8
DIM = 8
WORD_BUCKETS = 1 << 17
STEM_BUCKETS = 1 << 15
STEMS = (4, 5, 6)
EPOCHS = 4
RATE = 0.05
BATCH = 32
FOLD = (4, 2)
RUN = 256                           # consecutive words kept together where a training document is thinned
_WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_VALUES = lowered_values()
TABLE_ROWS = WORD_BUCKETS + len(STEMS) * STEM_BUCKETS + 1       # the last row is zero: no such stem


def word_ids(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embedding table of each word (words x 4) and the first word of each text."""
    start, end, first = word_spans(buf, off, _WORD)
    h = PrefixHash(buf, _VALUES)
    cols = [(h.spans(start, end) % np.uint64(WORD_BUCKETS)).astype(np.int32)]
    for i, k in enumerate(STEMS):
        long = end - start > k
        stem = (h.spans(start, np.minimum(start + k, len(buf))) % np.uint64(STEM_BUCKETS)).astype(np.int32)
        cols.append(np.where(long, stem + (WORD_BUCKETS + i * STEM_BUCKETS), TABLE_ROWS - 1).astype(np.int32))
    return np.stack(cols, axis=1), first


def _thinned(ids: np.ndarray, words: int) -> np.ndarray:
    """At most ``words`` rows of a long document's ids: runs of consecutive words, spread evenly over all of it."""
    if len(ids) <= words:
        return ids
    run = min(RUN, words)
    start = np.linspace(0, len(ids) - run, words // run).astype(np.int64)
    return ids[(start[:, None] + np.arange(run)).ravel()]


def _sample_rows(words: int):
    """Word ids of each row, thinned to ``words`` words."""
    def run(batches):
        enter_task("toxicity")
        for b in batches:
            for at, buf, off in text_chunks(string_array(b, "text")):
                ids, first = word_ids(buf, off)
                rows = [_thinned(ids[x:y], words).tobytes() for x, y in zip(first, first[1:])]
                k = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, k), b.column(1).slice(at, k), b.column(2).slice(at, k), pa.array(rows, pa.binary())],
                    ["label", "lang", "pick", "ids"])
    return run


@dataclass
class ToxicityModel:
    table: np.ndarray
    kernels: list[np.ndarray]           # per width: (width, DIM, FILTERS)
    offset: np.ndarray                  # per filter
    out: np.ndarray
    bias: float
    threshold: float = 2.0
    by_lang: dict[str, float] = field(default_factory=dict)

    def pooled(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum of every filter over each text (texts x filters, 0 at least) and the padded vectors' offsets."""
        texts = len(first) - 1
        x = _padded(self.table, ids, first)
        begin = first[:-1] + np.arange(texts) * (max(WIDTHS) - 1)
        out = np.zeros((texts, FILTERS * len(WIDTHS)), np.float32)
        some = np.flatnonzero(np.diff(first) > 0)
        if len(some):
            for i, k in enumerate(self.kernels):
                y = _convolve(x, k)
                cut = np.stack([begin[some], begin[some] + np.diff(first)[some]], axis=1).ravel()
                top = np.maximum.reduceat(y, cut, axis=0)[::2]       # filters that start at a word of the text
                sl = slice(i * FILTERS, (i + 1) * FILTERS)
                out[some, sl] = np.maximum(top + self.offset[sl], 0)
        return out, begin

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(ids, first)[0].astype(np.float64) @ self.out.astype(np.float64) + self.bias


def _padded(table: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Word vectors with zero rows after each text, so that no filter spans two texts."""
    gap = max(WIDTHS) - 1
    x = np.zeros((len(ids) + gap * len(first) + 1, table.shape[1]), np.float32)
    at = np.arange(len(ids)) + gap * np.repeat(np.arange(len(first) - 1), np.diff(first))
    v = table[ids[:, 0]]
    for k in range(1, ids.shape[1]):
        v = v + table[ids[:, k]]
    x[at] = v
    return x


def _convolve(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    n = len(x) - len(kernel) + 1
    y = x[:n] @ kernel[0]
    for j in range(1, len(kernel)):
        y += x[j:j + n] @ kernel[j]
    return y


def _log_odds(data: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Smoothed log-odds of each table row by the documents that contain it."""
    counts = np.zeros((2, TABLE_ROWS))
    totals = np.ones(2)
    for ids, y in data:
        counts[y, np.unique(ids)] += 1
        totals[y] += 1
    rate = (counts + 0.5) / (totals[:, None] + 1)
    odds = np.log(rate[1] / rate[0])
    odds[counts.sum(axis=0) < 2] = 0                     # one document says little
    odds[-1] = 0
    return np.clip(odds, -4, 4) / 4


def train(rows: list, share: float, epochs: int = EPOCHS, seed: int = 3) -> ToxicityModel:
    rng = np.random.default_rng(seed)
    width = FILTERS * len(WIDTHS)
    table = rng.normal(0, 0.05, (TABLE_ROWS, DIM)).astype(np.float32)
    table[-1] = 0
    kernels = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    model = ToxicityModel(table, kernels, np.zeros(width, np.float32), rng.normal(0, 0.1, width).astype(np.float32), 0.0)
    data = [(np.frombuffer(r["ids"], np.int32).reshape(-1, 1 + len(STEMS)), r["label"], r["lang"]) for r in rows]
    if len({y for _, y, _ in data}) < 2:
        model.out[:] = 0
        return model
    fitting = [(x, y) for i, (x, y, _) in enumerate(data) if i % 5]
    if len({y for _, y in fitting}) < 2:
        fitting = [(x, y) for x, y, _ in data]
    table[:, 0] = _log_odds(fitting)
    kernels[0][0, :, 0] = 0
    kernels[0][0, 0, 0] = 1
    model.out[0] = 2
    model.bias = -1.0
    ones = sum(y for _, y in fitting) / len(fitting)
    squares = {"table": np.full(TABLE_ROWS, 1e-2, np.float32), "out": np.full(width, 1e-2, np.float32),
               "offset": np.full(width, 1e-2, np.float32), "bias": 1e-2,
               "kernels": [np.full(k.shape, 1e-2, np.float32) for k in kernels]}
    steps = max(epochs, min(40, 6000 // max(1, len(fitting))))
    for _ in range(steps):
        order = rng.permutation(len(fitting))
        for s in range(0, len(order), BATCH):
            _step(model, squares, [fitting[i] for i in order[s:s + BATCH]])
    model.bias += float(np.log(share / (1 - share)) - np.log(ones / (1 - ones))) * 0.5
    _calibrate(model, data, share)
    return model


def _step(model: ToxicityModel, squares: dict, batch: list[tuple[np.ndarray, int]]) -> None:
    ids = np.concatenate([x for x, _ in batch])
    first = np.concatenate([[0], np.cumsum([len(x) for x, _ in batch])])
    y = np.array([v for _, v in batch], np.float32)
    x = _padded(model.table, ids, first)
    gap = max(WIDTHS) - 1
    begin = first[:-1] + np.arange(len(batch)) * gap
    n_words = np.diff(first)
    pooled = np.zeros((len(batch), len(model.out)), np.float32)
    where = np.zeros(pooled.shape, np.int64)
    for i, k in enumerate(model.kernels):
        conv = _convolve(x, k)
        sl = slice(i * FILTERS, (i + 1) * FILTERS)
        for r in range(len(batch)):
            if n_words[r]:
                part = conv[begin[r]:begin[r] + n_words[r]]
                at = part.argmax(axis=0)
                where[r, sl] = at
                pooled[r, sl] = part[at, np.arange(FILTERS)] + model.offset[sl]
    live = pooled > 0
    pooled *= live
    p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.bias, -30, 30)))
    g = (p - y) / len(batch)
    back = g[:, None] * model.out[None, :] * live        # by the pooled values
    grad_out = g @ pooled + 1e-4 * model.out
    dx = np.zeros_like(x)
    for i, k in enumerate(model.kernels):
        grad = np.zeros_like(k)
        sl = slice(i * FILTERS, (i + 1) * FILTERS)
        b, w = back[:, sl], where[:, sl] + begin[:, None]
        for j in range(len(k)):
            rows = w + j
            grad[j] = np.einsum("bf,bfd->df", b, x[rows])
            np.add.at(dx, rows.ravel(), (b[:, :, None] * k[j].T[None, :, :]).reshape(-1, x.shape[1]))
        squares["kernels"][i] += grad * grad
        k -= RATE * grad / np.sqrt(squares["kernels"][i])
    grad_off = back.sum(axis=0)
    for name, value, grad in (("out", model.out, grad_out), ("offset", model.offset, grad_off)):
        squares[name] += grad * grad
        value -= RATE * grad / np.sqrt(squares[name])
    squares["bias"] += float(g.sum()) ** 2
    model.bias -= RATE * float(g.sum()) / squares["bias"] ** 0.5
    at = np.arange(len(ids)) + gap * np.repeat(np.arange(len(batch)), n_words)
    d = dx[at]
    hot = np.flatnonzero(d.any(axis=1))
    if len(hot):
        rows = ids[hot].ravel()
        step = np.repeat(d[hot], ids.shape[1], axis=0)
        np.add.at(squares["table"], rows, (step * step).mean(axis=1))
        np.add.at(model.table, rows, -RATE * step / np.sqrt(squares["table"][rows])[:, None])
        model.table[-1] = 0


def _scores(model: ToxicityModel, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.logits(ids, first), -40, 40)))


def _best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float | None:
    """The cut with the best F1 of the weighted rows, half-way to the next lower score."""
    if len(p) < 10 or y.sum() < 3 or y.sum() == len(y):
        return None
    order = np.argsort(-p, kind="stable")
    s, w = p[order], weight[order]
    hits = np.cumsum(w * y[order])
    f1 = 2 * hits / (np.cumsum(w) + hits[-1])
    f1[:-1][s[:-1] == s[1:]] = -1                        # a cut between equal scores is none
    i = int(np.argmax(f1))
    low = s[i + 1] if i + 1 < len(s) else 0.0
    return float(min(0.9, max(0.1, (s[i] + low) / 2)))


def _calibrate(model: ToxicityModel, data: list[tuple[np.ndarray, int, str | None]], share: float) -> None:
    """Thresholds from the fifth of the sample that training left out (all of it where that fifth is too small). The
    sample takes each class by itself, so its rows are weighted back to the ``share`` of label 1 in the table."""
    ones = sum(y for _, y, _ in data) / len(data)
    for part in (data[::5], data):
        ids = np.concatenate([x for x, _, _ in part])
        first = np.concatenate([[0], np.cumsum([len(x) for x, _, _ in part])])
        p, y = _scores(model, ids, first), np.array([v for _, v, _ in part])
        weight = np.where(y == 1, share / ones, (1 - share) / (1 - ones))
        general = _best_threshold(p, y, weight)
        if general is not None:
            break
    model.threshold = general if general is not None else 0.5
    langs = np.array([str(v) for _, _, v in part])
    for lang in sorted(set(langs.tolist())):
        here = langs == lang
        cut = _best_threshold(p[here], y[here], weight[here])
        if cut is not None:
            model.by_lang[lang] = cut


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: tuple[int, int] = FOLD,
        max_rows: int = training.SAMPLE_ROWS, max_bytes: int = training.SAMPLE_BYTES) -> ToxicityModel:
    """A model from at most ``max_rows`` labelled documents and ``max_bytes`` of their features (16 bytes a word). Documents of
    more than a 32nd of that are trained on evenly spread runs of their words; all are scored whole."""
    words = max(1, training.row_bytes(max_bytes) // (4 * (1 + len(STEMS))))
    rows = training.labelled_sample(docs, labels, label, fold, _sample_rows(words),
                                    "label int, lang string, pick long, ids binary", max_rows=max_rows, max_bytes=max_bytes)
    return train(rows, training.class_shares(labels, label, fold))


def _text_scores(arr: pa.Array, model: ToxicityModel) -> np.ndarray:
    out = [_scores(model, *word_ids(buf, off)) for _, buf, off in text_chunks(arr)]
    return np.concatenate(out) if out else np.empty(0)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (probability of label 1) per document. The model has a fixed size and is broadcast."""
    src = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        enter_task("toxicity")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(_text_scores(string_array(b, "text"), held.value), 6), pa.float64())],
                                             ["doc_id", "score"])
        release_memory()

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")


def reject(docs: DataFrame, model: ToxicityModel, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose score is under their language's threshold; all columns unchanged."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        enter_task("toxicity")
        m = held.value
        for b in batches:
            p = _text_scores(string_array(b, text_col), m)
            at = b.schema.get_field_index(lang_col)
            langs = b.column(at).to_pylist() if at >= 0 else [None] * len(p)
            cut = np.array([m.by_lang.get(str(x), m.threshold) for x in langs])
            yield b.filter(pa.array(p < cut, pa.bool_()))
        release_memory()

    return bounded_batches(docs).mapInArrow(run, docs.schema)
