"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. Each byte has a learned vector; learned
filters run over windows of bytes, and each filter's largest response in a chunk is kept. The chunks' responses
are averaged over the document and combined into one probability, that a rater marks it as good.

Training reads a bounded sample of labelled rows: ``PER_CLASS`` of each label, each of ``MAX_BYTES`` bytes at most,
weighted to the labels' true shares. Scoring reads every whole text. Defined cases: a null text is empty, an empty
text is one blank chunk; without labelled rows the score is 0.5; with one label only, training still runs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_batches, remainder_of_id, utf8

PER_CLASS, MAX_BYTES, EPOCHS, STEPS, MINIBATCH, RATE = 2000, 12_000, 8, 300, 32, 0.01
CHUNK, HOP, WINDOW, STRIDE, VECTOR, FILTERS = 256, 192, 8, 2, 8, 32
PLACES = (CHUNK - WINDOW) // STRIDE + 1
PREDICTED_FROM = 0.3


@dataclass
class Model:
    vectors: np.ndarray
    filters: np.ndarray
    filter_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def chunks_of(data: np.ndarray) -> np.ndarray:
    """All bytes as rows of CHUNK bytes, one each HOP bytes; the last is filled with zeros."""
    n = max(1, -(-(len(data) - (CHUNK - HOP)) // HOP))
    whole = np.zeros((n - 1) * HOP + CHUNK, np.uint8)
    whole[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(whole, CHUNK)[::HOP]


def windows_of(x: np.ndarray) -> np.ndarray:
    """Vectors (chunks, CHUNK, VECTOR) as rows of WINDOW bytes' vectors, a row for each place."""
    a, b, c = x.strides
    return np.lib.stride_tricks.as_strided(x, (len(x), PLACES, WINDOW * VECTOR), (a, STRIDE * b, c), writeable=False)


def pooled(model: Model, chunks: np.ndarray, step: int = 64) -> np.ndarray:
    """The largest response of each filter in each chunk."""
    out = np.empty((len(chunks), FILTERS), np.float32)
    for i in range(0, len(chunks), step):
        some = np.ascontiguousarray(windows_of(model.vectors[chunks[i : i + step]]))
        out[i : i + step] = (some.reshape(-1, WINDOW * VECTOR) @ model.filters).reshape(-1, PLACES, FILTERS).max(axis=1)
    return np.maximum(out + model.filter_bias, 0)


def start(rng: np.random.Generator) -> Model:
    vectors = rng.normal(0, 0.3, (256, VECTOR)).astype(np.float32)
    code = np.arange(256)
    kinds = [(code >= 97) & (code < 123), (code >= 65) & (code < 91), (code >= 48) & (code < 58), code == 32, code >= 128, code < 32, (code > 32) & (code < 128)]
    for k, kind in enumerate(kinds):
        vectors[kind, k] += 1
    return Model(vectors, rng.normal(0, 0.2, (WINDOW * VECTOR, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, FILTERS).astype(np.float32), np.zeros(1, np.float32))


def fit(rows: list[tuple[int, str]], shares: dict[int, float] | None = None, seed: int = 5) -> Model | None:
    """rows: (label, text). Adam on the cross-entropy; gradients pass through the places of the largest responses."""
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    model = start(rng)
    docs = [chunks_of(np.frombuffer(t.encode(), np.uint8)) for _, t in rows]
    y = np.array([float(label == 1) for label, _ in rows], np.float32)
    ones = float(y.mean())
    weights = np.ones(len(y), np.float32)
    if shares and 0 < ones < 1:
        good = shares.get(1, 0) / max(1e-9, sum(shares.values()))
        weights = np.where(y == 1, good / ones, (1 - good) / (1 - ones)).astype(np.float32)
    names = ("vectors", "filters", "filter_bias", "out", "out_bias")
    moment = {k: (np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))) for k in names}
    epochs = max(EPOCHS, -(-STEPS // -(-len(docs) // MINIBATCH)))
    steps, done = epochs * -(-len(docs) // MINIBATCH), 0
    places = np.arange(WINDOW)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for a in range(0, len(order), MINIBATCH):
            some = order[a : a + MINIBATCH]
            chunks = np.concatenate([docs[i] for i in some])
            of = np.repeat(np.arange(len(some)), [len(docs[i]) for i in some])
            count = np.bincount(of, minlength=len(some)).astype(np.float32)
            top, where = np.empty((len(chunks), FILTERS), np.float32), np.empty((len(chunks), FILTERS), np.int64)
            for i in range(0, len(chunks), 64):
                x = np.ascontiguousarray(windows_of(model.vectors[chunks[i : i + 64]]))
                z = (x.reshape(-1, WINDOW * VECTOR) @ model.filters).reshape(-1, PLACES, FILTERS)
                where[i : i + 64] = z.argmax(axis=1)
                top[i : i + 64] = z.max(axis=1)
            h = np.maximum(top + model.filter_bias, 0)
            mean = np.zeros((len(some), FILTERS), np.float32)
            np.add.at(mean, of, h)
            mean /= count[:, None]
            p = 1 / (1 + np.exp(-(mean @ model.out + model.out_bias[0])))
            g = (p - y[some]) * weights[some] / len(some)
            back = (g[:, None] * model.out / count[:, None])[of] * (h > 0)
            at = where[:, :, None] * STRIDE + places
            codes = chunks[np.arange(len(chunks))[:, None, None], at]
            seen = model.vectors[codes].reshape(len(chunks), FILTERS, -1)
            to_vectors = (back[:, :, None] * model.filters.T[None]).reshape(-1, VECTOR)
            flat = codes.reshape(-1)
            grads = {
                "vectors": np.stack([np.bincount(flat, to_vectors[:, d], 256) for d in range(VECTOR)], axis=1).astype(np.float32),
                "filters": np.einsum("nf,nfk->kf", back, seen),
                "filter_bias": back.sum(axis=0),
                "out": mean.T @ g + np.float32(1e-4) * model.out,
                "out_bias": g.sum(keepdims=True),
            }
            done += 1
            rate = RATE * (1 - 0.9 * done / steps)
            for k in names:
                m, v = moment[k]
                m += 0.1 * (grads[k] - m)
                v += 0.001 * (grads[k] ** 2 - v)
                getattr(model, k)[...] -= rate * (m / (1 - 0.9**done)) / (np.sqrt(v / (1 - 0.999**done)) + 1e-8)
    return model


def score_texts(model: Model | None, column: pa.Array) -> np.ndarray:
    data, offsets = utf8(column)
    out = np.full(len(column), 0.5)
    if model is None:
        return out
    i = 0
    while i < len(column):  # about a thousand chunks at a time; a longer document stands alone
        some, n, j = [], 0, i
        while j < len(column) and (n < 1000 or j == i):
            some.append(chunks_of(data[offsets[j] : offsets[j + 1]]))
            n, j = n + len(some[-1]), j + 1
        h = np.concatenate([pooled(model, c) for c in (some if len(some) == 1 else [np.concatenate(some)])])
        sizes = np.array([len(c) for c in some])
        mean = np.add.reduceat(h.astype(np.float64), np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        out[i:j] = 1 / (1 + np.exp(-np.clip(mean @ model.out.astype(np.float64) + float(model.out_bias[0]), -60, 60)))
        i = j
    return out


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """From labelled rows whose id's crc32 isn't divisible by 5."""
    marks = labels.where(F.col("quality").isin(0, 1) & (remainder_of_id("doc_id", 5) != 0)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    shares = {r[0]: float(r[1]) for r in marks.groupBy("quality").count().collect()}
    return fit(bounded_sample(docs, "doc_id", "quality", PER_CLASS, MAX_BYTES, marks), shares)


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """(_row, _score) of every whole text; ``keep``: input columns that _row carries (default doc_id)."""
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # a text that is carried anyway isn't sent twice
    apart = "text" not in keep
    chosen = docs.select(F.struct(*[docs[c] for c in keep]).alias("_row"), *([docs["text"].cast("string").alias("_text")] if apart else []))
    schema = chosen.selectExpr("_row", "cast(null as double) _score").schema

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = score_texts(shared.value, batch.column(1) if apart else batch.column(0).field("text"))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["_row", "_score"])

    return map_batches(chosen, rows, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = predict(docs.select("doc_id", "text"), train(docs, labels)).select("_row.doc_id", "_score")
    return found.select("doc_id", (remainder_of_id("doc_id", 5) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= PREDICTED_FROM).cast("int").alias("predicted"))


def stage(docs: DataFrame, labels: DataFrame, keep_columns: list[str]) -> DataFrame:
    """The documents that aren't predicted to be bad, with their own columns."""
    return predict(docs, train(docs, labels), keep_columns).where(F.col("_score") >= PREDICTED_FROM).select("_row.*")
