"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's subwords are its runs of three and of four bytes (ASCII lower-cased, other ASCII than letters as blanks,
a blank at either end), hashed into two bucket tables. Their embeddings are averaged and go through one linear
layer. For prediction, embedding and layer are folded into class scores of each bucket, so the whole text is read
by table look-ups. Scores are calibrated by a temperature fitted on rows that training didn't see, and texts whose
best score is below a threshold, fitted there too, are rejected.

Training reads a bounded sample: ``PER_CLASS`` texts of each language, each of ``MAX_BYTES`` bytes at most.
Prediction reads every whole text. Defined cases: null texts and texts without a letter give ``und``, score 0,
rejected; without training rows every text does; ties go to the language first in the alphabet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_batches, remainder_of_id, slices, utf8

PER_CLASS, MAX_BYTES, BUCKETS, SIZE, EPOCHS, RATE = 500, 20_000, 1 << 15, 16, 6, 0.5
#: No text with at least this calibrated score is rejected, whatever the quantile says.
REJECT_MOST, REJECT_QUANTILE = 0.5, 0.002

FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    #: Class scores of each bucket: three-byte subwords first, then those of four bytes.
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    text = pc.fill_null(column.cast(pa.large_string()), "")
    blank = pa.scalar(" ", pa.large_string())
    data, offsets = utf8(pc.binary_join_element_wise(blank, text, pa.scalar("  ", pa.large_string()), pa.scalar("", pa.large_string())))
    return FOLD[data], offsets


def subwords(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the three- and four-byte runs that begin at each place but the last three."""
    w = b.astype(np.uint32)
    three = w[:-3] | w[1:-2] << np.uint32(8) | w[2:-1] << np.uint32(16)
    four = three | w[3:] << np.uint32(24)
    return three * np.uint32(2654435761) >> np.uint32(17), (four * np.uint32(2246822519) >> np.uint32(17)) + np.uint32(BUCKETS)


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, weights that sum to 1) of each text."""
    out = []
    data, offsets = padded(pa.array(texts, pa.large_string()))
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        got = np.concatenate(subwords(data[a:b])) if b - a > 3 else np.zeros(0, np.uint32)
        idx, n = np.unique(got, return_counts=True)
        out.append((idx, (n / max(1, n.sum())).astype(np.float32)))
    return out


def fit(rows: list[tuple[str, str]], seed: int = 11) -> Model:
    """rows: (language, text). One row in five is held back for the calibration."""
    languages = sorted({lang for lang, _ in rows})
    classes = {lang: k for k, lang in enumerate(languages)}
    rng = np.random.default_rng(seed)
    if not languages:
        return Model([], np.zeros((2 * BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    y = np.array([classes[lang] for lang, _ in rows])
    x = features([t for _, t in rows])
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 20 else np.zeros(len(rows), bool)
    k = len(languages)
    embedding = rng.normal(0, 0.1, (2 * BUCKETS, SIZE)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (SIZE, k)).astype(np.float32), np.zeros(k, np.float32)
    train = np.flatnonzero(~held)
    steps, done = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            idx, w = x[i]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            if not len(idx):
                continue
            rows_of = embedding[idx]
            h = w @ rows_of
            z = h @ layer + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y[i]] -= 1
            # the average divides by the length; its square root keeps steps alike for short and long texts
            scale = w * np.float32(np.sqrt(len(idx)))
            embedding[idx] = rows_of - rate * scale[:, None] * (layer @ g)[None, :]
            layer -= rate * np.outer(h, g)
            bias -= rate * np.float32(0.1) * g
    model = Model(languages, np.ascontiguousarray(embedding @ layer), bias)
    if held.any():
        z = np.array([w @ model.table[idx] + bias if len(idx) else bias for (idx, w), h in zip(x, held, strict=True) if h], np.float64)
        truth = y[held]

        def loss(t: float) -> float:
            s = z / t
            s -= s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]).mean())

        model.temperature = float(min(np.geomspace(0.05, 20, 61), key=loss))
        s = np.exp((z - z.max(axis=1, keepdims=True)) / model.temperature)
        best = (s / s.sum(axis=1, keepdims=True)).max(axis=1)
        model.threshold = float(min(REJECT_MOST, np.quantile(best, REJECT_QUANTILE)))
    return model


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Class scores before calibration of each padded text."""
    n = len(offsets) - 1
    out = np.zeros((n, len(model.languages)), np.float64)
    for i, j in slices(offsets):
        at = offsets[i : j + 1] - offsets[i]
        b = data[offsets[i] : offsets[j]]
        if len(b) < 4:
            continue
        three, four = subwords(b)
        each = model.table[three]
        each += model.table[four]
        count = np.maximum(at[1:] - at[:-1] - 3, 0)
        some = np.flatnonzero(count)
        pairs = np.stack([at[:-1][some], at[:-1][some] + count[some]], axis=1).reshape(-1)
        # a closing index at the very end would be out of range; the last range then runs to the end by itself
        pairs = pairs[:-1] if len(pairs) and pairs[-1] >= len(each) else pairs
        sums = np.add.reduceat(each, pairs, axis=0)[::2] if len(some) else each[:0]
        out[i + some] = sums / (2 * count[some])[:, None]
    return out + model.bias


def lettered(data: np.ndarray, offsets: np.ndarray, column: pa.Array) -> np.ndarray:
    """Whether each text has a letter; only texts without one of ASCII are looked at by character."""
    ascii_letter = np.concatenate([[0], np.cumsum((data >= 97) & (data < 123))])
    found = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in column[int(i)].as_py() or "")
    return found


SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """(_row, _lang, _score, _rejected) of every whole text; ``keep``: input columns that _row carries (default doc_id)."""
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # a text that is carried anyway isn't sent twice
    apart = "text" not in keep
    chosen = docs.select(F.struct(*[docs[c] for c in keep]).alias("_row"), *([docs["text"].cast("string").alias("_text")] if apart else []))
    schema = chosen.selectExpr("_row", "cast(null as string) _lang", "cast(null as double) _score", "cast(null as boolean) _rejected").schema

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        text = batch.column(1) if apart else batch.column(0).field("text")
        data, offsets = padded(text)
        known = lettered(data, offsets, text) & bool(m.languages)
        if m.languages:
            z = scores(m, data, offsets) / m.temperature
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            best = z.argmax(axis=1)
            score = np.where(known, z[np.arange(len(z)), best], 0.0)
            lang = [m.languages[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
        else:
            score, lang = np.zeros(len(known)), ["und"] * len(known)
        rejected = ~known | (score < m.threshold)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score), pa.array(rejected)], ["_row", "_lang", "_score", "_rejected"])

    return map_batches(chosen, rows, schema)


def train(docs: DataFrame) -> Model:
    """From rows with a language whose id's crc32 leaves another remainder than 2 by 4."""
    return fit(bounded_sample(docs.select("doc_id", "text", "lang").where(remainder_of_id("doc_id", 4) != 2), "doc_id", "lang", PER_CLASS, MAX_BYTES))


def digest(docs: DataFrame) -> DataFrame:
    found = predict(docs.select("doc_id", "text"), train(docs))
    found = found.select("_row.doc_id", "_lang", "_score", "_rejected")
    return found.select("doc_id", (remainder_of_id("doc_id", 4) == 2).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"))


def stage(docs: DataFrame, keep_columns: list[str]) -> DataFrame:
    """The documents that aren't rejected, with their own columns."""
    return predict(docs, train(docs), keep_columns).where(~F.col("_rejected")).select("_row.*")
