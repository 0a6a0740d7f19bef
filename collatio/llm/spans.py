"""Substring dedup by sliding sentence spans.

A text is cut into sentences at ends of sentences and lines. A sentence of more than ``UNIT_WORDS`` words is cut
further, after the word with the least hash of any ``UNIT_WORDS`` consecutive ones, so the cuts follow the words and
not the place where the sentence begins. A run is the shortest from or up to a unit that has ``RUN`` ends of
sentences or ``RUN_WORDS`` words. Runs are hashed and joined over the whole corpus, and units that any
repeated run covers are removed, but for the run's first place in the order of (doc_id, text, place).

Any 50 consecutive words that two places share have a run in common, wherever they begin: the first common cut is
after at most 12 of them and the last one before at most 12, and 26 words are left between. Up to 12 words at either
edge of such a passage may stay, where its first and last unit go on into other text.

A task keeps only the first of a run among the rows it has read together, so a run that stands in a third of all
documents is shuffled once a block, not once a row; the others of the block are known to be repeats at once.

Defined cases: null and empty texts stay as they are; a text without a run is left alone; equal
rows (same doc_id and text) count as one document and get the same result; among rows with one doc_id and
different texts the text's hash orders; texts may be of any length; other columns can be carried along.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches
from .shingles import mix

RUN, UNIT_WORDS = 4, 12
#: 50 words less a unit at either edge.
RUN_WORDS = 50 - 2 * UNIT_WORDS
#: Runs that a task looks at together.
BLOCK_RUNS = 400_000
LOWEST = -(1 << 63)

WORD = re.compile(r"\S+\s*")
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SENTENCE_END = re.compile(r"(?<=[.!?])(?=\s+\S)")


class Units(NamedTuple):
    """Parts that together are the text, their words in lower case, how many, and whether the part ends a sentence."""

    texts: list[str]
    keys: list[bytes]
    sizes: list[int]
    closes: list[bool]


def cuts(words: list[bytes]) -> list[int]:
    """Where a long sentence's units begin, but for the first: after the last of the least hashes of each window."""
    h = [zlib.crc32(w) for w in words]
    at, out = -1, []
    for k in range(UNIT_WORDS - 1, len(h)):
        if at <= k - UNIT_WORDS or at < 0:
            window = h[k - UNIT_WORDS + 1 : k + 1]
            at = k - window[::-1].index(min(window))
        elif h[k] <= h[at]:
            at = k
        else:
            continue
        out.append(at + 1)
    return out[:-1] if out[-1] == len(h) else out


def units_of(text: str) -> Units:
    u = Units([], [], [], [])
    for line in text.splitlines(keepends=True):
        if line.isspace():
            if u.texts:
                u.texts[-1] += line
                continue
        for s in SENTENCE_END.split(line):
            words = s.split()
            key = " ".join(words).encode("utf-8", "surrogatepass").lower()
            if len(words) > UNIT_WORDS:
                parts = WORD.findall(s)
                if lead := len(s) - len(s.lstrip()):
                    parts[0] = s[:lead] + parts[0]
                keys = key.split(b" ")
                i = 0
                for j in [*cuts(keys), len(parts)]:
                    u.texts.append("".join(parts[i:j]))
                    u.keys.append(b" ".join(keys[i:j]))
                    u.sizes.append(j - i)
                    u.closes.append(j == len(parts))
                    i = j
            else:
                u.texts.append(s)
                u.keys.append(key)
                u.sizes.append(len(words))
                u.closes.append(True)
    return u


def sentences(text: str) -> list[str]:
    return units_of(text).texts


def runs_in(sizes: list[int], closes: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """First unit and end of each run: the shortest from each unit on, then those up to each unit that aren't among them."""
    words, closed = (np.concatenate([[0], np.cumsum(np.asarray(x, np.int64))]) for x in (sizes, closes))
    n = len(sizes)
    ends = np.minimum(np.searchsorted(words, words[:-1] + RUN_WORDS), np.searchsorted(closed, closed[:-1] + RUN))
    ends = ends[ends <= n]
    # from the back: the last unit from which on enough is reached
    starts = np.maximum(np.searchsorted(words, words[1:] - RUN_WORDS, side="right"), np.searchsorted(closed, closed[1:] - RUN, side="right")) - 1
    up_to = np.arange(1, n + 1)[starts >= 0]
    starts = starts[starts >= 0]
    other = (starts >= len(ends)) | (ends[np.minimum(starts, len(ends) - 1)] != up_to) if len(ends) else np.zeros(0, bool)
    return np.concatenate([np.arange(len(ends)), starts[other]]), np.concatenate([ends, up_to[other]])


@lru_cache(maxsize=4)
def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.full(size, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def power_sums(x: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial of each range of x, modulo 2 ** 64."""
    up, down = powers(base, 1 << max(12, len(x).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[: len(x)], dtype=np.uint64)])
    return (total[ends] - total[starts]) * down[starts]


def run_hashes(u: Units) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of the hash of each run, which white space and the case of A-Z don't change."""
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, u.keys), np.uint64, len(u.keys))
    starts, ends = runs_in(u.sizes, u.closes)
    h = mix(power_sums(each, 0x9E3779B97F4A7C15, starts, ends) ^ (ends - starts).astype(np.uint64))
    g = mix(power_sums(mix(each), 0xBF58476D1CE4E5B9, starts, ends))
    return h, g >> np.uint64(32)


RUNS = "h long, gp long, d long, t long, sure boolean"


def text_hash(text: str) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(text)).astype(np.int64))


def table(h: np.ndarray, g: np.ndarray, d: np.ndarray, t: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    """First places of a block's runs, and its other places, which are sure to be repeats."""
    order = np.lexsort((p, t, d, g, h))
    h, g, d, t, p = h[order], g[order], d[order], t[order], p[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
    # two equal rows are one document: the same place of it is no repeat, and is told once
    same = np.zeros(len(h), bool)
    same[1:] = again[1:] & (d[1:] == d[:-1]) & (t[1:] == t[:-1]) & (p[1:] == p[:-1])
    first_of = np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))
    sure = again & ~((d == d[first_of]) & (t == t[first_of]) & (p == p[first_of]))
    keep = ~same
    # sure places travel by a key of their own, as a hot run's would all meet
    key = np.where(sure, (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ t.astype(np.uint64), h)
    gp = (g << np.uint64(32)) | p.astype(np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(gp[keep].view(np.int64)), pa.array(d[keep]), pa.array(t[keep]), pa.array(sure[keep])], ["h", "gp", "d", "t", "sure"])


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not text:
                continue
            h, g = run_hashes(units_of(text))
            n = len(h)
            if not n:
                continue
            held.append((h, g, np.full(n, ident, np.int64), np.full(n, text_hash(text), np.int64), np.arange(n, dtype=np.int64)))
            size += n
            if size >= BLOCK_RUNS:
                yield table(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield table(*(np.concatenate(c) for c in zip(*held, strict=True)))


def repeats_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows ordered by h: places of runs that aren't a run's first. Rows of one h may go on in the next batch."""
    rest: list[np.ndarray] | None = None

    def repeats(c: list[np.ndarray]) -> pa.RecordBatch:
        h, gp, d, t, sure = c
        g, p = gp.view(np.uint64) >> np.uint64(32), (gp & 0xFFFFFFFF)
        order = np.lexsort((p, t, d, sure, g, h))
        again = np.zeros(len(h), bool)
        i = order
        again[1:] = (h[i][1:] == h[i][:-1]) & (g[i][1:] == g[i][:-1]) & ~sure[i][1:] & ~sure[i][:-1]
        first_of = np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))
        f = i[first_of]
        found = again & ~((d[i] == d[f]) & (t[i] == t[f]) & (p[i] == p[f])) | sure[i]
        i = i[found]
        return pa.RecordBatch.from_arrays([pa.array(d[i]), pa.array(t[i]), pa.array(p[i].astype(np.int32))], ["_d", "_t", "pos"])

    for batch in batches:
        c = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        if rest is not None:
            c = [np.concatenate(x) for x in zip(rest, c, strict=True)]
        cut = int(np.searchsorted(c[0], c[0][-1], side="left"))
        if cut:
            yield repeats([x[:cut] for x in c])
        rest = [x[cut:] for x in c]
    if rest is not None and len(rest[0]):
        yield repeats(rest)


def keys(docs: DataFrame) -> list:
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(LOWEST)).alias("_d"), docs["text"].cast("string").alias("_text")]


def repeated(docs: DataFrame) -> DataFrame:
    """(_d, _t, starts): of each document, by id and text hash, the places of repeated runs in ``runs_in``."""
    small_batches(docs.sparkSession)
    runs = docs.select(*keys(docs)).mapInArrow(lean(runs_of), RUNS)
    met = runs.repartition(F.col("h")).sortWithinPartitions("h").mapInArrow(lean(repeats_of), "_d long, _t long, pos int")
    return met.groupBy("_d", "_t").agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def strip(text: str, runs: list[int]) -> tuple[str, int, list[tuple[int, int]]]:
    """(what is left, sentences, spans of removed sentences as first and end)."""
    units, _, sizes, closes = units_of(text)
    firsts, ends = runs_in(sizes, closes)
    gone = np.zeros(len(units) + 1, np.int64)
    np.add.at(gone, firsts[runs], 1)
    np.add.at(gone, ends[runs], -1)
    covered = np.cumsum(gone)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    spans = [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return "".join(u for u, c in zip(units, covered.tolist(), strict=True) if not c), len(units), spans


def dedup(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(_row, _text, _sentences, _spans): the columns ``keep``, what is left, and the removed sentences."""
    hashed = docs.select(F.struct(*[docs[c] for c in keep]).alias("_row"), *keys(docs))
    text_key = hashed.schema

    def with_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = [text_hash(x or "") for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t, pa.int64())], [*batch.schema.names, "_t"])

    schema = hashed.selectExpr("*", "cast(0 as long) _t").schema
    joined = hashed.mapInArrow(lean(with_hash), schema).join(repeated(docs), ["_d", "_t"], "left").select(*text_key.names, "starts")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            texts, counts, spans = [], [], []
            for text, starts in zip(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist(), strict=True):
                if text and starts:
                    text, count, gone = strip(text, starts)
                else:
                    count, gone = len(sentences(text)) if text else 0, []
                texts.append(text)
                counts.append(count)
                spans.append([{"first": a, "end": b} for a, b in gone])
            span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 3], pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(spans, span)], [*batch.schema.names[: n - 3], "_text", "_sentences", "_spans"])

    out = joined.selectExpr("_row", "cast(null as string) _text", "cast(null as int) _sentences", "cast(null as array<struct<first:int,end:int>>) _spans").schema
    return joined.mapInArrow(lean(rows), out)


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed, removed): every document with what is left of it."""
    removed = F.aggregate("_spans", F.lit(0), lambda n, s: n + s["end"] - s["first"])
    return dedup(docs.select("doc_id", "text"), ["doc_id"]).select("_row.doc_id", F.col("_text").alias("text"), F.col("_sentences").alias("n_sentences"), removed.alias("n_removed"), F.col("_spans").alias("removed"))


def stage(docs: DataFrame) -> DataFrame:
    """The documents without repeated passages; those of which nothing is left go, if there was something."""
    names = docs.columns
    own = dedup(docs, names)
    had = F.trim(F.coalesce(F.col("_row.text"), F.lit(""))) != ""
    left = own.where(~(had & (F.trim("_text") == "") & (F.size("_spans") > 0)))
    made = {"text": F.col("_text")}
    if "n_chars" in names:  # set anew where sentences went
        made["n_chars"] = F.when(F.size("_spans") > 0, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return left.select(*[made.get(c, F.col("_row").getField(c)).alias(c) for c in names])
