"""Token-id files with fixed-width bit packing.

A file holds documents in ascending order. Every id takes the same number of bits, the fewest that hold the
vocabulary; ids are packed in blocks of ``BLOCK`` ids, each beginning on a 64-bit word, and the file lists where
each block begins, so any range of ids is read by seeking to its blocks and unpacking them with numpy.

Layout, little-endian: magic ``BITIDS01``; uint32 bits, uint32 ids a block; uint64 documents, ids, blocks, words;
int64 document ids; uint64 first id of each document, and the end; uint64 first word of each block, and the end;
uint64 words.

``write`` orders the corpus by ranges of (doc_id, text hash), so a third of the rows under one id still spreads
out; each task writes its own files under names of its own attempt, and only the names of tasks that ended are in
the manifest, so lost executors leave at most unused files. Defined cases: null text is empty (its end id alone);
a null doc_id sorts first; equal rows are kept, each with its own ids.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, lean, shared_folder, small_batches
from .tokens import default_tokenizer, ended, piece_tokenizer

MAGIC, BLOCK, HEAD = b"BITIDS01", 4096, struct.Struct("<8sII4Q")
#: Ids that a task holds before it writes a file, and that a task reads back.
FILE_IDS = 4_000_000


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """64 ids take ``bits`` words; the ids of one place in all groups are shifted in at once."""
    groups = -(-len(ids) // 64)
    lanes = np.zeros((groups, 64), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    words = np.zeros((groups, bits + 1), np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        words[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return words[:, :bits].reshape(-1)


def unpack(words: np.ndarray, count: int, bits: int) -> np.ndarray:
    groups = -(-count // 64)
    rows = np.zeros((groups, bits + 1), np.uint64)
    rows[:, :bits] = words[: groups * bits].reshape(groups, bits)
    out, mask = np.empty((groups, 64), np.uint32), np.uint64((1 << bits) - 1)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        value = rows[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value |= rows[:, word + 1] << np.uint64(64 - shift)
        out[:, lane] = value & mask
    return out.reshape(-1)[:count]


def file_bytes(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    per = -(-BLOCK // 64) * bits
    blocks = -(-len(ids) // BLOCK)
    words = pack(ids, bits)
    first = np.minimum(np.arange(blocks + 1, dtype=np.uint64) * np.uint64(per), np.uint64(len(words)))
    return HEAD.pack(MAGIC, bits, BLOCK, len(doc_ids), len(ids), blocks, len(words)) + doc_ids.astype("<i8").tobytes() + starts.astype("<u8").tobytes() + first.astype("<u8").tobytes() + words.astype("<u8").tobytes()


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if urlparse(uri).scheme else f"file://{uri}")


class Reader:
    """Random access to a file: ``read(first, end)`` unpacks only the blocks that hold these ids."""

    def __init__(self, uri: str):
        store, path = filesystem(uri)
        self.file = store.open_input_file(path)
        magic, self.bits, self.block, docs, self.ids, blocks, _ = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError(f"{uri} isn't such a file")
        at = HEAD.size
        self.doc_ids = np.frombuffer(self.file.read_at(8 * docs, at), "<i8")
        self.starts = np.frombuffer(self.file.read_at(8 * (docs + 1), at := at + 8 * docs), "<u8").astype(np.int64)
        self.first_word = np.frombuffer(self.file.read_at(8 * (blocks + 1), at := at + 8 * (docs + 1)), "<u8").astype(np.int64)
        self.words_at = at + 8 * (blocks + 1)

    def read(self, first: int, end: int) -> np.ndarray:
        if end <= first:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, -(-end // self.block)
        w = self.first_word[[a, b]]
        words = np.frombuffer(self.file.read_at(int(8 * (w[1] - w[0])), int(self.words_at + 8 * w[0])), "<u8")
        return unpack(words, min(b * self.block, self.ids) - a * self.block, self.bits)[first - a * self.block : end - a * self.block]

    def close(self) -> None:
        self.file.close()


MANIFEST = "part int, file int, uri string, docs long, ids long"


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Writes all documents in ascending doc_id order; returns the manifest: the files in order with their sizes."""
    path = tokenizer or default_tokenizer()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt, number = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        t = piece_tokenizer(path)
        bits = bits_for(max(t.tokenizer.get_vocab_size(), end_id + 1))
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            keys = np.concatenate([k for k, _, _ in held])
            starts = np.zeros(len(keys) + 1, np.int64)
            np.cumsum(np.concatenate([np.diff(e) for _, _, e in held]), out=starts[1:])
            uri = f"{folder}/{part:06d}-{number:04d}-{attempt}.ids"
            store, place = filesystem(uri)
            store.create_dir(place.rpartition("/")[0], recursive=True)
            data = file_bytes(keys, starts, np.concatenate([x for _, x, _ in held]), bits)
            held.clear()
            with store.open_output_stream(place) as out:
                out.write(data)
            found = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([uri]), pa.array([len(keys)], pa.int64()), pa.array([int(starts[-1])], pa.int64())], ["part", "file", "uri", "docs", "ids"])
            number, size = number + 1, 0
            return found

        for batch in batches:
            keys = batch.column(0).to_numpy()
            for i, j, ids, ends in t.table.ids_of(batch.column(1)):
                held.append((keys[i:j], *ended(ids, ends, end_id)))
                size += len(held[-1][1])
                if size >= FILE_IDS:
                    yield flush()
        if held:
            yield flush()

    lowest = F.lit(-(1 << 63))
    ordered = (
        docs.select(F.coalesce(docs["doc_id"].cast("long"), lowest).alias("doc_id"), docs["text"].cast("string").alias("text"))
        .withColumn("_h", F.xxhash64("text"))
        .repartitionByRange("doc_id", "_h")
        .sortWithinPartitions("doc_id", "_h")
        .drop("_h")
    )
    small_batches(docs.sparkSession)
    return checkpointed(ordered.mapInArrow(lean(rows, stores=True), MANIFEST))


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: ids before it in the whole corpus, number of ids and their crc32."""
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each file, not for each document: the running sum of the files' sizes is small
    placed = manifest.select("uri", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r = Reader(uri)
                at = r.starts
                crc, i = np.zeros(len(r.doc_ids), np.int64), 0
                while i < len(crc):  # about a million ids at a time, or one longer document
                    j = min(len(crc), max(i + 1, int(np.searchsorted(at, at[i] + (1 << 20), side="right")) - 1))
                    ids = r.read(int(at[i]), int(at[j]))
                    crc[i:j] = [zlib.crc32(ids[a:b]) for a, b in zip((at[i:j] - at[i]).tolist(), (at[i + 1 : j + 1] - at[i]).tolist(), strict=True)]
                    i = j
                r.close()
                keys = pa.array(r.doc_ids, pa.int64(), mask=r.doc_ids == -(1 << 63))
                yield pa.RecordBatch.from_arrays([keys, pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a task for some millions of ids; dealt by place, so no task gets many more files than another
    files, ids = manifest.agg(F.count("*"), F.coalesce(F.sum("ids"), F.lit(0))).first()
    tasks = max(1, min(files, -(-ids // FILE_IDS)))
    return placed.repartitionByRange(tasks, "base", "uri").mapInArrow(lean(rows), DIGEST)


def digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """All documents written as files in the shared folder and read back from them."""
    spark: SparkSession = docs.sparkSession
    return read(write(docs, shared_folder(spark, "ids"), tokenizer))
