"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Texts are handed to numpy in slices of about this many bytes, so memory doesn't follow the batch.
SLICE_BYTES = 1 << 20


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; one of our own only on a single machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(root)
        return root
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="collatio-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; executors may be lost afterwards."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, stores: bool = False) -> DataFrame:
    """One record batch in, at most one out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out

    small_batches(df.sparkSession)
    return df.mapInArrow(lean(run, stores), schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; a null is empty."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer row stands alone, whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def remainder_of_id(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; the split that the contracts name. -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(-1))


def bounded_sample(docs: DataFrame, key: str, label: str, per_class: int, max_bytes: int, marks: DataFrame | None = None) -> list[tuple]:
    """At most ``per_class`` rows of each label, of at most ``max_bytes`` bytes each, as (label, text) on the driver.

    marks: the table (key, label), unless docs has the labels itself. The rows with the smallest hashes are taken, so
    the sample doesn't depend on partitioning. Three passes, however many labels there are: rows are counted by label,
    ids are chosen among the rows below a border of hashes that the counts give, so few meet in one task, and texts are
    fetched through a join with the chosen ids, whose number is bounded by that of the labels.
    """
    spread = F.xxhash64(key)
    fit = docs.where(F.col(key).isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    told = (fit.select(key, label) if marks is None else fit.select(key).join(marks, key)).where(F.col(label).isNotNull())
    counts = told.groupBy(label).count().collect()
    if not counts:
        return []
    # all hashes below a border that about three times as many rows pass as are wanted; the least ones are among them
    border = {r[0]: -(1 << 63) + min(1 << 64, ((3 * per_class + 100) << 64) // r[1]) for r in counts}
    below = F.lit(False)
    for value, most in border.items():
        below = below | ((F.col(label) == F.lit(value)) & ((spread < F.lit(most)) if most < 1 << 63 else F.lit(True)))
    ranked = told.where(below).withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(spread, key)))
    chosen = ranked.where(F.col("_r") <= per_class).groupBy(key).agg(F.min(label).alias("_label")).collect()
    if not chosen:
        return []
    picked = docs.sparkSession.createDataFrame(chosen, f"{key} {docs.schema[key].dataType.simpleString()}, _label {told.schema[label].dataType.simpleString()}")
    rows = fit.select(key, "text").join(F.broadcast(picked), key).groupBy(key).agg(F.min(F.struct(F.col("_label").alias("l"), F.col("text").alias("t"))).alias("r"))
    return [(r["r"]["l"], r["r"]["t"]) for r in rows.orderBy(spread, key).collect()]


def portions(batch: pa.RecordBatch, column: int = 1, most: int = 4 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, so what is made of them stays small."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for i, j in slices(ends, most):
        yield batch.slice(i, j - i)


#: Rows, and bytes, that travel to Python at once; texts may be long, so fewer than Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes from now on in this session, unless it asks for smaller ones."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, most)


def release() -> None:
    """Hand memory that a task no longer uses back to the system; the worker process lives on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


#: What empties the stores that a worker process keeps from task to task.
STORES: list[Callable[[], None]] = []


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], stores: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that leaves no unused memory behind in its worker.

    stores: it uses what is kept from task to task; other functions empty that first.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            if not stores:
                for forget in STORES:
                    forget()
            yield from run(batches)
        finally:
            release()

    return wrapped
