"""Connected components of links, by alternating large-star and small-star steps on DataFrames.

Each task first contracts the links it has; once no more than ``BLOCK`` links are left, which a task holds easily, one
task contracts them all and the steps end there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Links that a task contracts together before they are shuffled.
BLOCK = 200_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of these links but the least of its component, with that least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        u, v = forest(t.column(0).to_numpy(), t.column(1).to_numpy())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK:
            yield out()
    if held:
        yield out()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: (u long, v long). Returns (node, root) for every node but the least of its component, its root."""
    edges = checkpointed(links.where("u <> v").mapInArrow(contracted, "u long, v long").distinct())
    for _ in range(most_rounds):
        if edges.count() <= BLOCK:
            edges = checkpointed(edges.coalesce(1).mapInArrow(contracted, "u long, v long"))
            break
        # large star: every node gives its larger neighbours to the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: every node gives its smaller neighbours, and itself, to the least of them
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new = checkpointed(small.where("u <> v").distinct())
        # done when every node has one link, to a node that has none upwards
        state = new.join(new.select(F.col("u").alias("v"), F.lit(1).alias("has")).distinct(), "v", "left").agg(F.count("has").alias("deep"), F.count("*").alias("n"), F.count_distinct("u").alias("nodes")).first()
        edges = new
        if state["deep"] == 0 and state["n"] == state["nodes"]:
            break
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
