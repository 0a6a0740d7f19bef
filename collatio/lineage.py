"""Where plans are cut, by reliable checkpoints in the shared folder of ``spark.checkpoint.dir``, and where rows are dealt anew."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder; one of our own only on a single machine (tests)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="collatio-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to all cores, if they come in fewer parts, as those of a file with one row group do.

    For small tables before costly expressions; a table of many parts stays as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt_by(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by a key to as many parts as shuffles have; these stay apart, though they are small, for what is costly comes after."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def met_in_place(*sides: DataFrame) -> None:
    """Lets joins by several keys take sides that are dealt by fewer of them as they lie.

    A setting of the session: Spark else deals both sides anew by all keys of a join.
    """
    sides[0].sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
