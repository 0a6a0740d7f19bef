"""``python -m collatio.cli LEFT RIGHT OUT``: compares Word files of one folder with web pages of another.

Files pair by their names without the suffix. OUT gets ``comments``, ``appendix``, ``matches`` and ``summary`` as Parquet,
and ``summary`` as JSON lines, one a pair.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import review
from .operators.compare import Comparison
from .operators.matcher import Profile
from .sources import docx, html


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def named(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(pair_id, name, content): a pair is the hash of its files' name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.xxhash64(stem(F.col("path"))).alias("pair_id"), stem(F.col("path")).alias("name"), "content")


def sides(spark: SparkSession, left: str, right: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks of both sides of names that stand on both, and the names."""
    a, b = named(spark, left, "*.docx"), named(spark, right, "*.htm*")
    names = a.select("pair_id", "name").join(b.select("pair_id"), "pair_id")
    met = lambda d: d.join(names.select("pair_id"), "pair_id")
    words = docx.scan_bytes(met(a), "pair_id", "content").withColumnRenamed("doc_id", "pair_id")
    pages = html.scan(met(b).withColumn("html", F.decode("content", "utf-8")), "pair_id", "html").withColumnRenamed("doc_id", "pair_id")
    return words, pages, names


def run(spark: SparkSession, left: str, right: str, out: str, proofread: bool = False) -> None:
    words, pages, names = sides(spark, left, right)
    found = Comparison(Profile("html", proofread)).compare(words, pages)
    for name, rows in (("comments", found.comments), ("appendix", found.appendix), ("matches", found.matches), ("summary", found.summary)):
        rows.join(names, "pair_id").write.mode("overwrite").parquet(f"{out}/{name}")
    review.summary_json(found.matches.drop("covered")).join(names, "pair_id").select("name", "summary").write.mode("overwrite").json(f"{out}/summary-json")


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    for name in ("left", "right", "out"):
        args.add_argument(name)
    args.add_argument("--proofread", action="store_true")
    got = args.parse_args()
    run(SparkSession.builder.appName("collatio").getOrCreate(), got.left, got.right, got.out, got.proofread)


if __name__ == "__main__":
    main()
