"""The corpus pipeline: stages over ``documents``, each the next one's input.

Documents that the quality classifier or language identification rejects go; of near-duplicates one stays; passages
that repeat across documents are cut out; what is left is tokenised and packed. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from collatio.llm import jaccard, langid, packing, quality, spans
from collatio.llm.common import shared_folder, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.stage(docs, table(spark, sf_dir, "labels"), docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.stage(docs, docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.stage(docs, STAGE_SHINGLE, STAGE_PERCENT)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spans.stage(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(docs)


#: Near-duplicate stages take shingles of five words and a similarity of 0.8 or more.
STAGE_SHINGLE, STAGE_PERCENT = 5, 80
STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]
#: The first two stages are trained models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(spark, docs, name)
    return docs


def written(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """A stage's result as Parquet in the shared folder, read again."""
    folder = shared_folder(spark, name.replace(" ", "-"))
    docs.write.parquet(folder)
    return spark.read.schema(docs.schema).parquet(folder)
