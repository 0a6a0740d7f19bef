"""Queries of this subpackage, as ``__spark_entry__`` registers them, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import balltree, bitpack, bpe, jaccard, langid, licences, matroska, packing, quality, spans
from .common import table


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digest(table(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


def op3_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.digest(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"))


def op5_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.digest(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(table(spark, sf_dir, "documents"))


def op9_balltree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.digest(table(spark, sf_dir, "embeddings"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_matroska, op2_langid, op3_spans, op4_packing, op5_bitpack, op6_quality, op7_byte_bpe, op8_jaccard, op9_balltree, op10_licences)}


def oracle_sql() -> dict[str, str]:
    return {"op8_jaccard": jaccard.ORACLE_SQL, "op9_balltree": balltree.ORACLE_SQL, "op10_licences": licences.ORACLE_SQL}
