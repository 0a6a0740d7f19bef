"""The pipeline's stages on the smallest tables and on clashing columns."""

from pyspark.sql import functions as F

import corpus_pipeline
from collatio.llm import jaccard, spans
from conftest import SF


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_text", F.lit("x"))
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, SF)
        assert docs.columns == names
        assert docs.count() <= before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_one_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(3, base), (1, base + " more"), (2, base), (3, base), (7, None), (8, ""), (9, "other words here now again")]
    got = jaccard.stage(spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, d string"), 5, 80).collect()
    assert sorted(r.doc_id for r in got) == [1, 7, 8, 9]


def test_one_of_each_group_stays_under_repeated_and_null_ids(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (5, base), (5, base + " more"), (None, "other " + base), (None, "a text of its own here"), (5, "and one more text here"), (None, None)]
    got = jaccard.stage(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, ""), (0, "a text of its own here"), (0, "other " + base), (5, "and one more text here")]


def test_span_stage_keeps_columns(spark):
    rows = [(1, "A b c. D e f. G h i. J k l. M n o.", 9), (2, "X y z. A b c. D e f. G h i. J k l. M n o.", 9), (3, None, 9)]
    got = {r.doc_id: r for r in spans.stage(spark.createDataFrame(rows, "doc_id long, text string, _spans int")).collect()}
    assert got[2].text.strip() == "X y z." and got[1].text == rows[0][1] and got[3].text is None and got[2]["_spans"] == 9
