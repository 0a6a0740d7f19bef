"""Models against plain loops and held-out rows, odd input of all operators, and what the pipeline's stages remove."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from collatio.llm import entries, langid, matroska, packing, quality, spans
from collatio.llm.common import utf8
from conftest import SF

LARGER = SF.replace("sf0.001", "sf0.1")


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_language_scores_by_plain_loops():
    rng = random.Random(7)
    kinds = {"en": ["the", "thing", "and", "of"], "de": ["und", "schön", "der", "keit"], "fr": ["eau", "été", "le", "oui"]}
    rows = [(lang, prose(rng, words, rng.randint(3, 40))) for _ in range(40) for lang, words in kinds.items()]
    model = langid.fit(rows)
    texts = ["", "a", "ab", "the thing", None, "und " * 500, "1 2 3", "été\nété", "THE End"]
    data, offsets = langid.padded(pa.array(texts))
    got = langid.scores(model, data, offsets)
    for k, text in enumerate(texts):
        b = (" " + (text or "") + "  ").encode()
        fold = bytes(c + 32 if 65 <= c < 91 else c if 97 <= c < 123 or c >= 128 else 32 for c in b)
        found = []
        for i in range(len(fold) - 3):
            three, four = int.from_bytes(fold[i : i + 3], "little"), int.from_bytes(fold[i : i + 4], "little")
            found += [(three * 2654435761 % 2**32) >> 17, ((four * 2246822519 % 2**32) >> 17) + langid.BUCKETS]
        want = model.bias + (model.table[found].astype(float).mean(axis=0) if found else 0)
        assert got[k] == pytest.approx(want, abs=1e-5)


def test_quality_scores_by_plain_loops():
    rng = random.Random(3)
    model = quality.fit([(k % 2, prose(rng, ["good", "words", "here"] if k % 2 else ["!!", "BUY", "$$$"], 30)) for k in range(60)])
    texts = ["", None, "x", "good words here " * 40, "a" * 255, "b" * 257, "BUY !! " * 300]
    got = quality.score_texts(model, pa.array(texts))
    for k, text in enumerate(texts):
        data = (text or "").encode()
        n = max(1, -(-(len(data) - (quality.CHUNK - quality.HOP)) // quality.HOP))
        means = np.zeros(quality.FILTERS)
        for c in range(n):
            chunk = data[c * quality.HOP : c * quality.HOP + quality.CHUNK].ljust(quality.CHUNK, b"\0")
            best = np.full(quality.FILTERS, -np.inf)
            for at in range(0, quality.CHUNK - quality.WINDOW + 1, quality.STRIDE):
                window = np.concatenate([model.vectors[b] for b in chunk[at : at + quality.WINDOW]])
                best = np.maximum(best, window.astype(float) @ model.filters)
            means += np.maximum(best + model.filter_bias, 0) / n
        want = 1 / (1 + np.exp(-(means @ model.out + model.out_bias[0])))
        assert got[k] == pytest.approx(want, abs=1e-4)


def test_held_out_rows_of_the_tables(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang")
    told = entries.op2_langid(spark, LARGER).where("held_out").join(docs, "doc_id").where("lang is not null and lang_pred <> 'und'").selectExpr("avg(cast(lang = lang_pred as double)) a", "count(*) n").first()
    assert told.n > 1000 and told.a > 0.98
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", "quality")
    told = entries.op6_quality(spark, LARGER).where("held_out").join(labels, "doc_id").selectExpr("avg(cast(quality = predicted as double)) a", "count(*) n").first()
    assert told.n > 300 and told.a > 0.9


def test_models_on_odd_rows(spark):
    rng = random.Random(5)
    rows = [(k, prose(rng, ["one", "two", "three"] if k % 2 else ["eins", "zwei", "drei"], 20), "en" if k % 2 else "de", k) for k in range(60)]
    odd = [(None, "one two three", "en", 0), (7, rows[7][1], "en", 7), (7, rows[7][1], "en", 7), (200, "two three one " * 60_000, None, 0), (201, None, "de", 0), (202, "", None, 0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, held_out long")
    got = langid.digest(docs).collect()
    assert len(got) == 66 and all(r.held_out is not None for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[200].lang_pred == "en" and by_id[201].lang_pred == by_id[202].lang_pred == "und" and not by_id[None].held_out
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 7}) == 1
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    got = quality.digest(docs, labels).collect()
    assert len(got) == 66 and all(0 <= r.score <= 1 and r.held_out is not None and r.predicted == (r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id == 7}) == 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for found in (langid.digest(docs), quality.digest(docs, labels), matroska.digest(docs), spans.digest(docs), packing.digest(docs)):
        assert found.count() == 0


def test_op1_media_columns(spark):
    texts = ["text", "", "naïve 字 " * 3000]
    got = {r.doc_id: r for r in matroska.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        media = matroska.stored(text)
        raw = text.encode()
        assert (got[k].n_bytes, got[k].media_bytes, got[k].media_sha256) == (len(raw), len(media), hashlib.sha256(media).hexdigest())
        assert got[k].feature and (got[k].feature == got[0].feature) == (k == 0)
    again = {r.doc_id: r for r in matroska.digest(spark.createDataFrame([(9, texts[2])], "doc_id long, text string")).collect()}
    assert again[9][1:] == got[2][1:]


@pytest.fixture
def tables(spark, tmp_path):
    """Documents of which each stage removes some: junk, letterless ones, copies, and a shared passage."""
    rng = random.Random(9)
    english, german = [f"{a}{b}" for a in ("the", "ing", "ow", "ea", "st") for b in ("er", "on", "ly", "th", "ed")], [f"{a}{b}" for a in ("sch", "ung", "ei", "pf", "ü") for b in ("keit", "en", "ich", "tz", "au")]

    def said(words):
        return " ".join(prose(rng, words, 9).capitalize() + "." for _ in range(12))

    rows = [(k, said(english if k % 2 else german), "en" if k % 2 else "de") for k in range(120)]
    junk = [(200 + k, " ".join("$%" + str(rng.randint(0, 99)) + "!!" for _ in range(60)), "en") for k in range(60)]
    passage = " ".join(prose(rng, english, 9).capitalize() + "." for _ in range(8))
    more = [(300, rows[1][1], "en"), (301, rows[1][1] + " more", "en"), (302, passage + " " + said(english), "en"), (303, said(english) + " " + passage, "en"), (None, said(german), None), (5, said(english), "en"), (5, said(german), "de")]
    everything = [(*r, "s", len(r[1])) for r in rows + junk + more] + [(400, None, None, None, None), (401, "", "en", None, 0)]
    spark.createDataFrame(everything, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(120)] + [(200 + k, 0, 0) for k in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), passage


def test_what_each_stage_removes(spark, tables):
    folder, passage = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality classifier"](spark, docs, folder)
    left = [r.doc_id for r in good.collect()]
    assert good.columns == names and set(range(120)) <= set(left) and left.count(5) == 3 and None in left
    assert sum(200 <= (d or 0) < 260 for d in left) <= 2
    spoken = stage["language ID"](spark, good, folder)
    told = [r.doc_id for r in spoken.collect()]
    assert spoken.columns == names and set(range(120)) <= set(told) and not {400, 401} & set(told)
    single = stage["n-gram Jaccard join"](spark, spoken, folder)
    kept = [r.doc_id for r in single.collect()]
    assert sorted(set(told) - {None}) == sorted((set(kept) | {300, 301}) - {None}) and not {300, 301} & set(kept) and kept.count(5) == 3
    cut = stage["substring dedup"](spark, single, folder)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == names and passage in texts[302] and passage not in texts[303] and len(texts[303]) > 300
    assert {d for d in texts} == set(kept)
    packed = stage["best-fit packing"](spark, cut, folder)
    assert {r.doc_id for r in packed.collect()} == set(kept)


def test_pipeline_without_rows_or_labels(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == 0
    spark.createDataFrame([(1, "some words that are told", "en", "s", 9), (2, "other words to be told", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/b").collect()} == {1, 2}


def test_texts_of_any_length_are_read_whole():
    column = pa.array(["x" * 3_000_000 + "y"])
    data, offsets = utf8(column)
    assert offsets.tolist() == [0, 3_000_001] and data[-1] == ord("y")
