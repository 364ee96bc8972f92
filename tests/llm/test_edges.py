"""Every operator on empty tables, nulls, empty and very long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import pytest
from .conftest import EDGES
from pyspark.sql import functions as F

from cloudloom.llm import common, decontaminate, html, language, licenses, media, packing, pii, quality, simhash, toxicity

SENTENCE = {"en": "the of and to is that it for was with house people", "de": "der die und das ist nicht mit auf haus leute"}


def learned(spark):
    docs = spark.createDataFrame([(i, f"{SENTENCE[lang]} {'idiot' if i % 3 == 0 else 'nice'} w{i}", lang) for i, lang in enumerate(["en", "de"] * 30)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 != 1), int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    return docs, labels


def op_packing(spark, docs):
    return packing.pack_documents(docs)


def op_simhash(spark, docs):
    return simhash.simhash_components(docs)


def op_keep(spark, docs):
    return simhash.keep_one(docs)


def op_contamination(spark, docs):
    return decontaminate.contamination(docs, spark.createDataFrame([(1, "again and again"), (2, None), (3, "")], "item_id long, text string"))


def op_remove(spark, docs):
    return decontaminate.remove_contaminated(docs, spark.createDataFrame([(1, "again and again")], "item_id long, text string"))


def op_licenses(spark, docs):
    return licenses.scan_licenses(docs)


def op_pii(spark, docs):
    return pii.find_personal_data(docs)


def op_sanitise(spark, docs):
    return pii.sanitise(docs)


def op_language(spark, docs):
    return language.identify(docs, language.learn(learned(spark)[0]))


def op_quality(spark, docs):
    known, labels = learned(spark)
    vectors = spark.sparkContext.broadcast(quality.word_vectors(known))
    return quality.score_quality(docs, quality.train(known, labels, vectors), vectors)


def op_toxicity(spark, docs):
    known, labels = learned(spark)
    return toxicity.score_toxicity(docs, toxicity.learn(known, labels))


def op_clean(spark, docs):
    return toxicity.keep_clean(docs, toxicity.Convolution())


ROWS = {op_packing: None, op_simhash: 12, op_keep: None, op_contamination: 12, op_remove: 12, op_licenses: 12, op_pii: 12, op_sanitise: 12, op_language: 12, op_quality: 12, op_toxicity: 12, op_clean: 12}


@pytest.mark.parametrize("op", list(ROWS), ids=lambda f: f.__name__)
def test_edges(spark, frame, op):
    out = op(spark, frame(EDGES)).collect()
    if ROWS[op] is not None:
        assert len(out) == ROWS[op]
    assert op(spark, frame([])).collect() == []


CLASH = ("_row", "_text", "_words", "_hits", "_at", "_w", "_g", "_told", "_kept", "node", "root", "fp", "pos")


def test_stages_keep_columns_and_their_values(spark, frame):
    docs = frame(EDGES, extra=False).withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(0))) for c in CLASH})
    docs = simhash.checkpoint(docs)
    for op in (op_keep, op_remove, op_sanitise, op_clean):
        out = op(spark, docs)
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[c] == f"{c}{r.doc_id or 0}" for c in CLASH), (op.__name__, r.doc_id)


def test_a_repeated_doc_id_teaches_one_text(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    rows, sizes = common.labelled_sample(docs, labels, "toxic", 10)
    assert sorted(map(tuple, rows.collect())) == [("", 1), ("c", 0)] and sizes == {1: 1, 0: 1}


def test_defined_results(spark, frame):
    docs = frame(EDGES)
    packed = {r.doc_id: r for r in op_packing(spark, docs).where("doc_id in (1, 2)").collect()}
    assert packed[1].length == packed[2].length == 1
    fps = {r.doc_id: r for r in op_simhash(spark, docs).collect()}
    assert fps[1].fp == fps[2].fp == fps[3].fp == 0 and fps[1].component_id == fps[3].component_id == 1
    assert fps[6].component_id == fps[7].component_id == 6
    langs = {r.doc_id: r for r in op_language(spark, docs).collect()}
    assert langs[1].lang_pred == langs[5].lang_pred == "und" and langs[1].score == 0
    lic = {r.doc_id: r for r in op_licenses(spark, docs).collect()}
    assert lic[1].n_words == 0 and lic[1].first_word is None and lic[1].detections == []
    hits = {r.doc_id: r for r in op_contamination(spark, docs).collect()}
    assert hits[1].n_words == 0 and hits[1].items == [] and hits[6].n_hit == 3 and hits[6].items == ["1"]
    kept = op_keep(spark, docs).select("doc_id").where("doc_id is not null").collect()
    assert sorted(r[0] for r in kept if r[0] in (1, 2, 3, 6, 7)) == [1, 6]


def test_untaught_classifiers(spark, frame):
    docs = frame(EDGES, extra=False)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.sparkContext.broadcast(quality.word_vectors(docs))
    assert {r.score for r in quality.score_quality(docs, quality.train(docs, none, vectors), vectors).collect()} == {0.5}
    assert {r.score for r in toxicity.score_toxicity(docs, toxicity.learn(docs, none)).collect()} == {0.0}
    model = language.learn(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.identify(docs, model).collect()} == {"und"}


def test_copies_teach_a_language_once(spark, monkeypatch):
    """A hundred thousand copies of one text weigh as one; each language gives its least texts by hash, no more."""
    seen = []
    monkeypatch.setattr(language, "Model", lambda langs, counts, in_script: seen.append((langs, counts, in_script)))
    rows = spark.range(100_000).selectExpr("'der hund und die katze' as text", "'de' as lang")
    more = spark.range(300).selectExpr("concat('the word', id, ' here') as text", "'en' as lang")
    language.learn(rows.unionByName(more).repartition(8), sample_rows=50)
    (langs, counts, in_script), = seen
    assert langs == ["de", "en"] and in_script.sum(0).tolist() == [5.0, 150.0]


def test_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "plain & text"), (None, "u", "<p>a<p>b"), (5, "u", "<div " * 2000), (6, "u", "<p>" + "word " * 50_000), (6, "u", "<a 'b>" * 100)]
    out = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    by = {r.page_id: r for r in out}
    assert len(out) == 7 and by[1].text == by[2].text == "" and by[3].text == "plain & text" and by[None].text == "a b" and by[6].n_chars >= 0
    assert html.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_media_edges(spark):
    rows = [(1, None), (2, b""), (3, b"P5 junk"), (4, b"\x89PNG\r\n\x1a\n"), (4, b"P5\n2 2\n255\nabcd"), (None, b"x")]
    out = media.find_copies(spark.createDataFrame(rows, "image_id long, media binary")).collect()
    assert len(out) == 6 and all(r.n_corners == 0 for r in out)
    assert {r.class_id for r in out if r.image_id in (1, 2)} == {1}
    assert media.find_copies(spark.createDataFrame([], "image_id long, media binary")).collect() == []
