"""Very long texts, empty tables and clashing columns through every operator and stage."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from corpusloom.llm import byte_bpe, fingerprints, jaccard_join, pii_crf, repeats, toxicity, transport_stream, warc, wrapper_induction
from corpusloom.llm.queries import tokenizer_path


def long_docs(spark):
    r = random.Random(1)
    words = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "x@y.example.com"]) + str(r.randrange(999)) for _ in range(200_000))
    rows = [(1, words, "s"), (2, "z" * 1_500_000, "s"), (3, "漢" * 400_000, None), (4, words, "s"), (5, " \n" * 300_000, "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)


def test_very_long_texts(spark):
    docs = long_docs(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    path = tokenizer_path()
    for r in byte_bpe.bpe_encode(docs, path, packed=True, decoded="decoded").collect():
        assert r.decoded == texts[r.doc_id]
    found = {r.doc_id: r.n for r in pii_crf.find_pii(docs).select("doc_id", F.size("pii_spans").alias("n")).collect()}
    assert found[1] == found[4] > 0 and found[2] == found[3] == found[5] == 0
    classes = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(docs).collect()}
    assert classes == {1: (1, 1), 4: (1, 1), 2: (2, 0), 3: (3, 0), 5: (5, 0)}
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in repeats.remove_repeats(docs).collect()}
    assert cut[4] == (200_000, 200_000) and cut[1][0] == 200_000 and cut[2] == (1, 0) and cut[5] == (0, 0)
    model = toxicity.ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -1.0, np.zeros(0), np.zeros(0))
    assert toxicity.score_texts(docs, model).count() == 5
    stored = transport_stream.store_payloads(docs.withColumn("payload", transport_stream.padded_payload(F.col("text"))))
    for r in transport_stream.read_media(stored).collect():
        assert bytes(r.payload).rstrip(b"\xff").decode() == texts[r.doc_id]
    pairs = {r.doc_id: r for r in fingerprints.edited_pairs(docs).collect()}
    assert pairs[1].own == pairs[4].own and pairs[5].own is None and pairs[2].edited.endswith(texts[1][:500_000][-20:])
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://h/").alias("url"), F.concat(F.lit("<article><p>"), "text", F.lit("</p></article>")).alias("html"))
    assert {r.page_id: r.text for r in wrapper_induction.main_text(pages).collect()}[2] == texts[2]
    assert warc.derivatives(warc.responses(pages)).count() == 10


def test_empty_tables_through_every_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_nulls_in_any_column_through_every_stage(spark, sf):
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "s", None), (3, "a b c d e f", "en", "s", 11), (3, "a b c d e f", "en", "s", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.collect()
    assert P.STAGES[-1][1](spark, docs, sf).count() == 5


def test_clashing_columns_through_stages(spark, sf):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (2, "g h i j k l", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    more = docs.selectExpr("*", "1 AS toxicity", "2 AS pii_spans", "3 AS copy_no", "4 AS shuffle_key", "5 AS class_id", "6 AS ids", "7 AS near", "8 AS member")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, more, sf)
        assert out.columns == more.columns
        assert {(r.toxicity, r.pii_spans, r.copy_no, r.shuffle_key, r.ids) for r in out.collect()} <= {(1, 2, 3, 4, 6)}
    assert P.STAGES[-1][1](spark, more, sf).count() == 2
