import hashlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as P
from corpusloom.llm import pii_crf, toxicity
from corpusloom.llm.queries import tokenizer_path


def test_stages_against_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    kept = P.drop_toxic(spark, docs, sf)
    assert kept.columns == columns
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    wanted = {r.doc_id for r in toxicity.score_texts(docs, model).collect() if r.toxicity < toxicity.THRESHOLD}
    assert {r.doc_id for r in kept.collect()} == wanted

    from tests.llm.test_jaccard_join import brute

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    single = P.drop_near_duplicates(spark, kept, sf)
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted({c for _, c, _ in brute(rows)})

    masked = P.mask_personal_data(spark, single, sf)
    assert masked.columns == columns
    for r in masked.collect():
        assert r.n_chars == len(r.text) and not pii_crf.base_spans(r.text)
        if not pii_crf.base_spans(before[r.doc_id].text):
            assert r.lang == before[r.doc_id].lang

    mixed = P.mix_sources(spark, masked, sf)
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in masked.collect()}

    texts = {r.doc_id: r.text for r in masked.collect()}
    library = Tokenizer.from_file(tokenizer_path())
    for r in P.tokenise(spark, mixed, sf).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        assert bytes(r.ids) == packed and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_keeps_clean_documents(spark, sf):
    out = P.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)


def test_repeated_and_null_ids(spark, sf):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (None, "a b c d e f", "en", "s", 11), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.drop_near_duplicates(spark, docs, sf).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 2]
    assert P.mask_personal_data(spark, docs, sf).count() == 4


def test_no_text_is_lost_with_repeated_ids(spark, sf):
    rows = [(1, "a b c d e f g", "x"), (1, "h i j k l m n", "x"), (1, "h i j k l m n", "w"), (2, "h i j k l m n", "x"), (1, "", "x"), (1, " ", "x"), (None, "q", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for part in (1, 3):
        kept = [tuple(r) for r in P.drop_near_duplicates(spark, docs.repartition(part), sf).collect()]
        assert sorted(kept, key=str) == sorted([(1, "a b c d e f g", "x"), (1, "h i j k l m n", "w"), (1, "", "x"), (1, " ", "x"), (None, "q", "x")], key=str)
