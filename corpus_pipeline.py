"""A training-corpus pipeline over ``documents``: each stage applies one operator to all that its predecessor kept.

``STAGES`` lists (name, function); a function takes ``(spark, docs, sf_dir)``.
All but the last return the columns of ``documents``.  ``run`` writes each stage's
rows to the shared folder and reads them again as the next one's input.

``ORACLE_SQL`` is None: SQL can express neither the trained toxicity scores nor
the tokenizer's merges.  ``tests/llm/test_pipeline.py`` holds the stages against
brute-force versions instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import byte_bpe, jaccard_join, mixing, pii_crf, toxicity
from corpusloom.llm.common import discard, materialise, scratch, table, text_of
from corpusloom.llm.queries import tokenizer_path

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the model learns from ``labels`` by its own rule.

    Null and empty texts score alike, as the model says; texts are scored whole.
    Rows are judged one by one, so repeated rows stay or go together.  Extra columns
    pass through.  An empty table stays empty.
    """
    with scratch():
        model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_texts(docs, model, output="__toxicity")
    return scored.where(F.col("__toxicity") < toxicity.THRESHOLD).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the least ``doc_id``, of several texts of it the one with the least hash.

    Rows equal in ``doc_id`` and text are copies, of which the least by all columns
    stays; rows of one ``doc_id`` with different texts are different documents.  Rows
    without words (null, empty, white space) or without ``doc_id`` all stay.  Texts are
    compared whole.  Extra columns pass through.  An empty table stays empty.
    """
    keys = ["__doc", "__hash"]
    with scratch() as made:
        classes = jaccard_join.jaccard_classes(docs, detailed=True).where("class_key IS NOT NULL")
        copies = classes.groupBy("class_key", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
        first = copies.groupBy("class_key").agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("first"))
        chosen = first.select(F.col("first.doc_id").alias("__doc"), F.col("first.text_hash").alias("__hash"), "first.n")
        chosen = made.keep(materialise(chosen, "chosen"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(*columns, F.col("doc_id").cast("bigint").alias("__doc"), jaccard_join.text_hash().alias("__hash"))
    kept = keyed.join(chosen.select(*keys), keys, "left_semi")
    if not chosen.where("n > 1").isEmpty():
        kept = kept.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("row")).select("row.*")
    words = text_of().rlike(r"[^\x20\x09-\x0D]")
    return kept.select(*columns).unionByName(docs.where(F.col("doc_id").isNull() | ~words).select(*columns))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind; ``n_chars`` follows the text.

    A null text stays null (and so does its ``n_chars``), an empty one empty.  Rows are
    masked one by one and whole.  Extra columns pass through.  An empty table stays empty.
    """
    masked = pii_crf.mask_pii(docs)
    return masked.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards equal weights of all sources, in random order.

    A null ``source`` is a source of its own; texts, null or not, are only copied.  Rows
    of one ``doc_id`` are drawn alike.  Extra columns pass through.  An empty table stays empty.
    """
    return mixing.poisson_mix(docs, copy_no="__copy_no", shuffle_key="__shuffle_key").select(*(F.col(f"`{c}`") for c in docs.columns))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them.

    Null and empty texts have no tokens.  Texts are encoded whole, row by row: repeated
    rows give repeated results.  Only ``doc_id``, ``source`` and ``text`` are read.  An
    empty table stays empty.
    """
    path = tokenizer_path()
    both = byte_bpe.bpe_encode(docs.select("doc_id", "source", "text"), path, packed=True, decoded="decoded")
    return both.select("doc_id", "source", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", mask_personal_data),
    ("mixing sources", mix_sources),
    ("BPE", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a table between two stages is deleted as soon as the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            docs = made.keep(materialise(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
