"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from corpusloom.llm import byte_bpe, fingerprints, jaccard_join, mixing, pii_crf, repeats, toxicity, transport_stream, warc, wrapper_induction
from corpusloom.llm.common import scratch, spread, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the machine keeps a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))))


def op2_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.edited_pairs(table(spark, sf_dir, "documents"))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.packed_text(F.col("own")).alias("fingerprint"),
        fingerprints.packed_text(F.col("changed")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        fingerprints.likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


def op3_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("kept")


def op9_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_crf.find_pii(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    base = F.filter("pii_spans", lambda s: ~s["kind"].startswith("crf_"))
    kinds = F.transform("pii_spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in pii_crf.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii_crf.joined(base), 256).alias("base_sha256"), pii_crf.joined(F.col("pii_spans")).alias("spans"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    both = byte_bpe.bpe_encode(docs, path, packed=True, decoded="decoded")
    return both.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    with scratch():
        model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_texts(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op5_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return wrapper_induction.main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    given = docs.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        transport_stream.padded_payload(F.col("text")).alias("payload"),
    )
    stored = transport_stream.store_payloads(given).select(
        "*", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")
    )
    back = transport_stream.read_media(stored)
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, octet_length(payload) - 31, 32)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        transport_stream.features(back).alias("feature"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_one_permutation": op2_one_permutation,
    "op3_poisson_mix": op3_poisson_mix,
    "op4_weak_toxicity": op4_weak_toxicity,
    "op5_wrapper_induction": op5_wrapper_induction,
    "op6_transport_stream": op6_transport_stream,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_recompression": op8_recompression,
    "op9_pii_crf": op9_pii_crf,
    "op10_bpe": op10_bpe,
}

ORACLES: dict[str, str] = {
    "op3_poisson_mix": mixing.ORACLE,
    "op8_recompression": repeats.ORACLE,
}
