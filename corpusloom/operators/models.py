"""Hooks for models: token counters, embedders and generators, run by Arrow batches with one instance a worker."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import side_hash, split_paragraphs, user_prompt, whitespace_tokens
from corpusloom.operators.chat import render, to_messages


class TokenCounter(Protocol):
    def __call__(self, texts: Sequence[str]) -> Sequence[int]: ...


class Embedder(Protocol):
    name: str

    def __call__(self, texts: Sequence[str]) -> np.ndarray: ...


class Generator(Protocol):
    def __call__(self, prompts: Sequence[str]) -> Sequence[str]: ...


@lru_cache(maxsize=4)
def _made(factory: Callable):
    return factory()


def count_tokens(texts: Column, factory: Callable[[], TokenCounter] | None = None, step: int = 4096) -> Column:
    """Tokens per text; without a factory, words between white space (no Python)."""
    if factory is None:
        return whitespace_tokens(texts)

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _made(factory)
        for batch in batches:
            values = batch.fillna("").tolist()
            yield pd.Series([n for at in range(0, len(values), step) for n in counter(values[at : at + step])])

    return run(texts)


def prompt_overhead(template: str, system: str, counter: TokenCounter, margin: int = 8) -> int:
    """Tokens of the system text and the empty template, and a margin."""
    return counter([f"{system}\n{template.replace('{source}', '')}"])[0] + margin


def window_cost(source: Column, target: Column, overhead: int, count: Callable[[Column], Column] = whitespace_tokens) -> Column:
    return F.lit(overhead) + count(source) + count(target)


def inference_budget(context: int, overhead: int, max_new: int, margin: int = 0) -> int:
    """Tokens left for the source of one window."""
    budget = context - overhead - max_new - margin
    if budget <= 0:
        raise ValueError("nothing is left for the source")
    return budget


class HashEmbedder:
    """A fixed embedder without a model: signed counts of hashed words, normalised."""

    def __init__(self, width: int = 64):
        self.width, self.name = width, f"hash-{width}"

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.sha1(word.encode()).digest()[:8], "big")
                out[i, h % self.width] += 1 if h >> 32 & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(paragraphs: DataFrame, text: str, factory: Callable[[], Embedder] = HashEmbedder, step: int = 256) -> DataFrame:
    """Add ``vec``; inside a batch texts are ordered by length, so that a padding model wastes little."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _made(factory)
        for batch in batches:
            texts = batch.fillna("").tolist()
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            out: list = [None] * len(texts)
            for at in range(0, len(order), step):
                part = order[at : at + step]
                for i, v in zip(part, model([texts[i] for i in part]), strict=True):
                    out[i] = v
            yield pd.Series(out)

    return paragraphs.withColumn("vec", run(text))


def paragraphs_of(pages: DataFrame, doc: str, source: str, target: str, split: Callable[[Column], Column] = split_paragraphs) -> DataFrame:
    """``doc``, ``side``, ``idx``, ``text``, ``side_hash`` of pages whose both sides have paragraphs, as ``split`` finds them."""
    sides = pages.select(F.col(doc).cast("string").alias("doc"), split(F.col(source)).alias("s"), split(F.col(target)).alias("t"))
    kept = sides.where((F.size("s") > 0) & (F.size("t") > 0))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("side"), F.col(n).alias("ps"), side_hash(F.col(n)).alias("hash")) for n in ("s", "t"))))
    return kept.select("doc", rows.alias("x")).select("doc", "x.side", F.col("x.hash").alias("side_hash"), F.posexplode("x.ps").alias("idx", "text"))


def warm_up(pages: DataFrame, cache: DataFrame, doc: str, source: str, target: str, factory: Callable[[], Embedder] = HashEmbedder, name: str = "hash-64") -> DataFrame:
    """Rows that an embedding cache (``doc``, ``side``, ``idx``, ``vec``, ``side_hash``, ``model``) lacks, computed."""
    keys = ["doc", "side", "side_hash", "model"]
    todo = paragraphs_of(pages, doc, source, target).withColumn("model", F.lit(name))
    misses = todo.join(cache.select(*keys).distinct(), keys, "left_anti")
    return embed(misses, "text", factory).select("doc", "side", "idx", "vec", "side_hash", "model")


def write_embeddings(rows: DataFrame, path: str) -> None:
    """Append to a cache that is partitioned by model; documents are told apart by column, not by file name."""
    rows.write.mode("append").partitionBy("model").parquet(path)


def generate(df: DataFrame, source: str, template: str, factory: Callable[[], Generator], system: str = "") -> DataFrame:
    """Add ``prompt`` (rendered) and ``hypothesis``."""
    messages = to_messages(user_prompt(F.col(source), template), F.lit(""), F.lit(system) if system else None)
    asked = F.slice(messages, F.lit(1), F.size(messages) - 1)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _made(factory)
        for batch in batches:
            yield pd.Series(list(model(batch.tolist())))

    prompted = df.withColumn("prompt", render(asked, generation=True))
    return prompted.withColumn("hypothesis", run("prompt"))
