"""Structure-aware chunks: cut at headings and paragraphs, within token bounds, headings repeated."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import split_paragraphs
from corpusloom.operators.windows import count_words, sentence_pieces


def chunk_paragraphs(paragraphs: list[str], least: int, most: int, measure: Callable[[str], int] = count_words, repeat: bool = True) -> list[list[str]]:
    """Groups of paragraphs of at most ``most`` tokens.

    A heading (a paragraph that begins with ``+`` and a blank) closes a group that
    has ``least`` tokens already; a group that begins inside a section repeats its
    heading; an oversize paragraph is cut by sentences.
    """
    groups: list[list[str]] = []
    current, size, heading = [], 0, None

    def close() -> None:
        nonlocal current, size
        if current and current != [heading]:
            groups.append(current)
        current, size = [], 0

    for paragraph in paragraphs:
        first = paragraph.split("\n", 1)[0]
        is_heading = first.startswith("+") and first.lstrip("+").startswith(" ")
        if is_heading:
            if size >= least:
                close()
            heading = first
        room = most - (measure(heading) if repeat and heading and not is_heading else 0)
        for piece in [paragraph] if measure(paragraph) <= room else sentence_pieces(paragraph, max(1, room), measure):
            cost = measure(piece)
            if current and size + cost > most:
                close()
            if not current and repeat and heading and not is_heading:
                current, size = [heading], measure(heading)
            current.append(piece)
            size += cost
    close()
    return groups


def structured_chunks(df: DataFrame, row_id: str, text: str, least: int = 1200, most: int = 2400, measure: Callable[[str], int] = count_words) -> DataFrame:
    """``id``, ``chunk``, ``text``, ``tokens``."""
    given = df.select(F.col(row_id).cast("string").alias("id"), split_paragraphs(F.col(text)).alias("paragraphs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, paragraphs in zip(batch["id"], batch["paragraphs"], strict=True):
                for i, group in enumerate(chunk_paragraphs(list(paragraphs), least, most, measure)):
                    joined = "\n\n".join(group)
                    rows.append((key, i, joined, measure(joined)))
            yield pd.DataFrame(rows, columns=["id", "chunk", "text", "tokens"])

    return given.mapInPandas(run, "id string, chunk int, text string, tokens int")
