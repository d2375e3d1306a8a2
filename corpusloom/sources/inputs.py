"""Texts from a file, a folder or literals, results mirrored back, and a synthetic bilingual corpus for tests."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def collect_inputs(spark: SparkSession, path: str | None = None, literals: Sequence[str] = (), suffixes: Sequence[str] = ()) -> DataFrame:
    """``path``, ``text``: whole files (with one of the suffixes, if given), literal texts, or standard input if the path is ``-``."""
    if path == "-":
        return spark.createDataFrame([("stdin", sys.stdin.read())], "path string, text string")
    if path is None:
        return spark.createDataFrame([(f"literal-{i}", t) for i, t in enumerate(literals)], "path string, text string")
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).format("text").load(path)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    for_any = None
    for s in suffixes:
        hit = F.endswith(F.lower("path"), F.lit(s.lower()))
        for_any = hit if for_any is None else for_any | hit
    return rows if for_any is None else rows.where(for_any)


def write_mirrored(results: DataFrame, path: str, folder: str = "folder") -> None:
    """Texts below the folders they came from, with an index of all rows beside them."""
    results.select(folder, "text").write.partitionBy(folder).text(f"{path}/texts")
    results.drop("text").write.json(f"{path}/index")


def synthetic_pairs(spark: SparkSession, n: int, seed: int = 7, flaws: bool = False) -> DataFrame:
    """``id``, ``source``, ``target`` of invented marked-up pages; with ``flaws`` three broken pairs and one exact duplicate are added."""
    i = F.col("id")
    pick = F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(7)).cast("int") + 2
    body = F.concat_ws("\n\n", F.transform(F.sequence(F.lit(1), pick), lambda k: F.concat(F.lit("Paragraph "), k.cast("string"), F.lit(" of page "), i.cast("string"), F.lit(" tells **one** thing and [[span]]another[[/span]]."))))
    other = F.concat_ws("\n\n", F.transform(F.sequence(F.lit(1), pick), lambda k: F.concat(F.lit("第"), k.cast("string"), F.lit("段，页"), i.cast("string"), F.lit("，说**一**件事，[[span]]另一件[[/span]]。"))))
    head = F.concat(F.lit("[[module Rate]]\n+ Page "), i.cast("string"), F.lit("\n\n"))
    rows = spark.range(n).select(F.format_string("PAGE-%04d", i).alias("id"), F.concat(head, body).alias("source"), F.concat(head, other).alias("target"))
    if not flaws or not n:
        return rows
    first = rows.orderBy("id").limit(1)
    broken = spark.createDataFrame([("FLAW-EMPTY", "", "内容"), ("FLAW-SHORT", "tiny", "小"), ("FLAW-LATIN", "Some english text. " * 30, "Still english text. " * 30)], "id string, source string, target string")
    return rows.unionByName(broken).unionByName(first.withColumn("id", F.lit("FLAW-COPY")))
