"""The registry of queries over the standard tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the equivalent SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: A text with markup, made of a document by the same SQL on both engines.
SOURCE_SQL = (
    """concat('[[div class="bq"]]', chr(10), '**Item:** ', doc_id, chr(10), text, chr(10), '[[/div]]', chr(10), """
    """'[[include :wiki:component:box |name=', source, ']]', chr(10), '[[module Rate]]', chr(10), '{{{', lang, '  code}}} https://', source, '.example.org/x).', chr(10), '+ Head', chr(10), '> quote')"""
)
#: Its damaged copy.
HYPOTHESIS_SQL = (
    "CASE doc_id % 7 WHEN 1 THEN replace(src, '[[/div]]', '') WHEN 2 THEN replace(src, '[[module Rate]]', '[[module 评分]]')"
    " WHEN 3 THEN replace(src, 'name=', '') WHEN 4 THEN '' WHEN 5 THEN replace(replace(src, '**', '*'), '  code', ' kode') WHEN 6 THEN concat(src, chr(10), '[[include :wiki-xx:component:new-source]] ', src) ELSE src END"
)


def marked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with ``src`` and ``hyp``."""
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents").withColumn("src", F.expr(SOURCE_SQL.replace("doc_id,", "cast(doc_id AS string),")))
    return docs.withColumn("hyp", F.expr(HYPOTHESIS_SQL))


MARKED_UP = f"marked AS (SELECT *, {HYPOTHESIS_SQL} AS hyp FROM (SELECT *, {SOURCE_SQL} AS src FROM documents))"
