"""Joins with the semantics of corpus jobs: pairing, references, resuming, caches."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both sides by key; an unmatched row has nulls on the other side."""
    return left.join(right, key, "full_outer")


def matched(pairs: DataFrame, left: str, right: str) -> DataFrame:
    return pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull())


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def with_reference(predictions: DataFrame, references: DataFrame, key: str, columns: Sequence[str], order: str, separator: str = "::", required: bool = False) -> DataFrame:
    """Reference columns by id, else by the id before the separator (of several references the first in ``order``).

    With ``required`` a row without reference is an error.
    """
    head = F.substring_index(F.col(key), separator, 1)
    exact = references.select(F.col(key), *(F.col(c).alias(f"__a_{c}") for c in columns)).dropDuplicates([key])
    first = references.groupBy(head.alias("__head")).agg(*(F.min_by(c, order).alias(f"__b_{c}") for c in columns))
    rows = predictions.join(exact, key, "left").withColumn("__head", F.substring_index(F.col(key), separator, 1)).join(first, "__head", "left")
    found = {c: F.coalesce(f"__a_{c}", f"__b_{c}") for c in columns}
    if required:
        found = {c: F.coalesce(v, F.raise_error(F.concat(F.lit("no reference for "), F.col(key))).cast("string")) for c, v in found.items()}
    return rows.withColumns(found).drop("__head", *(f"__{s}_{c}" for s in "ab" for c in columns))


def in_order(moves: DataFrame, pages: DataFrame, doc: str, pos: str) -> DataFrame:
    """Documents that are in both tables, in the order in which they first stand in ``moves``."""
    first = moves.groupBy(doc).agg(F.min(pos).alias("__first"))
    return pages.join(first, doc).orderBy("__first", doc).drop("__first")


def union_keys(*tables: DataFrame, key: str) -> DataFrame:
    """The distinct keys of all tables, and in how many of them each stands."""
    every = None
    for t in tables:
        own = t.select(key).distinct()
        every = own if every is None else every.unionByName(own)
    return every.groupBy(key).agg(F.count(F.lit(1)).alias("tables"))


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``done`` yet."""
    return todo.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def probe(df: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``hit``: whether the cache has the row's key."""
    known = cache.select(*keys).distinct().withColumn("__hit", F.lit(True))
    return df.join(known, list(keys), "left").withColumn("hit", F.coalesce("__hit", F.lit(False))).drop("__hit")


def chosen(df: DataFrame, column: str, include: Sequence[str], other: str, exclude: Sequence[str]) -> DataFrame:
    """Rows whose ``column`` is listed and whose ``other`` matches no glob."""
    kept = df.where(F.col(column).isin(*include)) if include else df
    for glob in exclude:
        pattern = fnmatch.translate(glob)
        kept = kept.where(~F.rlike(F.col(other), F.lit(pattern)))
    return kept


def band(rows: DataFrame, columns: DataFrame, doc: str, n: str, m: str, width: int) -> DataFrame:
    """Pairs (i, j) of a document inside the band around the diagonal; indices from 1, sizes ``n`` and ``m`` given per row."""
    centre = F.col("i") * F.col(m) / F.col(n)
    low = F.greatest(F.lit(1), F.floor(centre - width).cast("int"))
    high = F.least(F.col(m), F.floor(centre + width).cast("int") + 1)
    bounded = rows.withColumns({"__low": low, "__high": high})
    return bounded.join(columns, [bounded[doc] == columns[doc], F.col("j").between(F.col("__low"), F.col("__high"))]).drop(columns[doc]).drop("__low", "__high")


def common(want: DataFrame, got: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Multiset comparison: per key the numbers wanted and got, and how many are preserved."""
    a = want.groupBy(*keys).agg(F.count(F.lit(1)).alias("want"))
    b = got.groupBy(*keys).agg(F.count(F.lit(1)).alias("got"))
    both = a.join(b, list(keys), "left").withColumn("got", F.coalesce("got", F.lit(0)))
    return both.withColumn("preserved", F.least("want", "got"))
