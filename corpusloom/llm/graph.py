"""Connected components of an undirected graph by Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, materialise

#: Sides of up to so many rows (of a few numbers each) are broadcast; larger ones meet salted keys.
BROADCAST_ROWS, SALTS = 200_000, 16


def lookup(df: DataFrame, column: str, side: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Left join of ``df.column`` with a table ``side`` whose ``key`` is unique, also if one value of ``column`` has very many rows.

    A side of few rows (``rows`` at most, else they are counted) is broadcast.  Otherwise rows of ``df`` are dealt
    by a salt, and ``side`` is copied once for each salt, so a frequent value meets ``SALTS`` tasks.
    """
    right = side.withColumnRenamed(key, "__key")
    if (side.count() if rows is None else rows) <= BROADCAST_ROWS:
        return df.join(F.broadcast(right), F.col(column) == F.col("__key"), "left").drop("__key")
    dealt = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = (F.col(column) == F.col("__key")) & (F.col("__salt") == F.col("__copy"))
    return dealt.join(copies, on, "left").drop("__key", "__copy", "__salt")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Columns ``node`` and ``component`` (its least node) for every node of ``edges`` (``a``, ``b``).

    Each round contracts the graph: a label hooks to its least neighbouring
    label if that is smaller, chains of hooks are shortened, and edges are
    renamed.  At least half of the labels that still have edges vanish in a
    round.  Only minima and lookups of unique keys are used, and lookups split
    frequent keys, so a node with very many edges costs no task more than others;
    each round is written to the shared folder, which cuts the lineage.  Edges with
    a null end are ignored; loops and repeated edges do no harm; no edges give no rows.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = materialise(pairs, f"{name}-edges")
    labels = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().withColumn("component", F.col("node"))
    left = pairs.where("a <> b")
    step, n, done = 0, left.count(), None
    while n:
        hooks = left.groupBy("a").agg(F.min("b").alias("to"))
        for _ in range(2):  # a hook's target may hook further down
            further = hooks.select(F.col("a").alias("key"), F.col("to").alias("next"))
            hooks = lookup(hooks, "to", further, "key", n).select("a", F.coalesce("next", "to").alias("to"))
        hooks = materialise(_few_files(hooks, n), f"{name}-hooks-{step}")
        low = hooks.select(F.col("a").alias("key"), F.col("to").alias("low"))
        labels = lookup(labels, "component", low, "key", n).select("node", F.coalesce("low", "component").alias("component"))
        labels = materialise(labels, f"{name}-labels-{step}")
        left = lookup(left, "a", low, "key", n).select(F.coalesce("low", "a").alias("a"), "b")
        left = lookup(left, "b", low, "key", n).select("a", F.coalesce("low", "b").alias("b"))
        left = left.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        left = materialise(_few_files(left, n), f"{name}-edges-{step}")
        discard(pairs, hooks, *([done] if done is not None else []))
        pairs, done = left, labels
        step, n = step + 1, left.count()
    return labels


def _few_files(df: DataFrame, rows: int) -> DataFrame:
    """A table of few rows in few files."""
    return df.coalesce(8) if rows <= BROADCAST_ROWS else df
