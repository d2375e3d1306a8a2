"""Mixing sources to target weights by Poisson replication.

Each document is repeated ``k`` times, where ``k`` is drawn from a Poisson
distribution whose mean is its source's target repetition rate

    rate(source) = total * weight(source) / sum(weights) / rows(source).

The draw inverts the distribution at a uniform number taken from a hash of the
document, so that it does not depend on partitioning, retries or executor loss.
A rate above ``CHUNK`` is split into equal parts with a draw each (a sum of
Poisson variables is one), which keeps ``exp(-rate)`` away from underflow.

Only DataFrame functions are used.  The rows are shuffled once, by the random
key that gives them their global order; a source with a third of all rows is
counted by partial aggregation and never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import require, with_columns

#: Largest mean that one draw inverts, and the terms kept of its distribution (the rest is below 1e-25).
CHUNK, TERMS = 16.0, 96
#: Sources beyond this number are joined by a shuffle, not by a broadcast table.
BROADCAST_SOURCES = 10_000


def _bits(seed: int, *parts: Column) -> Column:
    """A uniform integer below 2**52 from the MD5 of the parts."""
    joined = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts))
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long")


def _cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step)["all"]


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None) -> DataFrame:
    """One row per source: ``source``, ``n_rows``, ``rate``.

    ``weights`` maps sources to non-negative weights; a source it does not name
    gets weight 0.  Without it all sources weigh the same.  ``total`` is the
    expected number of rows of the mixture, by default the input's.
    A null source is a source of its own (its weight is under the key ``None``).
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    if weights is None:
        weight: Column = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            if value < 0:
                raise ValueError("weights must not be negative")
            same = F.col("source").isNull() if name is None else F.col("source") == name
            weight = F.when(same, F.lit(float(value))).otherwise(weight)
    counts = counts.withColumn("weight", weight)
    sums = counts.agg(F.sum("weight").alias("weight"), F.sum("n_rows").alias("rows")).first()
    goal = float(sums["rows"] or 0) if total is None else float(total)
    rate = F.try_divide(F.lit(goal) / F.col("n_rows"), F.lit(float(sums["weight"] or 0))) * F.col("weight")
    return counts.select("source", "n_rows", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: int = 17, copy_no: str = "copy_no", shuffle_key: str = "shuffle_key") -> DataFrame:
    """Repeat documents by Poisson counts and shuffle the copies globally.

    Needs ``doc_id`` and ``source``; all columns pass through, and ``copy_no``
    (1, 2, ...) and ``shuffle_key`` (the sort key of the global order) are added.
    Input columns of these two names give way.

    * Null ``doc_id`` or ``source``: kept; a null takes part as a value of its own.
    * Empty and very long texts: the text plays no role in the draw.
    * Repeated rows with one ``doc_id`` and source draw the same count and keep it each.
    * Ties of ``shuffle_key`` (improbable) are ordered by ``doc_id`` and ``copy_no``.
    * Empty input: an empty result.
    """
    require(docs, "doc_id", "source")
    rates = source_rates(docs, weights, total)
    parts = F.greatest(F.ceil(F.col("rate") / F.lit(CHUNK)), F.lit(1)).cast("int")
    rates = rates.select(F.col("source").alias("__source"), parts.alias("__parts"), _cdf(F.col("rate") / parts).alias("__cdf"))
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = docs.join(F.broadcast(rates) if few else rates, docs["source"].eqNullSafe(F.col("__source")), "inner")

    # Each draw is bound to a lambda variable: written into the filter it would be made anew for every entry of the table.
    draws = F.transform(F.sequence(F.lit(1), F.col("__parts")), lambda j: _bits(seed, docs["doc_id"], docs["source"], j) / F.lit(float(1 << 52)))
    count = F.aggregate(F.transform(draws, lambda u: F.size(F.filter(F.col("__cdf"), lambda c: c <= u))), F.lit(0), lambda n, k: n + k)
    counted = joined.withColumn("__count", count).where("__count > 0")
    copies = counted.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__count"))))
    key = _bits(seed + 1, docs["doc_id"], docs["source"], F.col("__copy"))
    out = with_columns(copies, {copy_no: F.col("__copy"), shuffle_key: key})
    return out.drop("__source", "__parts", "__cdf", "__count", "__copy").orderBy(shuffle_key, "doc_id", copy_no)


ORACLE = """
WITH counts AS (SELECT source, count(*) AS n_rows FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT count(*) FROM documents)::DOUBLE / (SELECT count(*) FROM counts) / n_rows AS rate FROM counts),
parts AS (SELECT source, greatest(ceil(rate / 16.0), 1)::INT AS m, rate FROM rates),
cdf AS (SELECT source, m, k, sum(exp(-rate / m + k * ln(rate / m) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
        FROM parts, range(0, 97) AS t(k)),
draws AS (SELECT d.doc_id, d.source, j,
            ('0x' || substr(md5('17:' || d.doc_id || ':' || d.source || ':' || j), 1, 13))::BIGINT / 4503599627370496.0 AS u
          FROM documents d JOIN parts USING (source), range(1, parts.m + 1) AS t(j)),
n AS (SELECT doc_id, draws.source, count(*) AS n FROM draws JOIN cdf ON draws.source = cdf.source AND cdf.c <= draws.u GROUP BY ALL)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c::INT AS copy_no,
  ('0x' || substr(md5('18:' || d.doc_id || ':' || d.source || ':' || c), 1, 13))::BIGINT AS shuffle_key
FROM documents d JOIN n USING (doc_id), range(1, n.n + 1) AS t(c)
"""
