"""Order statistics by three index rules.

``floor_index``, ``upper_median`` and ``nearest_even`` are aggregates (Column ->
Column) that sort the values of a group in one row, for small groups.
``order_statistics`` finds the same values of a whole column without gathering it.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _at(values: Column, index: Column) -> Column:
    return F.element_at(F.sort_array(F.collect_list(values)), (index + 1).cast("int"))


def floor_index(values: Column, p: float) -> Column:
    """sorted[int(p * (n - 1))]."""
    return _at(values, F.floor(F.lit(p) * (F.count(values) - 1)))


def upper_median(values: Column) -> Column:
    """sorted[n // 2]."""
    return _at(values, F.floor(F.count(values) / 2))


def nearest_even(values: Column, p: float) -> Column:
    """sorted[round(p * (n - 1))], halves to the even index."""
    return _at(values, F.bround(F.lit(p) * (F.count(values) - 1)))


#: Ranges of values whose counts come to the driver.
RANGES = 256


def _index(rule: str, p: float, n: int) -> int:
    if rule == "floor":
        return int(p * (n - 1))
    if rule == "upper":
        return n // 2
    if rule == "nearest":
        return round(p * (n - 1))
    raise ValueError(f"unknown rule {rule}")


def order_statistics(df: DataFrame, value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row with a column for each of ``wanted``, which names a rule (``floor``, ``upper`` or ``nearest``) and a share.

    Values are computed and counted once; the counts are kept on the executors' disks until the result is known, and cut
    into ``RANGES`` ranges by approximate percentiles, inside which they are summed in order.  Nulls are left out; without
    values all columns are null.  Ties, repeated rows and other columns make no difference.
    """
    # Filters on the value itself would be pushed below all that computes it, and repeat that.
    counts = df.select(F.col(value).alias("v")).groupBy("v").agg(F.count("v").alias("n")).where("n > 0").persist(StorageLevel.DISK_ONLY)
    try:
        found = _at_ranks(counts, wanted)
        return df.sparkSession.createDataFrame(found.collect(), found.schema)
    finally:
        counts.unpersist()


def _at_ranks(counts: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    found = counts.agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0]
    cuts = F.array(*(F.lit(c) for c in sorted(set(found or []))))
    ranged = counts.withColumn("r", F.size(F.filter(cuts, lambda c: c < F.col("v"))) if found else F.lit(0))
    sizes = {x["r"]: x["n"] for x in ranged.groupBy("r").agg(F.sum("n").alias("n")).collect()}
    total, places = sum(sizes.values()), {}
    for name, (rule, p) in wanted.items():
        left = min(_index(rule, p, total), total - 1) if total else -1
        for r in sorted(sizes):
            if 0 <= left < sizes[r]:
                places[name] = (r, left)
                break
            left -= sizes[r]
    inside = Window.partitionBy("r").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = ranged.withColumn("upto", F.sum("n").over(inside))
    at = {name: F.min(F.when((F.col("r") == places[name][0]) & (F.col("upto") > places[name][1]), F.col("v"))) if name in places else F.min(F.when(F.lit(False), F.col("v"))) for name in wanted}
    return upto.agg(*(c.alias(name) for name, c in at.items()))


def beside(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two tables of one row each as one row."""
    return one.withColumn("__one", F.lit(1)).join(other.withColumn("__one", F.lit(1)), "__one").drop("__one")
