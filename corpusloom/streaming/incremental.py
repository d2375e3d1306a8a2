"""Incremental runs: file streams that resume, content-addressed caches, event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.joins import not_done, probe


def process_new(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Apply ``work`` to the files of ``source`` that earlier runs with this checkpoint have not seen, and append to ``sink``.

    A run that dies is finished by the next one; a new checkpoint folder starts afresh.
    A damaged file fails the run: nothing is skipped silently, and once the file is
    mended or taken away the next run goes on where this one stood.
    """
    stream = spark.readStream.schema(schema).option("ignoreCorruptFiles", False).parquet(source)
    query = work(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def fill_cache(df: DataFrame, cache: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cache's rows for ``df`` and computed ones for what it lacks; only misses are computed."""
    wanted = df.select(*keys).distinct()
    known = cache.join(wanted, keys, "left_semi")
    misses = df.join(cache.select(*keys).distinct(), keys, "left_anti")
    return known.unionByName(compute(misses))


def cache_key(params: dict, *columns: Column) -> Column:
    """A key that changes with the parameters and with any of the columns."""
    fixed = ";".join(f"{k}={params[k]}" for k in sorted(params))
    return F.sha1(F.concat_ws("\0", F.lit(fixed), *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)))


def file_cache_key(files: DataFrame, params: dict) -> Column:
    """A key per input file that changes with its path, size, modification time and the parameters; ``files`` must read files."""
    about = files["_metadata"]
    return cache_key(params, about["file_path"], about["file_size"], about["file_modification_time"])


def cache_sizes(cache: DataFrame, model: str = "model", vec: str = "vec") -> DataFrame:
    """Per model: rows of an embedding cache and the bytes of their vectors (four a number)."""
    return cache.groupBy(model).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size(vec).cast("long") * 4).alias("bytes"))


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return not_done(todo, done, key)


def cache_report(df: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    return probe(df, cache, keys).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def event_windows(events: DataFrame, ts: str, size: str, keys: list[str], value: str, delay: str | None = None) -> DataFrame:
    """Tumbling windows per key: count and sum.  With ``delay`` (streams) late rows beyond it are dropped by a watermark."""
    rows = events.withWatermark(ts, delay) if delay else events
    found = rows.groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return found.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], delay: str | None = None) -> DataFrame:
    """Session windows per key: start, end and number of events."""
    rows = events.withWatermark(ts, delay) if delay else events
    found = rows.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")
