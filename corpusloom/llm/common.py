"""Small pieces that several operators share."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores, if the input has fewer partitions than there are cores (a file of one row group is one partition)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text_of(column: str = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only where neither is set and all runs in one process (as in tests) a local folder is
    taken; on a cluster without one this raises, as executors would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/corpusloom-{uuid.uuid4().hex}"


class Scratch:
    """Tables written while it is open; all but those kept are deleted at the end."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def keep(self, table: DataFrame) -> DataFrame:
        self.tables = [t for t in self.tables if t.table_path != table.table_path]
        outer = _SCRATCH.get()[:-1]
        if outer:
            outer[-1].tables.append(table)
        return table


_SCRATCH: contextvars.ContextVar[tuple[Scratch, ...]] = contextvars.ContextVar("scratch", default=())


@contextlib.contextmanager
def scratch() -> Iterator[Scratch]:
    """Delete the tables that :func:`materialise` writes inside, for results that are at hand at the end or are kept."""
    mine = Scratch()
    token = _SCRATCH.set((*_SCRATCH.get(), mine))
    try:
        yield mine
    finally:
        _SCRATCH.reset(token)
        discard(*mine.tables)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them again.

    With ``tidy`` Spark removes the shuffle files behind the rows as soon as they are
    written, instead of when the driver's garbage is collected.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}-{name}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true" if tidy else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.table_path = path
    if _SCRATCH.get():
        _SCRATCH.get()[-1].tables.append(found)
    return found


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables whose rows are all in later ones."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.table_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Add columns; an input column of the same name gives way."""
    return df.select(*(df[f"`{c}`"] for c in df.columns if c not in new), *(v.alias(k) for k, v in new.items()))
