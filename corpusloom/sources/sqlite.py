"""SQLite files as a Spark data source, read in ranges of rowid."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusloom.sources.files import FIELDS

_TYPES = {"INT": "bigint", "REAL": "double", "FLOA": "double", "DOUB": "double", "BLOB": "binary"}


def _columns(file: str, name: str) -> list[tuple[str, str]]:
    with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as db:
        rows = db.execute(f'PRAGMA table_info("{name}")').fetchall()
    return [(r[1], next((t for k, t in _TYPES.items() if k in (r[2] or "").upper()), "string")) for r in rows]


def detect_table(file: str, fields: Mapping = FIELDS) -> str:
    """The table with most source and target column names; the first of equals."""
    with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as db:
        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY rowid")]
    if not names:
        raise ValueError(f"no table in {file}")
    wanted = {*fields["source"]}, {*fields["target"]}

    def score(name: str) -> int:
        own = {c.lower() for c, _ in _columns(file, name)}
        return sum(len(own & w) for w in wanted)

    return max(names, key=score)


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, file: str, name: str, columns: list[str], parts: int):
        self.file, self.name, self.columns, self.parts = file, name, columns, parts

    def partitions(self):
        with sqlite3.connect(f"file:{self.file}?mode=ro", uri=True) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.name}"').fetchone()
        if low is None:
            return [_Range(0, -1)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, part) -> Iterator[tuple]:
        chosen = ", ".join(f'"{c}"' for c in self.columns)
        with sqlite3.connect(f"file:{self.file}?mode=ro", uri=True) as db:
            yield from db.execute(f'SELECT {chosen} FROM "{self.name}" WHERE rowid BETWEEN ? AND ? ORDER BY rowid', (part.low, part.high))


class SqliteSource(DataSource):
    """Options: ``file``, ``table`` (else detected), ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def _table(self) -> tuple[str, str]:
        file = str(self.options["file"])
        return file, str(self.options.get("table") or detect_table(file))

    def schema(self) -> str:
        return ", ".join(f"`{c}` {t}" for c, t in _columns(*self._table()))

    def reader(self, schema) -> DataSourceReader:
        file, name = self._table()
        return _Reader(file, name, [f.name for f in schema.fields], int(self.options.get("partitions", "4")))


def read_sqlite(spark: SparkSession, file: str, name: str | None = None, partitions: int = 4) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite_file").option("file", file).option("partitions", str(partitions))
    return (reader.option("table", name) if name else reader).load()
