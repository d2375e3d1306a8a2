"""File sources: folders of texts, JSON lines, JSON in three layouts, delimited text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import PurePath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import derive_id, normalize_id
from corpusloom.operators.joins import keep_first, paired
from corpusloom.schemas import MOVE

#: Column names accepted for a pair's fields, in order (fixed values).
FIELDS: Mapping[str, Sequence[str]] = {
    "id": ("id", "page_id", "scp_id", "name", "title", "key"),
    "source": ("source", "src", "en", "english", "source_text", "en_text", "input"),
    "target": ("target", "tgt", "zh", "chinese", "target_text", "zh_text", "output"),
}
LISTS = ("pairs", "data", "items", "records", "examples")


def _plain(name: str) -> str:
    return "_".join(name.strip().lower().replace("-", " ").split())


def pick(columns: Sequence[str], names: Sequence[str]) -> Column:
    """The first of the candidate columns that is not null, as text; null if none exists.

    Names are compared without regard to case, blanks and dashes; of columns that
    then agree, the last one counts.
    """
    known = {_plain(c): c for c in columns}
    found = [F.col(f"`{known[_plain(n)]}`").cast("string") for n in names if _plain(n) in known]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def as_pairs(df: DataFrame, order: Column | None = None) -> DataFrame:
    """``id``, ``source``, ``target`` of a table with unknown column names; a missing id becomes ``sample-<n>``, null texts become empty."""
    number = F.monotonically_increasing_id() if order is None else order
    fallback = F.concat(F.lit("sample-"), number.cast("string"))
    found = {k: pick(df.columns, v) for k, v in FIELDS.items()}
    return df.select(F.coalesce(found["id"], fallback).alias("id"), *(F.coalesce(found[k], F.lit("")).alias(k) for k in ("source", "target")))


def scan_folder(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``key``, ``path``, ``text`` of the files of a folder; hidden files are skipped, and of files with one key the first path counts."""
    reader = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", recursive)
    files = reader.load(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    files = files.where(~F.startswith("name", F.lit(".")))
    keyed = files.select(normalize_id(derive_id(F.col("name"))).alias("key"), "path", "text")
    return keep_first(keyed, ["key"], [F.col("path")])


def folder_pairs(spark: SparkSession, source: str, target: str, recursive: bool = True) -> DataFrame:
    """Both folders by key, unmatched files with nulls on the other side."""
    sides = (scan_folder(spark, p, recursive).select("key", F.col("path").alias(f"{n}_path"), F.col("text").alias(n)) for n, p in (("source", source), ("target", target)))
    return paired(*sides, "key")


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped and a broken one is an error."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_moves(spark: SparkSession, path: str) -> DataFrame:
    """Moves from JSON lines, with ``pos``: the file's own, else the line's place inside its document.

    Lines of one document must stand in one file; a broken line is an error.
    """
    rows = spark.read.schema(MOVE).option("mode", "FAILFAST").json(path).withColumns({"__file": F.col("_metadata.file_path"), "__line": F.monotonically_increasing_id()})
    place = F.row_number().over(Window.partitionBy("doc").orderBy("__file", "__line")) - 1
    return rows.withColumn("pos", F.coalesce("pos", place)).drop("__file", "__line")


def not_split(paths: Sequence[str]) -> list[str]:
    """The files that still wait for a split: not the results of one, and no unfinished ones."""
    done = (".train.", ".val.", ".test.", ".tmp")
    return [p for p in paths if not any(mark in f"{PurePath(p).name}" or PurePath(p).name.endswith(mark.rstrip(".")) for mark in done)]


def read_json_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs from a JSON file that is a list of records, an object with such a list, or a map from id to record."""
    whole = spark.read.text(path, wholetext=True).select(F.ltrim("value").alias("value"))
    record = "map<string,string>"
    as_list = F.from_json("value", f"array<{record}>")
    named = F.coalesce(*(F.from_json(F.get_json_object("value", f"$.{n}"), f"array<{record}>") for n in LISTS))
    by_id = F.transform(F.map_entries(F.from_json("value", f"map<string,{record}>")), lambda e: F.map_concat(F.map_filter(F.create_map(F.lit("id"), e["key"]), lambda k, v: ~F.map_contains_key(e["value"], "id")), e["value"]))
    rows = F.when(F.startswith("value", F.lit("[")), as_list).otherwise(F.coalesce(named, by_id))
    records = whole.select(F.posexplode(rows).alias("n", "r"))

    def first(kind: str) -> Column:
        return F.coalesce(*(F.try_element_at("r", F.lit(n)) for n in FIELDS[kind]))

    return records.select(F.coalesce(first("id"), F.concat(F.lit("sample-"), F.col("n").cast("string"))).alias("id"), *(F.coalesce(first(k), F.lit("")).alias(k) for k in ("source", "target")))


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Comma- or tab-separated text with a header, by suffix (.csv, .tsv, .tab)."""
    sep = "\t" if PurePath(path).suffix.lower() in (".tsv", ".tab") else ","
    return spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)


def load_pairs(spark: SparkSession, path: str | None = None, source_dir: str | None = None, target_dir: str | None = None) -> DataFrame:
    """Pairs from two folders, or from a file by its suffix."""
    if source_dir and target_dir:
        both = folder_pairs(spark, source_dir, target_dir)
        return both.where("source IS NOT NULL AND target IS NOT NULL").select(F.col("key").alias("id"), "source", "target")
    suffix = PurePath(path or "").suffix.lower()
    if suffix in (".jsonl", ".ndjson"):
        return as_pairs(read_jsonl(spark, path))
    if suffix == ".json":
        return read_json_pairs(spark, path)
    if suffix in (".csv", ".tsv", ".tab"):
        return as_pairs(read_delimited(spark, path))
    if suffix in (".db", ".sqlite", ".sqlite3"):
        from corpusloom.sources.sqlite import read_sqlite

        return as_pairs(read_sqlite(spark, path))
    raise ValueError(f"unknown source: {path}")


def page_table(df: DataFrame, source: str, target: str, order: str, limit: int = 0, largest: int = 0, size: str | None = None) -> DataFrame:
    """Pages with two non-blank sides in ``order``; or the ``largest`` ones by ``size``, which overrides ``limit``."""
    kept = df.where((F.length(F.trim(source)) > 0) & (F.length(F.trim(target)) > 0))
    if largest:
        return kept.orderBy(F.desc(size or order), order).limit(largest)
    kept = kept.orderBy(order)
    return kept.limit(limit) if limit else kept
