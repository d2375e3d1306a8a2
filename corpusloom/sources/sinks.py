"""Sinks: JSON lines, reports, split folders."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corpusloom.operators.splits import hash_split


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Write JSON lines by the job commit protocol (all or nothing); returns the number of rows."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return int(seen.get["n"])


def write_splits(df: DataFrame, path: str, *keys: str, mode: str = "errorifexists") -> None:
    """JSON lines in a folder per value of the keys (``kind=short/split=val``); empty ones are not written."""
    df.write.mode(mode).partitionBy(*keys).json(path)


def write_with_chat(df: DataFrame, chat: DataFrame, path: str, *keys: str, mode: str = "errorifexists") -> None:
    """Samples and their chat companions side by side, each in a folder per value of the keys."""
    write_splits(df, f"{path}/samples", *keys, mode=mode)
    write_splits(chat, f"{path}/chat", *keys, mode=mode)


def rewrite_split(df: DataFrame, path: str, doc: str, ratio: float) -> None:
    """Existing samples split by their document's hash, in a new folder; a later run over the same samples splits them alike."""
    write_splits(hash_split(df, doc, ratio), path, "split")


def write_tokens(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tokenised samples as Parquet: lists are stored as flat values with offsets."""
    df.write.mode(mode).parquet(path)


def report_json(one_row: DataFrame) -> str:
    """The JSON of a report of one row."""
    row = one_row.first()
    return json.dumps(row.asDict(recursive=True) if row else {}, ensure_ascii=False, indent=2, default=str)


def _shown(value) -> str:
    return f"{value:.4f}" if isinstance(value, float) else str(value)


def report_markdown(title: str, sections: Mapping[str, Mapping], nested: int = 6, issues: Mapping | None = None, examples: list | None = None, worst: list | None = None) -> str:
    """A markdown report: a section per mapping (inner mappings up to ``nested`` entries), up to 15 issues, 10 examples, and the worst rows."""
    lines = [f"# {title}", ""]
    for name, values in sections.items():
        lines.append(f"## {name}")
        for key, value in values.items():
            if isinstance(value, Mapping):
                lines.append(f"- {key}:")
                lines += [f"  - {k}: {_shown(v)}" for k, v in list(value.items())[:nested]]
            else:
                lines.append(f"- {key}: {_shown(value)}")
        lines.append("")
    for name, rows in (("Issues", [f"- {k}: {v}" for k, v in list((issues or {}).items())[:15]]), ("Examples", [f"- {x}" for x in (examples or [])[:10]]), ("Worst", [f"- {x}" for x in worst or []])):
        if rows:
            lines += [f"## {name}", *rows, ""]
    return "\n".join(lines)


def write_report(df: DataFrame, summary: DataFrame, path: str, title: str, worst: DataFrame | None = None) -> None:
    """Three parts below ``path``: the samples, the summary as JSON, and a markdown page (one text file each), which lists up to 20 ``worst`` rows."""
    spark = df.sparkSession
    df.write.json(f"{path}/samples")
    summary.coalesce(1).write.json(f"{path}/summary")
    row = summary.first()
    rows = [json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str) for r in worst.limit(20).collect()] if worst is not None else None
    page = report_markdown(title, {"Summary": row.asDict() if row else {}}, worst=rows)
    spark.createDataFrame([(page,)], "value string").coalesce(1).write.text(f"{path}/page")
