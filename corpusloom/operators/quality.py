"""Quality rules with machine-readable reasons: suspicious rows are flagged, not dropped."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import cjk_ratio, latin_ratio, length_ratio, plain_text, text, whitespace_tokens


@dataclass(frozen=True)
class Limits:
    """Thresholds (fixed values of the default configuration)."""

    source_chars: int = 200
    target_chars: int = 80
    source_words: int = 40
    ratio_low: float = 0.15
    ratio_high: float = 2.5
    target_cjk: float = 0.10
    source_latin: float = 0.20
    max_chars: int = 0


def _reasons(**tests: Column) -> Column:
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())))


def clean_metrics(df: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Add lengths, script ratios and hashes of both sides."""
    s, t = text(F.col(source)), text(F.col(target))
    sides = {"source": s, "target": t}
    out = {"length_ratio": length_ratio(s, t)}
    for name, c in sides.items():
        out |= {f"{name}_len": F.length(c), f"{name}_plain_len": F.length(plain_text(c)), f"{name}_cjk_ratio": cjk_ratio(c), f"{name}_latin_ratio": latin_ratio(c), f"{name}_sha1": F.sha1(c)}
    return df.withColumns(out)


def quality_flags(df: DataFrame, source: str = "source", target: str = "target", limits: Limits = Limits()) -> DataFrame:
    """Add ``flags``: the names of the rules that a pair breaks."""
    s, t = text(F.col(source)), text(F.col(target))
    ratio = length_ratio(s, t)
    tests = {
        "source_too_short": F.length(s) < limits.source_chars,
        "target_too_short": F.length(t) < limits.target_chars,
        "too_few_words": whitespace_tokens(s) < limits.source_words,
        "length_ratio_outlier": (ratio < limits.ratio_low) | (ratio > limits.ratio_high),
        "low_target_cjk": cjk_ratio(t) < limits.target_cjk,
        "low_source_latin": latin_ratio(s) < limits.source_latin,
        "identical_sides": s == t,
    }
    if limits.max_chars:
        tests["too_long"] = F.greatest(F.length(s), F.length(t)) > limits.max_chars
    return df.withColumn("flags", _reasons(**tests))


def drop_flagged(df: DataFrame, *rules: str, flags: str = "flags") -> DataFrame:
    """The rows without one of these flags (without any, if none is named): the drop mode of rules that else only flag."""
    hit = F.arrays_overlap(flags, F.array(*map(F.lit, rules))) if rules else F.size(flags) > 0
    return df.where(~F.coalesce(hit, F.lit(False)))


def drop_duplicates(df: DataFrame, row_id: str, source: str = "source", target: str = "target", same_source: bool = True) -> DataFrame:
    """The first row (by ``row_id``) of each source, or of each pair; only hashes are compared."""
    key = F.sha1(text(F.col(source))) if same_source else F.sha1(F.concat_ws("\0", text(F.col(source)), text(F.col(target))))
    rank = F.row_number().over(Window.partitionBy("__key").orderBy(row_id))
    return df.withColumn("__key", key).withColumn("__rank", rank).where("__rank = 1").drop("__key", "__rank")


def audit(df: DataFrame, source: str = "source", target: str = "target", identifier: str = r"[A-Z]+-[0-9]+", ignored: Sequence[str] = (), components: Callable[[Column], Column] | None = None, most_missing: int = 3) -> DataFrame:
    """Add ``prose_ratio``, ``identifier_recall`` (null below five identifiers), ``missing_components``, ``level`` (pass, review, fail) and ``reasons``.

    ``components`` extracts the names of a text's components; ``most_missing`` of the
    source's or more that the target lacks ask for a review.  ``ignored`` identifiers and
    components do not count.
    """
    s, t = text(F.col(source)), text(F.col(target))
    df = df.withColumns({"__ps": plain_text(s), "__pt": plain_text(t), "__ids": F.array_except(F.array_distinct(F.regexp_extract_all(s, F.lit(f"({identifier})"), F.lit(1))), F.array(*map(F.lit, ignored)).cast("array<string>"))})
    lost = F.lit(0) if components is None else F.size(F.array_except(F.array_except(components(s), components(t)), F.array(*map(F.lit, ignored)).cast("array<string>")))
    df = df.withColumn("missing_components", lost)
    kept = F.filter("__ids", lambda i: F.contains(t, i))
    recall = F.when(F.size("__ids") >= 5, F.size(kept) / F.size("__ids"))
    df = df.withColumns({"prose_ratio": F.coalesce(F.try_divide(F.length("__pt"), F.length("__ps")), F.lit(0.0)), "identifier_recall": recall})
    prose = F.length("__ps") >= 120
    ratio, found = F.col("prose_ratio"), F.col("identifier_recall")
    hard = _reasons(prose_ratio=prose & ((ratio < 0.10) | (ratio > 1.50)), target_not_cjk=cjk_ratio(F.col("__pt")) < 0.05, identifiers_lost=F.coalesce(found < 0.30, F.lit(False)))
    soft = _reasons(components_missing=F.col("missing_components") >= most_missing, prose_ratio_review=prose & ((ratio < 0.25) | (ratio > 0.75)), identifiers_review=F.coalesce(found < 0.85, F.lit(False)))
    level = F.when(F.size(hard) > 0, "fail").when(F.size(soft) > 0, "review").otherwise("pass")
    return df.withColumns({"level": level, "reasons": F.concat(hard, soft)}).drop("__ps", "__pt", "__ids")


def structure_level(df: DataFrame, source: str = "source", target: str = "target", low: float = 0.25, high: float = 1.60, least: int = 40) -> DataFrame:
    """Add ``structure``: pass or review by prose ratio and least target prose."""
    a, b = F.length(plain_text(text(F.col(source)))), F.length(plain_text(text(F.col(target))))
    ratio = F.coalesce(F.try_divide(b, a), F.lit(0.0))
    return df.withColumn("structure", F.when((ratio < low) | (ratio > high) | (b < least), "review").otherwise("pass"))


def approve(df: DataFrame, structure: str = "structure", semantic: str = "semantic", allowed: tuple[str, ...] = ("pass", "review")) -> DataFrame:
    """Add ``approved``: both verdicts are allowed."""
    return df.withColumn("approved", F.col(structure).isin(*allowed) & F.col(semantic).isin(*allowed))
