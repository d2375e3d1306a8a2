"""Corpus metrics as sums of per-row statistics."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.ranks import beside, order_statistics
from corpusloom.functions.text import cjk_ratio, plain_text, strip, text

#: Characters that the Chinese tokenization of BLEU sets apart: ideographs, their punctuation, and full-width forms (fixed ranges).
_WIDE = r"[\x{2e80}-\x{2fdf}\x{3000}-\x{303f}\x{31c0}-\x{31ef}\x{3200}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{fe30}-\x{fe4f}\x{ff00}-\x{ffef}\x{20000}-\x{2ffff}]"
STRATA = ((2000, "short"), (6000, "medium"))


def bleu_tokens(c: Column) -> Column:
    """Words for BLEU: wide characters alone, punctuation apart (but inside numbers not), the rest by white space."""
    out = F.regexp_replace(text(c), f"({_WIDE})", " $1 ")
    out = F.regexp_replace(out, r"([{-~\[-` -&(-+:-@/])", " $1 ")
    out = F.regexp_replace(out, r"([^0-9])([.,])", "$1 $2 ")
    out = F.regexp_replace(out, r"([.,])([^0-9])", " $1 $2")
    out = F.regexp_replace(out, r"([0-9])(-)", "$1 $2 ")
    return F.filter(F.split(out, r"\s+"), lambda w: w != "")


def char_units(c: Column) -> Column:
    """Characters without white space."""
    return F.filter(F.split(F.regexp_replace(text(c), r"(?U)\s+", ""), ""), lambda x: x != "")


def ngrams(units: Column, n: int) -> Column:
    count = F.size(units) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(units, i, n), "\x01"))).otherwise(F.array().cast("array<string>"))


def ngram_stats(df: DataFrame, row_id: str, hypothesis: Column, reference: Column, orders: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Per row and order: n-grams of hypothesis and reference and clipped matches.

    N-grams are rows that are counted by partial aggregation, so a long text costs no quadratic comparison.
    """
    given = df.select(F.col(row_id).alias("id"), *keys, hypothesis.alias("__h"), reference.alias("__r"))

    def grams(side: str) -> Column:
        return F.array(*(F.struct(F.lit(n).alias("n"), F.lit(side == "__h").alias("hyp"), ngrams(F.col(side), n).alias("grams")) for n in orders))

    sides = given.select("id", *keys, F.explode(F.concat(grams("__h"), grams("__r"))).alias("s")).select("id", *keys, "s.n", "s.hyp", F.explode_outer("s.grams").alias("gram"))
    counted = sides.groupBy("id", *keys, "n", "gram").agg(F.count_if(F.col("hyp") & F.col("gram").isNotNull()).alias("h"), F.count_if(~F.col("hyp") & F.col("gram").isNotNull()).alias("r"))
    return counted.groupBy("id", *keys, "n").agg(F.sum("h").alias("hyp"), F.sum("r").alias("ref"), F.sum(F.least("h", "r")).alias("match"))


def totals(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return stats.groupBy(*keys, "n").agg(F.sum("hyp").alias("hyp"), F.sum("ref").alias("ref"), F.sum("match").alias("match"))


def bleu(stats: DataFrame) -> DataFrame:
    """One row from statistics of orders 1..4: ``score``, ``bp``, ``sys_len``, ``ref_len``; a precision without match is smoothed by halving (exponential smoothing)."""
    by = F.map_from_entries(F.collect_list(F.struct("n", F.struct("hyp", "ref", "match"))))
    one = totals(stats).agg(by.alias("by"))
    start = F.struct(F.lit(1.0).alias("smooth"), F.lit(0.0).alias("logs"), F.lit(True).alias("some"))

    def step(a: Column, n: Column) -> Column:
        s = F.try_element_at("by", n)
        smooth = F.when(s["match"] == 0, a["smooth"] * 2).otherwise(a["smooth"])
        p = F.when(s["match"] == 0, 100.0 / (smooth * s["hyp"])).otherwise(100.0 * s["match"] / s["hyp"])
        some = a["some"] & (s["hyp"] > 0)
        return F.struct(smooth.alias("smooth"), (a["logs"] + F.when(some, F.log(p)).otherwise(0.0)).alias("logs"), some.alias("some"))

    folded = F.aggregate(F.array(*(F.lit(i) for i in range(1, 5))), start, step)
    unigrams = F.try_element_at("by", F.lit(1))
    bp = F.when(unigrams["hyp"] >= unigrams["ref"], 1.0).when(unigrams["hyp"] > 0, F.exp(1 - unigrams["ref"] / unigrams["hyp"])).otherwise(0.0)
    done = one.select(folded.alias("f"), bp.alias("bp"), unigrams["hyp"].alias("sys_len"), unigrams["ref"].alias("ref_len"), (unigrams["match"] > 0).alias("any"))
    return done.select(F.when(F.col("f.some") & F.col("any"), F.col("bp") * F.exp(F.col("f.logs") / 4)).otherwise(0.0).alias("score"), "bp", "sys_len", "ref_len")


def chrf(stats: DataFrame, keys: Sequence[str] = (), beta: float = 2.0) -> DataFrame:
    """``score`` per key: F-beta of the mean precision and mean recall over the orders where both sides have n-grams."""
    both = totals(stats, keys).where("hyp > 0 AND ref > 0")
    means = both.groupBy(*keys).agg(F.avg(F.col("match") / F.col("hyp")).alias("p"), F.avg(F.col("match") / F.col("ref")).alias("r"))
    b = beta * beta
    score = F.coalesce(100 * (1 + b) * F.try_divide(F.col("p") * F.col("r"), b * F.col("p") + F.col("r")), F.lit(0.0))
    return means.select(*keys, score.alias("score"))


def _lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a row at a time by prefix maxima."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        take = row.copy()
        take[1:] = np.maximum(row[1:], (row[:-1] + 1) * (b == x))
        row = np.maximum.accumulate(take)
    return int(row[-1])


def rouge_l(hypothesis: Column, reference: Column, mode: str = "ascii") -> Column:
    """F1 of the longest common subsequence of tokens: single characters a-z0-9 (``ascii``), any characters but white space (``char``) or words (``word``)."""
    cut = {"ascii": lambda t: re.findall(r"[a-z0-9]", t.lower()), "char": lambda t: re.findall(r"\S", t), "word": lambda t: t.split()}[mode]

    @F.pandas_udf("double")
    def run(h: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(h.fillna(""), r.fillna(""), strict=True):
            a, b = cut(x), cut(y)
            if not a or not b:
                out.append(0.0)
                continue
            ids: dict[str, int] = {}
            a, b = (np.array([ids.setdefault(t, len(ids)) for t in s]) for s in (a, b))
            n = _lcs(*((a, b) if len(a) <= len(b) else (b, a)))
            p, q = n / len(a), n / len(b)
            out.append(2 * p * q / (p + q) if n else 0.0)
        return pd.Series(out)

    return run(hypothesis, reference)


def length_anomalies(df: DataFrame, source: str, reference: str, hypothesis: str, low: float = 0.3, high: float = 2.0) -> DataFrame:
    """Add ``ratio`` (prose), ``ratio_raw``, ``cjk`` and ``reasons``."""
    h, r = text(F.col(hypothesis)), text(F.col(reference))
    df = df.withColumns({"__h": plain_text(h), "__r": plain_text(r), "ratio_raw": F.coalesce(F.try_divide(F.length(h), F.length(r)), F.lit(0.0))})
    n, m = F.length("__h"), F.length("__r")
    df = df.withColumns({"ratio": F.coalesce(F.try_divide(n, F.when(m > 0, m).otherwise(F.length(h))), F.lit(0.0)), "cjk": cjk_ratio(F.col("__h")), "__n": n})
    size = F.when(F.length(strip(h)) == 0, "empty_hypothesis").when(F.col("ratio") < low, "too_short").when(F.col("ratio") > high, "too_long")
    reasons = F.array_compact(F.array(size, F.when((F.col("__n") > 50) & (F.col("cjk") < 0.15), "not_chinese")))
    return df.withColumn("reasons", reasons).drop("__h", "__r", "__n")


def anomaly_summary(df: DataFrame) -> DataFrame:
    """One row: rows, anomalies and their share."""
    some = F.size("reasons") > 0
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(some).alias("anomalies"), F.coalesce(F.avg(some.cast("double")), F.lit(0.0)).alias("anomaly_ratio"))


def anomaly_examples(df: DataFrame, row_id: str, k: int = 20) -> DataFrame:
    """The first ``k`` rows with a reason, by ``row_id``."""
    # explode_outer: a filter on the reasons themselves would be pushed below all that computes them, and repeat that.
    some = F.explode_outer(F.array(F.size("reasons") > 0)).alias("__some")
    return df.select("*", some).where("__some").drop("__some").orderBy(row_id).limit(k)


def anomaly_report(df: DataFrame) -> DataFrame:
    """One row: :func:`anomaly_summary` and the 5th, 50th and 95th percentile of the ratio (nearest rank, halves to even)."""
    return beside(anomaly_summary(df), order_statistics(df, "ratio", {"p05": ("nearest", 0.05), "p50": ("nearest", 0.5), "p95": ("nearest", 0.95)}))


def throughput(runs: DataFrame, label: str, tokens: str, seconds: str) -> DataFrame:
    """Per label: steps, tokens, seconds, tokens and steps a second, and seconds a step; null rates without time or steps."""
    sums = runs.groupBy(label).agg(F.count(F.lit(1)).alias("steps"), F.sum(tokens).alias("tokens"), F.sum(seconds).alias("seconds"))
    return sums.withColumns({"tokens_per_second": F.try_divide("tokens", "seconds"), "steps_per_second": F.try_divide("steps", "seconds"), "seconds_per_step": F.try_divide("seconds", "steps")})


def reason_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode_outer("reasons").alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def worst(df: DataFrame, score: str, ratio: str, row_id: str, k: int = 20) -> DataFrame:
    return df.orderBy(score, ratio, row_id).limit(k)


def stratum(size: Column) -> Column:
    out = F.lit("long")
    for bound, name in reversed(STRATA):
        out = F.when(size < bound, name).otherwise(out)
    return out
