"""Preservation of markup between a source and a hypothesis, as columns only.

Each check compares two multisets.  The row's texts are scanned once into arrays,
each array pair is folded into entries (key, wanted, got), and outcomes, issues
and score derive from these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import markup as M
from corpusloom.functions.text import INLINE_MARKERS, text
from corpusloom.schemas import ISSUE

CHECKS = ("tag", "url", "param", "code", "heading", "inline", "include", "protected", "balance", "code_body")


def counted(want: Column, got: Column) -> Column:
    """array<struct<key, want, got>> over the distinct keys of ``want``."""

    def n(a: Column, k: Column) -> Column:
        return F.size(F.filter(a, lambda x: x == k))

    return F.transform(F.array_distinct(want), lambda k: F.struct(k.alias("key"), n(want, k).alias("want"), n(got, k).alias("got")))


def _sum(entries: Column, value) -> Column:
    return F.aggregate(entries, F.lit(0), lambda a, e: a + value(e))


def _outcome(checked: Column, preserved: Column) -> Column:
    return F.struct(checked.cast("int").alias("checked"), preserved.cast("int").alias("preserved"))


def _issue(code: str | Column, detail: Column) -> Column:
    return F.struct((F.lit(code) if isinstance(code, str) else code).alias("code"), detail.alias("detail"))


def _quoted(k: Column) -> Column:
    return F.concat(F.lit("'"), k, F.lit("'"))


def _arrow(want: Column, got: Column) -> Column:
    return F.concat(want.cast("string"), F.lit("->"), got.cast("string"))


def validate(df: DataFrame, source: str = "source", hypothesis: str = "hypothesis", checks: Sequence[str] = CHECKS, sites: M.Sites = M.Sites()) -> DataFrame:
    """Add ``score``, ``outcomes`` (map of check to checked/preserved), ``issues``, ``source_len`` and ``hypothesis_len``.

    ``checks`` chooses the outcomes that score.  Null texts count as empty; with
    nothing to check the score is 1.  The score is not rounded.
    """
    s, h = text(F.col(source)), text(F.col(hypothesis))
    df = df.withColumns({"__s": s, "__h": h})
    # All but addresses and code bodies stand in constructs, a small part of most texts.
    df = df.withColumns({f"__in_{side}": M.constructs_only(F.col(f"__{side}")) for side in "sh"})
    whole = ("url", "code_body")
    both = {
        "tag": M.tag_names, "url": lambda c: M.urls(c, sites), "param": M.params, "include": lambda c: M.includes(c, sites),
        "module": M.modules, "protected": M.protected_tokens, "open": M.opened, "close": M.closed, "code_body": M.code_bodies,
    }
    df = df.withColumns({f"__{k}_{side}": f(F.col(f"__{side}" if k in whole else f"__in_{side}")) for k, f in both.items() for side in "sh"})
    df = df.withColumns({f"__{k}": counted(F.col(f"__{k}_s"), F.col(f"__{k}_h")) for k in ("tag", "url", "param", "include", "module", "protected", "code_body")})
    df = df.withColumns({f"__{k}_more": counted(F.col(f"__{k}_h"), F.col(f"__{k}_s")) for k in ("include", "module")})
    counts = {"code": M.CODE, "heading": M.HEADING}
    df = df.withColumns({f"__{k}_{side}": F.regexp_count(F.col(f"__{side}"), F.lit(p)) for k, p in counts.items() for side in "sh"})
    inline = F.array(*(F.struct(F.lit(m).alias("key"), M.count_of(F.col("__s"), m).alias("want"), M.count_of(F.col("__h"), m).alias("got")) for m in INLINE_MARKERS))
    df = df.withColumn("__inline", F.filter(F.transform(inline, lambda e: F.struct(e["key"].alias("key"), F.floor(e["want"] / 2).alias("want"), F.floor(e["got"] / 2).alias("got"), (e["got"] % 2).alias("odd"), e["got"].alias("all"))), lambda e: e["want"] > 0))

    def times(a: str, tag: Column) -> Column:
        return F.size(F.filter(a, lambda x: x == tag))

    # Tags that the source has neither opened nor closed give no outcome and no issue.
    paired = F.array_intersect(F.array(*map(F.lit, M.PAIRED_TAGS)), F.concat("__open_s", "__close_s"))
    df = df.withColumn("__balance", F.transform(paired, lambda t: F.struct(t.alias("key"), times("__open_s", t).alias("want"), times("__open_h", t).alias("got"), times("__close_h", t).alias("closed"), times("__close_s", t).alias("had"))))

    def least(e: Column) -> Column:
        return F.least(e["want"], e["got"])

    made = {k: _outcome(F.size(f"__{k}_s"), _sum(F.col(f"__{k}"), least)) for k in ("tag", "url", "param", "include", "code_body")}
    made |= {k: _outcome(F.col(f"__{k}_s"), F.least(f"__{k}_s", f"__{k}_h")) for k in counts}
    made["inline"] = _outcome(_sum(F.col("__inline"), lambda e: e["want"].cast("int")), _sum(F.col("__inline"), lambda e: least(e).cast("int")))
    made["protected"] = _outcome(F.size("__protected_s"), _sum(F.col("__protected"), lambda e: F.when(M.has_cjk(e["key"]["token"]), e["want"]).otherwise(least(e))))
    opened = F.filter("__balance", lambda e: e["want"] > 0)
    made["balance"] = _outcome(_sum(opened, lambda e: e["want"]), _sum(opened, lambda e: F.least(e["want"], e["got"], e["closed"])))

    def lost(name: str, code: str) -> Column:
        return F.transform(F.filter(f"__{name}", lambda e: e["got"] < e["want"]), lambda e: _issue(code, F.concat(_quoted(e["key"]), F.lit(" "), _arrow(e["want"], e["got"]))))

    def added(name: str) -> Column:
        return F.transform(F.filter(f"__{name}_more", lambda e: e["got"] < e["want"]), lambda e: _issue(f"{name}_added", F.concat(_quoted(e["key"]), F.lit(" ->"), e["want"].cast("string"))))

    none = F.array().cast(f"array<{ISSUE}>")
    issues = [lost(k, f"{k}_missing") for k in ("tag", "url", "param")]
    issues += [F.when(F.col(f"__{k}_h") < F.col(f"__{k}_s"), F.array(_issue(f"{k}_missing", _arrow(F.col(f"__{k}_s"), F.col(f"__{k}_h"))))).otherwise(none) for k in counts]
    unmatched = F.transform("__inline", lambda e: F.array(F.when(e["got"] < e["want"], _issue("inline_missing", F.concat(e["key"], F.lit(" "), _arrow(e["want"], e["got"])))), F.when(e["odd"] == 1, _issue("inline_unbalanced", F.concat(e["key"], F.lit(" count="), e["all"].cast("string"))))))
    issues.append(F.filter(F.flatten(unmatched), lambda i: i.isNotNull()))
    issues += [lost("include", "include_missing"), added("include"), lost("module", "module_missing"), added("module")]
    broken = F.filter("__protected", lambda e: (e["got"] < e["want"]) & ~M.has_cjk(e["key"]["token"]))
    once = F.flatten(F.transform(broken, lambda e: F.array_repeat(e["key"], (e["want"] - e["got"]).cast("int"))))
    issues.append(F.transform(once, lambda k: _issue("cjk_in_protected", F.concat(k["kind"], F.lit(" "), _quoted(k["token"]), F.lit(" not kept ASCII")))))
    open_ = F.filter("__balance", lambda e: (e["want"] > 0) & (e["closed"] < e["got"]))
    issues.append(F.transform(open_, lambda e: _issue("unclosed_markup", F.concat(F.lit("[["), e["key"], F.lit("]] opened "), e["got"].cast("string"), F.lit(", closed "), e["closed"].cast("string")))))
    issues.append(F.transform(F.filter("__balance", lambda e: (e["had"] > 0) & (e["closed"] == 0)), lambda e: _issue("unclosed_markup", F.concat(F.lit("[[/"), e["key"], F.lit("]] lost")))))
    changed = F.filter("__code_body", lambda e: e["got"] < e["want"])
    issues.append(F.transform(changed, lambda e: _issue("code_block_modified", F.concat(_quoted(F.substring(e["key"], 1, 40)), F.lit(" changed or lost")))))

    outcomes = F.create_map(*(x for k in CHECKS if k in checks for x in (F.lit(k), made[k])))
    df = df.withColumns({"outcomes": outcomes, "issues": F.concat(*issues), "source_len": F.length("__s"), "hypothesis_len": F.length("__h")})
    total = F.aggregate(F.map_values("outcomes"), F.lit(0), lambda a, o: a + o["checked"])
    kept = F.aggregate(F.map_values("outcomes"), F.lit(0), lambda a, o: a + o["preserved"])
    df = df.withColumn("score", F.coalesce(F.try_divide(kept, total), F.lit(1.0)))
    return df.drop(*(c for c in df.columns if c.startswith("__")))


def rate(outcome: Column) -> Column:
    """Preserved share of an outcome, 1 if nothing was checked."""
    return F.coalesce(F.try_divide(outcome["preserved"], outcome["checked"]), F.lit(1.0))


def check_means(validated: DataFrame) -> DataFrame:
    """``check``, ``mean_rate`` over all rows."""
    return validated.select(F.explode_outer("outcomes").alias("check", "o")).groupBy("check").agg(F.avg(rate(F.col("o"))).alias("mean_rate"))


def issue_counts(validated: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` most frequent issue codes (ties by code)."""
    # explode_outer: an inferred filter would be pushed through every projection and repeat all of their expressions.
    return validated.select(F.explode_outer("issues").alias("i")).where("i IS NOT NULL").groupBy(F.col("i.code").alias("code")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "code").limit(k)


def preservation_summary(validated: DataFrame) -> DataFrame:
    """One row: mean score, share and number of rows with issues, and number of issues."""
    n = F.size("issues")
    return validated.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("score"), F.coalesce(F.avg((n == 0).cast("double")), F.lit(0.0)).alias("perfect_ratio"),
        F.coalesce(F.sum(n), F.lit(0)).alias("errors_total"), F.coalesce(F.avg(n), F.lit(0.0)).alias("errors_mean"), F.count_if(n > 0).alias("samples_with_errors"),
    )


def localised(df: DataFrame, source: str = "source", sites: M.Sites = M.Sites()) -> DataFrame:
    """The inventory of one text: every extractor as a column."""
    c = text(F.col(source))
    return df.withColumns({"tags": M.tag_names(c), "urls": M.urls(c, sites), "params": M.params(c), "includes": M.includes(c, sites), "modules": M.modules(c), "code_bodies": M.code_bodies(c), "inline": M.inline_counts(c), "n_code": F.regexp_count(c, F.lit(M.CODE)), "n_heading": F.regexp_count(c, F.lit(M.HEADING))})
