"""Queries that compute each text's prose and each value once, and extractors on constructs alone."""

import random

from pyspark.sql import functions as F

from corpusloom.functions import markup as M
from corpusloom.functions import ranks
from corpusloom.functions import text as T
from corpusloom.operators import metrics


def test_examples_strip_markup_once_a_text(spark):
    df = spark.createDataFrame([(2, "a", ""), (1, "b", ""), (3, "prose", "prose")], "id int, src string, hyp string")
    found = metrics.anomaly_examples(metrics.length_anomalies(df, "src", "src", "hyp"), "id")
    plan = found.select("id", "reasons")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\{\{\{") == 2
    assert [(r.id, r.reasons) for r in found.collect()] == [(1, ["empty_hypothesis"]), (2, ["empty_hypothesis"])]


def test_order_statistics_compute_values_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def value(x):
        made.add(1)
        return x % 7

    found = ranks.order_statistics(spark.range(100).select(value("id").alias("v")), "v", {"low": ("floor", 0.0), "mid": ("upper", 0.5)})
    assert tuple(found.first()) == (0, 3) and made.value == 100


def test_constructs_hold_what_extractors_find(spark):
    pick = random.Random(1)
    parts = ["[[", "]]", "[", "]", "/", " ", "\n", "include ", "module ", "a", "div", "x=", "|", "=", ":", "]]]", "[[[", "span_"]
    df = spark.createDataFrame([("".join(pick.choice(parts) for _ in range(pick.randint(0, 14))),) for _ in range(3000)], "t string").withColumn("m", M.constructs_only(F.col("t")))
    for f in (M.tag_names, M.params, M.includes, M.modules, M.protected_tokens, M.opened, M.closed):
        assert df.where(f(F.col("t")) != f(F.col("m"))).count() == 0


def test_strip_takes_all_unicode_white_space(spark):
    df = spark.createDataFrame([(f"{chr(i)}a {chr(i)}",) for i in range(1, 0x3100)], "t string")
    assert df.where(T.strip(F.col("t")) != F.regexp_replace("t", r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")).count() == 0
