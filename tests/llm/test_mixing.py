from collections import Counter

from corpusloom.llm import mixing


def test_rates_and_counts(spark):
    rows = [(i, "hot" if i < 3000 else f"s{i % 3}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, source string").selectExpr("*", "'x' AS copy_no", "'y' AS text")
    weights = {"hot": 1.0, "s0": 2.0, "s1": 1.0}
    out = mixing.poisson_mix(df, weights, total=8000).collect()
    n = Counter(r.source for r in out)
    assert n["s2"] == 0 and abs(n["hot"] - 2000) < 200 and abs(n["s0"] - 4000) < 300 and abs(n["s1"] - 2000) < 200
    copies = Counter((r.source, r.doc_id) for r in out)
    zero = sum((s, i) not in copies for i, s in rows if s == "s0") / 1000
    assert abs(zero - 2.718281828**-4) < 0.02
    assert all(r.copy_no <= copies[r.source, r.doc_id] for r in out)
    keys = [r.shuffle_key for r in out]
    assert keys == sorted(keys) and [r.doc_id for r in out] != sorted(r.doc_id for r in out)


def test_large_rates_do_not_underflow(spark):
    df = spark.createDataFrame([(i, "s") for i in range(20)], "doc_id long, source string")
    n = mixing.poisson_mix(df, total=20 * 2000).count()
    assert abs(n - 40000) < 1000


def test_independent_of_partitions_and_edge_rows(spark):
    rows = [(1, None, None), (2, "a", "x"), (2, "a", "x"), (None, "a", ""), (3, "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    once = [tuple(r) for r in mixing.poisson_mix(df, total=50).collect()]
    again = [tuple(r) for r in mixing.poisson_mix(df.repartition(7), total=50).collect()]
    assert Counter(once) == Counter(again) and once
    assert mixing.poisson_mix(df.limit(0)).count() == 0
    assert mixing.poisson_mix(df, {"zzz": 1.0}).count() == 0
