from pyspark.sql import functions as F

from corpusloom.functions import ranks
from corpusloom.operators import splits, tokens
from corpusloom.operators import windows as W


def test_pack(spark):
    df = spark.createDataFrame([("d", i, c) for i, c in enumerate([5, 5, 5, 20, 3, 3, 3, 3])], "doc string, pos int, cost int")
    rows = W.pack_windows(df, "doc", "pos", "cost", 10).orderBy("pos").collect()
    assert [r.window for r in rows] == [0, 0, 1, 2, 3, 3, 3, 4]


def test_spans_end_and_lose_nothing():
    assert W.spans([4, 4, 4], 8, overlap=5) == [(0, 2), (1, 3)]
    assert W.spans([9, 9, 9], 8, overlap=3) == [(0, 1), (1, 2), (2, 3)]
    found = W.spans([4, 4, 4, 4], 8, exact=lambda a, b: 4 * (b - a) + (b - a - 1))
    assert found == [(0, 1), (1, 2), (2, 3), (3, 4)] and W.spans([], 8) == []


def test_plan_windows(spark):
    text = "one two three. four five six! seven\n\n" + "x " * 30 + "\n\nend"
    rows = W.plan_windows(spark.createDataFrame([(1, text), (2, "")], "id int, text string"), "id", "text", 5).orderBy("window").collect()
    assert all(r.tokens <= 5 for r in rows) and " ".join(r.text for r in rows).split() == text.split()


def test_windows_leave_before_all_rows_are_read():
    read = []

    def rows():
        for i in range(50):
            read.append(i)
            yield str(i), ["a b c d", "e f g h"]

    batches = W.planned_batches(rows(), 5, 0, W.count_words, most=20)
    assert next(batches).num_rows == 3 and len(read) == 2
    assert sum(b.num_rows for b in batches) == 97


def test_sentences():
    assert W.sentence_pieces("A b. C d! E", 4, W.count_words) == ["A b. C d!", "E"]
    assert "".join(W.sentence_pieces("abcdefgh", 3, len)) == "abcdefgh"


def test_over_budget(spark):
    df = spark.createDataFrame([("a", 5), ("a", 50), ("b", 5)], "doc string, cost int")
    assert [r.doc for r in W.drop_over_budget(df, "doc", "cost", 10).collect()] == ["b"]
    assert W.drop_over_budget(df, "doc", "cost", 10, keep=True).where("over_budget").count() == 1


def test_encode_policies(spark):
    df = spark.createDataFrame([(1, "p q", "a b"), (2, "p q r", "a b c d"), (3, "", ""), (4, "", "a")], "id int, prompt string, answer string")
    drop = {r.id: r for r in tokens.encode(df, "prompt", "answer", 5).collect()}
    assert [drop[i].status for i in (1, 2, 3, 4)] == ["ok", "overlong", "empty", "ok"] and drop[2].input_ids is None
    assert drop[1].labels == [-100, -100, *drop[1].input_ids[2:]] and drop[4].labels == drop[4].input_ids
    cut = {r.id: r for r in tokens.encode(df, "prompt", "answer", 5, "truncate").collect()}
    assert cut[2].status == "truncated" and len(cut[2].input_ids) == 5
    assert {r.status: (r.n, r.tokens) for r in tokens.stats(tokens.encode(df, "prompt", "answer", 5)).collect()}["overlong"] == (1, 0)


def test_packing_and_padding(spark):
    df = spark.createDataFrame([(1, i, list(range(1, n + 1))) for i, n in enumerate([3, 4, 5, 2])], "shard int, pos int, input_ids array<int>").withColumn("labels", F.col("input_ids")).withColumn("attention_mask", F.col("input_ids"))
    packed = tokens.pack_sequences(df, "shard", "pos", 8).orderBy("bin").collect()
    assert [len(r.input_ids) for r in packed] == [7, 7] and packed[0].input_ids == [1, 2, 3, 1, 2, 3, 4]
    padded = tokens.pad_batches(df, "shard", 4, 9).orderBy("pos").first()
    assert padded.input_ids == [1, 2, 3, 9, 9, 9, 9, 9] and padded.labels[3:] == [-100] * 5 and padded.attention_mask[3:] == [0] * 5


def test_batches(spark):
    df = spark.createDataFrame([(i, (i * 7) % 10) for i in range(10)], "id int, n int")
    rows = tokens.length_batches(df, "n", "id", 4, 1, 0).collect()
    by = {}
    for r in rows:
        by.setdefault(r.batch, []).append(r.n)
    assert {k: sorted(v) for k, v in by.items()} == {0: [0, 1, 2, 3], 1: [4, 5, 6, 7], 2: [8, 9]}
    assert tokens.length_batches(df, "n", "id", 4, 1, 0, drop_last=True).count() == 8


def test_three_percentile_rules(spark):
    df = spark.range(10).withColumn("x", F.col("id"))
    row = df.agg(ranks.floor_index(F.col("x"), 0.5).alias("a"), ranks.upper_median(F.col("x")).alias("b"), ranks.nearest_even(F.col("x"), 0.5).alias("c")).first()
    assert (row.a, row.b, row.c) == (4, 5, 4)
    wanted = {"a": ("floor", 0.5), "b": ("upper", 0.5), "c": ("nearest", 0.5), "least": ("floor", 0.0), "most": ("floor", 1.0)}
    assert tuple(ranks.order_statistics(df, "x", wanted).first()) == (4, 5, 4, 0, 9)
    assert tuple(ranks.order_statistics(df.limit(0), "x", wanted).first()) == (None,) * 5


def test_order_statistics_of_ties_nulls_and_many_values(spark):
    import random

    r = random.Random(1)
    values = [r.choice([0.5, r.random(), -r.random() * 100]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 50, "v double").withColumn("n", F.lit(1)).withColumn("r", F.lit(2))
    wanted = {f"{rule}{k}": (rule, k / 7) for rule in ("floor", "nearest", "upper") for k in range(8)}
    row, ordered = ranks.order_statistics(df, "v", wanted).first(), sorted(values)
    for name, (rule, p) in wanted.items():
        at = {"floor": int(p * 2999), "nearest": round(p * 2999), "upper": 1500}[rule]
        assert row[name] == ordered[at], name


def test_group_split_is_leak_free(spark):
    rows = [(i, f"g{i % 20}", f"h{i % 33}", f"t{i}") for i in range(200)]
    df = splits.group_split(spark.createDataFrame(rows, "id int, g string, a string, b string"), "g")
    assert df.count() == 200 and df.select("g", "split").distinct().count() == 20
    kept = splits.remove_leaks(df, "a", "b").collect()
    sets = {s: {x for r in kept if r.split == s for x in (r.a, r.b)} for s in ("train", "val", "test")}
    assert not (sets["train"] & sets["val"] or sets["train"] & sets["test"] or sets["val"] & sets["test"])
    few = splits.group_split(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, g string"), "g")
    assert {r.split for r in few.collect()} == {"train", "val", "test"}


def test_round_robin(spark):
    df = spark.createDataFrame([(i, "big" if i < 90 else f"s{i}") for i in range(100)], "id int, doc string")
    rows = splits.round_robin(df, "doc", "id", 15).collect()
    assert len(rows) == 15 and len({r.doc for r in rows}) == 11


def test_global_rank_of_frequent_sizes_and_nulls(spark):
    import random

    r = random.Random(3)
    rows = [(i, r.choice([7, 7, 7, r.randrange(1000), None])) for i in r.sample(range(10**6), 4000)]
    df = spark.createDataFrame(rows, "id long, n long").withColumn("rank", F.lit(-1))
    found = {x.id: x.rank for x in splits.global_rank(df, "n", "id").collect()}
    ordered = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[0]))
    assert [found[i] for i, _ in ordered] == list(range(4000))
    named = df.withColumn("id", F.col("id").cast("string"))
    assert sorted(x.rank for x in splits.global_rank(named, "n", "id").collect()) == list(range(4000))
    assert splits.global_rank(df.limit(0), "n", "id").count() == 0


def test_splits_with_clashing_names_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(f"k{i % 12}" if i % 12 else None, i) for i in range(60)], "n string, split int").withColumn("slot", F.lit(1)).withColumn("h", F.lit(2))
    for out in (splits.group_split(df, "n"), splits.holdout(df, "n", 0.3), splits.hash_split(df, "n", 0.3)):
        assert out.count() == 60 and out.columns.count("split") == 1
        assert max(x.k for x in out.groupBy("n").agg(F.countDistinct("split").alias("k")).collect()) == 1
    assert splits.group_split(df.limit(0), "n").count() == 0 and splits.holdout(df.limit(0), "n", 0.5).count() == 0
