import json
import sys

from pyspark.sql import functions as F

from corpusloom.functions import markup
from corpusloom.operators import chat, metrics, quality, tokens
from corpusloom.sources import files, inputs, sinks
from corpusloom.streaming import incremental


def test_malformed_messages_are_counted(spark):
    kinds = "array<struct<role:string,content:string>>"
    rows = [
        (1, [("user", "a b"), ("assistant", "c")]), (2, None), (3, []), (4, [("user", "a")]), (5, [("user", None), ("assistant", "c")]), (6, [(None, "a"), ("assistant", "c")]),
        (7, [("assistant", "")]), (8, [("user", "x " * 50), ("assistant", "y")]),
    ]
    df = spark.createDataFrame(rows, f"id int, messages {kinds}").withColumn("status", F.lit("clash"))
    out = {r.id: r for r in tokens.encode_messages(df, 10).collect()}
    assert [out[i].status for i in range(1, 9)] == ["ok", *["malformed"] * 5, "empty", "overlong"]
    assert out[1].labels[:2] == [tokens.IGNORED] * 2 and out[2].input_ids is None and out[8].input_ids is None
    counts = {r.status: (r.n, r.tokens) for r in tokens.stats(tokens.encode_messages(df, 10)).collect()}
    assert counts == {"ok": (1, 3), "malformed": (5, 0), "empty": (1, 0), "overlong": (1, 0)}
    assert tokens.encode_messages(df.limit(0), 10).count() == 0
    turns = spark.createDataFrame([("c", 1, "assistant", "y"), ("c", 0, "user", "x")], "conv_id string, turn int, role string, text string")
    assert [(m.role, m.content) for m in chat.conversations(turns).first().messages] == [("user", "x"), ("assistant", "y")]


def test_anomaly_report_and_examples(spark):
    df = spark.createDataFrame([(i, i / 10, ["too_short"] if i < 3 else []) for i in range(11)], "id int, ratio double, reasons array<string>")
    row = metrics.anomaly_report(df).first()
    assert (row.n, row.anomalies, row.p05, row.p50, row.p95) == (11, 3, 0.0, 0.5, 1.0)
    assert [r.id for r in metrics.anomaly_examples(df, "id", 2).orderBy("id").collect()] == [0, 1]
    assert metrics.anomaly_report(df.limit(0)).first().p50 is None


def test_throughput(spark):
    df = spark.createDataFrame([("a", 100, 2.0), ("a", 50, 1.0), ("b", 5, 0.0)], "label string, tokens int, seconds double")
    out = {r.label: r for r in metrics.throughput(df, "label", "tokens", "seconds").collect()}
    assert (out["a"].tokens_per_second, out["a"].steps_per_second, out["a"].seconds_per_step) == (50.0, 2 / 3, 1.5) and out["b"].tokens_per_second is None


def test_rules_that_drop_and_missing_components(spark):
    df = spark.createDataFrame([(1, ["x"]), (2, []), (3, ["y", "z"]), (4, None)], "id int, flags array<string>")
    assert [r.id for r in quality.drop_flagged(df).orderBy("id").collect()] == [2, 4]
    assert [r.id for r in quality.drop_flagged(df, "y").orderBy("id").collect()] == [1, 2, 4]
    source = "[[module A]] [[module B]] [[module C]] AB-1 AB-2 AB-3 AB-4 AB-5"
    pairs = spark.createDataFrame([(1, source, "AB-1 AB-2 AB-3 AB-4 AB-5 \u6f22\u5b57"), (2, source, source + " \u6f22\u5b57" * 40)], "id int, source string, target string")
    levels = lambda **o: {r.id: (r.level, r.reasons) for r in quality.audit(pairs, **o).collect()}
    found = levels(components=markup.modules)
    assert "components_missing" in found[1][1] and "components_missing" not in found[2][1]
    names = [r.m for r in pairs.select(F.explode(markup.modules(F.col("source"))).alias("m")).distinct().collect()]
    assert "components_missing" not in levels(components=markup.modules, ignored=names[:1])[1][1]
    assert quality.audit(pairs, ignored=["AB-1"]).first().identifier_recall is None


def test_moves_splits_and_companions(spark, tmp_path):
    moves = tmp_path / "moves.jsonl"
    moves.write_text("".join(json.dumps({"doc": d, "type": "1:1", "source_ids": [i], "target_ids": [i], "similarity": 0.5}) + "\n" for d in "ab" for i in (2, 0, 1)))
    rows = files.read_moves(spark, str(moves)).orderBy("doc", "pos").collect()
    assert [(r.doc, r.pos, r.source_ids[0]) for r in rows] == [(d, k, i) for d in "ab" for k, i in enumerate((2, 0, 1))]
    assert files.not_split(["x/a.jsonl", "x/a.val.jsonl", "x/a.train.jsonl", "x/b.tmp", "x/c.tmp.jsonl"]) == ["x/a.jsonl"]
    df = spark.createDataFrame([(str(i), i) for i in range(50)], "doc string, x int")
    sinks.rewrite_split(df, str(tmp_path / "s"), "doc", 0.3)
    back = spark.read.json(str(tmp_path / "s"))
    assert back.count() == 50 and {r.split for r in back.select("split").distinct().collect()} == {"train", "val"}
    sinks.write_with_chat(df, df.drop("x"), str(tmp_path / "c"))
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == ["chat", "samples"]
    sinks.write_report(df, df.agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "r"), "Report", df.orderBy("x"))
    page = "\n".join(r.value for r in spark.read.text(str(tmp_path / "r" / "page")).collect())
    assert "## Worst" in page and page.count('"doc"') == 20


def test_file_cache_keys_and_sizes(spark, tmp_path):
    path = tmp_path / "in.txt"
    keys = []
    for text, params in (("a", {"x": 1}), ("a", {"x": 2}), ("ab", {"x": 1})):
        path.write_text(text)
        df = spark.read.text(str(path))
        keys.append(df.select(incremental.file_cache_key(df, params).alias("k")).first().k)
    assert len(set(keys)) == 3
    cache = spark.createDataFrame([("m", [1.0, 2.0]), ("m", [1.0]), ("n", [])], "model string, vec array<float>")
    assert {r.model: (r.rows, r.bytes) for r in incremental.cache_sizes(cache).collect()} == {"m": (2, 12), "n": (1, 0)}


def test_standard_input(spark, monkeypatch):
    import io

    monkeypatch.setattr(sys, "stdin", io.StringIO("from a pipe"))
    assert [tuple(r) for r in inputs.collect_inputs(spark, "-").collect()] == [("stdin", "from a pipe")]
