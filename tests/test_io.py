import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import files, sinks, sqlite
from corpusloom.streaming import incremental


def pairs(df):
    return sorted((r.id, r.source, r.target) for r in df.collect())


def test_folders(spark, tmp_path):
    for name, text in {"en/P-100.txt": "one", "en/P-101.txt": "alone", "zh/P-100_zh.txt": "一", "en/.hidden.txt": "x", "en/sub/p_100.txt": "later"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    found = files.folder_pairs(spark, str(tmp_path / "en"), str(tmp_path / "zh"))
    assert sorted((r.key, r.source, r.target) for r in found.collect()) == [("P-100", "one", "一"), ("P-101", "alone", None)]
    assert pairs(files.load_pairs(spark, source_dir=str(tmp_path / "en"), target_dir=str(tmp_path / "zh"))) == [("P-100", "one", "一")]


def test_json_layouts(spark, tmp_path):
    record = {"id": "a", "en": "x", "zh": None, "chinese": "y"}
    layouts = {"list.json": [record], "named.json": {"note": 1, "records": [record]}, "map.json": {"a": {"en": "x", "zh": "y"}}}
    for name, value in layouts.items():
        (tmp_path / name).write_text(json.dumps(value))
        assert pairs(files.load_pairs(spark, str(tmp_path / name))) == [("a", "x", "y")], name
    (tmp_path / "own.json").write_text(json.dumps({"a": {"id": "b", "src": "x"}}))
    assert pairs(files.load_pairs(spark, str(tmp_path / "own.json"))) == [("b", "x", "")]


def test_jsonl_and_delimited(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"Page-ID": 7, "source": "s", "target": "t"}\n\n{"source": "u", "target": null}\n')
    found = pairs(files.load_pairs(spark, str(tmp_path / "p.jsonl")))
    assert ("7", "s", "t") in found and any(i.startswith("sample-") and s == "u" and t == "" for i, s, t in found)
    (tmp_path / "bad.jsonl").write_text('{"source": "s"}\n{broken\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "source string").collect()
    for name, sep in (("p.csv", ","), ("p.tsv", "\t"), ("p.tab", "\t")):
        (tmp_path / name).write_text(f'id{sep}src{sep}tgt\n1{sep}"two\nlines ""q"""{sep}b\n')
        assert pairs(files.load_pairs(spark, str(tmp_path / name))) == [("1", 'two\nlines "q"', "b")]
    with pytest.raises(ValueError):
        files.load_pairs(spark, "x.unknown")


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "c.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE other (a TEXT)")
        db.execute("CREATE TABLE items (slug TEXT, num INTEGER, en_text TEXT, zh_text TEXT)")
        db.executemany("INSERT INTO items VALUES (?, ?, ?, ?)", [(f"s{i}", i, f"text {i}" if i % 5 else " ", f"文{i}") for i in range(23)])
    assert sqlite.detect_table(path) == "items"
    df = sqlite.read_sqlite(spark, path, partitions=3)
    assert df.rdd.getNumPartitions() == 3 and df.count() == 23
    pages = files.page_table(df, "en_text", "zh_text", "num", limit=4).collect()
    assert [r.num for r in pages] == [1, 2, 3, 4]
    assert [r.num for r in files.page_table(df, "en_text", "zh_text", "num", largest=2, size="num").collect()] == [22, 21]
    assert files.load_pairs(spark, path).where("source = 'text 7'").first().target == "文7"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "short", "val"), ("b", "long", "train")], "id string, kind string, split string")
    assert sinks.write_jsonl(df, str(tmp_path / "j")) == 2 and files.read_jsonl(spark, str(tmp_path / "j")).count() == 2
    sinks.write_splits(df, str(tmp_path / "s"), "kind", "split")
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir()) == ["kind=long", "kind=short"]
    sinks.write_report(df, df.agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "r"), "Report")
    assert {p.name for p in (tmp_path / "r").iterdir()} == {"samples", "summary", "page"}
    page = sinks.report_markdown("T", {"S": {"a": 0.5, "m": {str(i): i for i in range(9)}}}, issues={f"c{i}": i for i in range(20)}, examples=list(range(12)))
    assert page.count("\n- c") == 15 and "- a: 0.5000" in page and "  - 5: 5" in page and "  - 6" not in page
    assert json.loads(sinks.report_json(df.agg(F.count(F.lit(1)).alias("n")))) == {"n": 2}


def test_incremental_runs_do_not_repeat(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ck"))
    work = lambda df: df.withColumn("y", F.col("x") * 2)
    spark.createDataFrame([(1,), (2,)], "x long").write.parquet(source)
    for _ in range(2):
        incremental.process_new(spark, source, "x long", work, sink, checkpoint)
        assert spark.read.parquet(sink).count() == 2
    spark.createDataFrame([(3,)], "x long").write.mode("append").parquet(source)
    incremental.process_new(spark, source, "x long", work, sink, checkpoint)
    assert sorted(r.y for r in spark.read.parquet(sink).collect()) == [2, 4, 6]
    incremental.process_new(spark, source, "x long", work, str(tmp_path / "fresh"), str(tmp_path / "ck2"))
    assert spark.read.parquet(str(tmp_path / "fresh")).count() == 3


def test_cache(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    cache = spark.createDataFrame([(1, "old"), (9, "old")], "k long, v string")
    out = incremental.fill_cache(df, cache, ["k"], lambda d: d.withColumn("v", F.lit("new")))
    assert sorted((r.k, r.v) for r in out.collect()) == [(1, "old"), (2, "new"), (3, "new")]
    report = incremental.cache_report(df, cache, ["k"]).first()
    assert (report.hits, report.misses) == (1, 2)
    keys = {df.select(incremental.cache_key(p, F.col("k")).alias("h")).first().h for p in ({"a": 1}, {"a": 2}, {"a": 1, "b": 0})}
    assert len(keys) == 3


def test_streaming_windows(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", "a", 1.0), ("2024-01-01 00:59:00", "a", 2.0), ("2024-01-01 01:00:00", "b", 3.0)]
    df = spark.createDataFrame(rows, "ts string, k string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "e"))
    batch = incremental.event_windows(df, "ts", "1 hour", ["k"], "v")
    assert sorted((r.k, r.n, r.total) for r in batch.collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]
    incremental.process_new(spark, str(tmp_path / "e"), "ts timestamp, k string, v double", lambda s: incremental.event_windows(s, "ts", "1 hour", ["k"], "v", delay="0 seconds"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert [(r.k, r.n) for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [("a", 2)]


def test_a_damaged_file_is_not_skipped(spark, tmp_path):
    import shutil

    import pytest

    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.range(3).selectExpr("id AS x").coalesce(1).write.parquet(source)
    bad = tmp_path / "in" / "bad.parquet"
    bad.write_bytes(b"PAR1 this is no file PAR1")
    with pytest.raises(Exception):
        incremental.process_new(spark, source, "x long", lambda s: s, sink, checkpoint)
    good = str(tmp_path / "good")
    spark.createDataFrame([(7,)], "x long").coalesce(1).write.parquet(good)
    shutil.copy(next((tmp_path / "good").glob("part-*.parquet")), bad)
    (tmp_path / "in" / ".bad.parquet.crc").unlink(missing_ok=True)
    incremental.process_new(spark, source, "x long", lambda s: s, sink, checkpoint)
    assert sorted(r.x for r in spark.read.parquet(sink).collect()) == [0, 1, 2, 7]
