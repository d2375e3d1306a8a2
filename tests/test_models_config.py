import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import config
from corpusloom.operators import chunks, models, quality
from corpusloom.sources import files, inputs


def test_embeddings_cache(spark, tmp_path):
    pages = spark.createDataFrame([("a", "one\n\ntwo", "一\n\n二"), ("b", "three", "三"), ("c", "", "四")], "doc string, s string, t string")
    empty = spark.createDataFrame([], "doc string, side string, idx int, vec array<float>, side_hash string, model string")
    first = models.warm_up(pages, empty, "doc", "s", "t")
    rows = first.collect()
    assert len(rows) == 6 and all(abs(np.linalg.norm(r.vec) - 1) < 1e-5 for r in rows)
    models.write_embeddings(first, str(tmp_path / "cache"))
    cache = spark.read.parquet(str(tmp_path / "cache"))
    changed = pages.withColumn("s", F.when(F.col("doc") == "b", "changed").otherwise(F.col("s")))
    assert [(r.doc, r.side) for r in models.warm_up(changed, cache, "doc", "s", "t").collect()] == [("b", "s")]


def test_counters_and_budgets(spark):
    df = spark.createDataFrame([("a bb  ccc",), ("",), (None,)], "t string")
    letters = lambda: lambda texts: [len(t.replace(" ", "")) for t in texts]
    assert [r.n for r in df.select(models.count_tokens(F.col("t"), letters).alias("n")).collect()] == [6, 0, 0]
    assert [r.n for r in df.select(models.count_tokens(F.col("t")).alias("n")).collect()] == [3, 0, 0]
    words = lambda texts: [len(t.split()) for t in texts]
    assert models.prompt_overhead("Turn {source} round", "Be brief", words) == 12
    assert models.inference_budget(100, 12, 40, 8) == 40
    with pytest.raises(ValueError):
        models.inference_budget(10, 5, 5)


def test_generate(spark):
    df = spark.createDataFrame([("hello",)], "source string")
    row = models.generate(df, "source", "Say {source}", lambda: lambda prompts: [p.upper() for p in prompts], system="S").first()
    assert row.prompt.endswith("<|im_start|>user\nSay hello<|im_end|>\n<|im_start|>assistant\n") and row.hypothesis == row.prompt.upper()


def test_chunks(spark):
    paragraphs = ["+ One", "a " * 6, "b " * 6, "+ Two", "c " * 3, "d. " * 30]
    groups = chunks.chunk_paragraphs([p.strip() for p in paragraphs], 4, 10)
    assert all(sum(len(p.split()) for p in g) <= 10 for g in groups)
    assert groups[0][0] == "+ One" and groups[1][0] == "+ One" and all(g[0] in ("+ One", "+ Two") for g in groups)
    words = " ".join(w for g in groups for p in g for w in p.split() if not p.startswith("+"))
    assert words.split() == " ".join(p for p in paragraphs if not p.startswith("+")).split()
    df = spark.createDataFrame([(1, "x\n\ny"), (2, None)], "id int, t string")
    assert [(r.id, r.text) for r in chunks.structured_chunks(df, "id", "t").collect()] == [("1", "x\n\ny")]


def test_config(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"a": {"b": 1, "c": [1]}, "d": "x"}))
    (tmp_path / "own.json").write_text(json.dumps({"defaults": "base.json", "a": {"c": [2]}}))
    found = config.load(tmp_path / "own.json", ["a.b=5", "e.f=text"])
    assert found == {"a": {"b": 5, "c": [2]}, "d": "x", "e": {"f": "text"}}
    assert config.get(found, "a.b") == 5 and config.get(found, "a.x.y", 0) == 0
    (tmp_path / "one.json").write_text(json.dumps({"defaults": ["two.json"]}))
    (tmp_path / "two.json").write_text(json.dumps({"defaults": ["one.json"]}))
    with pytest.raises(ValueError):
        config.load(tmp_path / "one.json")


def test_inputs_and_synthetic(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_text("A\nB")
    (tmp_path / "x" / "b.md").write_text("C")
    assert [r.text for r in inputs.collect_inputs(spark, str(tmp_path / "x"), suffixes=[".TXT"]).collect()] == ["A\nB"]
    assert [r.text for r in inputs.collect_inputs(spark, literals=["p", "q"]).collect()] == ["p", "q"]
    pairs = inputs.synthetic_pairs(spark, 60, flaws=True)
    assert pairs.count() == 64 and quality.drop_duplicates(pairs, "id", same_source=False).count() == 63
    flagged = {r.id: r.flags for r in quality.quality_flags(pairs).collect()}
    assert "low_target_cjk" in flagged["FLAW-LATIN"] and "source_too_short" in flagged["FLAW-EMPTY"]
    inputs.write_mirrored(spark.createDataFrame([("d1", "t1", 1)], "folder string, text string, n int"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out" / "texts")).first().folder == "d1"
    assert files.pick(["A b", "a_b", "other"], ["zz"]) is not None
