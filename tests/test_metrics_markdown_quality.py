import math
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.operators import chat, joins, metrics, quality
from corpusloom.operators import markdown as MD


def test_bleu_and_chrf_by_hand(spark):
    rows = [(1, "the cat sat on the mat", "the cat sat on a mat"), (2, "收容措施是必要的", "收容措施很必要")]
    df = spark.createDataFrame(rows, "id int, hyp string, ref string")
    tokens = lambda t: list(t) if "收" in t else t.split()
    totals = {}
    for n in range(1, 5):
        for _, h, r in rows:
            a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (tokens(h), tokens(r)))
            old = totals.get(n, (0, 0))
            totals[n] = (old[0] + sum((a & b).values()), old[1] + sum(a.values()))
    sys_len, ref_len = (sum(len(tokens(r[k])) for r in rows) for k in (1, 2))
    want = min(1, math.exp(1 - ref_len / sys_len)) * math.exp(sum(math.log(100 * m / t) for m, t in totals.values()) / 4)
    stats = metrics.ngram_stats(df, "id", metrics.bleu_tokens(F.col("hyp")), metrics.bleu_tokens(F.col("ref")), range(1, 5))
    row = metrics.bleu(stats).first()
    assert abs(row.score - want) < 1e-9 and (row.sys_len, row.ref_len) == (sys_len, ref_len)
    chars = metrics.ngram_stats(df, "id", metrics.char_units(F.col("ref")), metrics.char_units(F.col("ref")), range(1, 7))
    assert metrics.chrf(chars).first().score == 100.0


def test_bleu_without_matches_is_smoothed(spark):
    df = spark.createDataFrame([(1, "a b c d e", "a x y z e")], "id int, h string, r string")
    stats = metrics.ngram_stats(df, "id", F.split("h", " "), F.split("r", " "), range(1, 5))
    want = math.exp((math.log(40) + math.log(100 / 2 / 4) + math.log(100 / 4 / 3) + math.log(100 / 8 / 2)) / 4)
    assert abs(metrics.bleu(stats).first().score - want) < 1e-9


def test_bleu_tokens(spark):
    df = spark.createDataFrame([("He said: 3.14, ok-ay 2-3.",)], "t string")
    assert df.select(metrics.bleu_tokens(F.col("t")).alias("x")).first().x == ["He", "said", ":", "3.14", ",", "ok-ay", "2", "-", "3."]


def test_rouge(spark):
    df = spark.createDataFrame([("a b c d", "a c d e"), ("漢字", "漢字"), ("", "a")], "h string, r string")
    word = [r.x for r in df.select(metrics.rouge_l(F.col("h"), F.col("r"), "word").alias("x")).collect()]
    assert word == [0.75, 1.0, 0.0]
    assert [r.x for r in df.select(metrics.rouge_l(F.col("h"), F.col("r"), "ascii").alias("x")).collect()][1] == 0.0


def test_anomalies(spark):
    rows = [(1, "x", "漢" * 100, "漢" * 100), (2, "x", "漢" * 100, ""), (3, "x", "漢" * 100, "漢" * 100 + "字" * 8000), (4, "x", "漢" * 100, "latin words " * 10), (5, "x", "漢" * 100, "漢")]
    out = {r.id: r.reasons for r in metrics.length_anomalies(spark.createDataFrame(rows, "id int, s string, r string, h string"), "s", "r", "h").collect()}
    assert out == {1: [], 2: ["empty_hypothesis"], 3: ["too_long"], 4: ["not_chinese"], 5: ["too_short"]}


def test_markdown():
    page = """<html><body>skip<div id="page-content"><h2>Title <b>x</b></h2><p>a  b<br>c <a href="/p">l</a> <a href="http://e">m</a></p><script>no</script>
    <div class="code"><pre>x ~~~ y
  z</pre></div><table><tbody><tr><th>h|1</th><th>h2</th></tr><tr><td>1</td></tr></tbody></table><ul><li>one<li>two</ul><blockquote>q<br>r</blockquote></i><hr>t</div></body></html>"""
    out = MD.convert(page, "https://site")
    assert "skip" not in out and "no" not in out.split("Title")[1][:40]
    for piece in ("## Title x", "a b\nc [l](https://site/p) [m](http://e)", "~~~~\nx ~~~ y\n  z\n~~~~", "| h\\|1 | h2 |\n| --- | --- |\n| 1 |  |", "> q\n> r", "----"):
        assert piece in out, piece
    assert "\n\n\n" not in out and out.endswith("\n") and MD.convert("") == "\n" and MD.fence("a") == "~~~"


def test_markdown_of_deep_and_odd_pages(spark):
    deep = "<div>" * 3000 + "<script>var secret=1;</script>deep"
    rows = [(1, deep), (2, None), (3, ""), (4, "<b>" * 3000 + "x"), (5, "<p>" + "y " * 200000)]
    df = spark.createDataFrame(rows, "id int, html string").withColumn("markdown", F.lit("clash"))
    out = {r.id: r.markdown for r in MD.html_to_markdown(df, "id", "html").collect()}
    assert out[1] == "deep\n" and out[2] == out[3] == "\n" and out[4] == "x\n" and len(out[5]) == 400000
    assert MD.html_to_markdown(df.limit(0), "id", "html").count() == 0


def test_markdown_parts():
    assert MD.convert("<ul><li>a<b>b</b></li>stray<p>lost</p><li> c </li></ul>") == "- ab\n- c\n"
    assert MD.convert("<pre>a <b>b</b><br>  c\n\n</pre>") == "~~~\na b\n  c\n~~~\n"
    assert MD.convert("<div class='code'>x<div><pre>inner</pre></div>y<pre>second</pre></div>") == "~~~\ninner\n~~~\n"
    assert MD.convert("<table><tr><td>a<br> b</td><td>c|d</td></tr><tr></tr><tr><th>e</th></tr></table>") == "| a\\nb | c\\|d |\n| --- | --- |\n| e |  |\n"
    assert MD.convert("<p>one <code>a  b</code> two<hr>x<a>bare</a></p>") == "one a  b two\n----\nxbare\n"
    assert MD.convert("</p><i>un<b>closed</i>text") == "un\nclosed\ntext\n"
    assert MD.convert("<body>all<div id='page-content'>this</div></body>") == "this\n"


def test_quality(spark):
    good = ("word " * 60, "漢字" * 60)
    df = spark.createDataFrame([(1, *good), (2, "short", "短"), (3, good[0], good[0]), (4, *good), (5, None, None)], "id int, source string, target string")
    flags = {r.id: r.flags for r in quality.quality_flags(df).collect()}
    assert flags[1] == [] and "identical_sides" in flags[3] and "source_too_short" in flags[2] and "low_target_cjk" in flags[3]
    assert sorted(r.id for r in quality.drop_duplicates(df, "id").collect()) == [1, 2, 5]
    assert sorted(r.id for r in quality.drop_duplicates(df, "id", same_source=False).collect()) == [1, 2, 3, 5]
    ids = " ".join(f"AB-{i}" for i in range(6))
    audited = {r.id: r for r in quality.audit(spark.createDataFrame([(1, ids + " word" * 40, "漢字" * 60), (2, ids + " word" * 40, ids + "漢字" * 40)], "id int, source string, target string")).collect()}
    assert audited[1].level == "fail" and "identifiers_lost" in audited[1].reasons and audited[2].level == "pass"
    assert quality.clean_metrics(df).first().source_len == 300


def test_chat(spark):
    df = spark.createDataFrame([("a", "q", "r")], "id string, source string, target string")
    row = chat.chat_samples(df, "id", "T {source}", system="S").first()
    assert [(m.role, m.content) for m in row.messages] == [("system", "S"), ("user", "T q"), ("assistant", "r")]
    swapped = chat.chat_samples(df, "id", "{source}", "target", "source").first()
    assert [m.content for m in swapped.messages] == ["r", "q"]


def test_joins(spark):
    preds = spark.createDataFrame([("a::1",), ("a::9",), ("z",)], "id string")
    refs = spark.createDataFrame([("a::1", "x"), ("a::2", "y")], "id string, target string")
    assert {r.id: r.target for r in joins.with_reference(preds, refs, "id", ["target"], "id").collect()} == {"a::1": "x", "a::9": "x", "z": None}
    rows = spark.createDataFrame([("d", i, 4, 2) for i in range(1, 5)], "doc string, i int, n int, m int")
    cols = spark.createDataFrame([("d", 1), ("d", 2)], "doc string, j int")
    assert joins.band(rows, cols, "doc", "n", "m", 0).count() == 6
