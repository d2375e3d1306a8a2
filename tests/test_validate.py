from pyspark.sql import functions as F

from corpusloom.functions import markup as M
from corpusloom.operators import validate as V

PAGE = """[[include :wiki:component:frame |name=alpha
|caption=Some words
]]
**Title** and //more//
[[div class="box"]]
+ Heading
text [[footnote]]note[[/footnote]] https://x.example.org/a). https://y.example.org
[[/div]]
[[code type="css"]]
a {  b }
[[/code]]
{{{x  y}}}
[[module Rate]]
"""


def check(spark, source, hypothesis, **kw):
    return V.validate(spark.createDataFrame([(source, hypothesis)], "source string, hypothesis string"), **kw).first()


def codes(row):
    return {i.code for i in row.issues}


def test_equal_texts(spark):
    row = check(spark, PAGE, PAGE)
    assert row.score == 1.0 and row.issues == [] and row.source_len == len(PAGE)
    assert set(row.outcomes) == set(V.CHECKS) and row.outcomes["balance"].checked == 3


def test_mutations(spark):
    assert {"unclosed_markup", "tag_missing"} <= codes(check(spark, PAGE, PAGE.replace("[[/div]]", "")))
    row = check(spark, PAGE, PAGE.replace("[[module Rate]]", "[[module 评分]]"))
    assert {"cjk_in_protected", "module_missing", "module_added"} <= codes(row) and row.score < 1
    assert codes(check(spark, PAGE, PAGE.replace("a {  b }", "c"))) == {"code_block_modified"}
    assert "include_missing" in codes(check(spark, PAGE, PAGE.replace("component:frame", "component:框")))
    assert codes(check(spark, PAGE, PAGE + "**")) == {"inline_unbalanced"}
    assert codes(check(spark, PAGE, PAGE.replace("a {  b }", "a { b }"))) == set()


def test_nothing_to_check_and_nulls(spark):
    assert check(spark, "words", None).score == 1.0 and check(spark, None, None).issues == []
    assert check(spark, PAGE, "").score == 0.0


def test_chosen_checks(spark):
    row = check(spark, PAGE, PAGE.replace("{{{x  y}}}", ""), checks=("tag",))
    assert list(row.outcomes) == ["tag"] and row.score == 1.0


def test_sites(spark):
    sites = M.Sites(hosts=("wiki.example.org", "wiki.example.net"))
    df = spark.createDataFrame([("http://www.wiki.example.net/a",)], "u string")
    assert df.select(M.canonical_url(F.col("u"), sites).alias("x")).first().x == "<wiki>/a"
    for target in (":wiki:component:frame", ":wiki-cn:component:frame-source", " wiki-xx:component:FRAME "):
        assert spark.createDataFrame([(target,)], "t string").select(M.canonical_include(F.col("t")).alias("x")).first().x == "component:frame"


def test_unicode_words_in_tags(spark):
    df = spark.createDataFrame([("[[footnote脚注]] x [[div_]]",)], "t string")
    row = df.select(M.protected_tokens(F.col("t")).alias("p"), M.tag_names(F.col("t")).alias("t")).first()
    assert [tuple(x) for x in row.p] == [("tag", "footnote脚注"), ("tag", "div_")] and row.t == ["footnote", "div"]


def test_summaries(spark):
    rows = V.validate(spark.createDataFrame([(PAGE, PAGE), (PAGE, "")], "source string, hypothesis string"))
    summary = V.preservation_summary(rows).first()
    assert summary.n == 2 and summary.perfect_ratio == 0.5 and summary.samples_with_errors == 1
    means = {r.check: r.mean_rate for r in V.check_means(rows).collect()}
    assert means["tag"] == 0.5
    assert V.issue_counts(rows, 1).count() == 1
