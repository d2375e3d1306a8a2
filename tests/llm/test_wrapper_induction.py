import html
import random
import re

from corpusloom.llm import wrapper_induction as W
from corpusloom.llm.queries import QUERIES


def test_article_text_of_all_pages(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = {r.page_id: r for r in QUERIES["op5_wrapper_induction"](spark, sf).collect()}
    assert found.keys() == pages.keys()
    for k, page in pages.items():
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert found[k].text == "\n".join(p for p in parts if p) and found[k].n_chars == len(found[k].text)


def test_constant_slots_are_template(spark):
    r = random.Random(2)
    pages = [(i, f"http://h.example/{i}", f"<body><div class='top'>Site name</div><article><p>Read this first</p><h1>Title {i}</h1>" + "".join(f"<p>body {i} {r.random()}</p>" for _ in range(r.randint(1, 5))) + "<div class='comments'><p>nice!</p></div></article><div>bye</div></body>") for i in range(20)]
    out = {x.page_id: x.text for x in W.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i, _, page in pages:
        wanted = [f"Title {i}", *re.findall(r"<p>(body[^<]*)", page)]
        assert out[i].split("\n") == wanted


def test_pages_without_article(spark):
    pages = [(i, f"https://u@H.example:80/{i}", f"<body><ul class='menu'><li><a href=x>home</a></ul><div id='c'><p>{'long text ' * 20}{i}</p><p>more text {i} {'w ' * 60}</p></div><p>footer line</p></body>") for i in range(12)]
    out = {x.page_id: x.text for x in W.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(out[i].startswith("long text") and f"more text {i}" in out[i] and "home" not in out[i] and "footer" not in out[i] for i in out)


def brute(a, i, b, j):
    if a.nodes[i].tag != b.nodes[j].tag:
        return 0
    x, y = a.children[i], b.children[j]
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for p, u in enumerate(x):
        for q, v in enumerate(y):
            m[p + 1][q + 1] = max(m[p][q + 1], m[p + 1][q], m[p][q] + brute(a, u, b, v))
    return 1 + m[-1][-1]


def test_simple_tree_matching_against_recursion():
    r = random.Random(7)

    def page(depth=0):
        return "".join(f"<{t}>{page(depth + 1)}</{t}>" for t in r.choices(["div", "span", "b"], k=r.randint(0, 4 - depth))) if depth < 4 else ""

    m = W.Matcher()
    for _ in range(60):
        a, b = m.tree(page()), m.tree(page())
        assert m.score(a, 0, b, 0) == brute(a, 0, b, 0)
        pairs = m.align(a, b)
        assert len(pairs) == brute(a, 0, b, 0) and len(set(pairs.values())) == len(pairs)


def test_edge_rows(spark):
    rows = [(1, None, None), (2, "nonsense", ""), (3, "http://a.b/c", "<article><p>x</p></article>"), (3, "http://a.b/c", "<article><p>x</p></article>"), (None, "http://a.b/d", "no markup")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "7 AS text", "8 AS pivot", "9 AS host")
    out = sorted((x.page_id or 0, x.text, x.pivot, x.host) for x in W.main_text(df).collect())
    assert out == [(0, "no markup", 8, 9), (1, "", 8, 9), (2, "", 8, 9), (3, "x", 8, 9), (3, "x", 8, 9)]
    assert W.main_text(df.limit(0)).count() == 0


def texts_of(spark, pages):
    df = spark.createDataFrame([(i, "http://h.example/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [x.text.split("\n") for x in sorted(W.main_text(df).collect(), key=lambda x: x.page_id)]


def test_only_constant_text_of_different_pages_is_template(spark):
    usual = [f"<article><p>Read this</p><p><span>inline {i}</span></p></article>" for i in range(20)]
    usual.append("<article><p>other 20</p><p>direct <span>inline 20</span></p></article>")
    assert texts_of(spark, usual) == [[f"inline {i}"] for i in range(20)] + [["other 20", "direct inline 20"]]
    assert texts_of(spark, ["<article><p>body</p></article>"] * 12) == [["body"]] * 12


def test_only_whole_class_names_are_boilerplate(spark):
    pages = [
        "<body class='post no-sidebar'><article><p>a</p></article></body>",
        "<body class='sidebar'><div id='page' class='has-header'><p>b</p></div></body>",
        "<article><div class='body with-sidebar'><p>c</p></div><div class='Ad x'><p>no</p></div></article>",
        "<div class='sidebar'><article><p>d</p></article></div>",
    ]
    assert texts_of(spark, pages) == [["a"], ["b"], ["c"], ["d"]]


def test_all_articles_are_content(spark):
    pages = [
        "<article><p>one</p></article><article><p>two, longer</p></article>",
        "<main><p>lead</p><article><p>body</p></article><p>end</p></main>",
        f"<article><p>text</p></article><article class='comment'><p>{'long ' * 50}</p></article>",
    ]
    assert texts_of(spark, pages) == [["one", "two, longer"], ["lead", "body", "end"], ["text"]]


def test_short_sections_without_article_are_content(spark):
    pages = [f"<body><div><h1>Title {i}</h1></div><div><p>{'long ' * 100}{i}</p></div><div><p>short {i}</p></div></body>" for i in range(10)]
    assert texts_of(spark, pages) == [[f"Title {i}", f"{'long ' * 100}{i}", f"short {i}"] for i in range(10)]


def disguised(n, seed=3):
    """Pages without article elements and with random names: a notice and a line of links change their text but not their structure."""
    r = random.Random(seed)

    def words(k):
        return " ".join(r.choice("abcdefghij") * r.randint(2, 6) for _ in range(k))

    pages, wanted = [], []
    for _ in range(n):
        parts = [words(6), *(words(r.randint(3, 30)) for _ in range(r.randint(1, 7)))]
        name = lambda: "x%d" % r.randrange(10**6)
        links = "".join(f"<span><a href=/>{words(1)}</a></span>" for _ in range(5))
        body = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{p}</p>" for p in parts[1:])
        pages.append(f"<html><body><div class={name()}>{links}</div><div class={name()}>{words(12)}</div><div class={name()}><div id={name()}>{body}</div></div><div>{words(8)}</div></body></html>")
        wanted.append(parts)
    return pages, wanted


def test_region_is_found_by_alignment_alone(spark):
    for n in (2, 5, 30):
        pages, wanted = disguised(n, seed=n)
        assert texts_of(spark, pages) == wanted


def test_without_a_template_the_region_is_lost():
    pages, wanted = disguised(30)
    bare = [W.extract(W.Tree(W.parse(p), {})).split("\n") for p in pages]
    assert all(b != w for b, w in zip(bare, wanted, strict=True))


def test_wide_pages_take_time_in_proportion():
    import time

    def took(n):
        r = random.Random(1)
        m = W.Matcher()
        a, b = (m.tree("<div>" + "".join(r.choice(["<p>x</p>", "<p><b>x</b></p>", "<p><i>x</i><b>y</b></p>"]) for _ in range(k)) + "</div>") for k in (n, n - 7))
        began = time.perf_counter()
        found = m.align(a, b)
        assert len(set(found.values())) == len(found) >= n
        return time.perf_counter() - began

    took(100)
    small, large = took(10_000), took(100_000)
    assert large < 20 * small + 2


def test_equal_ends_lose_nothing():
    r = random.Random(9)
    m = W.Matcher()
    for _ in range(40):
        page = lambda: "<div>" + "".join(r.choice(["<p>x</p>", "<p><b>x</b></p>", "<ul><li>a</ul>"]) for _ in range(r.randint(0, 6))) + "</div>"
        a, b = m.tree(page()), m.tree(page())
        assert m.score(a, 0, b, 0) == brute(a, 0, b, 0)


def test_wide_lists_are_mapped_like_short_ones(monkeypatch):
    r = random.Random(5)
    m = W.Matcher()
    for k, top, n in ((3, 4, 40), (12, 4, 40), (3, 300, 60), (12, 70_000, 25), (1, 1, 30)):
        for _ in range(6):
            m.known = {(s, t): (r.choice([0, r.randint(1, top)]), []) for s in range(k) for t in range(k)}
            a, b = ([r.randrange(k) for _ in range(r.randint(1, n))] for _ in range(2))
            for b in (b, a[: len(a) // 3] + b[:2] + a[len(a) // 3 :]):
                assert W.Wide(a, b, m.known).pairs() == m._table(a, b, 0, len(a), 0, len(b))
    pages = ["<div>" + "".join(r.choice(["<p>x</p>", "<p><b>x</b></p>", "<p><i>x</i><b>y</b></p>", "<ul><li>a</ul>"]) for _ in range(size)) + "</div>" for size in (700, 640)]
    found = []
    for cells in (W.MAX_CELLS, 10**9):
        monkeypatch.setattr(W, "MAX_CELLS", cells)
        m = W.Matcher()
        found.append(m.align(*map(m.tree, pages)))
    assert 640 * 700 > 250_000 and found[0] == found[1]


def test_a_notice_is_template_however_wide_its_page_is(spark):
    for size in (1, 100):
        pages, wanted = [], []
        for i in range(12):
            lead, rest = [f"lead {i} {k}" for k in range(i % 2 * 8 * size)], [f"body {i} {k}" for k in range(6 * size)]
            tag = "bi"[i % 2]
            pages.append("<article>" + "".join(f"<p>{x}</p>" for x in lead) + "<ul><li>Read this<li>and this</ul>" + "".join(f"<p>{x}</p>" for x in rest) + f"<p><{tag}>end {i}</{tag}></p></article>")
            wanted.append([*lead, *rest, f"end {i}"])
        assert texts_of(spark, pages) == wanted


def test_pivots_by_broadcast_and_by_salt_give_equal_texts(spark, monkeypatch):
    pages, wanted = disguised(30)
    for limit in (W.BROADCAST_BYTES, -1):
        monkeypatch.setattr(W, "BROADCAST_BYTES", limit)
        assert texts_of(spark, pages) == wanted
