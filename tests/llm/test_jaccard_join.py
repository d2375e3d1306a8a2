import random
import re
from collections import Counter, defaultdict

import numpy as np

from corpusloom.llm import jaccard_join as J
from corpusloom.llm.graph import components


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    parent, links = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, k in Counter(j for g in s for j in where[g] if j != i).items():
            if 5 * k >= 4 * (len(s) + len(sets[j]) - k):
                links[i] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def test_against_brute_force(spark):
    r = random.Random(4)
    words = ["w%d" % i for i in range(300)]
    rows, d = [], 0
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.choice([3, 12, 60, 150]))]
        for _ in range(r.choice([1, 2, 8])):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                text[r.randrange(len(text))] = r.choice(words)
            rows.append((d, " ".join(text)))
            d += 1
    rows += [(d, ""), (d + 1, None), (d + 2, "one"), (d + 3, "one"), (d + 4, " \t one\n")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((x.doc_id, x.class_id, x.n_links) for x in J.jaccard_classes(df).collect())
    assert found == brute(rows)


def test_large_groups_are_split_into_blocks(spark, monkeypatch):
    r = random.Random(5)
    base = ["b%d" % i for i in range(80)]
    rows = []
    for d in range(60):
        text = list(base)
        text[r.randrange(80)] = "x%d" % d
        rows.append((d, " ".join(text)))
    # A star: leaves that are near the centre and far from each other.
    centre = ["c%d" % i for i in range(120)]
    rows.append((100, " ".join(centre)))
    for d in range(20):
        rows.append((101 + d, " ".join([*centre[: 5 * d], *("y%d-%d" % (d, i) for i in range(3)), *centre[5 * d :], "z%d" % d])))
    monkeypatch.setattr(J, "BLOCK", 8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((x.doc_id, x.class_id, x.n_links) for x in J.jaccard_classes(df).collect()) == brute(rows)
    monkeypatch.setattr(J, "BLOCK", 512)
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 500)
    assert sorted((x.doc_id, x.class_id, x.n_links) for x in J.jaccard_classes(df).collect()) == brute(rows)


def test_rows_grow_with_members(spark, monkeypatch):
    """One family of different near copies, in blocks: no operator's rows grow with its square."""
    made = []
    plain = J.materialise

    def counted(df, name, tidy=False):
        found = plain(df, name, tidy)
        made.append(found.count())
        return found

    monkeypatch.setattr(J, "materialise", counted)
    monkeypatch.setattr(J, "BLOCK", 64)
    r, base = random.Random(6), ["b%d" % i for i in range(120)]
    most = {}
    for n in (500, 2000):
        rows = []
        for d in range(n):
            text = list(base)
            text[r.randrange(120)] = "x%d" % d
            rows.append((d, " ".join(text)))
        made.clear()
        found = J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {(x.class_id, x.n_links) for x in found} == {(0, n - 1)}
        most[n] = max(made)
    assert most[2000] <= 4.5 * most[500] and most[2000] <= J.BANDS * 2000


def test_links_whose_edges_do_not_fit_come_in_further_rounds(spark, monkeypatch):
    """Members of one block that link to more members elsewhere than a task may write edges."""
    import pyarrow as pa

    sets = [np.array([1], np.uint64)]
    blocks = {0: [0], 1: list(range(1, 9)), 2: list(range(9, 17))}
    sig = np.zeros(J.ROWS * J.BANDS, "<u2").tobytes()
    shape = pa.struct([("member", pa.int64()), ("copies", pa.int64()), ("sig", pa.binary()), ("shingles", pa.binary()), ("label", pa.int64())])
    rows = [[{"member": m, "copies": 1, "sig": sig, "shingles": sets[0].tobytes(), "label": m} for m in ms] for ms in blocks.values()]
    batch = pa.RecordBatch.from_arrays([pa.array([5] * 3), pa.array([0] * 3), pa.array([-1, 1, 2]), pa.array(rows, pa.list_(shape))], names=["family", "task", "rank", "members"])
    out = pa.Table.from_batches(J._links_between([batch])).to_pylist()
    assert [x["n"] for x in out if x["b"] is None and x["a"] is not None] == [16]
    assert sum(x["b"] is not None for x in out) == 2 and sum(x["a"] is None for x in out) == 1


def test_recall_of_near_copies(spark):
    """Pairs of 0.8 to 0.9, each planted once: how many of them are found."""
    r, rows, linked = random.Random(8), [], 0
    for k in range(1500):
        base = ["k%d-%d" % (k, i) for i in range(r.randint(60, 200))]
        text = list(base)
        for _ in range(max(1, len(base) // 45)):
            text[r.randrange(len(text))] = "x%d" % r.randrange(10**6)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(text))]
    truth = brute(rows)
    found = sorted((x.doc_id, x.class_id, x.n_links) for x in J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    linked = sum(n for _, _, n in truth)
    assert linked > 1000 and sum(n for _, _, n in found) >= 0.999 * linked


def test_posterior_rule():
    rng = np.random.default_rng(0)
    for n in (32, 64, 192):
        m = J.least_matches(n)
        draws = rng.beta(m + 1, n - m + 1, 400000)
        below = rng.beta(m, n - m + 2, 400000)
        assert (draws >= 0.8).mean() > J.TOLERANCE / 4 and (below >= 0.8).mean() < J.TOLERANCE * 4


def test_repeats_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, "a b c d e f")], "doc_id long, text string").selectExpr("*", "1 AS class_id", "2 AS size")
    rows = J.jaccard_classes(df).collect()
    assert Counter((x.doc_id, x.class_id, x.n_links) for x in rows) == Counter([(1, 1, 2), (1, 1, 2), (None, None, 0), (2, 2, 0), (3, 1, 2)])
    assert J.jaccard_classes(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (30, 30), (None, 4)] + [(100 + i, 101 + i) for i in range(40)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[x] for x in (1, 2, 3, 7, 8, 9)} == {1} and found[21] == 20 and found[30] == 30 and {found[100 + i] for i in range(41)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
