import hashlib
import random
import re
from collections import defaultdict

import numpy as np

from corpusloom.llm import repeats as R
from corpusloom.llm import text_arrays as TA


def brute(rows):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = defaultdict(lambda: 1 << 60)
    for d, w in words:
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            first[key] = min(first[key], d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["a", "b", "the", "of"] + ["w%d" % i for i in range(r.choice([5, 60, 2000]))]
    passages = [[r.choice(vocabulary) for _ in range(r.choice([49, 50, 51, 70, 130]))] for _ in range(5)] + [["same"] * 70, ["x", "y"] * 40]
    rows = []
    for d in range(40):
        text = []
        for _ in range(r.randint(0, 4)):
            text += r.choice(passages) if r.random() < 0.6 else [r.choice(vocabulary) for _ in range(r.randint(1, 90))]
        rows.append((d, r.choice([" ", "\n", "\t "]).join(text)))
    rows.append((40, rows[3][1]))
    rows.append((41, rows[5][1].replace(" ", "\n")))
    r.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for seed in range(3):
        rows = corpus(seed)
        found = R.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in found) == brute(rows), seed


def test_equal_windows_have_equal_interior_symbols():
    r = random.Random(9)
    for trial in range(60):
        vocabulary = range(r.choice([2, 3, 40, 5000]))
        shared = [r.choice(vocabulary) for _ in range(r.choice([50, 80]))]
        texts = [[r.choice(vocabulary) for _ in range(r.randint(0, 60))] + shared + [r.choice(vocabulary) for _ in range(r.randint(0, 60))] for _ in range(2)]
        seen = []
        for t in texts:
            p = R.Parsed(TA.mix(np.array(t, np.uint64)), np.array([0, len(t)]))
            windows = defaultdict(list)
            for s, low, high in zip(p.starts, p.low, p.high, strict=True):
                windows[tuple(t[s : s + 50])].append(tuple(p.symbols[low : max(low, high)]))
            seen.append(windows)
        for key in seen[0].keys() & seen[1].keys():
            inner = {x for w in seen for x in w[key]}
            assert len(inner) == 1, trial


def test_edge_rows(spark):
    long = " ".join(f"t{i}" for i in range(60))
    rows = [(1, long), (1, long), (None, long), (2, None), (3, ""), (4, "short text"), (5, "short text"), (6, long + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS kept", "1 AS n_words", "2 AS shared")
    found = sorted(((x.doc_id or 0, x.n_words, x.n_removed) for x in R.remove_repeats(df).collect()))
    assert found == [(0, 60, 0), (1, 60, 0), (1, 60, 0), (2, 0, 0), (3, 0, 0), (4, 2, 0), (5, 2, 0), (6, 61, 60)]
    assert R.remove_repeats(df.limit(0)).count() == 0
