import hashlib

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import fingerprints as P
from corpusloom.llm.queries import QUERIES


def shingles(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_edited_texts_and_likeness(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id", ascending=False).reset_index(drop=True)
    found = QUERIES["op2_one_permutation"](spark, sf).toPandas().set_index("doc_id")
    errors, prints = [], {}
    for i, row in docs.iterrows():
        after = docs.text[(i + 1) % len(docs)]
        k = len(row.text) // 3
        edited = row.text[: len(row.text) - k] + after[:k]
        got = found.loc[row.doc_id]
        assert got.n_chars == len(row.text) and got.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(row.text), shingles(edited), shingles(after)
        errors += [got.near_edited - len(a & b) / len(a | b), got.near_next - len(a & c) / len(a | c)]
        assert prints.setdefault(row.text, got.fingerprint) == got.fingerprint
    assert len(found) == len(docs) and abs(np.mean(errors)) < 0.01 and np.sqrt(np.mean(np.square(errors))) < 0.04


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one  two"), (7, "a b c d e f g"), (7, "a b c d e f g"), (None, "a b c d e f g")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS own", "2 AS next_own")
    bins = {(r.doc_id, r.text): r.bins for r in P.with_bins(df, "text", "bins").collect()}
    assert bins[1, None] is bins[2, ""] is bins[3, " \n"] is None
    assert bins[4, "one two"] == bins[5, "one  two"] != bins[7, "a b c d e f g"]
    assert all(len(b) == P.BINS for b in bins.values() if b)
    out = P.edited_pairs(df).collect()
    assert len(out) == len(rows)
    assert P.edited_pairs(df.limit(0)).count() == 0
    one = P.edited_pairs(df.where("doc_id = 4")).first()
    assert one.edited == "one t" + "on" and one.own == one.next_own


def test_next_row_over_ranges(spark, monkeypatch):
    import random

    monkeypatch.setattr(P, "FINE_ROWS", 3)
    r = random.Random(1)
    ids = [r.choice([r.randrange(50), r.randrange(10**6, 10**6 + 40), -r.randrange(10**12)]) for _ in range(150)]
    rows = [(i, str(k)) for k, i in enumerate(sorted(set(ids)))]
    found = {x.k: x.next_v for x in P.with_next(spark.createDataFrame(rows, "k long, v string"), "k", ["v"]).collect()}
    down = sorted(rows, reverse=True)
    assert found == {k: down[(i + 1) % len(down)][1] for i, (k, _) in enumerate(down)}


def test_likeness_of_nulls(spark):
    none = F.lit(None).cast("array<tinyint>")
    some = F.array_repeat(F.lit(1).cast("tinyint"), P.BINS)
    row = spark.range(1).select(P.likeness(none, none).alias("a"), P.likeness(none, some).alias("b"), P.likeness(some, some).alias("c")).first()
    assert (row.a, row.b, row.c) == (1.0, 0.0, 1.0)
