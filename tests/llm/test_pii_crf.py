import random
import re

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import pii_crf as P


def brute(text):
    def digits(m):
        return re.findall("[0-9]", m[0])

    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and P.luhn("".join(digits(m)))]
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]


def test_base_patterns_against_plain_search():
    r = random.Random(3)
    for _ in range(20000):
        text = "".join(r.choice("12345.@+-() a%0") for _ in range(r.randint(0, 60)))
        assert P.base_spans(text) == brute(text), text


def test_base_patterns_are_linear():
    assert P.base_spans("a" * 300000 + " @ " + "1" * 300000 + "+" + "9 " * 100000) == []


def test_viterbi_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    k = len(P.LABELS)
    model = P.Crf({}, rng.normal(size=(k, k)).astype(np.float32), rng.normal(size=k).astype(np.float32))
    lengths = np.array([1, 4, 2, 3])
    first = np.array([0, 1, 5, 7])
    em = rng.normal(size=(10, k)).astype(np.float32)
    labels = P.viterbi(em, first, lengths, model)
    for a, n in zip(first, lengths, strict=True):

        def score(path, a=a):
            return model.start[path[0]] + sum(em[a + t, x] for t, x in enumerate(path)) + sum(model.move[x, y] for x, y in zip(path, path[1:], strict=False))

        best = max(product(range(k), repeat=int(n)), key=score)
        assert tuple(labels[a : a + n]) == best


def test_held_out_precision_and_recall():
    """Whole added spans on sentences that the model has not seen, written apart from the labelled table."""
    import pathlib

    import pyarrow as pa

    held = P.read_marked((pathlib.Path(__file__).parent / "pii_held_out.txt").read_text(encoding="utf-8"))
    assert not {" ".join(t) for t, _ in held} & {" ".join(t) for t, _ in P._default_sentences()}
    lines = [" ".join(t) for t, _ in held]
    found = P.batch_spans(pa.array(lines), P.default_model())
    right = wanted = given = 0
    for (tokens, labels), line, spans in zip(held, lines, found, strict=True):
        truth, at, before = set(), 0, "none"
        for t, label in zip(tokens, labels, strict=True):
            if label != "none":
                last = next(iter(x for x in truth if x[2] == at - 1 and before == label), None)
                truth.discard(last)
                truth.add((label, last[1] if last else at, at + len(t)))
            before, at = label, at + len(t) + 1
        truth = {(k, a, a + len(line[a:b].rstrip(".,;:!?"))) for k, a, b in truth}
        base = P.base_spans(line)
        truth = {x for x in truth if all(b <= x[1] or x[2] <= a for _, a, b in base)}
        got = {(k.removeprefix("crf_"), a, b) for k, a, b in spans if k.startswith("crf_")}
        right += len(truth & got)
        wanted += len(truth)
        given += len(got)
    print(right, wanted, given)
    assert right / wanted >= 0.75 and right / given >= 0.8, (right, wanted, given)


def test_labelled_table(spark):
    table = P.labelled_table(spark).withColumn("note", F.lit(1))
    rows = P.sentences(table)
    assert rows == [x for x in P._default_sentences()] and 60 <= len(rows) <= P.MAX_LABELLED
    assert {x for _, labels in rows for x in labels} == set(P.LABELS)
    assert P.marked_sentence("a {phone|1 2}, b{ip|3}c") == (["a", "1", "2,", "b3c"], ["none", "phone", "phone", "none"])
    odd = spark.createDataFrame([(1, 0, "x", "none"), (1, 1, None, "none"), (2, 0, "y", "what"), (None, 0, "z", "none")], "sentence int, position int, word string, label string")
    assert P.sentences(odd) == [(["x"], ["none"])] and P.sentences(odd.limit(0)) == []


def test_one_long_line_takes_time_in_proportion():
    import time

    import pyarrow as pa

    def took(n):
        line = "call (312) 555-0142 or 1.2.3.4 now é " * n
        began = time.perf_counter()
        (spans,) = P.batch_spans(pa.array([line]), P.default_model())
        assert len(spans) == 2 * n
        assert len(P.masked(line, spans)) < len(line)
        return time.perf_counter() - began

    took(100)
    small, large = took(5_000), took(20_000)
    assert large < 8 * small + 1


def test_added_spans_and_masks(spark):
    texts = ["call me at (312) 555-0142 today", "+1 (269) 555-3296 4524132264652876 and so on", "a@b.example.com, 10.0.0.1", "plain words 404189 only", "", None, "é +49 (30) 1234-5678 é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pii_spans", F.lit(1))
    found = {r.doc_id: [tuple(s) for s in r.pii_spans] for r in P.find_pii(df).collect()}
    assert [s[0] for s in found[0]] == ["crf_phone"] and texts[0][found[0][0][1] : found[0][0][2]] == "(312) 555-0142"
    assert [texts[1][a:b] for _, a, b in found[1]] == ["4524132264652876", "+1 (269) 555-3296"]
    assert [s[0] for s in found[2]] == ["email", "ip"]
    assert found[3] == found[4] == found[5] == []
    masked = {r.doc_id: r.text for r in P.mask_pii(df.drop("pii_spans")).collect()}
    assert masked[0] == "call me at <PHONE> today" and masked[2] == "<EMAIL>, <IP>" and masked[3] == texts[3]
    assert masked[4] == "" and masked[5] is None and masked[6] == "é <PHONE> é"
    assert P.find_pii(df.limit(0)).count() == 0
