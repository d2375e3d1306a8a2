import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.llm import toxicity as X


def corpus(n=1500, seed=3):
    """Clean words, and toxic texts with words of a few stems, several each."""
    r = random.Random(seed)
    words = ["".join(r.choice(["an", "er", "ti", "on", "re", "ou", "le"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(20, 200))]
        toxic = r.random() < 0.12
        if toxic:
            for _ in range(r.randint(4, 12)):
                text[r.randrange(len(text))] = r.choice(["vequ", "lostra", "moron"]) + r.choice(["", "an", "er", "iß"])
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    model = X.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    scored = {r.doc_id: r.toxicity for r in X.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    held = [(scored[i] >= X.THRESHOLD, t == 1) for i, t in labels if X.held_out(i)]
    assert sum(p == t for p, t in held) / len(held) > 0.97


def test_held_out_labels_are_never_used(spark):
    docs, labels = corpus(400)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(i, 1 - t if X.held_out(i) else t) for i, t in labels]
    one, two = (X.train(d, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert np.array_equal(one.keys, two.keys) and np.allclose(one.weights, two.weights) and one.bias == two.bias


def planted(rng, n, share, accuracy, coverage):
    """Hidden labels, and votes of voters that vote on some rows, right with their accuracy."""
    truth = rng.random(n) < share
    given = [np.where(rng.random(n) < c, np.where(rng.random(n) < a, truth, ~truth), -1) for a, c in zip(accuracy, coverage, strict=True)]
    return truth, np.stack(given, 1).astype(np.int8)


def test_label_model_finds_planted_accuracies_and_correlations():
    rng = np.random.default_rng(1)
    accuracy, coverage = [0.9, 0.85, 0.8, 0.75, 0.7, 0.65], [0.9, 0.8, 1.0, 0.7, 0.9, 1.0]
    truth, given = planted(rng, 20_000, 0.3, accuracy, coverage)
    # Three more voters that mostly repeat the last one: without pairs in the model they would outvote the rest.
    echo = [np.where(rng.random(len(truth)) < 0.95, given[:, 5], rng.integers(0, 2, len(truth))) for _ in range(3)]
    given = np.concatenate([given, np.stack(echo, 1)], 1).astype(np.int8)
    model = X.label_model(given, 0.3)
    assert np.abs(model.accuracies[:6] - accuracy).max() < 0.06
    assert model.correlations[5, 6] > 0.8 and np.abs(model.correlations[:5, :5] - np.eye(5)).max() < 0.1
    linked = {frozenset((j, int(p))) for j, p in enumerate(model.parent) if p >= 0}
    assert len(linked) == 3 and all(x <= {5, 6, 7, 8} for x in linked)
    right = ((model.posterior(given) > 0.5) == truth).mean()
    best = ((np.log(0.3 / 0.7) + sum(np.where(given[:, j] < 0, 0, np.where(given[:, j] == 1, 1, -1) * np.log(a / (1 - a))) for j, a in enumerate(accuracy)) > 0) == truth).mean()
    assert right > best - 0.01


def test_votes_do_not_read_their_own_label(spark):
    """A word that is clear evidence in one document's label alone gives that document no lexicon vote."""
    docs, labels = corpus(600)
    rows = X.training_rows(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = rows.withColumn("fold", F.pmod("doc_id", F.lit(X.FOLDS)).cast("int"))
    rows = rows.withColumn("text", F.when(F.col("fold") == 1, F.concat("text", F.lit(" onlyhere"))).otherwise(F.col("text"))).withColumn("toxic", F.when(F.col("fold") == 1, 1).otherwise(F.col("toxic")))
    counts = {r.fold: (r.n, r.t) for r in rows.groupBy("fold").agg(F.count("toxic").alias("n"), F.sum("toxic").alias("t")).collect()}
    lexicons, _, clear = X.clear_features(rows, [counts[f] for f in range(X.FOLDS)])
    _, h, _ = X.document_features(pa.array(["onlyhere"]))
    at = np.flatnonzero(np.isin(lexicons.keys, h))
    assert len(at) and clear[at].all() and not lexicons.clear[1, at].any() and lexicons.clear[0, at].all()


def test_classifier_on_posteriors_against_plain_labels(spark):
    """Held-out accuracy beside that of the same classifier on the labels themselves."""
    docs, labels = corpus(1500, seed=11)
    d, given = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model, truth = X.train(d, given), dict(labels)
    features = lambda part: [h.astype("<u8").tobytes() for _, t in part for h in [np.intersect1d(X.document_features(pa.array([t]))[1], model.keys)]]
    taught, held = ([x for x in docs if X.held_out(x[0]) == w] for w in (False, True))
    w, bias = X._classifier(features(taught), model.keys, np.array([float(truth[i]) for i, _ in taught]), np.zeros(len(model.keys)))
    plain = X.ToxicityModel(model.keys, w, bias, w, w)
    right = [np.mean((m.score(pa.array([t for _, t in held])) >= c) == np.array([truth[i] == 1 for i, _ in held])) for m, c in ((model, X.THRESHOLD), (plain, 0.5))]
    assert right[0] >= right[1] - 0.02 and right[0] > 0.95, right


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "some words"), (3, "some words"), (None, "x")], "doc_id long, text string").selectExpr("*", "'z' AS toxicity", "5 AS near")
    labels = spark.createDataFrame([(1, None), (3, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    model = X.train(docs, labels)
    scores = [r.toxicity for r in X.score_texts(docs, model).collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores) and scores[2] == scores[3] and scores[0] == scores[1]
    empty = X.train(docs, labels.limit(0))
    assert {r.toxicity for r in X.score_texts(docs, empty).collect()} == {1 / (1 + np.exp(2.0))}
    assert X.score_texts(docs.limit(0), model).count() == 0


def test_scores_ignore_other_columns():
    model = X.ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -1.0, np.zeros(0), np.zeros(0))
    assert np.allclose(model.score(pa.array(["a", None, ""])), 1 / (1 + np.e))


def test_only_verified_near_copies_are_dropped(spark):
    r = random.Random(5)
    ids = [i for i in range(400) if not X.held_out(i)][:120]
    docs = [(i, "the same opening " + " ".join(f"w{r.randrange(10**6)}q" for _ in range(60))) for i in ids[:100]]
    docs = [(i, t.translate(str.maketrans("0123456789", "abcdefghij"))) for i, t in docs]
    copies = [(i, docs[k][1] + " end") for k, i in enumerate(ids[100:])]
    labels = [(i, int(k % 3 == 0)) for k, i in enumerate(ids[:100])]
    labels += [(i, t if k else 1 - t) for k, (i, (_, t)) in enumerate(zip(ids[100:], labels))]
    rows = X.training_rows(spark.createDataFrame(docs + copies, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert sorted(x.doc_id for x in rows.collect()) == ids[:101]


def test_all_labels_count_though_the_classifier_is_fitted_on_a_sample(spark, monkeypatch):
    docs, labels = corpus(900)
    clean = [t for (_, t), (_, toxic) in zip(docs, labels) if not toxic]
    late = [r.id for r in spark.range(900, 3000).orderBy(F.xxhash64("id").desc()).limit(60).collect() if not X.held_out(r.id)]
    rare = [(i, t + " zorbikux") for i, t in zip(late[:30], clean[-30:])]
    d = spark.createDataFrame(docs + rare, "doc_id long, text string")
    given = spark.createDataFrame(labels + [(i, 1) for i, _ in rare], "doc_id long, toxic int")
    monkeypatch.setattr(X, "MAX_SAMPLE", 100)
    model = X.train(d, given)
    clean = clean[:50]
    assert (model.score(pa.array([t + " zorbikux" for t in clean])) >= X.THRESHOLD).all()
    assert (model.score(pa.array(clean)) < X.THRESHOLD).mean() > 0.9
    monkeypatch.setattr(X, "MAX_PATTERNS", 0)
    summed = X.train(d, given)
    assert np.array_equal(model.keys, summed.keys) and np.allclose(model.accuracies, summed.accuracies) and np.allclose(model.correlations, summed.correlations, atol=1e-6)
    assert np.allclose(model.weights, summed.weights, atol=1e-4)
