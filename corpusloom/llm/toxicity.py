"""Toxicity by weak supervision.

1. *Evidence* counts, over all labelled rows that may train (``crc32(doc_id as
   text) mod 4`` is not 2; of verified near copies one), in how many documents each
   word and each word beginning occurs, and in how many toxic ones, by fold: rows are
   dealt into ``FOLDS`` folds by a hash.
2. *Voters*: beginnings and words with clear evidence are dealt by hash into
   ``LEXICONS`` lexicons, a lexicon voting 1 if the text has one of its entries;
   lexicons also vote on density.  A row's lexicons have entries from the other folds
   only, so no vote reads the label of its own row.  Pattern voters look at shouted
   words, marks, odd characters, digits, stretched letters, repetition and lengths.
   A voter votes 1, 0 or abstains.
3. *Label model*: a generative model of the votes given the hidden label.  A voter's
   vote depends on the label and on the vote of at most one other voter, so that
   correlations are factors of the model: the pairs are a maximum spanning forest of
   the votes' mutual information given the label.  It is fitted by expectation
   maximisation over the votes of all these rows, from sums over equal votes, and
   starts from majority votes; labels give the share of label 1 and nothing else.
4. *Classifier*: logistic regression over hashed words and word beginnings,
   trained on the label model's posteriors of a bounded sample; a feature that the
   sample lacks weighs what its evidence says.  Its bias is calibrated on the labels
   of all rows that may train.  Scores use every word of a text.

Neither labels, languages, sources nor ``doc_id`` are inputs of a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, materialise, require, text_of, with_columns
from corpusloom.llm.jaccard_join import jaccard_classes
from corpusloom.llm.text_arrays import buffer_of, chunks, mix, span_hashes, stream

#: Sizes of word beginnings in bytes; 0 is the whole word.
BEGINNINGS = (4, 5, 6, 7, 0)
#: The most labelled rows that the classifier is fitted on, lexicon voters, and folds of labelled rows.
MAX_SAMPLE, LEXICONS, FOLDS = 20_000, 24, 4
#: More different votes than these are summed by Spark; margins are counted in steps of 1 / ``STEPS``.
MAX_PATTERNS, STEPS = 20_000, 1024
#: Evidence is clear in MIN_DOCS toxic documents, or one in SELDOM of them if these are more (which bounds the number of
#: features, as a document has few different words), MIN_SHARE of all with the feature, and if chance alone would make
#: it so at odds below one in exp(SURPRISE) rows (a log-likelihood ratio against the share of toxic rows).
MIN_DOCS, SELDOM, MIN_SHARE, SURPRISE, THRESHOLD = 6, 4000, 0.7, 2, 0.3
#: Pairs of voters with less mutual information given the label (in nats) are no factor of the label model.
LEAST_INFORMATION, FOREST_ROUNDS = 0.05, (0, 8)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def held_out(doc_id: int | None) -> bool:
    """Rows that never train."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, start and end of each run of letters, and its text."""
    import pyarrow.compute as pc

    data, offsets = buffer_of(pc.utf8_lower(pc.fill_null(column, "")))
    letter = _LETTER[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    return data, starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: which tokens have it, and its 64-bit hash."""
    values = stream(977, 256)[data]
    for size in BEGINNINGS:
        if size:
            which = np.flatnonzero(ends - starts > size)
            yield which, span_hashes(values, starts[which], starts[which] + size, 70 + size)
        else:
            yield np.arange(len(starts)), span_hashes(values, starts, ends, 70)


def document_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs of a batch, and the number of times each occurs."""
    data, starts, ends, owner = tokens(column)
    docs, features = [], []
    for which, hashes in word_features(data, starts, ends):
        docs.append(owner[which])
        features.append(hashes)
    d, h = np.concatenate(docs), np.concatenate(features)
    if not len(d):
        return d, h, d
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return d[at], h[at], np.diff(np.append(at, len(d)))


PATTERNS = ("shouted", "exclaimed", "asked", "odd", "digits", "stretched", "repeated", "short", "long", "lines")


def pattern_values(column: pa.Array) -> np.ndarray:
    """Text x pattern voter: -1 abstains, 0 or 1 votes."""
    data, offsets = buffer_of(column)
    size = np.diff(offsets)
    n = np.maximum(size, 1)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    upper = count((data >= 65) & (data < 91)) / n
    odd = count(np.isin(data, np.frombuffer(b"#$%&*|=<>", np.uint8))) / n
    stretched = np.zeros(len(data), bool)
    if len(data) > 3:
        same = (data[1:] == data[:-1]) & _LETTER[data[1:]]
        stretched[3:] = same[2:] & same[1:-1] & same[:-2]
        for back in range(3):  # not over the border of two texts
            at = offsets[1:-1] + back
            stretched[at[at < len(data)]] = False
    lower, starts, ends, owner = tokens(column)
    words = np.bincount(owner, minlength=len(n))
    hashes = span_hashes(stream(977, 256)[lower], starts, ends, 70) if len(starts) else np.zeros(0, np.uint64)
    order = np.lexsort((hashes, owner))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (owner[order][1:] != owner[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    different = np.bincount(owner[order][fresh], minlength=len(n)) / np.maximum(words, 1)
    per_line = size / (count(data == 10) + 1)
    out = np.full((len(n), len(PATTERNS)), -1, np.int8)
    for k, (one, zero) in enumerate([
        (upper > 0.5, upper < 0.02), (count(data == 33) / n > 0.02, None), (count(data == 63) / n > 0.02, None), (odd > 0.1, odd == 0), (None, count((data >= 48) & (data < 58)) / n > 0.1),
        (count(stretched) > 0, None), ((words >= 40) & (different < 0.25), (words >= 40) & (different > 0.9)), (None, size < 40), (None, size > 20_000), (None, (size > 400) & (per_line < 40)),
    ]):
        if zero is not None:
            out[zero, k] = 0
        if one is not None:
            out[one, k] = 1
    return out


@dataclass(frozen=True)
class ToxicityModel:
    """Weights by hashed feature; a score is the logistic of their sum over a text's distinct features."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    accuracies: np.ndarray
    correlations: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        d, h, _ = document_features(column)
        total = np.full(len(column), self.bias)
        if len(self.keys) and len(d):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            total += np.bincount(d[hit], self.weights[at[hit]], len(column))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def evidence(labelled: DataFrame) -> DataFrame:
    """``feature``, ``fold``, ``n``, ``n_toxic`` over all labelled rows (``text``, ``toxic``, ``fold``), pre-aggregated per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                d, h, _ = document_features(part.column("text"))
                toxic, fold = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[d] for c in ("toxic", "fold"))
                for f in range(FOLDS):
                    mine = fold == f
                    features, back = np.unique(h[mine], return_inverse=True)
                    n, t = np.bincount(back, minlength=len(features)), np.bincount(back, toxic[mine], len(features)).astype(np.int64)
                    folds = pa.array(np.full(len(features), f, np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(features.view(np.int64)), folds, pa.array(n), pa.array(t)], names=["feature", "fold", "n", "n_toxic"])

    counted = labelled.select("text", "toxic", "fold").mapInArrow(run, "feature bigint, fold int, n bigint, n_toxic bigint")
    return counted.groupBy("feature", "fold").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))


@dataclass(frozen=True)
class Lexicons:
    """Hashed features in order, and for each fold whether the other folds' evidence for them is clear."""

    keys: np.ndarray
    clear: np.ndarray

    def voter(self) -> np.ndarray:
        return (mix(self.keys) % np.uint64(LEXICONS)).astype(np.int64)


def _least(toxic: int) -> int:
    return max(2, min(MIN_DOCS, toxic // 8), toxic // SELDOM)


def clear_features(rows: DataFrame, folds: list[tuple[int, int]]) -> tuple[Lexicons, np.ndarray, np.ndarray]:
    """Features that are clear over all rows or over all but one fold's, and their log odds and whether they are clear over all rows.

    ``folds`` has the numbers of rows and of toxic rows in each fold.
    """
    sums = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}_{f}") for f in range(FOLDS) for c in ("n", "n_toxic")]
    wide = evidence(rows).groupBy("feature").agg(*sums)

    def total(c: str, without: int | None) -> Column:
        return sum((F.col(f"{c}_{f}") for f in range(FOLDS) if f != without), F.lit(0))

    def clear(without: int | None) -> Column:
        size, toxic = (sum(x[k] for f, x in enumerate(folds) if f != without) for k in (0, 1))
        n, t = total("n", without), total("n_toxic", without)
        base = min(max(toxic / max(size, 1), 1e-6), 1 - 1e-6)
        share = t / n
        rest = F.when(t < n, (n - t) * F.log((1 - share) / (1 - base))).otherwise(0.0)
        gain = t * F.log(share / base) + rest
        return F.coalesce((t >= _least(toxic)) & (t >= MIN_SHARE * n) & (gain >= float(np.log(max(size, 1))) + SURPRISE), F.lit(False))

    flags = [clear(f).alias(f"clear_{f}") for f in range(FOLDS)]
    found = wide.select("feature", total("n", None).alias("n"), total("n_toxic", None).alias("t"), clear(None).alias("clear"), *flags)
    found = found.where(F.greatest("clear", *(f"clear_{f}" for f in range(FOLDS)))).toPandas()
    keys = found["feature"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    found = found.iloc[order]
    odds = np.log((found["t"] + 0.5) / (found["n"] - found["t"] + 0.5)).to_numpy(np.float64)
    each = np.stack([found[f"clear_{f}"].to_numpy(bool) for f in range(FOLDS)]) if len(keys) else np.zeros((FOLDS, 0), bool)
    return Lexicons(keys[order], each), odds, found["clear"].to_numpy(bool)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All labelled documents that may train: ``doc_id``, ``text``, ``toxic``.

    A document with several labels takes the largest.  Near copies are dropped by
    :func:`without_near_copies`.  Neither join here is by broadcast, as labels grow
    with the documents.
    """
    mine = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.lit(False))
    kept = labels.where(mine & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = docs.select("doc_id", text_of().alias("text")).where(mine).join(kept.hint("merge"), "doc_id")
    return without_near_copies(rows.select("doc_id", "text", "toxic"))


def without_near_copies(rows: DataFrame) -> DataFrame:
    """One row of each label in each class of near copies, that with the least ``doc_id``.

    Near copies teach nothing new but would make all their words look like evidence.
    Classes are those of :mod:`jaccard_join`: links are verified on whole shingle
    sets.  Rows are told apart by a number, as a ``doc_id`` may have several texts.
    """
    found = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "labelled", tidy=True)
    classes = jaccard_classes(found.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "class_id")
    about = found.select("row", "toxic", F.struct("doc_id", F.xxhash64("text").alias("h"), "row").alias("first")).join(classes, "row")
    lone = about.groupBy("class_id", "toxic").agg(F.min("first")["row"].alias("row")).select("row")
    kept = materialise(found.join(lone.hint("merge"), "row", "left_semi").select("doc_id", "text", "toxic"), "training", tidy=True)
    discard(found)
    return kept


def votes(column: pa.Array, lexicons: Lexicons, fold: np.ndarray) -> np.ndarray:
    """Text x voter.  Lexicon voters vote 1 on a hit; those of density vote 0 or 1; patterns follow."""
    d, h, _ = document_features(column)
    keys = lexicons.keys
    hits = np.zeros((len(column), LEXICONS), np.int64)
    if len(keys) and len(d):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = (keys[at] == h) & lexicons.clear[fold[d], at]
        np.add.at(hits, (d[hit], lexicons.voter()[at[hit]]), 1)
    words = np.maximum(np.bincount(tokens(column)[3], minlength=len(column)), 1)
    every = hits.sum(1)
    density = np.stack([np.where(every >= 4, 1, np.where(every <= 1, 0, -1)), np.where(every / words > 0.004, 1, np.where(every == 0, 0, -1))], 1)
    return np.concatenate([np.where(hits > 0, 1, -1), density, pattern_values(column)], 1).astype(np.int8)


def _states(given: np.ndarray) -> np.ndarray:
    """Row x (voter, state): which of abstain, 0 and 1 each voter says."""
    return np.stack([given == s for s in (-1, 0, 1)], 2).astype(np.float64).reshape(len(given), -1)


@dataclass(frozen=True)
class LabelModel:
    """A tree-augmented generative model: P(label) times P(vote | label, the parent's vote) for each voter that votes.

    ``alone`` (voter x label x state) are the votes' probabilities given the label,
    ``parent`` is a voter or -1, ``factors`` (voter x label x parent's state x state)
    those given the parent's vote too, which count where both vote.  An abstention
    counts for nothing: else the label would drift towards whichever group of lexicons
    a part of the toxic texts is written in.  ``accuracies`` are the share of votes for
    the label among votes, ``correlations`` those of votes given the label.
    """

    prior: float
    alone: np.ndarray
    parent: np.ndarray
    factors: np.ndarray
    accuracies: np.ndarray
    correlations: np.ndarray

    def posterior(self, given: np.ndarray) -> np.ndarray:
        total = np.full(len(given), np.log(self.prior / (1 - self.prior)))
        for j, up in enumerate(self.parent.tolist()):
            own = given[:, j].astype(np.int64) + 1
            ratio = np.log(self.alone[j, 1] / self.alone[j, 0])[own]
            if up >= 0:
                above = given[:, up].astype(np.int64) + 1
                ratio = np.where(above > 0, np.log(self.factors[j, 1] / self.factors[j, 0])[above, own], ratio)
            total += np.where(own > 0, ratio, 0)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def majority(given: np.ndarray, prior: float) -> np.ndarray:
    """Where the model starts: the majority of votes, the share of label 1 without one."""
    ones, zeros = (given == 1).sum(1), (given == 0).sum(1)
    return np.where(ones > zeros, 0.9, np.where(ones < zeros, min(prior, 0.1), prior))


#: Calls a function of (votes, number of rows) on the different votes, or on parts of them, and sums what it gives.
Total = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]


def _forest(pairs: np.ndarray) -> np.ndarray:
    """Parents in a maximum spanning forest of the pairs' mutual information, without pairs that have little."""
    k = len(pairs)
    parent, inside = np.full(k, -1), np.zeros(k, bool)
    best, link = np.full(k, -1.0), np.full(k, -1)
    for _ in range(k):
        j = int(np.where(inside, -2.0, best).argmax())
        inside[j], parent[j] = True, link[j] if best[j] >= LEAST_INFORMATION else -1
        closer = ~inside & (pairs[j] > best)
        best[closer], link[closer] = pairs[j][closer], j
    return parent


def fit_labels(total: Total, voters: int, prior: float, rounds: int = 25) -> LabelModel:
    """Expectation maximisation by sums alone; the forest of pairs is found in ``FOREST_ROUNDS``, first given the majority votes.

    Were it found only after rounds without pairs, the label would by then stand for
    the largest group of voters that repeat each other.
    """
    k, model = voters, None
    parent = np.full(k, -1)
    for step in range(rounds):

        def moments(given, n, model=model):
            post = majority(given, prior) if model is None else model.posterior(given)
            states = _states(given)
            return np.concatenate([((states.T * (p * n)) @ states).ravel() for p in (1 - post, post)])

        joint = total(moments).reshape(2, k, 3, k, 3).transpose(1, 3, 0, 2, 4)  # voter, voter, label, state, state
        seen = joint[np.arange(k), np.arange(k)].diagonal(axis1=2, axis2=3)  # voter, label, state
        size = np.maximum(seen[0].sum(1), 1e-9)
        alone = (seen + [1.0, 0.5, 0.5]) / (size[None, :, None] + 2)
        if step in FOREST_ROUNDS:
            parent = _forest(_information(joint, size))
        factors = np.ones((k, 2, 3, 3))
        for j, up in enumerate(parent.tolist()):
            if up >= 0:  # among rows where both vote
                both = joint[up, j][:, 1:, 1:]
                own = alone[j][:, None, 1:] / alone[j][:, None, 1:].sum(2, keepdims=True)
                factors[j][:, 1:, 1:] = (both + 2 * own) / (both.sum(2, keepdims=True) + 2)
        weight = size / size.sum()
        right = weight[0] * alone[:, 0, 1] + weight[1] * alone[:, 1, 2]
        accuracies = right / (weight[None, :, None] * alone[:, :, 1:]).sum((1, 2))
        model = LabelModel(prior, alone, parent, factors, accuracies, _correlations(joint, size))
    return model


def _information(joint: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mutual information given the label of each two voters' votes where both vote, times the share of rows where they do; 0 with itself."""
    votes = joint[:, :, :, 1:, 1:] + 0.25
    n = votes.sum((3, 4), keepdims=True)
    both = votes / n
    found = (both * np.log(both / (both.sum(4, keepdims=True) * both.sum(3, keepdims=True)))).sum((3, 4))
    found = (found * n[..., 0, 0]).sum(2) / size.sum()
    np.fill_diagonal(found, 0)
    return found


def _correlations(joint: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Correlations given the label of votes as -1, 0 (abstained) and 1."""
    value = np.array([0.0, -1.0, 1.0])
    share = joint / size[None, None, :, None, None]
    product = np.einsum("ijyst,s,t->ijy", share, value, value)
    mean = np.einsum("iyss,s->iy", share[np.arange(len(share)), np.arange(len(share))], value)
    both = (product - mean[:, None] * mean[None, :]) @ (size / size.sum())
    spread = np.where(np.diag(both) > 1e-9, np.sqrt(np.maximum(np.diag(both), 1e-9)), np.inf)  # votes that never differ go with nothing
    return both / np.outer(spread, spread)


def label_model(given: np.ndarray, prior: float, rounds: int = 25) -> LabelModel:
    """The model of votes that are all at hand: see :func:`fit_labels`."""
    return fit_labels(lambda step: step(given, np.ones(len(given))), given.shape[1], prior, rounds)


def _vote_totals(voted: DataFrame) -> Total:
    """Sums over all rows' votes: here if few votes differ, else by Spark."""
    patterns = materialise(voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), "votes")

    def arrays(votes, n):
        return np.frombuffer(b"".join(votes), np.int8).reshape(len(n), -1), np.asarray(n, np.float64)

    if patterns.count() <= MAX_PATTERNS:
        held = patterns.toPandas().sort_values("votes")
        few = arrays(held["votes"], held["n"])
        return lambda step: step(*few)

    def total(step):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = 0
            for batch in batches:
                if batch.num_rows:
                    sums = sums + step(*arrays(*(batch.column(c).to_pylist() for c in ("votes", "n"))))
            if isinstance(sums, np.ndarray):
                yield pa.RecordBatch.from_arrays([pa.array([sums.astype("<f8").tobytes()])], names=["sums"])

        return np.sum([np.frombuffer(r["sums"], "<f8") for r in patterns.mapInArrow(run, "sums binary").collect()], 0)

    return total


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit voters, label model and threshold on all :func:`training_rows`, the classifier on a sample of them.

    ``docs`` needs ``doc_id`` and ``text``, ``labels`` ``doc_id`` and ``toxic``; other
    columns are not read, whatever their names.  Null texts count as empty, texts are
    read whole.  Rows whose ``doc_id`` or label is null teach nothing; a document
    labelled more than once takes the largest label, repeated rows count once.  With no
    labelled rows, or no toxic ones, every text scores the same.
    """
    rows = training_rows(docs, labels).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    whole = {r["fold"]: (r["n"], r["t"]) for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).collect()}
    n, t = (sum(x[k] for x in whole.values()) for k in (0, 1))
    if not n or not t:
        none = np.zeros(0)
        return ToxicityModel(none.astype(np.uint64), none, -30.0 if n else -2.0, none, none)
    lexicons, odds, clear = clear_features(rows, [whole.get(f, (0, 0)) for f in range(FOLDS)])
    keys, odds = lexicons.keys[clear], odds[clear]
    voted = materialise(rows.mapInArrow(_voted(lexicons, keys), "doc_id bigint, toxic int, votes binary, features binary"), "voted")
    model = fit_labels(_vote_totals(voted), LEXICONS + 2 + len(PATTERNS), float(np.clip(t / n, 1e-3, 0.5)))
    sample = voted
    if n > MAX_SAMPLE:  # a little less than MAX_SAMPLE, as the number of hashes below a bound varies
        sample = voted.where(F.pmod(F.xxhash64("doc_id", "votes", "features"), F.lit(1 << 20)) < int(0.95 * MAX_SAMPLE / n * (1 << 20)))
    sample = sample.select("doc_id", "votes", "features").toPandas().sort_values(["doc_id", "votes", "features"])
    post = model.posterior(np.stack([np.frombuffer(v, np.int8) for v in sample["votes"]])) if len(sample) else np.zeros(0)
    w, bias = _classifier(sample["features"], keys, np.clip(post, 0.01, 0.99), odds)
    seen = _margins(voted, keys, w, bias).toPandas().sort_values(["margin", "toxic"])
    bias += np.log(THRESHOLD / (1 - THRESHOLD)) - cutoff(seen["margin"].to_numpy() / STEPS, seen["toxic"].to_numpy(), seen["n"].to_numpy())
    return ToxicityModel(keys, w, float(bias), model.accuracies, model.correlations)


def _voted(lexicons: Lexicons, keys: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                given = votes(part.column("text"), lexicons, part.column("fold").to_numpy())
                d, h, _ = document_features(part.column("text"))
                hit = np.isin(h, keys)
                d, h = d[hit], h[hit]
                bounds = np.searchsorted(d, np.arange(part.num_rows + 1))
                rows = [h[a:b].astype("<u8").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array([g.tobytes() for g in given], pa.binary()), pa.array(rows, pa.binary())], names=["doc_id", "toxic", "votes", "features"])

    return run


def _margins(voted: DataFrame, keys: np.ndarray, w: np.ndarray, bias: float) -> DataFrame:
    """How many rows of each label have each margin, in steps of 1 / ``STEPS``: ``margin``, ``toxic``, ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [w[np.searchsorted(keys, np.frombuffer(f, "<u8"))].sum() for f in batch.column("features").to_pylist()]
            steps = np.rint(np.clip(np.array(sums, np.float64) + bias, -64, 64) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(steps), batch.column("toxic")], names=["margin", "toxic"])

    found = voted.select("toxic", "features").mapInArrow(run, "margin bigint, toxic int")
    return found.groupBy("margin", "toxic").agg(F.count(F.lit(1)).alias("n"))


def cutoff(margin: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> float:
    """The margin that parts the labels of ``n`` rows each with the best F-measure of label 1; the middle of the gap, if several do."""
    order = np.argsort(margin, kind="stable")
    m, t, n = margin[order], toxic[order] == 1, n[order]
    if t.all() or not t.any():
        return float(m[-1] + 1 if not t.any() else m[0] - 1)
    missed, raised = np.cumsum(t * n), (~t * n).sum() - np.cumsum(~t * n)
    caught = (t * n).sum() - missed
    error = np.where(np.append(m[1:] > m[:-1], False), -caught / (caught + (missed + raised) / 2), np.inf)
    at = int(error.argmin())
    return float((m[at] + m[at + 1]) / 2) if np.isfinite(error[at]) else float(m.mean())


def _classifier(features, keys: np.ndarray, target: np.ndarray, odds: np.ndarray, steps: int = 1000) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on posteriors, by full-batch AdaGrad with a ridge.

    A feature that no row has gets the weight with which a text that has it alone scores its log ``odds``.
    """
    row, column = [], []
    for i, f in enumerate(features):
        at = np.searchsorted(keys, np.frombuffer(f, "<u8"))
        row.append(np.full(len(at), i))
        column.append(at)
    row, column = (np.concatenate([*x, np.zeros(0)]).astype(np.int64) for x in (row, column))
    if not len(target):
        return odds + 2.0, -2.0
    n, w, bias = len(target), np.zeros(len(keys)), -2.0
    square, square_bias = np.full(len(keys), 1e-8), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[column], n) + bias, -30, 30)))
        rest = target - p
        g = np.bincount(column, rest[row], len(keys)) / n - 1e-5 * w
        square += g * g
        w += 0.1 * g / np.sqrt(square)
        gb = rest.mean()
        square_bias += gb * gb
        bias += 0.1 * gb / np.sqrt(square_bias)
    unseen = np.bincount(column, minlength=len(keys)) == 0
    w[unseen] = odds[unseen] - bias
    return w, float(bias)


def score_texts(docs: DataFrame, model: ToxicityModel, text: str = "text", output: str = "toxicity") -> DataFrame:
    """Add ``output`` (0 to 1).

    All columns pass through (an input column of the output's name gives way).  A null
    text counts as empty; an empty one gets the model's base score.  Texts are
    scored whole; rows are independent, nothing is shuffled, and repeated texts
    score alike.
    """
    require(docs, text)
    given = with_columns(docs, {output: text_of(text)})
    from pyspark.sql import types as T

    schema = T.StructType([*given.schema.fields[:-1], T.StructField(output, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, output):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(model.score(part.column(output)))], names=part.schema.names)

    return given.mapInArrow(run, schema)
