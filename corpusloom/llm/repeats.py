"""Removal of repeated passages by recompression.

A passage repeats if a window of ``WINDOW`` consecutive words also starts in a
document with a smaller ``doc_id``.  Comparing all windows would shuffle a row a
word.  Recompression finds the few windows that can repeat:

* Words are symbols.  Round 0 names maximal runs of one symbol; each further round
  deals the symbols into left and right ones by a hash and names every adjacent
  (left, right) pair.  A name is a hash of what it stands for, hence the same in
  every document and partition, and a round keeps about 3/4 of the symbols.
* Whether two symbols merge depends on them alone.  Equal windows therefore get
  the same *interior* symbols; only those at the borders may merge with what
  stands outside, and which ones can do so follows from the window itself.
* Spark finds the symbols of the last round that occur in different texts.  A
  window with an interior symbol that does not cannot repeat.  The windows left
  over (also those without interior symbols) are verified by 128-bit hashes of
  all their words, the least ``doc_id`` of each being found by aggregation.

Texts with equal words are one text for all this: later copies of at least
``WINDOW`` words lose every word.  Frequent symbols or windows are aggregated
before the shuffle and joined back on keys that are unique on one side, so no
task collects their occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, materialise, require, text_of
from corpusloom.llm.text_arrays import buffer_of, chunks, mix, span_hashes, stream, word_hashes, words

WINDOW, ROUNDS = 50, 6


class Parsed:
    """The symbols of a batch after the last round, and each window's interior ones.

    ``symbols`` are names, ``begins`` the first word of each; ``starts`` are the
    first words of all windows and ``low``/``high`` bound their interior symbols.
    """

    def __init__(self, hashes: np.ndarray, first: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS):
        n = len(hashes)
        lengths = np.diff(first)
        self.starts = np.concatenate([np.arange(a, a + c - window + 1) for a, c in zip(first[:-1], lengths, strict=True) if c >= window] or [np.zeros(0, np.int64)])
        edge = np.zeros(n + 1, bool)
        edge[first] = True
        # Round 0: runs.  A window's first and last run may go on outside it.
        new = np.ones(n, bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | edge[1:n]
        begins = np.flatnonzero(new)
        size = np.diff(np.append(begins, n))
        names = hashes[begins]
        with np.errstate(over="ignore"):
            names = np.where(size > 1, mix(names * np.uint64(0xD6E8FEB86659FD93) + size.astype(np.uint64)), names)
        at = np.cumsum(new) - 1
        low = at[self.starts] + 1
        high = at[self.starts + window - 1]
        for salt in stream(4242, rounds):
            right = (mix(names ^ salt) & np.uint64(1)).astype(bool)
            border = edge[begins]
            merge = np.zeros(len(names), bool)  # with the symbol before
            merge[1:] = right[1:] & ~right[:-1] & ~border[1:]
            heads = np.flatnonzero(~merge)
            at = np.cumsum(~merge) - 1
            with np.errstate(over="ignore"):
                joined = names.copy()
                tails = np.flatnonzero(merge)
                joined[tails - 1] = mix(names[tails - 1] * np.uint64(0x9FB21C651E98DF25) + mix(names[tails] + salt))
            some = low < high
            if len(names):
                a, b = np.minimum(low, len(names) - 1), np.maximum(high - 1, 0)
                after = np.minimum(a + right[a], len(names) - 1)
                low = np.where(some, np.where(a + right[a] < len(names), at[after], len(heads)), 0)
                high = np.where(some, at[b] + right[b], 0)
            names, begins = joined[heads], begins[heads]
        self.symbols, self.begins, self.low, self.high = names, begins, low, high


def _parse(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = buffer_of(column)
    starts, ends, first = words(data, offsets)
    return data, starts, ends, first, word_hashes(data, starts, ends)


def _sequences(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(span_hashes(mix(hashes ^ np.uint64(s)), first[:-1], first[1:], s).view(np.int64) for s in (11, 12))


def sketch(docs: DataFrame) -> DataFrame:
    """Per document: number of words, digest of its words, hash of the sequence, distinct last-round symbols, and whether a window has no interior symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                _, _, _, first, hashes = _parse(part.column("text"))
                parsed = Parsed(hashes, first)
                bounds = np.searchsorted(parsed.begins, first)
                bare = np.zeros(part.num_rows, bool)
                bare[np.searchsorted(first, parsed.starts[parsed.low >= parsed.high], "right") - 1] = True
                symbols = parsed.symbols.view(np.int64)
                rows = [np.unique(symbols[a:b]) if n >= WINDOW else None for a, b, n in zip(bounds[:-1], bounds[1:], np.diff(first), strict=True)]
                digests = [hashlib.sha256(b" ".join(t.encode().split())).hexdigest() for t in part.column("text").to_pylist()]
                a, b = _sequences(hashes, first)
                arrays = [pa.array(np.diff(first)), pa.array(digests), pa.array(a), pa.array(b), pa.array(rows, pa.list_(pa.int64())), pa.array(bare)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names=["doc_id", "n_words", "digest", "seq_a", "seq_b", "symbols", "bare"])

    return docs.mapInArrow(run, "doc_id bigint, n_words bigint, digest string, seq_a bigint, seq_b bigint, symbols array<bigint>, bare boolean")


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows whose interior symbols are all shared, as distinct hashes and the place of each."""
    for batch in batches:
        for part in chunks(batch, "text", 500_000):
            _, _, _, first, hashes = _parse(part.column("text"))
            parsed = Parsed(hashes, first)
            a, _ = _sequences(hashes, first)
            wanted = a == part.column("seq_a").to_numpy(zero_copy_only=False)
            shared = np.zeros(len(parsed.symbols), bool)
            bounds = np.searchsorted(parsed.begins, first)
            for i, own in enumerate(part.column("shared")):
                if own.is_valid:
                    x, y = bounds[i], bounds[i + 1]
                    shared[x:y] = np.isin(parsed.symbols[x:y].view(np.int64), own.values.to_numpy(zero_copy_only=False))
            alone = np.zeros(len(shared) + 1, np.int64)
            np.cumsum(~shared, out=alone[1:])
            low, high = parsed.low, np.maximum(parsed.low, parsed.high)
            keep = alone[high] == alone[low]
            starts = parsed.starts[keep]
            one, two = (span_hashes(mix(hashes ^ np.uint64(s)), starts, starts + WINDOW, s).view(np.int64) for s in (21, 22))
            cuts = np.searchsorted(starts, first)
            rows = []
            for i in np.flatnonzero((np.diff(cuts) > 0) & wanted).tolist():
                x, y = cuts[i], cuts[i + 1]
                _, at, which = np.unique(one[x:y], return_index=True, return_inverse=True)
                rows.append((i, starts[x:y] - first[i], which, one[x:y][at], two[x:y][at]))
            if rows:
                taken = part.take(pa.array([r[0] for r in rows]))
                arrays = [pa.array([r[k] for r in rows], pa.list_(t)) for k, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.int64()), (4, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in ("doc_id", "seq_a", "text")), *arrays], names=["doc_id", "seq_a", "text", "starts", "which", "one", "two"])


def _removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, kept = [], []
        for text, starts, which, hit in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "which", "hit")), strict=True):
            tokens = text.encode().split()
            flagged = np.asarray(starts)[np.isin(np.asarray(which), np.asarray(hit))]
            cover = np.zeros(len(tokens) + 1, np.int64)
            np.add.at(cover, flagged, 1)
            np.add.at(cover, flagged + WINDOW, -1)
            gone = np.cumsum(cover)[:-1] > 0
            n.append(int(gone.sum()))
            kept.append(b" ".join([t for t, g in zip(tokens, gone.tolist(), strict=True) if not g]).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("seq_a"), pa.array(n, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "seq_a", "n_removed", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept`` and ``kept_sha256``.

    ``kept`` is the remaining words joined by one space where words were removed,
    and null where none were (the text then stands as it is).

    * Null or empty texts have no words; texts below 50 words are never cut.
    * Windows of one ``doc_id`` never count against it: repeated rows are treated alike.
    * A row with a null ``doc_id`` is neither cut nor a reason to cut.
    * Whole texts are used, however long.  Other columns are not read, so none can clash.  Empty input: empty result.
    """
    require(docs, "doc_id", "text")
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    whole = materialise(sketch(given), "sketch")
    long = whole.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= WINDOW))
    firsts = materialise(long.groupBy("seq_a", "seq_b").agg(F.min("doc_id").alias("first")), "firsts")
    chosen = long.join(firsts, ["seq_a", "seq_b"]).where("doc_id = first")
    chosen = materialise(chosen.select("doc_id", "seq_a", "symbols", "bare"), "chosen", tidy=True)
    # From here on tables that are used up are deleted: what they gave is in later ones.
    sketched = materialise(whole.select("doc_id", "n_words", "digest", "seq_a", "seq_b"), "words")
    discard(whole)
    named = chosen.select("doc_id", "seq_a", F.explode("symbols").alias("symbol"))
    shared = named.groupBy("symbol").agg(F.min("seq_a").alias("low"), F.max("seq_a").alias("high")).where("low <> high").select("symbol")
    own = named.join(shared, "symbol").groupBy("doc_id", "seq_a").agg(F.collect_set("symbol").alias("shared"))
    own = materialise(own, "shared", tidy=True)
    plain = chosen.select("doc_id", "seq_a", "bare").distinct()
    need = plain.join(own, ["doc_id", "seq_a"], "left").where("bare OR shared IS NOT NULL").select("doc_id", "seq_a", "shared")
    columns = "doc_id bigint, seq_a bigint, text string, starts array<int>, which array<int>, one array<bigint>, two array<bigint>"
    left = materialise(need.join(given, "doc_id").mapInArrow(_candidates, columns), "candidates", tidy=True)
    discard(chosen, own)
    windows = left.select("doc_id", "seq_a", F.posexplode(F.arrays_zip("one", "two")).alias("at", "w")).select("doc_id", "seq_a", "at", "w.one", "w.two")
    least = windows.groupBy("one", "two").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least <> most").drop("most")
    hits = windows.join(least, ["one", "two"]).where("doc_id > least").groupBy("doc_id", "seq_a").agg(F.collect_list("at").alias("hit"))
    hits = materialise(hits, "hits", tidy=True)
    cut = left.select("doc_id", "seq_a", "text", "starts", "which").join(hits, ["doc_id", "seq_a"])
    cut = cut.mapInArrow(_removals, "doc_id bigint, seq_a bigint, n_removed bigint, kept string").dropDuplicates(["doc_id", "seq_a"])
    rows = sketched.join(firsts, ["seq_a", "seq_b"], "left").join(cut, ["doc_id", "seq_a"], "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    removed = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("bigint")))
    kept = F.when(copy, F.lit("")).otherwise(F.col("kept"))
    return rows.select("doc_id", "n_words", removed.alias("n_removed"), kept.alias("kept"), F.coalesce(F.sha2(kept, 256), F.col("digest")).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM w, unnest(range(1, len(ws) - 48)) AS t(i) WHERE len(ws) >= 50),
least AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
bad AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN least USING (h), range(0, 50) AS t(k) WHERE doc_id > first),
gone AS (SELECT doc_id, count(*) AS n_removed, list(p) AS ps FROM bad GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
