"""N-gram Jaccard self-join with Bayesian candidate pruning.

A text is the set of its five-word shingles.  The join finds every pair of
different sets whose Jaccard similarity reaches the threshold, without listing
pairs as rows:

1. *Sketch* (one pass): a hash of the shingle set and a MinHash signature.  Equal
   sets are one *member* with a multiplicity.
2. *Candidates*: ``BANDS`` bands of ``ROWS`` MinHash values; members that agree in
   a band meet.  A pair at the threshold 0.8 is missed by all bands with
   probability 6e-5.
3. *Bayesian pruning*: two candidates' MinHash values are compared ``STEP`` at a
   time.  Under a uniform prior, the similarity's posterior after ``m`` of ``n``
   agreements is Beta(m + 1, n - m + 1); a pair is dropped as soon as the
   probability of reaching the threshold is below ``TOLERANCE``.  Survivors join
   members to families (connected components), inside which links are counted.
4. *Exact verification*: the pairs of a family that pruning keeps are compared on
   whole shingle sets, by integer arithmetic.  Results are one number of links per
   member, and spanning forests, whose components are the classes.

Groups and families are dealt by hash into blocks of about ``BLOCK`` members (fewer
if these are long).  Each block is first compared with itself.  Only where a group's
blocks are not yet connected, or links between blocks are to be counted, do blocks
meet, as one row each; a block's task then reads the others one after the other.
What a task writes is bounded by the members of its own block, so rows grow in
proportion to members, also in one large group.  The *comparisons* of different near
copies in one family still grow with its square: the number of links asks for them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, require, text_of
from corpusloom.llm.graph import components, lookup
from corpusloom.llm.text_arrays import buffer_of, chunks, mix, span_hashes, stream, window_hashes, word_hashes, words

SHINGLE, ROWS, BANDS, STEP = 5, 6, 32, 32
TOLERANCE = 1e-5
#: Members of a block, and distinct shingles of a block of long texts.
BLOCK, BLOCK_SHINGLES = 512, 500_000
#: The threshold 0.8 as a fraction.
THRESHOLD = (4, 5)


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams of a batch of texts, and where each text's begin (one more entry).

    A text with fewer words has one shingle, all its words; one without words has none.
    """
    data, offsets = buffer_of(column)
    starts, ends, first = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    at, found = window_hashes(hashes, first, size)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        at = np.concatenate([at, first[short]])
        found = np.concatenate([found, span_hashes(hashes, first[short], first[short + 1], 0)])
        order = np.argsort(at, kind="stable")
        at, found = at[order], found[order]
    return found, np.searchsorted(at, first)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in order, end to end, and where each text's begin (one more entry)."""
    hashes, first = shingles(column)
    owner = np.repeat(np.arange(len(column)), np.diff(first))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[keep], np.searchsorted(o[keep], np.arange(len(column) + 1))


def set_hashes(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, none of them empty."""
    return tuple(np.add.reduceat(mix(sets ^ np.uint64(s)), bounds[:-1]).view(np.int64) for s in (0x51ED, 0xA2F7))


@lru_cache(maxsize=1)
def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    x = stream(31, 2 * k)
    return (x[:k] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[k:] >> np.uint64(32)).astype(np.uint32)


def signatures(hashes: np.ndarray, bounds: np.ndarray, k: int = ROWS * BANDS) -> np.ndarray:
    """MinHash values (text x k, 32 bits) of texts that all have shingles."""
    low, (mul, add) = (hashes >> np.uint64(32)).astype(np.uint32), _permutations(k)
    out = np.empty((len(bounds) - 1, k), np.uint32)
    for j in range(k):
        x = (low + add[j]) * mul[j]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        out[:, j] = np.minimum.reduceat(x, bounds[:-1])
    return out


def text_hash() -> Column:
    """What tells rows of one ``doc_id`` apart."""
    return F.xxhash64(text_of())


def sketch(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``text_hash``, ``set_a``/``set_b`` (128-bit hash of the shingle set), ``size`` of the set, ``bands`` (keys) and ``sig`` (16 bits a value); nulls without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                n = part.num_rows
                h, first = shingle_sets(part.column("text"))
                some = np.flatnonzero(np.diff(first) > 0)
                columns = [[None] * n for _ in range(5)]
                if len(some):
                    bounds = np.append(first[some], len(h))
                    sums = set_hashes(h, bounds)
                    sig = signatures(h, bounds)
                    at = np.arange(len(some) * BANDS) * ROWS
                    keys = span_hashes(sig.astype(np.uint64).ravel(), at, at + ROWS, 3).reshape(-1, BANDS)
                    for i, at in enumerate(some.tolist()):
                        columns[0][at], columns[1][at], columns[2][at] = int(sums[0][i]), int(sums[1][i]), int(bounds[i + 1] - bounds[i])
                        columns[3][at] = keys[i].view(np.int64)
                        columns[4][at] = (sig[i] & np.uint32(0xFFFF)).astype("<u2").tobytes()
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *arrays], names=["doc_id", "text_hash", "set_a", "set_b", "size", "bands", "sig"])

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"), text_hash().alias("text_hash"))
    return given.mapInArrow(run, "doc_id bigint, text_hash bigint, set_a bigint, set_b bigint, size bigint, bands array<bigint>, sig binary")


@lru_cache(maxsize=8)
def least_matches(n: int, tolerance: float = TOLERANCE) -> int:
    """The fewest agreements among ``n`` values with which a pair stays: the posterior P(J >= t) is a binomial tail."""
    t, total = THRESHOLD[0] / THRESHOLD[1], 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def pruned_pairs(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature matrices that survive incremental comparison; with ``same`` only i < j."""
    first = np.zeros((len(a), len(b)), np.int16)
    for k in range(STEP):
        first += a[:, k, None] == b[None, :, k]
    alive = first >= least_matches(STEP)
    if same:
        alive &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
    i, j = np.nonzero(alive)
    matches = first[i, j].astype(np.int64)
    for n in range(STEP, a.shape[1], STEP):
        if not len(i):
            break
        matches += (a[i, n : n + STEP] == b[j, n : n + STEP]).sum(1)
        stay = matches >= least_matches(n + STEP)
        i, j, matches = i[stay], j[stay], matches[stay]
    return i, j


class Forest:
    """Trees over any numbers; keeps the edges that join two of them."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        p, q = self.find(x), self.find(y)
        if p != q:
            self.parent[max(p, q)] = min(p, q)
        return p != q


def forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the edges ``ids[i]`` - ``ids[j]``."""
    trees = Forest()
    return [(x, y) for x, y in zip(ids[i].tolist(), ids[j].tolist(), strict=True) if trees.join(x, y)]


def by_group(df: DataFrame, key: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``work`` on the rows of each key (which must be few): shuffle, sort, then stream over the sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
            change = np.zeros(batch.num_rows, bool)
            for c in codes:
                change[1:] |= c[1:] != c[:-1]
            head = tuple(c[0] for c in codes)
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            if held and head != last:
                yield from work(pa.Table.from_batches(held))
                held = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
            last = tuple(c[-1] for c in codes)
        if held:
            yield from work(pa.Table.from_batches(held))

    return df.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)


def block_of(member: str, blocks: str, *salt: str) -> Column:
    """The block, from 0, of a member."""
    return F.pmod(F.xxhash64(member, *salt), F.col(blocks)).cast("int")


def _edges(found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if found:
        a, b = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _matrix(sig: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = sig.to_pylist()
    return np.frombuffer(b"".join(rows), "<u2").reshape(len(rows), -1)


def _survivors(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the pairs inside a block that pruning keeps."""
    ids = group.column("member").to_numpy()
    if len(ids) > 1:
        sig = _matrix(group.column("sig"))
        yield from _edges(forest(ids, *pruned_pairs(sig, sig, True)))


def _survivors_between(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """One edge for each two components that a pair of blocks connects; a block is one row."""
    if group.num_rows == 2:
        (x, sig_x), (y, sig_y) = ((r.values.field("component").to_numpy(), _matrix(r.values.field("sig"))) for r in group.column("members"))
        i, j = pruned_pairs(sig_x, sig_y, False)
        trees = Forest()
        apart = x[i] != y[j]
        pairs = np.unique(np.stack([x[i][apart], y[j][apart]], 1), axis=0)
        yield from _edges([(a, b) for a, b in pairs.tolist() if trees.join(a, b)])


def _families(met: DataFrame) -> DataFrame:
    """``node`` and ``component`` of members that survivors connect; ``met`` has (band, key, blocks, member, sig), a row a member and group."""
    dealt = met.withColumn("own", block_of("member", "blocks", "band", "key"))
    edges = by_group(dealt, ["band", "key", "own"], _survivors, "a bigint, b bigint")
    found = components(edges, "families")
    large = dealt.where("blocks > 1")
    if large.isEmpty():
        return found
    known = large.join(found, large["member"] == found["node"], "left").withColumn("component", F.coalesce("component", "member"))
    known = materialise(known.select("band", "key", "blocks", "own", "member", "component", "sig"), "large-groups")
    open_groups = known.groupBy("band", "key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("band", "key")
    left = known.join(open_groups, ["band", "key"])
    packed = left.groupBy("band", "key", "blocks", "own").agg(F.collect_list(F.struct("component", "sig")).alias("members"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("other")
    pairs = packed.select("band", "key", "own", "members", other).where("own <> other").select("band", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "members")
    between = by_group(pairs, ["band", "key", "low", "high"], _survivors_between, "a bigint, b bigint")
    between = materialise(between, "between")
    if between.isEmpty():
        return found
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(between), "joined-families")


def intersections(values: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of intersections between two lists of sets (indices into ``values``), by products of incidence columns."""
    every = np.concatenate(values)
    owner = np.repeat(np.arange(len(values)), [len(v) for v in values])
    _, code, counts = np.unique(every, return_inverse=True, return_counts=True)
    shared = counts > 1  # a shingle of one set meets no other
    rank = np.cumsum(shared) - 1
    keep = shared[code]
    code, owner = rank[code[keep]], owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    total = np.zeros((len(left), len(right)), np.int64)
    width = 2048
    for start in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(code, (start, start + width))
        grid = np.zeros((len(values), width), np.float32)
        grid[owner[a:b], code[a:b] - start] = 1
        total += np.rint(grid[left] @ grid[right].T).astype(np.int64)
    return total


@dataclass(frozen=True)
class Block:
    """Members with their numbers of copies, signatures and shingle sets, each once, and labels of what is connected."""

    ids: np.ndarray
    copies: np.ndarray
    sig: np.ndarray
    sets: list[np.ndarray]
    labels: np.ndarray

    @staticmethod
    def of(rows: pa.Table | pa.StructArray) -> Block:
        column = rows.column if isinstance(rows, pa.Table) else rows.field
        ids = column("member").to_numpy()
        _, at = np.unique(ids, return_index=True)  # repeated rows of one doc_id
        sets = column("shingles").to_pylist()
        labels = column("label").to_numpy()[at] if not isinstance(rows, pa.Table) else ids[at]
        return Block(ids[at], column("copies").to_numpy()[at], _matrix(column("sig"))[at], [np.frombuffer(sets[i], "<u8") for i in at.tolist()], labels)

    def linked(self, other: Block) -> np.ndarray:
        """Own x other: whether pruning keeps the pair and its whole sets reach the threshold."""
        alive = np.zeros((len(self.ids), len(other.ids)), bool)
        i, j = pruned_pairs(self.sig, other.sig, other is self)
        alive[i, j] = True
        if other is self:
            alive |= alive.T
        left, right = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if len(left):
            sets = [*(self.sets[x] for x in left.tolist()), *(other.sets[y] for y in right.tolist())]
            both = intersections(sets, np.arange(len(left)), np.arange(len(left), len(sets)))
            size = np.array([len(s) for s in sets])
            union = size[: len(left), None] + size[None, len(left) :] - both
            alive[np.ix_(left, right)] &= THRESHOLD[1] * both >= THRESHOLD[0] * union
        return alive


_FOUND = "a bigint, b bigint, n bigint, family bigint"


def _found(family: int, counts: list[tuple[int, int]], edges: list[tuple[int, int]], more: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (member, null, links), (a, b, 0), and one of nulls if the family has edges that were not written."""
    rows = [*((a, None, n) for a, n in counts), *((a, b, 0) for a, b in edges), *([(None, None, 0)] if more else [])]
    if rows:
        columns = zip(*((*r, family) for r in rows), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n", "family"])


def _links_inside(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links of a block's members to each other, and a spanning forest of these."""
    block = Block.of(group)
    if len(block.ids) > 1:
        linked = block.linked(block)
        n = linked @ block.copies
        some = np.flatnonzero(n)
        counts = zip(block.ids[some].tolist(), n[some].tolist(), strict=True)
        yield from _found(int(group.column("family")[0].as_py()), list(counts), forest(block.ids, *np.nonzero(np.triu(linked))))


def _links_between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each block's members to those of its family's other blocks.

    A row is a block; rows are sorted by (family, task), the task's own block first.
    Edges connect labels, two for each member of the own block at the most; if
    there are more to write, the family comes again with new labels.
    """
    at, own, counts, edges, trees, more = None, None, None, [], Forest(), False

    def close() -> Iterator[pa.RecordBatch]:
        if own is not None:
            some = np.flatnonzero(counts)
            yield from _found(at[0], list(zip(own.ids[some].tolist(), counts[some].tolist(), strict=True)), edges, more)

    for batch in batches:
        for k in range(batch.num_rows):
            key = (batch.column("family")[k].as_py(), batch.column("task")[k].as_py())
            if key != at:
                yield from close()
                at, own = key, None
                if batch.column("rank")[k].as_py() < 0:
                    own = Block.of(batch.column("members")[k].values)
                    counts, edges, trees, more = np.zeros(len(own.ids), np.int64), [], Forest(), False
                continue
            if own is None:  # a block without members
                continue
            block = Block.of(batch.column("members")[k].values)
            linked = own.linked(block)
            counts += linked @ block.copies
            i, j = np.nonzero(linked & (own.labels[:, None] != block.labels[None, :]))
            # The first link of each label, then the others.
            _, first = np.unique(own.labels[i], return_index=True)
            order = np.concatenate([first, np.setdiff1d(np.arange(len(i)), first)])
            for a, b in zip(own.labels[i[order]].tolist(), block.labels[j[order]].tolist(), strict=True):
                if len(edges) >= 2 * len(own.ids):
                    more = more or trees.find(a) != trees.find(b)
                    if more:
                        break
                elif trees.join(a, b):
                    edges.append((a, b))
    yield from close()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle sets of texts, without rows whose text is not the member's own (of several of one doc_id) and repeats that follow each other."""
    last = None
    for batch in batches:
        for part in chunks(batch, "text"):
            h, first = shingle_sets(part.column("text"))
            some = np.flatnonzero(np.diff(first) > 0)
            if not len(some):
                continue
            one, two = set_hashes(h, np.append(first[some], len(h)))
            some = some[(part.column("set_a").to_numpy()[some] == one) & (part.column("set_b").to_numpy()[some] == two)]
            member = part.column("member").to_numpy()[some]
            fresh = np.ones(len(some), bool)
            fresh[1:] = member[1:] != member[:-1]
            if len(some):
                fresh[0], last = member[0] != last, member[-1]
            some = some[fresh]
            taken = part.take(pa.array(some))
            sets = pa.array([h[first[i] : first[i + 1]].astype("<u8").tobytes() for i in some.tolist()], pa.binary())
            names = ["family", "blocks", "own", "member", "copies", "sig"]
            yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in names), sets], names=[*names, "shingles"])


def _links(held: DataFrame) -> DataFrame:
    """``a``, ``b``, ``n``: (member, null, links) and edges (a, b, 0) whose components are the classes."""
    inside = materialise(by_group(held, ["family", "own"], _links_inside, _FOUND), "links-inside")
    large = held.where("blocks > 1")
    if large.isEmpty():
        return inside
    found, again = inside, None
    while True:
        labels = components(found.where("b IS NOT NULL").select("a", "b"), "blocks")
        known = large.join(labels, large["member"] == labels["node"], "left").withColumn("label", F.coalesce("component", "member"))
        if again is not None:
            known = lookup(known, "family", again, "family").where("again")
        members = F.collect_list(F.struct("member", "copies", "sig", "shingles", "label")).alias("members")
        packed = known.groupBy("family", "blocks", "own").agg(members)
        tasks = packed.select("family", "own", "members", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("task"))
        tasks = tasks.withColumn("rank", F.when(F.col("own") == F.col("task"), -1).otherwise(F.col("own")))
        between = tasks.repartition("family", "task").sortWithinPartitions("family", "task", "rank").mapInArrow(_links_between, _FOUND)
        between = materialise(between, "links-between")
        kept = between if again is None else between.where("b IS NOT NULL OR a IS NULL")  # links were counted the first time
        found = found.unionByName(kept.where("a IS NOT NULL"))
        again = materialise(between.where("a IS NULL").select("family", F.lit(True).alias("again")).distinct(), "again")
        if again.isEmpty():
            return found


def jaccard_classes(docs: DataFrame, detailed: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``class_id`` and ``n_links``; if ``detailed`` also ``text_hash`` and ``class_key``.

    ``n_links`` counts the other rows whose shingle set has Jaccard similarity
    0.8 or more (equal sets included); ``class_id`` is the least ``doc_id`` among
    all rows reached by links.

    ``class_key`` is a number of the class, also where ``doc_id`` is not unique; it is null for rows that form their own class by rule.

    * Null or wordless texts have no shingles, link to nothing and form their own class.
    * A text with one to four words has one shingle, its words.
    * Texts are used whole.  Repeated rows (also with one ``doc_id``) are rows of their own and link to each other.
      So do rows of one ``doc_id`` with different texts, which may then have different classes.
    * A row with a null ``doc_id`` counts nowhere and keeps null as its class, with no links.
    * Other columns are not read, so none can clash.  Empty input: empty result.
    """
    require(docs, "doc_id", "text")
    # Rows are numbered where they are written; a member's number is the least of its rows'.
    sketched = materialise(sketch(docs).withColumn("row", F.monotonically_increasing_id()), "sketch")
    keys = ["set_a", "set_b"]
    whole = sketched.where("doc_id IS NOT NULL AND set_a IS NOT NULL")
    members = whole.groupBy(*keys).agg(F.min("doc_id").alias("least"), F.min("row").alias("member"), F.count(F.lit(1)).alias("copies"))
    members = materialise(members, "members")
    # One row of each member (equal sets have equal signatures).
    chosen = members.join(sketched.select(F.col("row").alias("member"), "size", "bands", "sig"), "member")
    keyed = chosen.select("member", F.posexplode("bands").alias("band", "key"))
    sizes = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = sizes.select("band", "key", F.ceil(F.col("n") / F.lit(BLOCK)).alias("blocks"))
    met = materialise(keyed.join(sizes, ["band", "key"]), "met")
    families = _families(met.join(chosen.select("member", "sig"), "member"))
    placed = families.withColumnRenamed("node", "member").withColumnRenamed("component", "family").join(chosen.drop("bands"), "member")
    placed = materialise(placed, "placed")
    need = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("size") / F.lit(BLOCK_SHINGLES)))
    large = materialise(placed.groupBy("family").agg(need.alias("blocks")).where("blocks > 1"), "large")
    placed = lookup(placed, "family", large, "family").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint")))
    placed = placed.withColumn("own", block_of("member", "blocks"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("least"), text_of().alias("text"))
    columns = "family bigint, blocks bigint, own int, member bigint, copies bigint, sig binary, shingles binary"
    held = materialise(placed.join(texts, "least").mapInArrow(_sets, columns), "held")
    found = _links(held)
    classes = components(found.where("b IS NOT NULL").select("a", "b"), "classes")
    least = classes.join(members.select(F.col("member").alias("node"), "least"), "node")
    least = materialise(least, "least")
    named = materialise(least.groupBy("component").agg(F.min("least").alias("class_id")), "named")
    classes = lookup(least, "component", named, "component").select("node", "component", "class_id")
    links = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("others"))
    about = members.join(classes, members["member"] == classes["node"], "left").join(links, members["member"] == links["a"], "left")
    about = about.select(
        *keys, F.coalesce("class_id", "least").alias("class_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "member").alias("class_key")
    )
    columns = ["doc_id", "class_id", "n_links", *(["text_hash", "class_key"] if detailed else [])]
    with_words = whole.select("doc_id", "text_hash", *keys).join(about, keys)
    rest = sketched.where("doc_id IS NULL OR set_a IS NULL").withColumns({"class_id": F.col("doc_id"), "n_links": F.lit(0).cast("bigint"), "class_key": F.lit(None).cast("bigint")})
    return with_words.select(*columns).unionByName(rest.select(*columns))
