"""Main text of web pages by wrapper induction over same-host pages.

1. *Pivot*: of each host the page with the least hash is its pivot tree.
2. *Alignment*: every page's DOM tree is aligned to its host's pivot by simple tree
   matching (the largest order-preserving mapping of equal tags).  A slot is a text
   block, inline text included, of a node.  For each slot of the pivot it is counted
   over all different pages in how many its node is present, and in how many with that text.
   For each node of the pivot the text is summed that stands below it in elements
   without a partner, on either side: it tells where pages differ in structure.
3. *Template*: nodes that all pages share are template; slots whose text stays constant
   over a host's pages are so too.  The node below which most text varies in structure is
   the host's *region*.
4. *Content*: the slots of the region, in page order.  A block of them is dropped only
   if its own text is that of a template slot of its node.  Tags, roles and names help where
   alignment cannot tell: a region that holds article or main elements, or lies in one,
   stands for these; a host whose pages do not differ in structure uses its articles, or
   without any all varying slots; menus, headers, footers, sidebars, notices, adverts,
   forms and reader comments (by tag, role, class or id) are never content.

Alignments depend on tree shapes alone and are remembered per pair of shapes.  Equal
beginnings and ends of two lists of children are matched without a table (which
loses nothing).  A table of more than ``MAX_CELLS`` is not held: :class:`Wide` walks its
diagonals where a largest mapping can pass and gives the same pairs.  That is a small
part of the table where lists are alike; time still grows with the product of their
lengths where they are not.  Counts are summed per
batch before the shuffle, so a host with a third of all pages costs no task more
than others.  Pivots are broadcast if their size, which is measured, is below
``BROADCAST_BYTES``; otherwise pages are dealt by host and a salt to copies of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, require, with_columns
from corpusloom.llm.html_dom import RAW, Node, blocks, parse
from corpusloom.llm.text_arrays import chunks

#: A slot of a region is template if at least MIN_PAGES different pages have its node and CONSTANT of them with
#: the pivot's text; where a host has no region and a page no article, two pages are enough.
MIN_PAGES, CONSTANT = 8, 0.9
BROADCAST_BYTES, SALTS, MAX_CELLS = 8_000_000, 16, 250_000
#: Boilerplate by tag, by role, and by words in class and id (fixed values).
_TAGS = RAW | frozenset("nav header footer aside form menu head button select option dialog object embed svg canvas audio video".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs "
    "header masthead footer sidebar sidebars aside widget widgets comment comments disqus reply replies notice notices cookie cookies consent gdpr popup modal overlay "
    "newsletter subscribe subscription signup login search share sharing social related recommended toolbar pagination pager copyright disclaimer".split()
)
_WHOLE = frozenset(["#root", "html", "body"])
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"


def boilerplate(node: Node, words: bool = True) -> bool:
    """Whether an element is never content, by its own tag and attributes; without ``words`` by tag and role alone.

    Only whole names of a class or id count: ``no-sidebar`` is no sidebar.
    """
    if node.tag in _TAGS:
        return True
    if not node.attributes or node.tag in _WHOLE:
        return False
    if _ROLES & set(node.get("role").lower().split()):
        return True
    return words and not _WORDS.isdisjoint(node.get("class", "id").lower().split())


class Tree:
    """A page's elements in page order with shape numbers, parents and children."""

    def __init__(self, root: Node, shapes: dict):
        self.nodes, self.children, self.shape, self.parent = [], [], [], []
        stack = [(root, -1)]
        while stack:
            node, parent = stack.pop()
            k = len(self.nodes)
            self.nodes.append(node)
            self.children.append([])
            self.parent.append(parent)
            if parent >= 0:
                self.children[parent].append(k)
            if node.tag not in RAW:
                stack.extend((c, k) for c in reversed(node.elements()))
        self.shape = [0] * len(self.nodes)
        for k in range(len(self.nodes) - 1, -1, -1):
            key = (self.nodes[k].tag, tuple(self.shape[c] for c in self.children[k]))
            self.shape[k] = shapes.setdefault(key, len(shapes))


class Matcher:
    """Simple tree matching, remembered per pair of shapes; forgets all when it holds too much."""

    def __init__(self, limit: int = 200_000):
        self.shapes: dict = {}
        self.known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
        self.limit = limit

    def tree(self, text: str) -> Tree:
        return Tree(parse(text), self.shapes)

    def fresh(self) -> bool:
        """Start again if too much is remembered (trees made before are then void)."""
        if len(self.shapes) + len(self.known) > self.limit:
            self.shapes.clear()
            self.known.clear()
            return True
        return False

    def score(self, a: Tree, i: int, b: Tree, j: int) -> int:
        """Size of the largest mapping of the subtrees at ``i`` and ``j``, whose children pairs are remembered.  Iterative: trees may be deep."""
        todo = [(i, j)]
        while todo:
            x, y = todo[-1]
            key = (a.shape[x], b.shape[y])
            if key in self.known:
                todo.pop()
                continue
            if a.nodes[x].tag != b.nodes[y].tag:
                self.known[key] = (0, [])
                todo.pop()
                continue
            left, right = a.children[x], b.children[y]
            one, two = ({t.shape[c]: c for c in cs} for t, cs in ((a, left), (b, right)))
            missing = [(u, v) for s, u in one.items() for t, v in two.items() if (s, t) not in self.known]
            if missing:
                todo.extend(missing)
                continue
            self.known[key] = self._best([a.shape[u] for u in left], [b.shape[v] for v in right])
            todo.pop()
        return self.known[(a.shape[i], b.shape[j])][0]

    def _best(self, left: list[int], right: list[int]) -> tuple[int, list[tuple[int, int]]]:
        """Size of the mapping of two nodes with these children, and the pairs of children that it maps."""
        pairs, n, m = [], len(left), len(right)
        low = 0  # equal subtrees at both ends are best mapped to each other
        while low < min(n, m) and left[low] == right[low]:
            pairs.append((low, low))
            low += 1
        high = 0
        while high < min(n, m) - low and left[n - 1 - high] == right[m - 1 - high]:
            high += 1
        if (n - low - high) * (m - low - high) <= MAX_CELLS:
            pairs += self._table(left, right, low, n - high, low, m - high)
        else:
            pairs += [(low + u, low + v) for u, v in Wide(left[low : n - high], right[low : m - high], self.known).pairs()]
        pairs += [(n - k, m - k) for k in range(high, 0, -1)]
        return 1 + sum(self.known[left[u], right[v]][0] for u, v in pairs), pairs

    def _table(self, left: list[int], right: list[int], a: int, b: int, c: int, d: int) -> list[tuple[int, int]]:
        """The best mapping of ``left[a:b]`` to ``right[c:d]``."""
        rows = [[0] * (d - c + 1)]
        for u in left[a:b]:
            before, row, last = rows[-1], [0], 0
            for j, v in enumerate(right[c:d]):
                w = before[j] + self.known[u, v][0]
                up = before[j + 1]
                last = w if w > up and w > last else up if up > last else last
                row.append(last)
            rows.append(row)
        pairs, i, j = [], b - a, d - c
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((a + i, c + j))
        return pairs[::-1]

    def align(self, a: Tree, b: Tree) -> dict[int, int]:
        """Pivot node of each aligned node of ``a``."""
        found: dict[int, int] = {}
        todo = [(0, 0)]
        while todo:
            x, y = todo.pop()
            if self.score(a, x, b, y):
                found[x] = y
                for u, v in self.known[(a.shape[x], b.shape[y])][1]:
                    todo.append((a.children[x][u], b.children[y][v]))
        return found


class Wide:
    """The mapping that :meth:`Matcher._table` finds, of lists too long for a table.

    Cell (i, j) of the table is the most that the first i and j children give.  Held
    are only its differences to the cells above (``up``, by row) and to the left
    (``left``, by column, backwards), of one diagonal i + j at a time.  A cell counts
    only if what stands before and after it could still add up to a bound: first one
    near the most that the children could give, then, if that is not reached, the sum
    that was (no largest mapping passes a cell left out).  The way back computes the cells
    around it again, from copies of some diagonals.
    """

    def __init__(self, left: list[int], right: list[int], known: dict):
        self.n, self.m = len(left), len(right)
        one, two = ({s: k for k, s in enumerate(dict.fromkeys(x))} for x in (left, right))
        weights = np.array([[known[s, t][0] for t in two] for s in one], np.int64)
        self.type = next(t for t in (np.int8, np.int16, np.int32) if weights.max() <= np.iinfo(t).max)
        a, b = np.array([one[s] for s in left]), np.array([two[s] for s in right])
        #: The most that the first i children could give, and the first j.
        self.most = [np.concatenate([[0], np.cumsum(w[x])]) for w, x in ((weights.max(1), a), (weights.max(0), b))]
        b = b[::-1]
        few = min(len(one), len(two))
        weights = weights.astype(self.type)
        self.masks = []
        if few > 8:
            self.table, self.rows, self.columns = weights.ravel(), a * len(two), b.copy()
        elif few == len(one):
            self.masks = [(-(a == k).astype(self.type), weights[k][b]) for k in range(few)]
        else:
            self.masks = [(weights[:, k][a], -(b == k).astype(self.type)) for k in range(few)]

    def _band(self, bound: int) -> None:
        """First and last row of each diagonal whose cells can be on a way that gives ``bound``."""
        ahead, beside = self.most
        i = np.arange(self.n + 1)
        low = np.searchsorted(beside, bound - (ahead[-1] - ahead), "left")
        high = np.searchsorted(beside, ahead + beside[-1] - bound, "right") - 1
        steps = np.append(i, self.n + 1) * self.m // self.n  # cells around the straight way keep the band in one piece
        low, high = np.minimum(low, steps[:-1]), np.minimum(np.maximum(high, steps[1:]), self.m)
        d = np.arange(self.n + self.m + 1)
        first, last = np.searchsorted(i + high, d, "left"), np.searchsorted(i + low, d, "right") - 1
        self.first, self.last = (np.maximum(first, np.maximum(1, d - self.m))).tolist(), np.minimum(last, np.minimum(self.n, d - 1)).tolist()

    def _walk(self, begin: int, end: int, top: int, side: int, copies: dict | None = None, every: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Diagonals ``begin`` to ``end`` up to row ``top`` and column ``side``: first row, and the differences up and to the left."""
        m, up, left, other, first, last = self.m, self.up, *self.left, self.first, self.last
        best, work = np.empty(self.n, self.type), np.empty(self.n, self.type)
        index = None if self.masks else np.empty(self.n, np.int64)
        for d in range(begin, end + 1):
            low, high = max(first[d], d - side), min(last[d], top)
            if low <= high:
                # Row i is at i - 1; column j = d - i, backwards, at m - j.
                a, b = slice(low - 1, high), slice(m - d + low, m - d + high + 1)
                w, x = best[: high - low + 1], work[: high - low + 1]
                if self.masks:
                    (mask, given), *others = self.masks
                    np.bitwise_and(mask[a], given[b], out=w)
                    for mask, given in others:
                        np.bitwise_or(w, np.bitwise_and(mask[a], given[b], out=x), out=w)
                else:
                    np.take(self.table, np.add(self.rows[a], self.columns[b], out=index[: high - low + 1]), out=w, mode="clip")
                over, before = up[a], left[b]
                np.maximum(w, before, out=w)
                np.maximum(w, over, out=w)
                now = other[b]
                np.subtract(w, over, out=now)
                np.subtract(w, before, out=over)
                if copies is None:
                    yield low, over == 0, now == 0
                elif d % every == 0:
                    copies[d] = (a, b, over.copy(), now.copy())
            elif copies is None:
                yield low, *(np.zeros(0, bool),) * 2
            left, other = other, left

    def _clear(self) -> None:
        self.up, self.left = np.zeros(self.n, self.type), [np.zeros(self.m, self.type) for _ in range(2)]

    def _sums(self, bound: int, copies: dict, every: int) -> int:
        """The most that ways through the band give; all largest mappings are in it if that reaches the bound."""
        self._band(bound)
        self._clear()
        for _ in self._walk(2, self.n + self.m, self.n, self.m, copies, every):
            pass
        return int(self.up.sum(dtype=np.int64))

    def pairs(self) -> list[tuple[int, int]]:
        most = int(min(x[-1] for x in self.most))
        copies: dict[int, tuple] = {}
        every = 1 + int((self.n + self.m) ** 0.6)
        bound = most - most // 16
        found = self._sums(bound, copies, every)
        if found < bound:
            copies.clear()
            self._sums(found, copies, every)
        out, i, j = [], self.n, self.m
        while i and j:
            d = i + j
            start = (d - 1) // every * every
            self._clear()
            if start in copies:
                a, b, over, now = copies[start]
                self.up[a] = over
                for x in self.left:
                    x[b] = now
            cells = list(self._walk(max(start + 1, 2), d, i, j))
            begin = d + 1 - len(cells)
            while i and j and i + j >= begin:
                low, over, now = cells[i + j - begin]
                if over[i - low]:
                    i -= 1
                elif now[i - low]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((i, j))
        return out[::-1]


class Pivot:
    """A pivot's tree, by node its slots (number and text), and which nodes may not be regions."""

    def __init__(self, tree: Tree):
        self.tree, self.slots, self.chars = tree, _numbered(tree, whole(tree)), amounts(tree)
        self.closed = [False] * len(tree.nodes)
        for k, node in enumerate(tree.nodes):
            self.closed[k] = boilerplate(node) or (k > 0 and self.closed[tree.parent[k]])

    def variation(self, page: Tree, found: dict[int, int]) -> dict[int, int]:
        """By node of the pivot: characters below it in elements without a partner, here or there."""
        chars, taken, out = amounts(page), set(found.values()), {}
        for x, y in found.items():
            if not self.closed[y]:
                n = sum(chars[c] for c in page.children[x] if c not in found) + sum(self.chars[c] for c in self.tree.children[y] if c not in taken)
                if n:
                    out[y] = n
        return out


class _Pivots:
    """Parsed pivots of the hosts met last."""

    def __init__(self):
        self.matcher, self.trees = Matcher(), {}

    def get(self, text: str) -> Pivot:
        if self.matcher.fresh() or len(self.trees) > 500:
            self.trees.clear()
        if text not in self.trees:
            self.trees[text] = Pivot(self.matcher.tree(text))
        return self.trees[text]


@lru_cache(maxsize=1)
def _pivots() -> _Pivots:
    return _Pivots()


def slots(node: Node, skip=boilerplate) -> list[tuple[Node, str]]:
    """The text blocks below a node in page order, and the elements that they stand in."""
    found: list[tuple[Node, str]] = []
    blocks(node, skip, lambda owner, text: found.append((owner, text)))
    return found


def _articles(tree: Tree, words: bool = True) -> list[int]:
    """All outermost article and main elements outside boilerplate in page order.

    Without ``words`` what stands around an article is told by tag and role alone.
    """
    found, closed = [], [False] * len(tree.nodes)
    for k, node in enumerate(tree.nodes):
        if k and closed[tree.parent[k]]:
            closed[k] = True
            continue
        mine = node.tag in ("article", "main") or node.get("role").lower() in ("main", "article")
        closed[k] = mine or boilerplate(node, words)
        if mine and not boilerplate(node):
            found.append(k)
    return found


def amounts(tree: Tree) -> list[int]:
    """Characters below each node, without boilerplate."""
    out = [0] * len(tree.nodes)
    for k in range(len(tree.nodes) - 1, -1, -1):
        node = tree.nodes[k]
        if not boilerplate(node):
            out[k] = sum(len(c.strip()) for c in node.children if c.__class__ is not Node) + sum(out[c] for c in tree.children[k])
    return out


def _below(tree: Tree, k: int, top: int) -> bool:
    while k > top:
        k = tree.parent[k]
    return k == top


def regions(tree: Tree, region: int | None) -> tuple[list[int], bool]:
    """The nodes whose slots are content, and whether they were found by structure or by an article (not the whole page).

    An induced ``region`` that holds articles, or lies in one, gives way to them; other
    articles of the page are content as well.
    """
    articles = next((found for words in (True, False) if (found := [k for k in _articles(tree, words) if slots(tree.nodes[k])])), [])
    if region and not any(_below(tree, k, region) or _below(tree, region, k) for k in articles) and slots(tree.nodes[region]):
        articles = sorted([*articles, region]) if not articles else articles
    return (articles, True) if articles else ([0], False)


def whole(tree: Tree) -> list[tuple[Node, str]]:
    """All slots of a page outside boilerplate; class words do not count around its only articles."""
    around: set[int] = set()
    if not _articles(tree):
        for k in _articles(tree, False):
            while k:
                k = tree.parent[k]
                around.add(id(tree.nodes[k]))
    return slots(tree.nodes[0], lambda n: boilerplate(n, id(n) not in around))


def _numbered(tree: Tree, found: list[tuple[Node, str]]) -> dict[int, list[tuple[int, str]]]:
    place = {id(n): k for k, n in enumerate(tree.nodes)}
    out: dict[int, list[tuple[int, str]]] = {}
    for i, (owner, text) in enumerate(found):
        out.setdefault(place[id(owner)], []).append((i, text))
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: a hash of its texts, the pivot's slots whose node it has, those that it has with the pivot's text, and the pivot's nodes below which it varies with how much."""
    state = _pivots()
    for batch in batches:
        for part in chunks(batch, "html"):
            pages, presents, equals, nodes, amount = [], [], [], [], []
            for page, text in zip(*(part.column(c).to_pylist() for c in ("html", "pivot")), strict=True):
                pivot = state.get(text)
                known = pivot.slots
                tree = state.matcher.tree(page)
                found = whole(tree)
                own = _numbered(tree, found)
                present, equal = [], []
                aligned = state.matcher.align(tree, pivot.tree)
                varies = pivot.variation(tree, aligned)
                nodes.append(list(varies))
                amount.append(list(varies.values()))
                for x, y in aligned.items():
                    if y in known:
                        texts = {t for _, t in own.get(x, ())}
                        present.extend(i for i, _ in known[y])
                        equal.extend(i for i, t in known[y] if t in texts)
                pages.append(int.from_bytes(hashlib.blake2b("\n".join(t for _, t in found).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True))
                presents.append(sorted(present))
                equals.append(sorted(equal))
            arrays = [part.column("host"), pa.array(pages, pa.int64()), *(pa.array(x, pa.list_(pa.int32())) for x in (presents, equals, nodes)), pa.array(amount, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "page", "present", "equal", "nodes", "amounts"])


def extract(tree: Tree, pivot: Pivot | None = None, found: dict[int, int] | None = None, template: frozenset[int] = frozenset(), repeated: frozenset[int] = frozenset(), region: int | None = None) -> str:
    """The content of one page, a block a line.

    ``found`` aligns it to the pivot, whose ``template`` slots are constant (``repeated``: over a few pages); ``region`` is a node of the pivot.
    """
    found = found or {}
    mine = next((x for x, y in found.items() if y == region), None)
    kept, known = regions(tree, mine)
    constant = template if known else template | repeated
    dropped = {id(tree.nodes[x]): {t for i, t in pivot.slots.get(y, ()) if i in constant} for x, y in found.items()} if constant else {}
    return "\n".join(text for k in kept for owner, text in slots(tree.nodes[k]) if text not in dropped.get(id(owner), ()))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = _pivots()
    for batch in batches:
        for part in chunks(batch, "text"):
            out = []
            for page, text, template, repeated, region in zip(*(part.column(c).to_pylist() for c in ("text", "__pivot", "__template", "__repeated", "__region")), strict=True):
                if template or repeated or region is not None:
                    pivot = state.get(text)
                    tree = state.matcher.tree(page)
                    out.append(extract(tree, pivot, state.matcher.align(tree, pivot.tree), frozenset(template or ()), frozenset(repeated or ()), region))
                else:
                    out.append(extract(Tree(parse(page), {})))
            names = part.schema.names
            kept = [i for i, n in enumerate(names) if n not in ("text", "__pivot", "__template", "__repeated", "__region")]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(out, pa.string())], names=[*(names[i] for i in kept), "text"])


def with_host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("__host", F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), _HOST, 1)))


def wrappers(pages: DataFrame) -> DataFrame:
    """One row per host: ``host``, ``pivot`` (a page), ``template`` and ``repeated`` (numbers of slots that are constant on many or on a few pages) and ``region`` (a node, or null)."""
    given = with_host(pages).select(F.col("__host").alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pivots = materialise(given.groupBy("host").agg(F.min_by("html", F.xxhash64("html")).alias("pivot")), "pivots")
    found = _joined(given, pivots, "host").mapInArrow(_counts, "host string, page bigint, present array<int>, equal array<int>, nodes array<int>, amounts array<bigint>")
    pages = found.groupBy("host", "page").agg(F.min(F.struct("present", "equal", "nodes", "amounts")).alias("has"))
    pages = materialise(pages, "aligned")
    had = pages.select("host", F.explode("has.present").alias("slot"), F.col("has.equal").alias("equal"))
    sums = had.groupBy("host", "slot").agg(F.count(F.lit(1)).alias("present"), F.count_if(F.array_contains("equal", F.col("slot"))).alias("equal"))
    same = sums.where((F.col("present") >= 2) & (F.col("equal") >= CONSTANT * F.col("present")))

    def numbers(which: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(which, F.col("slot"))))

    constant = same.groupBy("host").agg(numbers(F.col("present") >= MIN_PAGES).alias("template"), numbers(F.col("present") < MIN_PAGES).alias("repeated"))
    varies = pages.select("host", F.explode(F.arrays_zip(F.col("has.nodes").alias("node"), F.col("has.amounts").alias("amount"))).alias("v"))
    varies = varies.groupBy("host", F.col("v.node").alias("node")).agg(F.sum("v.amount").alias("amount"))
    most = varies.groupBy("host").agg(F.max_by("node", F.struct("amount", -F.col("node"))).alias("region"))
    return pivots.join(constant, "host", "left").join(most, "host", "left")


def _joined(df: DataFrame, side: DataFrame, key: str, pivot: str = "pivot") -> DataFrame:
    """Join per-host rows, whose template is never larger than its pivot: by broadcast if they are small, else by host and a salt."""
    size = 2 * (side.agg(F.sum(F.octet_length(pivot))).first()[0] or 0)
    if size <= BROADCAST_BYTES:
        return df.join(F.broadcast(side), key)
    copies = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("__salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(copies, [key, "__salt"]).drop("__salt")


def main_text(pages: DataFrame) -> DataFrame:
    """Add ``text``, the main text of each page's whole ``html``.

    Needs ``url`` and ``html``; all columns but ``html`` pass through, and an
    input column ``text`` gives way.

    * Null html counts as empty and gives an empty text; so does a page without content.
    * Pages whose URL is null or has no host share one host, the empty one.
    * A host of one page has no template; the page is cut by tags alone.
    * Repeated rows, and pages with equal texts, count as one page for the template and give equal texts.  Empty input: empty result.
    """
    require(pages, "url", "html")
    sides = materialise(wrappers(pages), "wrappers").select(F.col("host").alias("__host"), F.col("pivot").alias("__pivot"), F.col("template").alias("__template"), F.col("repeated").alias("__repeated"), F.col("region").alias("__region"))
    given = with_host(pages)
    kept = [c for c in pages.columns if c not in ("html", "text")]
    rows = _joined(given, sides, "__host", "__pivot")
    rows = with_columns(rows.select(*(F.col(f"`{c}`") for c in kept), "html", "__pivot", "__template", "__repeated", "__region"), {"text": F.coalesce(F.col("html").cast("string"), F.lit(""))}).drop("html")
    schema = given.select(*(F.col(f"`{c}`") for c in kept), F.lit("").alias("text")).schema
    return rows.mapInArrow(_texts, schema)
