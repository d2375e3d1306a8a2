"""Personal data: base patterns, and a linear-chain CRF over word shapes that adds spans.

Base spans come from fixed patterns (leftmost, non-overlapping per kind); a match
that fails its kind's test (Luhn, part values, digit counts) is dropped and not
retried.  They are found in linear time whatever the text.

The CRF labels white-space separated words; a sequence is one line of a text.  A
word is described by its shape alone: counts of digits, cases, dots, dashes and
so on, quantised and packed into one integer.  Emissions are sums of weights over
the shapes of the word and its two neighbours, so they are looked up per distinct
shape.  Viterbi runs over all lines of a batch at once, ordered by length.  A
labelled run of words becomes a span of kind ``crf_<kind>`` if it passes the
kind's plausibility test and overlaps no base span.

The model is trained on the driver from a small labelled table of words
(:func:`labelled_table`): by default the sentences of ``data/pii_labelled.txt``, about
a hundred lines written by hand, with made-up personal data in forms that the base
patterns miss and with numbers that are no personal data.  Each sentence is used
once as it stands and ``VARIANTS`` times with other digits and letters, since only
shapes count.  Tables of up to ``MAX_LABELLED`` sentences are taken.
"""

from __future__ import annotations

import importlib.resources
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import require, text_of, with_columns
from corpusloom.llm.text_arrays import buffer_of, chunks, words

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
MAX_LABELLED, VARIANTS = 5000, 2

# --- base patterns -----------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_NUMBER = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_AT = re.compile(r"\w(?:@|\(at\)|\[at\])\w")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for chain in _DOTTED.finditer(text):
        numbers = list(_NUMBER.finditer(text, chain.start(), chain.end()))
        for i in range(0, len(numbers) - 3, 4):
            four = numbers[i : i + 4]
            if all(len(m[0].lstrip("0")) <= 3 and int(m[0].lstrip("0") or "0") <= 255 for m in four):
                yield four[0].start(), four[3].end()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    found = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            found += [("ip", *s) for s in _ips(text)]
        found += [("card", *s) for s in _cards(text)]
        if "+" in text:
            found += [("phone", *s) for s in _phones(text)]
    return found


# --- word shapes -------------------------------------------------------------

#: Fields of a shape: name and number of values.
_FIELDS = (("digits", 9), ("lower", 2), ("upper", 3), ("high", 2), ("at", 3), ("dot", 5), ("dash", 4), ("paren", 3), ("plus", 2), ("other", 2), ("first", 5))
_PAIRS = (("digits", "first"), ("digits", "dash"), ("digits", "dot"), ("digits", "lower"), ("at", "dot"), ("digits", "paren"), ("digits", "plus"))
_OUTSIDE = int(np.prod([n for _, n in _FIELDS]))
_LONGEST = 4000


def _class_sums() -> tuple[np.ndarray, np.ndarray]:
    one, two = np.zeros(256, np.uint64), np.zeros(256, np.uint64)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            one[b] = 1 << 36
        elif c.isdigit():
            one[b] = 1
        elif c.islower():
            one[b] = 1 << 12
        elif c.isupper():
            one[b] = 1 << 24
        elif c == "@":
            one[b] = 1 << 48
        else:
            two[b] = 1 << 12 * {".": 0, "-": 1, "(": 2, ")": 2, "/": 2, "+": 3}.get(c, 4)
    return one, two


_ONE, _TWO = _class_sums()
_DIGIT_STEP = np.minimum(np.searchsorted([1, 2, 3, 4, 5, 10, 13, 20], np.arange(64), "right"), 8)
_TRAILING = np.zeros(256, bool)
_TRAILING[[ord(c) for c in ".,;:!?\"'"]] = True


def trim(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends without closing punctuation (at most three characters, at least one is left)."""
    for _ in range(3):
        ends = ends - ((ends - starts > 1) & _TRAILING[data[ends - 1]])
    return ends


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One integer per word."""
    if not len(starts):
        return np.zeros(0, np.int64)
    bounds = np.empty(2 * len(starts), np.int64)
    bounds[0::2], bounds[1::2] = starts, ends
    padded = np.append(data, np.uint8(32))
    one, two = (np.add.reduceat(sums[padded], bounds)[0::2] for sums in (_ONE, _TWO))

    def count(x: np.ndarray, k: int, most: int) -> np.ndarray:
        return np.minimum(x >> np.uint64(12 * k) & np.uint64(0xFFF), np.uint64(most)).astype(np.int64)

    first = data[starts]
    kind = np.full(len(starts), 4, np.int64)
    kind[(first >= 48) & (first < 58)] = 0
    kind[((first | 32) >= 97) & ((first | 32) < 123) | (first >= 128)] = 1
    kind[first == ord("+")] = 2
    kind[first == ord("(")] = 3
    values = (
        _DIGIT_STEP[count(one, 0, 63)], count(one, 1, 1), count(one, 2, 2), count(one, 3, 1), count(one, 4, 2),
        count(two, 0, 4), count(two, 1, 3), count(two, 2, 2), count(two, 3, 1), count(two, 4, 1), kind,
    )
    code = np.zeros(len(starts), np.int64)
    for (_, n), v in zip(_FIELDS, values, strict=True):
        code = code * n + v
    code[ends - starts > _LONGEST] = _OUTSIDE - 1
    return code


def features(code: int) -> list[tuple]:
    """The names of a shape's features; ``_OUTSIDE`` stands for the border of a line."""
    if code == _OUTSIDE:
        return [("border",)]
    values = {}
    for name, n in reversed(_FIELDS):
        code, values[name] = divmod(code, n)
    return [*values.items(), *((a, values[a], b, values[b]) for a, b in _PAIRS)]


# --- the model ---------------------------------------------------------------


@dataclass(frozen=True)
class Crf:
    """Weights: (offset, feature) -> one per label; transitions and start scores."""

    emit: dict[tuple, np.ndarray]
    move: np.ndarray
    start: np.ndarray

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """Scores of distinct shapes: offset (-1, 0, 1) x shape x label."""
        out = np.zeros((3, len(codes), len(LABELS)), np.float32)
        for i, code in enumerate(codes.tolist()):
            for f in features(code):
                for offset in (-1, 0, 1):
                    w = self.emit.get((offset, f))
                    if w is not None:
                        out[offset + 1, i] += w
        return out


Sentence = tuple[list[str], list[str]]
_MARKED = re.compile(r"\{(\w+)\|([^}]*)\}")


def marked_sentence(line: str) -> Sentence:
    """Words of a line and a label for each; personal data stands in braces as ``{kind|words}``."""
    tokens, labels, at = [], [], 0
    glued = False  # the last word goes on
    for kind, piece in [x for m in _MARKED.finditer(line) for x in (("none", line[at : m.start()]), (m[1], m[2])) if not (at := m.end()) < 0] + [("none", line[at:])]:
        parts = piece.split()
        if glued and parts and not piece[0].isspace():
            tokens[-1] += parts.pop(0)
        tokens += parts
        labels += [kind] * len(parts)
        glued = bool(tokens) and bool(piece) and not piece[-1].isspace()
    return tokens, labels


def read_marked(text: str) -> list[Sentence]:
    return [marked_sentence(line) for line in text.splitlines() if line.strip() and not line.startswith("#")]


def labelled_table(spark: SparkSession) -> DataFrame:
    """The default labelled table: ``sentence``, ``position``, ``word``, ``label``."""
    rows = [(i, k, w, label) for i, (words_, labels) in enumerate(_default_sentences()) for k, (w, label) in enumerate(zip(words_, labels, strict=True))]
    return spark.createDataFrame(rows, "sentence int, position int, word string, label string")


def sentences(table: DataFrame) -> list[Sentence]:
    """The first ``MAX_LABELLED`` sentences of a labelled table, by their key; rows without a word or with an unknown label are no words."""
    require(table, "sentence", "position", "word", "label")
    known = table.where(F.col("word").isNotNull() & F.col("sentence").isNotNull() & F.col("label").isin(*LABELS))
    grouped = known.groupBy("sentence").agg(F.array_sort(F.collect_list(F.struct("position", "word", "label"))).alias("words"))
    return [([w["word"] for w in r["words"]], [w["label"] for w in r["words"]]) for r in grouped.orderBy("sentence").limit(MAX_LABELLED).collect()]


@lru_cache(maxsize=1)
def _default_sentences() -> list[Sentence]:
    text = importlib.resources.files("corpusloom.llm").joinpath("data/pii_labelled.txt").read_text(encoding="utf-8")
    return read_marked(text)


def variants(rows: list[Sentence], times: int = VARIANTS, seed: int = 5) -> list[Sentence]:
    """The sentences, and copies whose digits, small and capital letters are drawn anew."""
    r = random.Random(seed)

    def drawn(word: str) -> str:
        return "".join(r.choice("0123456789") if c.isdigit() else r.choice("abcdefghijklmnopqrstuvwxyz") if "a" <= c <= "z" else r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") if "A" <= c <= "Z" else c for c in word)

    return rows + [([drawn(w) for w in tokens], labels) for _ in range(times) for tokens, labels in rows]


def _coded(tokens: list[str]) -> np.ndarray:
    data, offsets = buffer_of(pa.array(["\n".join(tokens)]))
    starts, ends, _ = words(data, offsets)
    return shapes(data, starts, trim(data, starts, ends))


def train(rows: list[Sentence], steps: int = 80, rate: float = 0.3, ridge: float = 1e-3) -> Crf:
    """Maximum conditional likelihood by full-batch AdaGrad with forward-backward sums."""
    rows = [x for x in rows if x[0]]
    k = len(LABELS)
    names: dict[tuple, int] = {}
    n, longest = len(rows), max((len(x[0]) for x in rows), default=1)
    coded = [_coded(tokens) for tokens, _ in rows]
    width = 3 * (len(_FIELDS) + len(_PAIRS))
    index = np.zeros((n, longest, width), np.int64)  # 0: no feature
    gold, mask = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (codes, (_, labels)) in enumerate(zip(coded, rows, strict=True)):
        around = [_OUTSIDE, *codes.tolist(), _OUTSIDE]
        for t, label in enumerate(labels):
            own = [(o, f) for o in (-1, 0, 1) for f in features(around[t + 1 + o])]
            index[i, t, : len(own)] = [names.setdefault(x, len(names) + 1) for x in own]
            gold[i, t], mask[i, t] = LABELS.index(label), True
    w, move, start = np.zeros((len(names) + 1, k)), np.zeros((k, k)), np.zeros(k)
    sums = [np.full_like(x, 1e-8) for x in (w, move, start)]
    hot = np.eye(k)[gold] * mask[..., None]
    used = index[mask]
    flat = used.ravel()
    for _ in range(steps):
        em = np.zeros((n, longest, k))
        em[mask] = w[used].sum(1)
        alpha, beta = np.zeros((longest, n, k)), np.zeros((longest, n, k))
        alpha[0] = start + em[:, 0]
        for t in range(1, longest):
            x = alpha[t - 1][:, :, None] + move
            top = x.max(1)
            new = top + np.log(np.exp(x - top[:, None]).sum(1)) + em[:, t]
            alpha[t] = np.where(mask[:, t, None], new, alpha[t - 1])
        for t in range(longest - 2, -1, -1):
            x = move + (em[:, t + 1] + beta[t + 1])[:, None, :]
            top = x.max(2)
            beta[t] = np.where(mask[:, t + 1, None], top + np.log(np.exp(x - top[..., None]).sum(2)), beta[t + 1])
        top = alpha[-1].max(1)
        log_z = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(1))
        unary = np.exp(alpha.transpose(1, 0, 2) + beta.transpose(1, 0, 2) - log_z[:, None, None]) * mask[..., None]
        pairs, seen = np.zeros((k, k)), np.zeros((k, k))
        for t in range(1, longest):
            on = mask[:, t]
            x = alpha[t - 1][on][:, :, None] + move + (em[on, t] + beta[t][on])[:, None, :] - log_z[on][:, None, None]
            pairs += np.exp(x).sum(0)
            np.add.at(seen, (gold[on, t - 1], gold[on, t]), 1)
        rest = (hot - unary)[mask]
        slope = np.stack([np.bincount(flat, np.repeat(rest[:, j], width), len(w)) for j in range(k)], 1)
        slope[0] = 0
        for value, g, total in ((w, slope / n - ridge * w, sums[0]), (move, (seen - pairs) / n - ridge * move, sums[1]), (start, (hot[:, 0] - unary[:, 0]).sum(0) / n, sums[2])):
            total += g * g
            value += rate * g / np.sqrt(total)
    return Crf({f: w[i].astype(np.float32) for f, i in names.items()}, move.astype(np.float32), start.astype(np.float32))


@lru_cache(maxsize=1)
def default_model() -> Crf:
    return train(variants(_default_sentences()))


def train_on(table: DataFrame) -> Crf:
    """A model from a labelled table."""
    return train(variants(sentences(table)))


def viterbi(em: np.ndarray, first: np.ndarray, lengths: np.ndarray, model: Crf) -> np.ndarray:
    """The best label of each word; ``em`` word x label, sequences given by first word and length."""
    labels = np.zeros(len(em), np.int8)
    order = np.argsort(-lengths, kind="stable")
    first, lengths = first[order], lengths[order]
    live = int((lengths > 0).sum())
    if not live:
        return labels
    score = model.start + em[first[:live]]
    scores_end, back, alive = score.copy(), [], [live]
    longest = int(lengths[0])
    counts = np.searchsorted(-lengths, -np.arange(longest), "left")  # sequences longer than t
    for t in range(1, longest):
        n = int(counts[t])
        x = score[:n, :, None] + model.move
        step = x.argmax(1).astype(np.int8)
        score = np.take_along_axis(x, step[:, None, :].astype(np.int64), 1)[:, 0] + em[first[:n] + t]
        scores_end[:n] = score
        back.append(step)
        alive.append(n)
    label = scores_end.argmax(1)
    for t in range(longest - 1, -1, -1):
        n = alive[t]
        labels[first[:n] + t] = label[:n]
        if t:
            label[:n] = np.take_along_axis(back[t - 1], label[:n, None], 1)[:, 0]
    return labels


def _plausible(kind: str, piece: str) -> bool:
    digits = "".join(_DIGIT.findall(piece))
    if kind == "email":
        return _AT.search(piece) is not None
    if kind == "ip":
        numbers = _NUMBER.findall(piece)
        return piece.count(".") == 3 and len(numbers) >= 4 and all(int(x) <= 255 for x in numbers[:4] if len(x) < 6) and all(len(x) <= 3 for x in numbers[:4])
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


def batch_spans(column: pa.Array, model: Crf) -> list[list[tuple[str, int, int]]]:
    """All spans of each text: base ones by kind and start, then those the CRF adds."""
    data, offsets = buffer_of(column)
    texts = [t or "" for t in column.to_pylist()]
    found = [base_spans(t) for t in texts]
    starts, ends, first = words(data, offsets)
    if not len(starts):
        return found
    ends = trim(data, starts, ends)
    codes, inverse = np.unique(shapes(data, starts, ends), return_inverse=True)
    em = model.emissions(np.append(codes, _OUTSIDE))
    newline = np.flatnonzero(data == 10)
    begins = np.unique(np.concatenate([first[:-1], np.searchsorted(starts, newline)]))
    begins = begins[begins < len(starts)]
    lengths = np.diff(np.append(begins, len(starts)))
    border = len(codes)
    before, after = np.empty_like(inverse), np.empty_like(inverse)
    before[1:], after[:-1] = inverse[:-1], inverse[1:]
    before[begins], after[begins[1:] - 1], after[-1] = border, border, border
    labels = viterbi(em[1][inverse] + em[0][before] + em[2][after], begins, lengths, model)
    marked = np.flatnonzero(labels)
    if not len(marked):
        return found
    opens = np.zeros(len(starts), bool)
    opens[begins] = True
    heads = marked[(marked == 0) | opens[marked] | (labels[marked] != labels[np.maximum(marked - 1, 0)])]
    tails = np.append(heads[1:], len(starts) + 1)
    owner = np.searchsorted(first, heads, "right") - 1
    added: dict[int, list[tuple[str, int, int]]] = {}
    inner = np.flatnonzero(data & 0xC0 == 0x80)  # bytes that begin no code point
    base: dict[int, tuple[list[int], list[int]]] = {}
    for head, limit, doc in zip(heads.tolist(), tails.tolist(), owner.tolist(), strict=True):
        last = head
        while last + 1 < min(limit, len(starts)) and labels[last + 1] == labels[head] and not opens[last + 1]:
            last += 1
        low, a, b = int(offsets[doc]), int(starts[head]), int(ends[last])
        kind = LABELS[labels[head]]
        piece = data[a:b].tobytes().decode("utf-8", "replace")
        if not _plausible(kind, piece):
            continue
        start = a - low - int(np.searchsorted(inner, a) - np.searchsorted(inner, low))
        end = start + len(piece)
        if doc not in base:
            ordered = sorted((s, e) for _, s, e in found[doc])
            base[doc] = [s for s, _ in ordered], list(accumulate((e for _, e in ordered), max))
        begins_at, reach = base[doc]
        before_end = bisect_left(begins_at, end)
        if not before_end or reach[before_end - 1] <= start:
            added.setdefault(doc, []).append((f"crf_{kind}", start, end))
    rank = {f"crf_{k}": i for i, k in enumerate(KINDS)}
    for doc, extra in added.items():
        found[doc] = found[doc] + sorted(extra, key=lambda x: (rank[x[0]], x[1]))
    return found


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_pii(docs: DataFrame, text: str = "text", model: Crf | None = None, output: str = "pii_spans") -> DataFrame:
    """Add ``output``: array of (kind, start, end) in code points, base kinds first.

    All columns pass through (an input column of the output's name gives way).  A null
    text counts as empty and has no spans.  Texts are searched whole.  Rows are
    independent, nothing is shuffled, and repeated rows give repeated results.
    """
    require(docs, text)
    model = model or default_model()
    given = with_columns(docs, {output: text_of(text)})
    schema = T.StructType([*given.schema.fields[:-1], T.StructField(output, SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, output):
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in row] for row in batch_spans(part.column(output), model)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(spans, _ARROW)], names=part.schema.names)

    return given.mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of spans that overlap the first one's."""
    pieces, at, reach = [], 0, 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], x[2])):
        if start >= reach:
            pieces += [text[at:start], f"<{kind.removeprefix('crf_').upper()}>"]
        at = reach = max(reach, end)
    return "".join([*pieces, text[at:]])


def mask_pii(docs: DataFrame, text: str = "text", model: Crf | None = None) -> DataFrame:
    """Replace each span of personal data by its kind in angle brackets, overlapping spans by the first one's.

    Column order and names stay; other columns pass through.  A null text stays null,
    an empty one empty.  Texts are taken whole, in time proportional to their length.
    Rows are independent: repeated rows give repeated results, an empty table an
    empty one.
    """
    require(docs, text)
    model = model or default_model()
    given = docs.select(*(F.col(f"`{c}`").cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                column = part.column(text)
                out = [t if t is None or not spans else masked(t, spans) for t, spans in zip(column.to_pylist(), batch_spans(column, model), strict=True)]
                at = part.schema.get_field_index(text)
                columns = [*part.columns[:at], pa.array(out, column.type), *part.columns[at + 1 :]]
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return given.mapInArrow(run, given.schema)


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
