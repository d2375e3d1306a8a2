"""Byte-level BPE encoding and decoding with a contiguous rank array.

A text is cut into words by the tokenizer's pattern.  A word's bytes are held as
parts in one list and the merge ranks of adjacent parts in a second list beside
it.  The least rank is found by a scan, its right part is deleted, and the two
neighbouring ranks are looked up again, until no adjacent parts can merge.  The
two lists are short, so a scan is cheaper than any index; a word with more than
``LONG`` parts is merged by a heap over linked parts instead, with equal results.

The vocabulary file is a parameter and is opened by each Python worker itself;
it must lie at the same path on every machine.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import require, text_of, with_columns
from corpusloom.llm.text_arrays import chunks

#: The pattern that byte-level vocabularies of this family cut words by (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"



def _latin_pattern() -> str:
    """The same pattern for texts below U+0100, with its classes spelt out for the faster engine of ``re``."""
    letters, numbers, spaces = ("".join(re.escape(chr(c)) for c in range(256) if regex.match(p, chr(c))) for p in (r"\p{L}", r"\p{N}", r"\s"))
    return PATTERN.replace(r"\s+(?!\S)", f"[{spaces}]+(?![^{spaces}])").replace(r"\s\p{L}\p{N}", spaces + letters + numbers).replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{spaces}]")


_WIDE = re.compile("[^\x00-\xff]").search
LONG = 256
CACHED_WORDS, CACHED_CHARS = 200_000, 48
_NONE = 1 << 62


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary's file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Words(dict):
    """Encoded words, as packed ids; forgets all when it is full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        found = self.encode(word.encode("utf-8", "surrogatepass"))
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = found
        return found


class ByteBpe:
    """Encodes texts to ids and decodes ids to texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_alphabet()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_ids = [0] * 256
        for c, b in letters.items():
            self.byte_ids[b] = vocab[c]
        #: For a pair of ids: the rank of its merge and, in the low bits, the id it gives.
        self.merges: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[left], vocab[right]), rank << 24 | vocab[left + right])
        self.find_any, self.find_latin = regex.compile(PATTERN).findall, re.compile(_latin_pattern()).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = _Words(self._word)

    def _word(self, word: bytes) -> bytes:
        parts = [self.byte_ids[b] for b in word]
        parts = self._by_array(parts) if len(parts) <= LONG else self._by_heap(parts)
        return b"".join([p.to_bytes(4, "little") for p in parts])

    def _by_array(self, parts: list[int]) -> list[int]:
        rank = self.merges.get
        ranks = [rank(pair, _NONE) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            at = ranks.index(least)
            parts[at] = least & 0xFFFFFF
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), _NONE)
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), _NONE)
        return parts

    def _by_heap(self, parts: list[int]) -> list[int]:
        rank, n = self.merges.get, len(parts)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(m, i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := rank((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], alive[j], after[i] = m & 0xFFFFFF, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (m := rank((parts[i], parts[after[i]]))) is not None:
                    heapq.heappush(heap, (m, i, parts[i], parts[after[i]]))
            if before[i] >= 0 and (m := rank((parts[before[i]], parts[i]))) is not None:
                heapq.heappush(heap, (m, before[i], parts[before[i]], parts[i]))
        return [p for p, a in zip(parts, alive, strict=True) if a]

    def find(self, text: str) -> list[str]:
        return self.find_any(text) if _WIDE(text) else self.find_latin(text)

    def encode(self, text: str) -> bytes:
        """The ids as packed little-endian unsigned 32-bit integers."""
        one = self.words.__getitem__
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(map(one, self.find(text)))
        return b"".join(self.special[piece].to_bytes(4, "little") if piece in self.special else b"".join(map(one, self.find(piece))) for piece in self.cut.split(text) if piece)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def bpe_encode(docs: DataFrame, path: str, text: str = "text", packed: bool = False, decoded: str | None = None) -> DataFrame:
    """Add ``ids``: array<int>, or with ``packed`` binary (little-endian unsigned 32-bit).

    With ``decoded`` the text decoded from these ids is added under that name in
    the same pass, which needs half the workers of a second one.

    All columns pass through; an input column ``ids`` gives way.  A null text
    counts as empty and gives no ids.  Texts are encoded whole, whatever their
    length.  Rows are independent: nothing is shuffled, and repeated rows give
    repeated results.
    """
    require(docs, text)
    given = with_columns(docs, {"ids": text_of(text)})
    if decoded:
        given = given.drop(decoded)
    own = [T.StructField(decoded, T.StringType())] if decoded else []
    schema = T.StructType([*given.schema.fields[:-1], *own, T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for part in chunks(batch, "ids"):
                ids = [bpe.encode(t) for t in part.column("ids").to_pylist()]
                texts = [pa.array([bpe.decode(i) for i in ids], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *texts, pa.array(ids, pa.binary())], names=schema.names)

    found = given.mapInArrow(run, schema)
    return found if packed else _unpacked(found)


def _unpacked(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(b, "<u4").astype(np.int32) for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.int32()))], names=batch.schema.names)

    schema = T.StructType([*df.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """Add the text of a column of ids (array<int> or packed binary); null ids give null.  An input column ``output`` gives way."""
    require(df, ids)
    given = with_columns(df, {output: F.col(ids)})
    packed = isinstance(given.schema[output].dataType, T.BinaryType)
    schema = T.StructType([*given.schema.fields[:-1], T.StructField(output, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = tokenizer(path).decode
        for batch in batches:
            step = 500
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows = part.column(output).to_pylist()
                texts = [None if r is None else decode(r if packed else np.array(r, "<u4").tobytes()) for r in rows]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=part.schema.names)

    return given.mapInArrow(run, schema)
