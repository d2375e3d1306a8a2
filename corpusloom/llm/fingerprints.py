"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each five-word shingle is hashed once.  The low bits of the hash pick one of
``BINS`` bins and its high bits are the value there; a bin keeps its least value.
An empty bin borrows from a bin chosen by hashing (bin, attempt) until a filled
one is met, so each empty bin borrows independently and all texts borrow alike
(optimal densification).  The fingerprint packs the low ``BITS`` bits of all bins.

Two fingerprints agree in a bin by chance with probability 2**-BITS, so their
likeness is corrected: (agreements/BINS - 2**-BITS) / (1 - 2**-BITS), at least 0.

Everything happens in arrays inside a row, and nothing is shuffled.  The hashes
of a text are sorted as primitive integers, which puts those of a bin together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import require, with_columns

SHINGLE, BINS, BITS = 5, 256, 8
#: Attempts of densification by hashing, in portions; beyond the last, the next filled bin in circular order.
ATTEMPTS = ((1, 8), (9, 64), (65, 512))
_VALUE_BITS = 40
_BLANKS = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Maximal runs without the white space 0x20 and 0x09-0x0D; null and blank texts have none."""
    tidy = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(_BLANKS))
    return F.when(tidy != "", F.split(tidy, r"[ \t\n\x0B\f\r]+")).otherwise(F.array().cast("array<string>"))


def with_bins(df: DataFrame, text: str, output: str, seed: int = 7) -> DataFrame:
    """Add ``output``: array<tinyint>, the low bits (less 128) of all bins; null for a text without words.

    All columns pass through; an input column of the output's name gives way.
    Texts with equal words have equal bins.  A text of one to four words has one
    shingle, its words.  Texts are used whole, however long.
    """
    require(df, text)
    one = F.lit((1 << BITS) - 1)
    step = df.withColumn("__hashed", F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)))
    n = F.size("__hashed")
    many = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(F.get("__hashed", i + k) for k in range(SHINGLE))))
    few = F.array(F.xxhash64(F.concat_ws(":", F.transform("__hashed", lambda h: h.cast("string")))))
    hashes = F.when(n >= SHINGLE, many).when(n > 0, few).otherwise(F.array().cast("array<bigint>"))
    packed = F.transform(hashes, lambda h: F.shiftleft(h.bitwiseAND(F.lit(BINS - 1)), _VALUE_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - _VALUE_BITS)))
    step = step.withColumn("__packed", F.sort_array(packed))
    first = F.filter("__packed", lambda x, i: (i == 0) | (F.shiftright(x, _VALUE_BITS) != F.shiftright(F.get("__packed", i - 1), _VALUE_BITS)))
    step = step.withColumn("__first", first)
    # Gaps before, between and after the filled bins become nulls.
    def bin_of(x: Column) -> Column:
        return F.shiftright(x, _VALUE_BITS).cast("int")

    nothing = F.lit(None).cast("tinyint")

    def filled(x: Column, i: Column) -> Column:
        gap = bin_of(x) - F.when(i > 0, bin_of(F.get("__first", i - 1))).otherwise(F.lit(-1)) - 1
        return F.concat(F.array_repeat(nothing, gap), F.array((x.bitwiseAND(one) - F.lit(128)).cast("tinyint")))

    last = F.coalesce(bin_of(F.get("__first", F.size("__first") - 1)), F.lit(-1))
    sparse = F.concat(F.flatten(F.transform("__first", filled)), F.array_repeat(nothing, F.lit(BINS - 1) - last))
    # A column that a lambda reads is referred to several times: Catalyst then keeps it as a column instead of inlining it into the loop.
    step = step.withColumn("__sparse", sparse)

    def found(tries: Column) -> Column:
        return F.get(F.filter(tries, lambda v: v.isNotNull()), F.lit(0))

    def attempt(b: Column, low: int, high: int) -> Column:
        return found(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda j: F.get("__sparse", F.pmod(F.xxhash64(b, j, F.lit(seed)), F.lit(BINS)).cast("int"))))

    def value(v: Column, b: Column) -> Column:
        around = found(F.transform(F.sequence(F.lit(1), F.lit(BINS - 1)), lambda j: F.get("__sparse", (b + j) % BINS)))
        return F.coalesce(v, *(attempt(b, *a) for a in ATTEMPTS), around)

    bins = F.when(F.size("__first") > 0, F.transform("__sparse", value))
    return with_columns(step, {output: bins}).drop("__hashed", "__packed", "__first", "__sparse")


def packed_text(bins: Column) -> Column:
    """Bins as hexadecimal text; empty for a text without words."""
    digits = F.array(*(F.lit(f"{i:02x}") for i in range(1 << BITS)))
    return F.coalesce(F.array_join(F.transform(bins, lambda v: F.get(digits, v.cast("int") + 128)), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts by their bins; 1 if neither has words, 0 if one has none."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    chance = 2.0**-BITS
    near = F.greatest((same / F.lit(float(BINS)) - F.lit(chance)) / F.lit(1 - chance), F.lit(0.0))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(near)


#: Coarse ranges of keys, and fine ones in all (both bound what is broadcast), and the rows aimed at in a fine one.
COARSE, FINE, FINE_ROWS = 4096, 32_768, 250


def with_next(df: DataFrame, key: str, columns: list[str], prepare=lambda d: d) -> DataFrame:
    """Add ``next_<column>`` of the next row in descending order of an integer ``key`` (after the last: the first).

    The order is global, yet no task sorts more than a range of keys.  Keys are
    cut into ``COARSE`` equal ranges, and each of these, by its count, into fine
    ones of about ``FINE_ROWS`` rows.  A window looks ahead inside a fine range;
    its last row finds the first row of the following range because that row is
    dealt to both.  The ranges' statistics and first keys are broadcast: at most
    ``COARSE + FINE`` rows each.  ``prepare`` maps the rows once before they are
    shuffled (``columns`` may be its outputs).  Ties are ordered by ``columns``;
    a null key comes last.
    """
    spark = df.sparkSession
    span = df.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n")).first()
    low = span["low"] if span["low"] is not None else 1
    high = span["high"] if span["high"] is not None else 1
    at = F.coalesce(F.col(key).cast("bigint"), F.lit(low - 1))
    width = max(1, -(-(high - low + 2) // COARSE))
    aim = max(FINE_ROWS, -(-span["n"] // FINE))
    keyed = df.select(at.alias("__at")).withColumn("__coarse", F.expr(f"cast((__at - {low - 1}L) div {width}L as int)"))
    ranges = keyed.groupBy("__coarse").agg(F.min("__at").alias("__from"), F.max("__at").alias("__to"), F.count(F.lit(1)).alias("__n"))
    ranges = ranges.selectExpr("__coarse", "__from", f"greatest(1L, cast(ceil((__to - __from + 1) / ceil(__n / {aim})) as bigint)) AS __step")
    fine = F.expr("__coarse * 1048576L + (__at - __from) div __step")
    heads = keyed.join(F.broadcast(ranges), "__coarse").groupBy(fine.alias("__fine")).agg(F.max("__at").alias("__head")).orderBy("__fine").collect()
    # A range's first row also ends the range above it; the first row of all ends the lowest range.
    also = [(h["__head"], heads[(i + 1) % len(heads)]["__fine"]) for i, h in enumerate(heads)]
    targets = spark.createDataFrame(also, "__at bigint, __also bigint")
    rows = prepare(df).withColumn("__at", at).withColumn("__coarse", F.expr(f"cast((__at - {low - 1}L) div {width}L as int)"))
    rows = rows.join(F.broadcast(ranges), "__coarse").withColumn("__fine", fine).join(F.broadcast(targets), "__at", "left")
    deals = F.filter(F.array(F.struct(F.col("__fine").alias("to"), F.lit(False).alias("extra")), F.struct(F.col("__also").alias("to"), F.lit(True).alias("extra"))), lambda d: d["to"].isNotNull())
    dealt = rows.withColumn("__deal", F.explode(deals)).withColumn("__to", F.col("__deal.to")).withColumn("__extra", F.col("__deal.extra"))
    order = Window.partitionBy("__to").orderBy("__extra", F.col("__at").desc(), *(F.col(c).asc_nulls_first() for c in columns))
    looked = dealt.withColumn("__next", F.lead(F.struct(*columns)).over(order)).where("NOT __extra")
    looked = looked.select("*", *(F.col(f"__next.{c}").alias(f"next_{c}") for c in columns))
    return looked.drop("__at", "__coarse", "__from", "__step", "__fine", "__also", "__deal", "__to", "__extra", "__next")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each document with its edited text and the fingerprints of its own, the edited and the next text.

    Returns ``doc_id``, ``n_chars``, ``edited`` (text), and bins ``own``,
    ``changed`` and ``next_own``.  The edited text replaces the last
    floor(n_chars/3) code points by the first as many (or all) of the next
    document in descending ``doc_id``.  A null text counts as empty.
    """
    require(docs, "doc_id", "text")
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(given, "doc_id", ["text", "own"], lambda d: with_bins(d, "text", "own"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "own", "next_own")
    return with_bins(rows, "edited", "changed")
