"""Splits and samples whose decisions depend on keys alone, by hashes instead of a random generator's state.

Rows of one key always go together, repeated ones too; a null key is a key of its own.
Texts are not read.  Columns that an operator adds replace input columns of the same
name.  Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.ranks import beside, order_statistics
from corpusloom.functions.text import hash_fraction

#: Prefix of the hashed key (a fixed value: splits of existing files depend on it).
SALT = "scp-split-v1:"


def key_rank(key: Column, seed: int) -> Column:
    """A pseudo-random but fixed sort key: SHA-1 of seed and key."""
    return F.sha1(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_split(df: DataFrame, doc: str, ratio: float, salt: str = SALT) -> DataFrame:
    """Add ``split``: val if the document's hash falls below ``ratio``, else train.  The same in every file and at every size; no shuffle."""
    return df.withColumn("split", F.when(hash_fraction(F.col(doc).cast("string"), salt) < F.lit(ratio), "val").otherwise("train"))


def _numbered(keys: DataFrame, key: str, seed: int) -> DataFrame:
    """Distinct keys (null is one) with ``n`` before each in hash order, without a global window: hash prefixes are counted, then ranked inside."""
    ranked = keys.select(F.col(key).alias("__key")).distinct().withColumn("__h", F.coalesce(key_rank(F.col("__key"), seed), F.lit("")))
    ranked = ranked.withColumn("__slot", F.substring("__h", 1, 3))
    sizes = ranked.groupBy("__slot").agg(F.count(F.lit(1)).alias("__size"))
    # At most 4097 slots, whatever the number of keys.
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("__slot").orderBy("__h", "__key")) - 1
    return ranked.join(F.broadcast(before), "__slot").select("__key", (F.col("__before") + inside).alias("__n"))


def _with_split(df: DataFrame, key: str, named: DataFrame) -> DataFrame:
    """Rows with the ``split`` of their key; an input column ``split`` gives way."""
    rest = df.drop("split")
    return rest.join(named, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def group_split(df: DataFrame, key: str, val: float = 0.1, test: float = 0.1, train: float = 0.8, seed: int = 42) -> DataFrame:
    """Add ``split`` so that the rows of a key stay together: shares of the keys in hash order, at least one val and test key if there are three."""
    total = train + val + test
    if total <= 0:
        raise ValueError("split ratios must be positive")
    ranked = _numbered(df, key, seed)
    groups = ranked.count()
    n_train, n_val = round(groups * train / total), round(groups * val / total)
    if groups >= 3:
        n_val = max(1, n_val)
        n_train = min(n_train, groups - n_val - 1)
    name = F.when(F.col("__n") < n_train, "train").when(F.col("__n") < n_train + n_val, "val").otherwise("test")
    return _with_split(df, key, ranked.select("__key", name.alias("split")))


def remove_leaks(df: DataFrame, source_hash: str, target_hash: str, split: str = "split") -> DataFrame:
    """Drop val rows that share a source or target hash with train, then test rows that share one with train or the kept val."""

    def hashes(part: DataFrame) -> DataFrame:
        return part.select(F.explode(F.array(source_hash, target_hash)).alias("h")).distinct()

    def clean(part: DataFrame, seen: DataFrame) -> DataFrame:
        for column in (source_hash, target_hash):
            part = part.join(seen.withColumnRenamed("h", column), column, "left_anti")
        return part.select(*df.columns)

    train, val, test = (df.where(F.col(split) == s) for s in ("train", "val", "test"))
    seen = hashes(train)
    kept = clean(val, seen)
    return train.unionByName(kept).unionByName(clean(test, seen.union(hashes(kept)).distinct()))


def split_stats(df: DataFrame, split: str, group: str, chars: str, row_id: str, head: int = 10) -> DataFrame:
    """Per split: rows, distinct groups, characters, the least and greatest id, and ``ids``, the first ``head`` ids in order.

    The ids come from a ranked selection, so no split's ids are gathered in one place.
    """
    sums = df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(group).alias("groups"), F.sum(chars).alias("chars"))
    first = df.groupBy(split).agg(F.min(row_id).alias("first_id"), F.max(row_id).alias("last_id"))
    ranked = df.select(split, row_id).withColumn("__rank", F.row_number().over(Window.partitionBy(split).orderBy(row_id)))
    ids = ranked.where(F.col("__rank") <= head).groupBy(split).agg(F.sort_array(F.collect_list(row_id)).alias("ids"))
    return sums.join(first, split).join(ids, split)


def holdout(df: DataFrame, doc: str, ratio: float, seed: int = 42) -> DataFrame:
    """Add ``split``: the first ``int(n * ratio)`` documents in hash order are val."""
    ranked = _numbered(df, doc, seed)
    limit = int(ranked.count() * ratio)
    return _with_split(df, doc, ranked.select("__key", F.when(F.col("__n") < limit, "val").otherwise("train").alias("split")))


def round_robin(df: DataFrame, doc: str, row_id: str, target: int, seed: int = 42) -> DataFrame:
    """At most ``target`` rows, so that every document gives its k-th row before any gives its (k+1)-th."""
    order = Window.partitionBy(doc).orderBy(key_rank(F.col(row_id), seed), row_id)
    ranked = df.withColumn("turn", F.row_number().over(order))
    return ranked.orderBy("turn", key_rank(F.col(doc), seed), doc).limit(target)


def subsample(df: DataFrame, doc: str, row_id: str, target: int, seed: int = 42) -> DataFrame:
    """A round-robin sample in shuffled order; all rows, as they are, if there are no more than ``target``."""
    if df.count() <= target:
        return df
    return round_robin(df, doc, row_id, target, seed).drop("turn").orderBy(key_rank(F.col(row_id), seed + 1), row_id)


def strata_sample(df: DataFrame, size: str, row_id: str, limit: int, strata: int) -> DataFrame:
    """Systematic sample over equal-count strata of ``size`` (ties by ``row_id``): each gives its share at even steps.

    Ranks come from range-partitioned counts, not from one global window.
    """
    n = df.count()
    if limit <= 0 or limit >= n:
        return df
    ranked = global_rank(df, size, row_id)
    pos = F.col("rank")
    stratum = F.floor(((pos + 1) * strata - 1) / F.lit(n)).cast("long")
    low = F.floor(stratum * n / F.lit(strata)).cast("long")
    high = F.floor((stratum + 1) * n / F.lit(strata)).cast("long")
    take = F.lit(limit // strata) + F.when(stratum < limit % strata, 1).otherwise(0)
    block, at = high - low, pos - low
    j = F.ceil(at * take / block).cast("long")
    chosen = (take >= block) | ((j < take) & (F.floor(j * (block / take)).cast("long") == at))
    return ranked.where(chosen).drop("rank")


#: Ranges of sizes, and of ids inside a frequent size.
SLOTS = 256


def global_rank(df: DataFrame, size: str, row_id: str) -> DataFrame:
    """Add ``rank`` (from 0) in the order of (size, row_id), without a global window.

    Rows are dealt into ranges of sizes by approximate percentiles, a size that is a
    percentile having a range of its own; one that is several percentiles at once is
    frequent, and its rows are dealt further into ranges of a numeric ``row_id``.  Ranges
    are counted (at most ``SLOTS`` of each kind a frequent size), and rows are ranked
    inside them.  Null sizes come first; ties in both columns are ranked in any order.
    An input column ``rank`` gives way.  An empty table gives an empty one.
    """
    df = df.drop("rank")
    kind = df.schema[row_id].dataType
    shares = [i / SLOTS for i in range(1, SLOTS)]
    wanted = [F.percentile_approx(size, shares, 10_000).alias("sizes")]
    if isinstance(kind, T.NumericType):
        wanted.append(F.percentile_approx(row_id, shares, 10_000).alias("ids"))
    found = df.agg(*wanted).first().asDict()
    sizes, ids = found["sizes"] or [], sorted(set(found.get("ids") or []))
    cuts, often = sorted(set(sizes)), sorted({c for c in sizes if sizes.count(c) > 1})

    def array(values: list, like: str) -> Column:
        return F.array(*map(F.lit, values)).cast(T.ArrayType(df.schema[like].dataType))

    def below(values: list, c: str) -> Column:
        return F.size(F.filter(array(values, c), lambda x: x < F.col(c)))

    def among(values: list) -> Column:
        return F.coalesce(F.array_contains(array(values, size), F.col(size)), F.lit(False))

    slot = 2 * below(cuts, size) + among(cuts).cast("int")
    inner = F.when(among(often), below(ids, row_id)).otherwise(0) if often and ids else F.lit(0)
    dealt = df.withColumns({"__slot": slot, "__inner": inner})
    counts = {(r["__slot"], r["__inner"]): r["n"] for r in dealt.groupBy("__slot", "__inner").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for key in sorted(counts):
        before.append((*key, total))
        total += counts[key]
    offsets = df.sparkSession.createDataFrame(before, "__slot int, __inner int, __before long")
    inside = F.row_number().over(Window.partitionBy("__slot", "__inner").orderBy(size, row_id)) - 1
    ranked = dealt.withColumn("__in", inside).join(F.broadcast(offsets), ["__slot", "__inner"])
    return ranked.withColumn("rank", F.col("__before") + F.col("__in")).drop("__slot", "__inner", "__before", "__in")


def coverage(df: DataFrame, doc: str) -> DataFrame:
    """One row: documents, and least, median (upper) and most rows per document."""
    per = df.groupBy(doc).agg(F.count(F.lit(1)).alias("n"))
    sums = per.agg(F.count(F.lit(1)).alias("docs"), F.min("n").alias("least"), F.max("n").alias("most"))
    return beside(sums, order_statistics(per, "n", {"median": ("upper", 0.5)})).select("docs", "least", "median", "most")
