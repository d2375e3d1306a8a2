"""Tokenised samples: masks, policies, packing, padding, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import text
from corpusloom.operators.chat import message_status
from corpusloom.operators.splits import global_rank, key_rank
from corpusloom.operators.windows import pack_windows

IGNORED = -100


def word_ids(c: Column) -> Column:
    """A stand-in for a tokenizer: a fixed positive id for each white-space word."""
    words = F.filter(F.split(text(c), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.conv(F.substring(F.sha1(w), 1, 7), 16, 10).cast("int"))


def mask_prompt(ids: Column, prompt: Column) -> Column:
    """Labels: the first ``prompt`` positions are ignored; 0 or more than there are leaves all."""
    masked = F.concat(F.array_repeat(F.lit(IGNORED), prompt), F.slice(ids, prompt + 1, F.size(ids)))
    return F.when((prompt > 0) & (prompt <= F.size(ids)), masked).otherwise(ids)


def encode(df: DataFrame, prompt: str, answer: str, limit: int, policy: str = "drop") -> DataFrame:
    """Add ``input_ids``, ``labels``, ``attention_mask`` and ``status``: ok, empty, overlong (no ids) or truncated."""
    if policy not in ("drop", "truncate"):
        raise ValueError("policy must be drop or truncate")
    p, a = word_ids(F.col(prompt)), word_ids(F.col(answer))
    df = df.withColumns({"__p": p, "__ids": F.concat(p, a)})
    df = df.withColumn("__labels", mask_prompt(F.col("__ids"), F.size("__p")))
    n = F.size("__ids")
    status = F.when(n == 0, "empty").when(n <= limit, "ok").otherwise("truncated" if policy == "truncate" else "overlong")
    keep = n <= limit if policy == "drop" else F.lit(True)
    ids = F.when(keep & (n > 0), F.slice("__ids", 1, limit))
    out = df.withColumns({"status": status, "input_ids": ids, "labels": F.when(ids.isNotNull(), F.slice("__labels", 1, limit))})
    return out.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1))).drop("__p", "__ids", "__labels")


def encode_messages(df: DataFrame, limit: int, messages: str = "messages", policy: str = "drop") -> DataFrame:
    """As :func:`encode`, from ``messages``: the last one is the answer, what stands before it the prompt; broken rows get no ids and status ``malformed``."""
    sound = message_status(F.col(messages)) == "ok"
    n = F.size(messages)
    prompt = F.array_join(F.transform(F.slice(messages, 1, F.greatest(n - 1, F.lit(0))), lambda m: m["content"]), " ")
    df = df.withColumns({"__prompt": F.when(sound, prompt), "__answer": F.when(sound, F.try_element_at(messages, F.lit(-1))["content"]), "__sound": sound})
    out = encode(df, "__prompt", "__answer", limit, policy)
    return out.withColumn("status", F.when(F.col("__sound"), F.col("status")).otherwise("malformed")).drop("__prompt", "__answer", "__sound")


def stats(encoded: DataFrame) -> DataFrame:
    """Rows and tokens by status."""
    return encoded.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("input_ids").isNotNull(), F.size("input_ids"))), F.lit(0)).cast("long").alias("tokens"))


def pack_sequences(encoded: DataFrame, shard: str, order: str, limit: int) -> DataFrame:
    """Samples of a shard, in order, joined to sequences of at most ``limit`` ids (no sample is split).

    Bins are found from (order, length) of a shard's samples alone; ids and labels meet
    only in the row of their bin.  Samples without ids are left out.
    """
    rows = encoded.where(F.col("input_ids").isNotNull()).select(shard, order, "input_ids", "labels", F.size("input_ids").alias("__size"))
    packed = pack_windows(rows, shard, order, "__size", limit)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("pos"), F.col("input_ids").alias("ids"), "labels")))
    whole = packed.groupBy(shard, F.col("window").alias("bin")).agg(parts.alias("parts"))
    ids, labels = (F.flatten(F.col(f"parts.{f}")) for f in ("ids", "labels"))
    return whole.select(shard, "bin", ids.alias("input_ids"), labels.alias("labels")).withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))


def length_batches(df: DataFrame, size: str, row_id: str, batch: int, seed: int, epoch: int, drop_last: bool = False) -> DataFrame:
    """Add ``batch`` (in order of length) and ``batch_key``, by which batches are shuffled anew each epoch."""
    ranked = global_rank(df, size, row_id)
    number = F.floor(F.col("rank") / batch).cast("long")
    out = ranked.withColumn("batch", number).withColumn("batch_key", key_rank(F.concat(F.lit(f"{seed + epoch}:"), number.cast("string")), seed)).drop("rank")
    return out.where(F.col("batch") < df.count() // batch) if drop_last else out


def pad_batches(df: DataFrame, batch: str, multiple: int = 8, pad: int = 0) -> DataFrame:
    """Ids, labels and masks filled up to the batch's longest row, rounded up to ``multiple``."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    width = (F.ceil(longest / multiple) * multiple).cast("int")
    df = df.withColumn("__gap", width - F.size("input_ids"))

    def filled(c: str, value: int) -> Column:
        return F.concat(F.col(c), F.array_repeat(F.lit(value), F.col("__gap")))

    return df.withColumns({"input_ids": filled("input_ids", pad), "labels": filled("labels", IGNORED), "attention_mask": filled("attention_mask", 0)}).drop("__gap")
