"""Chat samples: messages, templates, turn pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import user_prompt

DEFAULT_SYSTEM = "You are a helpful assistant."
HYPOTHESIS_FIELDS = ("hypothesis", "prediction", "output", "translation", "hyp", "target_pred")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def to_messages(user: Column, assistant: Column, system: Column | None = None) -> Column:
    """Optional system, user and assistant message; a null or empty system message is left out."""
    both = F.array(message("user", user), message("assistant", assistant))
    if system is None:
        return both
    return F.when(F.length(system) > 0, F.concat(F.array(message("system", system)), both)).otherwise(both)


def chat_samples(df: DataFrame, row_id: str, template: str, source: str = "source", target: str = "target", system: str = "", task: str = "translate") -> DataFrame:
    """``id``, ``task``, ``messages``; swap ``source`` and ``target`` for the reverse direction."""
    prompt = user_prompt(F.col(source), template)
    return df.select(F.col(row_id).cast("string").alias("id"), F.lit(task).alias("task"), to_messages(prompt, F.col(target), F.lit(system) if system else None).alias("messages"))


def message_status(messages: Column) -> Column:
    """``ok``, or ``malformed``: no messages, one without role or content, or no assistant message at the end."""
    broken = F.exists(messages, lambda m: m.isNull() | m["role"].isNull() | m["content"].isNull())
    last = F.try_element_at(messages, F.lit(-1))["role"]
    sound = messages.isNotNull() & ~F.coalesce(broken, F.lit(True)) & F.coalesce(last == "assistant", F.lit(False))
    return F.when(sound, "ok").otherwise("malformed")


def conversations(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its ``messages`` in the order of turns."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return turns.groupBy(conversation).agg(F.transform(parts, lambda p: F.struct(p["role"].alias("role"), p["content"].alias("content"))).alias("messages"))


def sft_counts(samples: DataFrame, page: str) -> DataFrame:
    """One row: samples and distinct pages."""
    return samples.agg(F.count(F.lit(1)).alias("total"), F.countDistinct(page).alias("pages"))


def render(messages: Column, generation: bool = False, default_system: str | None = DEFAULT_SYSTEM) -> Column:
    """Messages in the im_start/im_end template; without a leading system message the default one is put first."""
    whole = messages
    if default_system is not None:
        whole = F.when(F.get(messages, F.lit(0))["role"] == "system", messages).otherwise(F.concat(F.array(message("system", F.lit(default_system))), messages))
    text = F.array_join(F.transform(whole, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")
    return F.concat(text, F.lit("<|im_start|>assistant\n")) if generation else text


def pick_hypothesis(df: DataFrame) -> Column:
    """The first of the usual fields that is present and not null, else the last assistant message, else an error."""
    found = [F.col(c).cast("string") for c in HYPOTHESIS_FIELDS if c in df.columns]
    if "messages" in df.columns:
        found.append(F.try_element_at(F.filter("messages", lambda m: m["role"] == "assistant"), F.lit(-1))["content"])
    if not found:
        raise ValueError("no hypothesis field")
    return F.coalesce(*found, F.raise_error(F.lit("no hypothesis in a row")).cast("string"))


def turn_pairs(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Adjacent user -> assistant turns of each conversation."""
    order = Window.partitionBy(conversation).orderBy(turn)
    ahead = turns.withColumns({"next_role": F.lead(role).over(order), "next_text": F.lead(text).over(order)})
    both = (F.col(role) == "user") & (F.col("next_role") == "assistant")
    return ahead.where(both).select(conversation, turn, F.col(text).alias("source"), F.col("next_text").alias("target"))
