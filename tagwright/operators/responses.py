"""Flatten conversations into assistant responses (T4-T7) and previews.

Two input shapes are supported:

* nested ``(prompt_id, messages array<struct<role, content>>)`` - every row is
  one conversation, flattened with ``posexplode`` of a filtered array (no
  shuffle at all);
* flat ``(conv_id, turn, role, text)`` - one row per message.  Ranking the
  kept assistant messages inside a conversation uses a blocked row number:
  turns are cut into blocks of ``block_turns`` so a conversation with a huge
  number of turns is ranked by many tasks.  The first user message (the
  prompt) comes out of the same per-(conversation, block) aggregation, so the
  flat path costs one aggregation plus one co-partitioned join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import defaults as D
from ..functions.text import strip

RESPONSE_COLUMNS = ["source_split", "source_row", "response_index", "prompt_id", "prompt", "assistant_output"]


def message_content(content: Column) -> Column:
    """Content coerced to a string.  A null content becomes ``"None"``,
    which is what ``str(None)`` gives in the reference for a null parquet
    field; a missing message list yields no rows at all."""
    return F.coalesce(content.cast("string"), F.lit("None"))


def responses_from_nested(df: DataFrame, source_split: Column | str, row_col: str = "source_row") -> DataFrame:
    """T4/T5 for nested conversations: one row per non-blank assistant message."""
    split_c = F.lit(source_split) if isinstance(source_split, str) else source_split
    msgs = F.coalesce(F.col("messages"), F.array())
    users = F.filter(msgs, lambda m: m["role"] == "user")
    prompt = F.when(F.size(users) > 0, message_content(users[0]["content"])).otherwise(F.lit(""))
    kept = F.filter(
        F.transform(F.filter(msgs, lambda m: m["role"] == "assistant"), lambda m: strip(message_content(m["content"]))),
        lambda t: t != "",
    )
    return df.select(
        split_c.alias("source_split"),
        F.col(row_col).alias("source_row"),
        F.col("prompt_id"),
        prompt.alias("prompt"),
        F.posexplode(kept).alias("response_index", "assistant_output"),
    ).select(*RESPONSE_COLUMNS)


def responses_from_flat(
    conversations: DataFrame,
    split: Column | str | None = None,
    block_turns: int = 4096,
) -> DataFrame:
    """T4/T5 for flat ``(conv_id, turn, role, text)`` rows.

    ``source_row`` is the conversation id, ``prompt_id`` its string form;
    ``split`` is a column expression over ``conv_id`` (see
    :func:`tagwright.operators.split.split_assignment`) or a constant.
    """
    blk = F.floor(F.col("turn") / F.lit(block_turns)).cast("long")
    msgs = conversations.select("conv_id", "turn", "role", message_content(F.col("text")).alias("content")).withColumn(
        "__blk", blk
    )
    assistant = (
        msgs.where(F.col("role") == "assistant")
        .withColumn("assistant_output", strip("content"))
        .where(F.col("assistant_output") != "")
    )
    per_block = msgs.groupBy("conv_id", "__blk").agg(
        F.count_if((F.col("role") == "assistant") & (strip("content") != "")).alias("__n"),
        F.min_by(F.col("content"), F.when(F.col("role") == "user", F.col("turn"))).alias("__first_user"),
        F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("__first_user_turn"),
    )
    conv = Window.partitionBy("conv_id")
    before = conv.orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.select(
        "conv_id",
        "__blk",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
        F.coalesce(
            F.min_by("__first_user", "__first_user_turn").over(conv), F.lit("")
        ).alias("prompt"),
    )
    local = assistant.withColumn(
        "__lrn", F.row_number().over(Window.partitionBy("conv_id", "__blk").orderBy("turn"))
    )
    out = local.join(per_block, ["conv_id", "__blk"])
    if split is None:
        split_c = F.lit("train")
    elif isinstance(split, str):
        split_c = F.lit(split)
    else:
        split_c = split
    return out.select(
        split_c.alias("source_split"),
        F.col("conv_id").alias("source_row"),
        (F.col("__off") + F.col("__lrn") - 1).cast("long").alias("response_index"),
        F.col("conv_id").cast("string").alias("prompt_id"),
        "prompt",
        "assistant_output",
    )


def responses_nonempty(df: DataFrame) -> bool:
    """Empty-split guard (raises on an empty frame)."""
    if df.isEmpty():
        raise ValueError("no assistant outputs found")
    return True


def preview_180(text: str | Column = "assistant_output") -> Column:
    """First 180 characters (prediction preview)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.substring(c, 1, D.PREVIEW_CHARS)


def preview_300_oneline(text: str | Column = "assistant_output") -> Column:
    """First 300 characters with newlines turned into spaces."""
    c = F.col(text) if isinstance(text, str) else text
    return F.replace(F.substring(c, 1, D.DISAGREEMENT_PREVIEW_CHARS), F.lit("\n"), F.lit(" "))


def sample_text(text: str | Column, sample_chars: int = D.SAMPLE_CHARS) -> Column:
    """Cut at ``sample_chars``, right-strip, append ``...`` only when cut."""
    c = F.col(text) if isinstance(text, str) else text
    cut = F.regexp_replace(F.substring(c, 1, sample_chars), r"[\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]+$", "")
    return F.when(F.length(c) > sample_chars, F.concat(cut, F.lit("..."))).otherwise(c)
