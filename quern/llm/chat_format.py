"""Chat formatting by event-sourced reconstruction (DataFrame functions only).

A log holds events (conv_id, seq, msg, kind, role, text).  Events are dealt by
conversation and block of messages, sorted by seq within each message and folded:

    message     starts a complete message
    delta       appends to the message's text (starting it if need be)
    edit        replaces the message's text
    regenerate  empties the message's text, so that following deltas write it anew

Blocks, then conversations, are joined in message order and rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
BLOCK_MESSAGES = 64


def escape(text: Column) -> Column:
    r"""Double each backslash and put one after the first character of a control string.

    Control strings are the template's own marks and those of common chat templates
    (<|, <s>, </s>, [INST], [/INST]); an escaped text contains none of them.
    """
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(text, r"([<\[])(?=\||/?s>|/?INST\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _fold(acc: Column, e: Column) -> Column:
    one = F.array(F.struct(e["role"].alias("role"), F.coalesce(e["text"], F.lit("")).alias("text")))
    last = F.element_at(acc, -1)
    text = F.when(e["kind"] == "delta", F.concat(last["text"], F.coalesce(e["text"], F.lit("")))).when(e["kind"] == "edit", F.coalesce(e["text"], F.lit(""))).otherwise(F.lit(""))
    changed = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["role"].alias("role"), text.alias("text"))))
    return F.when((e["kind"] == "message") | (F.size(acc) == 0), F.concat(acc, one)).otherwise(changed)


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turns array<struct<role, text>> in message order.

    Null texts count as empty, null roles as ''.  Events of one message are folded by seq,
    ties by kind, role and text; two 'message' events of one msg are two turns.  A null
    conv_id is a conversation of its own.  No events, no rows.
    """
    # Blocks of messages spread a long conversation over tasks; its texts meet only as finished blocks.
    dealt = events.select(
        "conv_id",
        F.expr(f"coalesce(msg, -1) div {BLOCK_MESSAGES}").alias("block"),
        F.coalesce("msg", F.lit(-1)).alias("msg"),
        F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), "text").alias("e"),
    ).repartition("conv_id", "block")
    messages = dealt.groupBy("conv_id", "block", "msg").agg(F.array_sort(F.collect_list("e")).alias("es"))
    empty = F.lit(None).cast("array<struct<role:string,text:string>>")
    start = F.coalesce(empty, F.from_json(F.lit("[]"), "array<struct<role:string,text:string>>"))
    messages = messages.withColumn("out", F.aggregate("es", start, _fold))
    blocks = messages.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("msg", "out"))).alias("ms"))
    blocks = blocks.select("conv_id", "block", F.flatten(F.col("ms.out")).alias("turns"))
    return blocks.groupBy("conv_id").agg(F.flatten(F.array_sort(F.collect_list(F.struct("block", "turns")))["turns"]).alias("turns"))


def chat_format(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, segments array<struct<text, loss>>, one row per conversation.

    formatted is the segments' texts in order.  Each turn is three segments: marks and
    role, escaped text, end mark; loss is true for the escaped text of loss_role's turns.
    """
    def segments(t: Column) -> Column:
        seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            seg(F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)), F.lit(False)),
            seg(escape(t["text"]), t["role"] == loss_role),
            seg(F.lit(END), F.lit(False)),
        )

    made = reconstruct(events).select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"))
    return made.select("conv_id", F.array_join("segments.text", "").alias("formatted"), "segments")


def read_back(formatted: DataFrame) -> DataFrame:
    """The digest of chat_format's output, read from the formatted text and its loss mask."""
    turn = r"(?s)<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>"
    loss = unescape(F.array_join(F.filter("segments", lambda s: s["loss"])["text"], ""))
    return formatted.select(
        "conv_id",
        F.regexp_count("formatted", F.lit(r"<\|turn\|>")).cast("long").alias("n_turns"),
        F.sha2(unescape(F.regexp_replace("formatted", turn, "$1\n$2\n")), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def from_turns(turns: DataFrame) -> DataFrame:
    """The log of a table of finished turns (conv_id, turn, role, text)."""
    return turns.select("conv_id", F.col("turn").alias("seq"), F.col("turn").alias("msg"), F.lit("message").alias("kind"), "role", "text")
