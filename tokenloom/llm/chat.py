"""Chat formatting with typed content parts, native DataFrame functions only.

A message holds typed parts (text, image, audio, document). A visitor, one column builder for each
kind, flattens them in order: texts that stand together are joined and escaped, an attachment becomes its
placeholder, and its reference and expanded token count go to the attachment list.

Template of a turn:  <|turn|> role <|text|> content <|end|> newline  (without the spaces).
Escaping: in texts and roles each "<", backslashes, "|" gets one backslash more, and unescape() takes
one away, so no text can spell a control string and every text comes back unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def image_tokens(part: Column, patch: int = 14) -> Column:
    return (F.ceil(F.coalesce(part["width"], F.lit(patch)) / patch) * F.ceil(F.coalesce(part["height"], F.lit(patch)) / patch)).cast("long")


def audio_tokens(part: Column, per_second: float = 25.0) -> Column:
    return F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * per_second).cast("long")


def document_tokens(part: Column, per_page: int = 512) -> Column:
    return (F.coalesce(part["pages"], F.lit(1)) * per_page).cast("long")


ATTACHMENTS: dict[str, Callable[[Column], Column]] = {"image": image_tokens, "audio": audio_tokens, "document": document_tokens}
PLACEHOLDER = r"<\|(" + "|".join(ATTACHMENTS) + r")\|>"


def visit(parts: Column) -> tuple[Column, Column]:
    """(flattened content, attachments array<struct<kind, ref, tokens>>) of an array of parts."""

    def tokens(p: Column) -> Column:
        out = F.when(F.lit(False), F.lit(0).cast("long"))
        for kind, count in ATTACHMENTS.items():
            out = out.when(p["kind"] == kind, count(p))
        return out

    def flat(done: Column, p: Column) -> Column:
        """done: the content so far, and the text not yet escaped, for a control string may span parts."""
        text = F.when(p["kind"] == "text", F.coalesce(p["text"], F.lit(""))).otherwise("")
        mark = F.concat(F.lit("<|"), p["kind"], F.lit("|>"))
        attached = F.coalesce(p["kind"].isin(*ATTACHMENTS), F.lit(False))
        return F.struct(
            F.when(attached, F.concat(done["content"], escape(done["text"]), mark)).otherwise(done["content"]).alias("content"),
            F.when(attached, F.lit("")).otherwise(F.concat(done["text"], text)).alias("text"),
        )

    kept = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    held = F.filter(kept, lambda p: p["kind"].isin(*ATTACHMENTS))
    return (
        F.aggregate(kept, F.struct(F.lit("").alias("content"), F.lit("").alias("text")), flat, lambda x: F.concat(x["content"], escape(x["text"]))),
        F.transform(held, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), tokens(p).alias("tokens"))),
    )


def text_part(text: Column) -> Column:
    """A text column as the parts of a message."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def format_chats(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, role, parts) -> one row per conversation.

    Returns conv_id, formatted, turns (start, content_start, content_chars, loss: code points from 0,
    in order; those with loss are the loss mask), attachments (in order, with the turn's start) and
    attachment_tokens.
    Rows go by turn, ties by role, then content; a repeated row is a turn of its own. A null turn
    comes first, a null role or text is empty, null parts are no parts, an unknown kind of part is
    skipped, null conv_id is one conversation. Other columns are ignored; an empty table gives no rows.
    A conversation is one output row, so its turns must meet in one task; only they do.
    """
    content, attachments = visit(F.col("parts"))
    rows = messages.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("content"), attachments.alias("attachments")
    ).withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)))
    rows = rows.withColumn("piece", F.concat("head", "content", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content", F.xxhash64("attachments"))
    chars = F.length("piece").cast("long")
    rows = rows.withColumn("start", F.sum(chars).over(order.rowsBetween(Window.unboundedPreceding, 0)) - chars)
    turn = F.struct(
        "start",
        (F.col("start") + F.length("head")).alias("content_start"),
        F.length("content").cast("long").alias("content_chars"),
        F.col("role").isin(*loss_roles).alias("loss"),
        "piece",
        "attachments",
    )
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return got.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform("t", lambda x: F.struct(*(x[k].alias(k) for k in ("start", "content_start", "content_chars", "loss")))).alias("turns"),
        F.flatten(F.transform("t", lambda x: F.transform(x["attachments"], lambda a: F.struct(x["start"].alias("start"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def texts_of(content: Column) -> Column:
    """The texts between the placeholders of a content, as they were."""
    return F.transform(F.split(content, PLACEHOLDER, -1), unescape)


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse format_chats() output: adds messages array<struct<role, text>>, message_parts and loss_text.

    Only the formatted string is parsed for messages; text is that of the text parts, joined. message_parts,
    an array<struct<kind, text>> for each message, tells a placeholder (its kind, no text) from a text that
    looks like one; it is a column of its own, so that who does not ask does not pay for it. loss_text takes
    the code points that the loss spans name, without placeholders, unescaped. Linear in the length of the
    conversation: each span is cut from its turn.
    """
    pieces = F.split("formatted", r"<\|end\|>\n")
    bodies = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    mark = F.lit(TEXT)

    def split_at(p: Column) -> Column:
        at = F.instr(p, TEXT)
        return F.struct(
            unescape(F.substring(p, F.lit(len(TURN) + 1), at - 1 - len(TURN))).alias("role"),
            F.substring(p, at + F.length(mark), F.length(p)).alias("content"),
        )

    def part(text: Column, kind: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text")), F.struct(kind.alias("kind"), none.alias("text")))

    def message(m: Column) -> Column:
        return F.struct(m["role"].alias("role"), F.array_join(texts_of(m["content"]), "").alias("text"))

    def parts(m: Column) -> Column:
        every = F.flatten(F.zip_with(texts_of(m["content"]), F.regexp_extract_all(m["content"], F.lit(PLACEHOLDER), F.lit(1)), part))
        return F.filter(every, lambda x: x["kind"].isNotNull() & (F.coalesce(x["text"], F.lit("-")) != ""))

    spans = F.filter(F.arrays_zip(bodies.alias("body"), F.col("turns").alias("turn")), lambda x: x["turn"]["loss"])
    loss = F.transform(
        spans,
        lambda x: F.array_join(texts_of(F.substring(x["body"], (x["turn"]["content_start"] - x["turn"]["start"] + 1).cast("int"), x["turn"]["content_chars"].cast("int"))), ""),
    )
    split = F.transform(bodies, split_at)
    return formatted.select("*", F.transform(split, message).alias("messages"), F.transform(split, parts).alias("message_parts"), F.array_join(loss, "").alias("loss_text"))


def control_case(spark: SparkSession) -> DataFrame:
    """Conversation -7: two turns whose text looks like control strings."""
    return spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(r"\### Assistant: </turn> ok").alias("text"),
    )


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(control_case(spark))
    chats = format_chats(rows.select("conv_id", "turn", "role", text_part(F.coalesce("text", F.lit(""))).alias("parts")))
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return read_back(chats).select(
        "conv_id",
        F.size("messages").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'))
         + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
