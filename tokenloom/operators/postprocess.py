"""What follows the model: trimmed offsets, masks, truncation, padding. Native array expressions.

An encoding is a struct of ids, tokens, starts, ends; with_masks() adds type_ids, attention_mask and
special_tokens_mask.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what counts as white space at a token's ends, the mapped space included.
SPACES = "".join(map(chr, [0x120, *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
FIELDS = ("ids", "tokens", "starts", "ends", "type_ids", "attention_mask", "special_tokens_mask")


@dataclass(frozen=True)
class Truncation:
    """stride is accepted and, as in the tokenizer this agrees with, without effect."""

    max_length: int | None = None
    stride: int | None = None
    direction_from_end: bool = False


@dataclass(frozen=True)
class Padding:
    max_length: int | None = None
    pad_id: int = 0
    pad_token: str = "<pad>"
    pad_type_id: int = 0


def rebuilt(e: Column, **new: Column) -> Column:
    return F.struct(*((new[k] if k in new else e[k]).alias(k) for k in FIELDS))


def trim_offsets(df: DataFrame, column: str, add_prefix_space: bool) -> DataFrame:
    """An encoding column's offsets without the white space at tokens' ends. One leading space of the first token stays if a
    prefix space is added."""
    e = F.col(column)
    ends = F.transform(e["tokens"], lambda t: F.struct(F.length(F.regexp_extract(t, f"^[{SPACES}]*", 0)).alias("lead"), F.length(t).alias("n"), F.length(F.regexp_extract(t, f"[{SPACES}]*$", 0)).alias("trail")))
    rows = F.arrays_zip(ends.alias("x"), e["starts"].alias("s"), e["ends"].alias("e"))

    def one(r: Column, i: Column) -> Column:
        lead, trail = r["x"]["lead"], F.least(r["x"]["trail"], r["x"]["n"] - r["x"]["lead"])
        lead = F.when((i == 0) & (lead == 1) & F.lit(add_prefix_space), 0).otherwise(lead)
        start = F.least(r["s"] + lead, r["e"])
        return F.struct(start.alias("s"), F.greatest(r["e"] - trail, start).alias("e"))

    # a column of its own, used twice: worked out once
    df = df.withColumn("_spans", F.transform(rows, one))
    new = F.struct(e["ids"].alias("ids"), e["tokens"].alias("tokens"), F.transform("_spans", lambda x: x["s"]).alias("starts"), F.transform("_spans", lambda x: x["e"]).alias("ends"))
    return df.withColumn(column, new).drop("_spans")


def shifted(e: Column, shift: Column) -> Column:
    """Offsets moved from the normalized to the original text (what was cut from its front)."""
    move = lambda c: F.transform(c, lambda x: (x + shift).cast("int"))
    return F.struct(e["ids"].alias("ids"), e["tokens"].alias("tokens"), move(e["starts"]).alias("starts"), move(e["ends"]).alias("ends"))


def with_masks(e: Column) -> Column:
    fill = lambda v: F.array_repeat(F.lit(v), F.size(e["ids"]))
    return F.struct(*(e[k].alias(k) for k in FIELDS[:4]), fill(0).alias("type_ids"), fill(1).alias("attention_mask"), fill(0).alias("special_tokens_mask"))


def truncate(e: Column, t: Truncation) -> Column:
    """The first max_length tokens, or the last."""
    if t.max_length is None:
        return e
    n = F.size(e["ids"])
    first = F.greatest(n - t.max_length, F.lit(0)) + 1 if t.direction_from_end else F.lit(1)
    return rebuilt(e, **{k: F.slice(e[k], first, F.lit(t.max_length)) for k in FIELDS})


def pad(df: DataFrame, column: str, p: Padding, batch: str | None = None) -> DataFrame:
    """Right padding to max_length, or to the longest row of the batch (a key column, else the frame).

    Longer rows stay. The longest row is one aggregate row per batch, joined back by broadcast or, with a
    batch column, by key.
    """
    e = F.col(column)
    size = F.size(e["ids"])
    if p.max_length is not None:
        target = F.lit(p.max_length)
    elif batch is None:
        df = df.crossJoin(F.broadcast(df.agg(F.max(size).alias("_longest"))))  # one row
        target = F.col("_longest")
    else:
        longest = df.groupBy(F.col(batch).alias("_batch")).agg(F.max(size).alias("_longest"))
        df = df.join(longest, F.col(batch).eqNullSafe(F.col("_batch"))).drop("_batch")
        target = F.col("_longest")
    more = F.greatest(target - size, F.lit(0))
    fill = {"ids": p.pad_id, "tokens": p.pad_token, "starts": 0, "ends": 0, "type_ids": p.pad_type_id, "attention_mask": 0, "special_tokens_mask": 0}
    return df.withColumn(column, rebuilt(e, **{k: F.concat(e[k], F.array_repeat(F.lit(v), more)) for k, v in fill.items()})).drop("_longest")
