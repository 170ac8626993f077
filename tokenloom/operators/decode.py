"""Ids back to text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytechars import chars_to_bytes, chars_to_text, unmap_chars
from .model import Bpe

#: Vocabularies up to this size are looked up in a literal, larger ones by a broadcast.
MAP_LIMIT = 2_000
#: Ids below this are places in an array literal, found at once; a map literal is searched from its start for each id.
DENSE = 4 * MAP_LIMIT


def looked_up(ids: Column, texts: dict[int, str]) -> Column:
    """An array with the text of each id, null where there is none."""
    if texts and 0 <= min(texts) and max(texts) < DENSE:
        table = F.array(*(F.lit(texts.get(i)).cast("string") for i in range(max(texts) + 1)))
        return F.transform(ids, lambda i: F.get(table, i.cast("int")))
    table = F.create_map(*(F.lit(x) for i, t in sorted(texts.items()) for x in (i, t))) if texts else F.create_map().cast("map<int,string>")
    return F.transform(ids, lambda i: F.try_element_at(table, i.cast("int")))


def tokens_of(df: DataFrame, ids: str, model: Bpe, key: str | None = None, out: str = "tokens") -> DataFrame:
    """df with the tokens of an array of ids; ids that the vocabulary lacks are skipped.

    Small vocabularies are a literal, larger ones a broadcast Arrow look-up; neither shuffles.
    """
    if model.vocab_size <= MAP_LIMIT:
        return df.withColumn(out, F.filter(looked_up(F.col(ids), model.tokens), lambda t: t.isNotNull()))
    sent = df.sparkSession.sparkContext.broadcast(model.tokens)

    @F.pandas_udf("array<string>")
    def look_up(rows: pd.Series) -> pd.Series:
        get = sent.value.get
        return rows.map(lambda r: [t for i in r if (t := get(i)) is not None], na_action="ignore")

    return df.withColumn(out, look_up(F.col(ids)))


def without_special(tokens: Column) -> Column:
    """Tokens that do not look like <...>; byte tokens look like that, too."""
    return F.filter(tokens, lambda t: ~(F.startswith(t, F.lit("<")) & F.endswith(t, F.lit(">"))))


def decode_bytes(tokens: Column, skip_special: bool = True) -> Column:
    """BINARY of tokens of a byte-level vocabulary: joined first, so that split characters recombine."""
    return chars_to_bytes(F.array_join(without_special(tokens) if skip_special else tokens, ""))


def decode_text(tokens: Column, skip_special: bool = True) -> Column:
    return F.make_valid_utf8(decode_bytes(tokens, skip_special).cast("string"))


def decode(df: DataFrame, ids: str, model: Bpe, skip_special: bool = True, out: str = "decoded") -> DataFrame:
    if model.vocab_size <= MAP_LIMIT:
        # a token stands for the same bytes wherever it is: told as Latin-1, they are joined and need no look-up by character
        raw = {i: unmap_chars(t).decode("latin-1") for i, t in model.tokens.items() if not (skip_special and t.startswith("<") and t.endswith(">"))}
        joined = F.array_join(looked_up(F.col(ids), raw), "")  # ids without a text are left out
        return df.withColumn(out, F.make_valid_utf8(F.encode(joined, "ISO-8859-1").cast("string")))
    tokens = tokens_of(df, ids, model, out="_tokens")
    # joined in a column of its own: what follows names it more than once
    joined = tokens.withColumn("_joined", F.array_join(without_special(F.col("_tokens")) if skip_special else F.col("_tokens"), ""))
    return joined.withColumn(out, chars_to_text(F.col("_joined"))).drop("_tokens", "_joined")
