"""Streams: word counts that go on growing, and encoding of rows as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.pretokenize import kept_texts, pieces_of


def stream_word_counts(stream: DataFrame, text: str = "text", pre_tokenizer=None, time: str | None = None, window: str | None = None, late: str | None = None) -> DataFrame:
    """(word, n) of a stream, cumulative as repeated feeds are; with time and window per window.

    With late, rows later than that are left out and finished windows can be appended to a sink.
    """
    if time and late:
        stream = stream.withWatermark(time, late)
    keys = ["word"]
    rows = stream.filter(F.col(text).isNotNull())
    word = F.explode(kept_texts(pieces_of(F.col(text), pre_tokenizer))).alias("word")
    if time and window:
        rows = rows.select(F.window(time, window).alias("window"), word)
        keys = ["window", "word"]
    else:
        rows = rows.select(word)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def stream_encode(stream: DataFrame, tokenizer, text: str = "text", out: str = "encoding") -> DataFrame:
    """Stateless: the batch plan on a stream. Padding needs a whole batch and must name a length."""
    if tokenizer.padding and tokenizer.padding.max_length is None:
        raise ValueError("a stream has no longest row; give the padding a length")
    return tokenizer.encode(stream, text, out)
