"""A first training: a few lines of text, a small vocabulary, a file, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import pretokenize as pt
from ..operators.train import TrainerOptions, train_on
from .tokenizer import Tokenizer

LINES = (
    "rain on the roof and rain on the road",
    "the river runs past the mill and under the old bridge",
    "a miller, a baker and a rider met under the bridge",
    "the rider said: it rains, it rained, and it will rain again",
    "and the baker said that bread is better than rain",
)
OPTIONS = TrainerOptions(vocab_size=80, min_frequency=1, special_tokens=("<unk>", "<pad>"))


def train_demo(spark: SparkSession, path: str, options: TrainerOptions = OPTIONS) -> tuple[Tokenizer, DataFrame]:
    """Train on LINES, write the tokenizer to path, read it again: (tokenizer, lines with encoding and decoded)."""
    lines = spark.createDataFrame([(t,) for t in LINES], "text string")
    splitter = pt.ByteLevel(add_prefix_space=False, trim_offsets=False)
    Tokenizer(train_on(lines, "text", options, splitter), None, splitter).to_file(spark, path)
    tokenizer = Tokenizer.from_file(spark, path)
    encoded = tokenizer.encode(lines).selectExpr("text", "encoding.ids AS ids", "encoding.tokens AS tokens")
    return tokenizer, tokenizer.decode(encoded, "ids")


if __name__ == "__main__":
    import sys

    session = SparkSession.builder.getOrCreate()
    made, shown = train_demo(session, sys.argv[1] if len(sys.argv) > 1 else "demo-tokenizer.json")
    print(f"{made.model.vocab_size} tokens, {len(made.model.merges)} merges")
    shown.show(truncate=False)
