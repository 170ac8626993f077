"""A whole tokenizer as one logical plan: normalize, split, encode, post-process, cut, pad; and back."""

from __future__ import annotations

import json
from collections.abc import Callable, Collection
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..operators import decode as dc
from ..operators import postprocess as pp
from ..operators.encode import encode_text
from ..operators.model import Bpe
from ..operators.pretokenize import ByteLevel
from ..sources import files


@dataclass(frozen=True)
class Tokenizer:
    """Immutable; with_(...) gives a changed one.

    Parts can be one's own: a normalizer needs apply and cut, a pre-tokenizer takes and gives an array of
    pieces and has mapped, a post-processor is a ByteLevel (trims offsets) or takes and gives an
    encoding column, a decoder is "ByteLevel" or takes a column of tokens. compat_offsets counts an added
    prefix space as a byte, as some files' offsets do.
    """

    model: Bpe | None = None
    normalizer: nz.Normalizer | None = None
    pre_tokenizer: Any = None
    post_processor: ByteLevel | Callable[[Column], Column] | None = None
    decoder: str | Callable[[Column], Column] | None = "ByteLevel"
    truncation: pp.Truncation | None = None
    padding: pp.Padding | None = None
    compat_offsets: bool = False

    def with_(self, **changes) -> "Tokenizer":
        return replace(self, **changes)

    def encode(self, df: DataFrame, text: str = "text", out: str = "encoding", add_special_tokens: bool = True, batch: str | None = None, seed: Column | None = None, fields: Collection[str] = pp.FIELDS) -> DataFrame:
        """df with an encoding struct (postprocess.FIELDS, or those of them that are named); null texts count as empty.

        add_special_tokens is accepted and without effect. Padding, if set, is to the frame's or the
        batch column's longest row unless it names a length.
        """
        if not fields or set(fields) - set(pp.FIELDS):
            raise ValueError(f"fields are some of {', '.join(pp.FIELDS)}")
        raw = F.coalesce(F.col(text), F.lit(""))
        if set(fields) <= {"ids", "tokens"} and self.model is not None and not (self.truncation or self.padding) and (self.post_processor is None or isinstance(self.post_processor, ByteLevel)):
            # post-processors of this kind and normalizers' cuts change offsets alone
            return encode_text(df, self.normalizer(raw) if self.normalizer else raw, self.model, self.pre_tokenizer, out, seed, fields=fields)
        if self.model is None:
            empty = F.struct(*(F.array().cast(f"array<{t}>").alias(k) for k, t in (("ids", "int"), ("tokens", "string"), ("starts", "int"), ("ends", "int"))))
            e = empty
        else:
            plain = self.normalizer(raw) if self.normalizer else raw
            df = encode_text(df, plain, self.model, self.pre_tokenizer, "_e", seed, self.compat_offsets)
            e = F.col("_e")
            if isinstance(self.post_processor, ByteLevel):
                if self.post_processor.trim_offsets:
                    df = pp.trim_offsets(df, "_e", self.post_processor.add_prefix_space)
            elif self.post_processor is not None:
                df = df.withColumn("_e", self.post_processor(e))
            if self.normalizer:
                df = df.withColumn("_e", pp.shifted(F.col("_e"), self.normalizer.cut(raw)))
        e = pp.with_masks(e)
        if self.truncation:
            e = pp.truncate(e, self.truncation)
        df = df.withColumn(out, e).drop("_e")
        df = pp.pad(df, out, self.padding, batch) if self.padding else df
        return df if set(fields) == set(pp.FIELDS) else df.withColumn(out, F.struct(*(F.col(out)[f].alias(f) for f in pp.FIELDS if f in fields)))

    def decode(self, df: DataFrame, ids: str, out: str = "decoded", skip_special_tokens: bool = True) -> DataFrame:
        """df with the text of an array of ids; empty without model or decoder."""
        if self.model is None or self.decoder is None:
            return df.withColumn(out, F.lit(""))
        if callable(self.decoder):
            tokens = dc.tokens_of(df, ids, self.model, out="_tokens")
            kept = dc.without_special(F.col("_tokens")) if skip_special_tokens else F.col("_tokens")
            return tokens.withColumn(out, self.decoder(kept)).drop("_tokens")
        return dc.decode(df, ids, self.model, skip_special_tokens, out)

    @staticmethod
    def from_file(spark: SparkSession, path: str) -> "Tokenizer":
        d = files._parsed(files.read_text(spark, path), path)
        if not isinstance(d, dict):
            raise files.FileProblem(f"{path} is not an object")
        decoder = d.get("decoder")
        post = d.get("post_processor")
        return Tokenizer(
            files.parse_model(d.get("model") or {}),
            files.parse_normalizer(d.get("normalizer")),
            files.parse_pre_tokenizer(d.get("pre_tokenizer")),
            files.parse_byte_level(post) if files._get(post, "type", str) == "ByteLevel" else None,
            "ByteLevel" if decoder is None or files._get(decoder, "type", str) == "ByteLevel" else None,
        )

    def to_json(self) -> str:
        return json.dumps(
            {
                "version": "1.0",
                "truncation": None,
                "padding": None,
                "added_tokens": [],
                "normalizer": files.normalizer_json(self.normalizer),
                "pre_tokenizer": files.pre_tokenizer_json(self.pre_tokenizer),
                "post_processor": files.pre_tokenizer_json(self.post_processor),
                "decoder": {"type": self.decoder} if isinstance(self.decoder, str) else None,
                "model": files.model_json(self.model) if self.model else None,
            },
            ensure_ascii=False,
            indent=2,
        )

    def to_file(self, spark: SparkSession, path: str) -> None:
        files.write_text(spark, path, self.to_json())

    def to_vocab_merges(self, spark: SparkSession, folder: str) -> None:
        if self.model is None:
            raise ValueError("there is no model to write")
        files.write_vocab_merges(spark, folder, self.model)
