"""Vocabulary, merges and tokenizer files, read and written through Spark's file systems."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..operators import pretokenize as pt
from ..operators.model import Bpe, Options


class FileProblem(ValueError):
    """A file that is missing or does not hold what it should."""


def read_text(spark: SparkSession, path: str) -> str:
    """A whole file as text; these files are a few MB."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        raise FileProblem(f"{path} is not there")
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0]["value"] if rows else ""


def write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def _parsed(text: str, path: str) -> Any:
    def first_wins(pairs):
        out = {}
        for k, v in pairs:
            out.setdefault(k, v)
        return out

    try:
        return json.loads(text, object_pairs_hook=first_wins)
    except ValueError as e:
        raise FileProblem(f"{path} is not JSON: {e}") from e


def read_vocab(spark: SparkSession, path: str) -> dict[str, int]:
    """A JSON object of token to id; of a repeated token the first id holds."""
    got = _parsed(read_text(spark, path), path)
    if not isinstance(got, dict) or not all(isinstance(v, int) and not isinstance(v, bool) for v in got.values()):
        raise FileProblem(f"{path} is not an object of integers")
    return got


def merge_lines(text: DataFrame) -> DataFrame:
    """(rank, a, b) from whole files in a column value: native, in file order.

    Empty lines, lines that start with "#" and lines without a space are skipped; a line is split at its
    first space; a return at its end is dropped.
    """
    from pyspark.sql import Window

    lines = text.select(F.posexplode(F.split("value", "\n")).alias("at", "line"))
    lines = lines.select("at", F.regexp_replace("line", r"\r$", "").alias("line")).filter("line <> '' AND NOT startswith(line, '#') AND contains(line, ' ')")
    rank = F.row_number().over(Window.orderBy("at")) - 1  # one file of a few MB
    return lines.select(rank.alias("rank"), F.regexp_extract("line", r"(?s)^([^ ]*) (.*)$", 1).alias("a"), F.regexp_extract("line", r"(?s)^([^ ]*) (.*)$", 2).alias("b"))


def read_merges(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    read_text(spark, path)
    return [(r["a"], r["b"]) for r in merge_lines(spark.read.text(path, wholetext=True)).orderBy("rank").collect()]


def from_files(spark: SparkSession, vocab: str, merges: str, options: Options | None = None) -> Bpe:
    return Bpe(read_vocab(spark, vocab), tuple(read_merges(spark, merges)), options or Options())


def _get(d: Any, key: str, kind, default=None):
    v = d.get(key) if isinstance(d, dict) else None
    return v if isinstance(v, kind) and not (kind is int and isinstance(v, bool)) else default


def _merge_pairs(listed: list) -> list[tuple[str, str]]:
    out = []
    for m in listed:
        parts = m if isinstance(m, list) else [x for x in m.split(" ") if x] if isinstance(m, str) else []
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


def parse_model(d: Any) -> Bpe:
    kind = _get(d, "type", str, "BPE")
    if kind != "BPE":
        raise FileProblem(f"model type {kind} is not supported")
    options = Options(
        unk_token=_get(d, "unk_token", str),
        continuing_subword_prefix=_get(d, "continuing_subword_prefix", str),
        end_of_word_suffix=_get(d, "end_of_word_suffix", str),
        fuse_unk=_get(d, "fuse_unk", bool, False),
        byte_fallback=_get(d, "byte_fallback", bool, False),
        ignore_merges=_get(d, "ignore_merges", bool, False),
        dropout=_get(d, "dropout", (int, float)),
    )
    return Bpe(dict(_get(d, "vocab", dict, {})), tuple(_merge_pairs(_get(d, "merges", list, []))), options)


def parse_normalizer(d: Any) -> nz.Normalizer | None:
    if not isinstance(d, dict):
        return None
    if _get(d, "type", str) == "Sequence":
        return nz.sequence(*(parse_normalizer(x) for x in _get(d, "normalizers", list, [])))
    return nz.make(_get(d, "type", str, ""))


def parse_split(d: Any) -> pt.Split | None:
    p = _get(d, "pattern", dict, {})
    text = _get(p, "Regex", str) or _get(p, "String", str)
    if not text:
        return None
    behavior = _get(d, "behavior", str, "Isolated")
    return pt.Split(text, bool(_get(p, "Regex", str)), behavior if behavior in pt.BEHAVIORS else "Isolated", _get(d, "invert", bool, False))


def parse_byte_level(d: Any) -> pt.ByteLevel:
    return pt.ByteLevel(_get(d, "add_prefix_space", bool, True), _get(d, "trim_offsets", bool, True), _get(d, "use_regex", bool, True))


def parse_pre_tokenizer(d: Any):
    """ByteLevel, Split or Sequence; other kinds give none. A sequence of which nothing is known is ByteLevel."""
    kind = _get(d, "type", str)
    if kind == "ByteLevel":
        return parse_byte_level(d)
    if kind == "Split":
        return parse_split(d)
    if kind == "Sequence":
        known = [x for c in _get(d, "pretokenizers", list, []) if (x := parse_pre_tokenizer(c) if _get(c, "type", str) in ("ByteLevel", "Split") else None)]
        return pt.Sequence(tuple(known)) if known else pt.ByteLevel()
    return None


def normalizer_json(n: nz.Normalizer | None) -> Any:
    if n is None:
        return None
    return {"type": "Sequence", "normalizers": [normalizer_json(s) for s in n.steps]} if n.kind == "Sequence" else {"type": n.kind}


def pre_tokenizer_json(p: Any) -> Any:
    if isinstance(p, pt.ByteLevel):
        return {"type": "ByteLevel", "add_prefix_space": p.add_prefix_space, "trim_offsets": p.trim_offsets, "use_regex": p.use_regex}
    if isinstance(p, pt.Split):
        return {"type": "Split", "pattern": {"Regex" if p.is_regex else "String": p.pattern}, "behavior": p.behavior, "invert": p.invert}
    if isinstance(p, pt.Sequence):
        return {"type": "Sequence", "pretokenizers": [pre_tokenizer_json(s) for s in p.steps if s is not None]}
    return None


def model_json(m: Bpe) -> dict:
    o = m.options
    return {"type": "BPE", "dropout": o.dropout, "unk_token": o.unk_token, "continuing_subword_prefix": o.continuing_subword_prefix, "end_of_word_suffix": o.end_of_word_suffix, "fuse_unk": o.fuse_unk, "byte_fallback": o.byte_fallback, "ignore_merges": o.ignore_merges, "vocab": dict(sorted(m.vocab.items(), key=lambda x: x[1])), "merges": [list(x) for x in m.merges_list()]}


def write_vocab_merges(spark: SparkSession, folder: str, m: Bpe) -> None:
    """vocab.json and merges.txt, with the merges."""
    write_text(spark, f"{folder}/vocab.json", json.dumps(dict(sorted(m.vocab.items(), key=lambda x: x[1])), ensure_ascii=False))
    write_text(spark, f"{folder}/merges.txt", "#version: 0.1\n" + "".join(f"{a} {b}\n" for a, b in m.merges_list()))
