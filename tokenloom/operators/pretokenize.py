"""Pre-tokenizers: a text column becomes an array of pieces that tile it.

A piece is struct<t: string, k: boolean, p: int>: its text, whether it is kept, and how many bytes of
t were put in front and are not in the text. Removed pieces stay in the array, so byte offsets are
running sums of piece lengths. All steps are native array expressions, linear in the text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import regex_compat as rx
from ..functions.bytechars import byte_chars

PIECE = "struct<t:string,k:boolean,p:int>"
BEHAVIORS = ("Removed", "Isolated", "MergedWithPrevious", "MergedWithNext", "Contiguous")
MARK = "\x01"


def piece(t: Column, k: Column | bool = True, p: Column | int = 0) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(t.alias("t"), lit(k).alias("k"), lit(p).cast("int").alias("p"))


def whole(text: Column) -> Column:
    """No pre-tokenizer: the text is one piece."""
    return F.array(piece(text))


def _each(pieces: Column, step) -> Column:
    return F.flatten(F.transform(pieces, lambda x: F.when(x["k"], step(x["t"], x["p"])).otherwise(F.array(x))))


@dataclass(frozen=True)
class ByteLevel:
    """Splits by the byte-level pattern and writes bytes as printable characters."""

    add_prefix_space: bool = True
    trim_offsets: bool = True
    use_regex: bool = True
    mapped = True

    def __call__(self, pieces: Column, write=byte_chars) -> Column:
        """write: how the bytes of a piece are written; the identity leaves that to who encodes them."""

        def step(t: Column, p: Column) -> Column:
            put = (~F.startswith(t, F.lit(" "))) if self.add_prefix_space else F.lit(False)
            led = F.when(put, F.concat(F.lit(" "), t)).otherwise(t)
            first = p + put.cast("int")
            if not self.use_regex:
                return F.when(led == "", F.array().cast(f"array<{PIECE}>")).otherwise(F.array(piece(write(led), True, first)))
            words = F.regexp_extract_all(led, F.lit("(?U)" + rx.GPT2), F.lit(0))
            return F.transform(words, lambda w, i: piece(write(w), True, F.when(i == 0, first).otherwise(0)))

        return _each(pieces, step)


@dataclass(frozen=True)
class Split:
    """Splits at a literal or a pattern. A pattern that does not compile matches nothing."""

    pattern: str
    is_regex: bool = True
    behavior: str = "Isolated"
    invert: bool = False
    mapped = False

    @cached_property
    def java(self) -> str | None:
        p = rx.translate(self.pattern) if self.is_regex else rx.escape(self.pattern)
        return p if p and rx.usable(p) else None

    def __call__(self, pieces: Column) -> Column:
        if self.java and rx.matches_empty(self.java):
            return self._by_python(pieces)
        return _each(pieces, lambda t, p: F.when(t == "", F.array(piece(t, True, p))).otherwise(self._shaped(self._segments(t), p)))

    def _segments(self, t: Column) -> Column:
        """array<struct<t, m>>: matches and gaps in order, none empty; m is flipped by invert."""
        seg = lambda x, m: F.struct(x.alias("t"), F.lit(m != self.invert).alias("m"))
        if not self.java:
            return F.array(seg(t, False))
        gaps, hits = F.split(t, self.java, -1), F.regexp_extract_all(t, F.lit(self.java), F.lit(0))
        both = F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), hits.alias("h")), lambda x: F.array(seg(x["g"], False), seg(x["h"], True))))
        return F.filter(both, lambda x: x["t"].isNotNull() & (x["t"] != ""))

    def _shaped(self, segments: Column, p: Column) -> Column:
        first = lambda i: F.when(i == 0, p).otherwise(0)
        if self.behavior in ("Removed", "Isolated"):
            keep = (lambda m: ~m) if self.behavior == "Removed" else (lambda m: F.lit(True))
            return F.transform(segments, lambda x, i: piece(x["t"], keep(x["m"]), first(i)))
        # glued runs: each segment gets a tag that says whether a run starts, and the tags are split at
        before = F.concat(F.array(F.lit(None).cast("boolean")), F.transform(segments, lambda x: x["m"]))
        zipped = F.filter(F.arrays_zip(segments.alias("s"), before.alias("b")), lambda x: x["s"].isNotNull())

        def tagged(x: Column) -> Column:
            m, b = x["s"]["m"], x["b"]
            glue = {"MergedWithPrevious": m & ~b, "MergedWithNext": b & ~m, "Contiguous": b == m}[self.behavior]
            return F.concat(F.when(F.coalesce(glue, F.lit(False)), MARK + "+").otherwise(MARK + "="), F.replace(x["s"]["t"], F.lit(MARK), F.lit(MARK + "?")))

        runs = F.split(F.array_join(F.transform(zipped, tagged), ""), MARK + "=", -1)
        clean = lambda r: F.replace(F.replace(r, F.lit(MARK + "+"), F.lit("")), F.lit(MARK + "?"), F.lit(MARK))
        return F.transform(F.slice(runs, F.lit(2), F.size(runs)), lambda r, i: piece(clean(r), True, first(i)))

    def segments_of(self, text: str) -> list[tuple[str, bool]]:
        """The Python form, for patterns that can match the empty string; empty matches are dropped."""
        out, at = [], 0
        for m in regex.finditer(self.pattern if self.is_regex else regex.escape(self.pattern), text):
            if m.end() > m.start():
                out += [(text[at : m.start()], self.invert)] * (m.start() > at) + [(m[0], not self.invert)]
                at = m.end()
        return out + [(text[at:], self.invert)] * (at < len(text))

    def runs_of(self, text: str) -> list[tuple[str, bool]]:
        """(text, kept) of a text's pieces."""
        segments = self.segments_of(text) if text else [("", False)]
        if self.behavior == "Removed":
            return [(t, not m or not text) for t, m in segments]
        glue = {"Isolated": lambda b, m: False, "MergedWithPrevious": lambda b, m: m and not b, "MergedWithNext": lambda b, m: b and not m, "Contiguous": lambda b, m: b == m}[self.behavior]
        out: list[list[str]] = []
        last = None
        for t, m in segments:
            if last is not None and glue(last, m):
                out[-1].append(t)
            else:
                out.append([t])
            last = m
        return [("".join(x), True) for x in out]

    def _by_python(self, pieces: Column) -> Column:
        @F.pandas_udf(f"array<{PIECE}>")
        def run(batch: pd.Series) -> pd.Series:
            def one(row):
                out = []
                for x in row:
                    if not x["k"]:
                        out.append(x)
                    else:
                        out += [{"t": t, "k": k, "p": x["p"] * (i == 0)} for i, (t, k) in enumerate(self.runs_of(x["t"]))]
                return out

            return batch.map(one, na_action="ignore")

        return run(pieces)


@dataclass(frozen=True)
class Sequence:
    """Each step splits the pieces of the one before; None steps are skipped."""

    steps: tuple = ()

    @property
    def mapped(self) -> bool:
        return any(s is not None and s.mapped for s in self.steps)

    def __call__(self, pieces: Column) -> Column:
        for s in self.steps:
            if s is not None:
                pieces = s(pieces)
        return pieces


def pieces_of(text: Column, pre_tokenizer=None) -> Column:
    return pre_tokenizer(whole(text)) if pre_tokenizer else whole(text)


def only_step(pre_tokenizer):
    """The one step of a pre-tokenizer; None if it has none or several."""
    steps = [s for s in pre_tokenizer.steps if s is not None] if isinstance(pre_tokenizer, Sequence) else [pre_tokenizer]
    return steps[0] if len(steps) == 1 else None


def unwritten(text: Column, pre_tokenizer) -> tuple[Column, bool]:
    """Pieces of a text, and whether their bytes are still to be written as characters.

    They are if the last step is ByteLevel: the encoder does it once for each distinct piece.
    """
    steps = [s for s in pre_tokenizer.steps if s is not None] if isinstance(pre_tokenizer, Sequence) else [pre_tokenizer]
    if not steps or not isinstance(steps[-1], ByteLevel) or any(s.mapped for s in steps[:-1]):
        return pieces_of(text, pre_tokenizer), False
    pieces = whole(text)
    for s in steps[:-1]:
        pieces = s(pieces)
    return steps[-1](pieces, write=lambda c: c), True


def kept_texts(pieces: Column) -> Column:
    """The kept pieces' texts in order, empty ones left out."""
    return F.transform(F.filter(pieces, lambda x: x["k"] & (x["t"] != "")), lambda x: x["t"])


def whitespace() -> Split:
    """Extension: words between white space."""
    return Split(r"\s+", behavior="Removed")


def punctuation() -> Split:
    """Extension: each punctuation character by itself."""
    return Split(r"\p{P}", behavior="Isolated")


def with_offsets(df, key: str, pieces: Column, mapped: bool):
    """One row per kept piece: key, pos, text, start, end (byte offsets, half-open).

    Rows are exploded and summed in a window over the key, which is the shuffle; use tokens' own
    offsets (operators.encode) where only those are needed.
    """
    from pyspark.sql import Window

    rows = df.select(key, F.posexplode(pieces).alias("at", "x"))
    unit = F.length("x.t") if mapped else F.octet_length("x.t")
    rows = rows.withColumn("size", (unit - F.col("x.p")).cast("long"))
    run = Window.partitionBy(key).orderBy("at")
    rows = rows.withColumn("end", F.sum("size").over(run)).filter("x.k")
    return rows.select(key, (F.row_number().over(run) - 1).alias("pos"), F.col("x.t").alias("text"), (F.col("end") - F.col("size")).alias("start"), "end")
