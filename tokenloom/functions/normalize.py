"""Normalizers: Column to Column, with what is needed to map byte offsets back."""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\r\x0b\x0c"
# Latin-1 letters that the byte-wise case rules move: fixed values.
_UPPER = string.ascii_uppercase + "".join(chr(b) for b in range(0xC0, 0xDF) if b != 0xD7)
_LOWER = string.ascii_lowercase + "".join(chr(b + 0x20) for b in range(0xC0, 0xDF) if b != 0xD7)


@dataclass(frozen=True)
class Normalizer:
    """A named step. cut(text) is the number of bytes it takes from the front."""

    kind: str
    apply: Callable[[Column], Column]
    cut: Callable[[Column], Column]
    steps: tuple["Normalizer", ...] = ()

    def __call__(self, text: Column) -> Column:
        return self.apply(text)

    def original(self, text: Column, start: Column, end: Column) -> tuple[Column, Column]:
        """Byte span [start, end) of the normalized text as a span of the original one."""
        size = F.octet_length(self.apply(text)).cast("int")
        shift = self.cut(text).cast("int")
        none = (size == 0) | F.lit(self.kind == "Identity")
        last = shift + size
        s = F.when(none, start).otherwise(F.least(start, F.greatest(size - 1, F.lit(0))) + shift)
        e = F.when(none, end).when((end == 0) | (end > size), last).otherwise(end + shift)
        return s, F.greatest(s, e)


def _none(text: Column) -> Column:
    return F.lit(0)


def identity() -> Normalizer:
    return Normalizer("Identity", lambda t: t, _none)


def strip() -> Normalizer:
    """Spaces, tabs, newlines, vertical tabs, form feeds and returns at both ends; nothing else."""
    white = F.lit(WHITE)
    return Normalizer("Strip", lambda t: F.btrim(t, white), lambda t: F.octet_length(t) - F.octet_length(F.ltrim(t, white)))


def lowercase() -> Normalizer:
    """A-Z only: equal to the byte-wise rule on ASCII and never malformed."""
    return Normalizer("Lowercase", lambda t: F.translate(t, string.ascii_uppercase, string.ascii_lowercase), _none)


def uppercase() -> Normalizer:
    return Normalizer("Uppercase", lambda t: F.translate(t, string.ascii_lowercase, string.ascii_uppercase), _none)


def byte_case(text: Column, upper: bool) -> Column:
    """BINARY: the byte-wise Latin-1 case rule, which can take UTF-8 apart."""
    pair = (_LOWER, _UPPER) if upper else (_UPPER, _LOWER)
    return F.encode(F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), *pair), "ISO-8859-1")


def replace_range(text: Column, start: int, end: int, by: str) -> Column:
    """text with its bytes [start, end) replaced; as it is if that is no range of it."""
    raw = F.encode(text, "UTF-8")
    spliced = F.concat(F.substring(raw, 1, start), F.encode(F.lit(by), "UTF-8"), F.substring(raw, F.lit(end + 1), F.octet_length(text)))
    return F.when((F.lit(start) > end) | (F.octet_length(text) < end), text).otherwise(F.decode(spliced, "UTF-8"))


def replace_alignment(text: Column, start: int, end: int, by: str) -> Column:
    """array<int>: for each byte of replace_range(), the byte of text that it stands for. What is put in
    stands for the byte at start, or the last one."""
    n, none = F.octet_length(text), F.array().cast("array<int>")
    upto = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)
    put = F.when(n == 0, F.lit(start)).otherwise(F.least(F.lit(start), n - 1))
    spliced = F.concat(upto(F.lit(0), F.lit(start)), F.array_repeat(put, len(by.encode())), upto(F.lit(end), n))
    return F.when((F.lit(start) > end) | (n < end), upto(F.lit(0), n)).otherwise(spliced)


def append(text: Column, more: str) -> tuple[Column, Column]:
    """(text and more behind it, alignment): what is put there stands for the byte after the last."""
    n = F.octet_length(text)
    own = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.concat(text, F.lit(more)), F.concat(own, F.array_repeat(n, len(more.encode())))


def sequence(*steps: Normalizer | None) -> Normalizer:
    own = tuple(s for s in steps if s is not None)

    def apply(t: Column) -> Column:
        for s in own:
            t = s(t)
        return t

    def cut(t: Column) -> Column:
        total = F.lit(0)
        for s in own:
            total, t = total + s.cut(t), s(t)
        return total

    return Normalizer("Sequence", apply, cut, own)


KINDS = {"Identity": identity, "Strip": strip, "Lowercase": lowercase, "Uppercase": uppercase}


def make(kind: str) -> Normalizer:
    """By name; unknown names give identity."""
    return KINDS.get(kind, identity)()
