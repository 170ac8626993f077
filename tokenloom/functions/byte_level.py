"""The byte-level splitter's pattern as arrays: the pieces of many texts at once, as the JVM's regular expressions cut them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

OTHER, LETTER, NUMBER, WHITE = range(4)
_CLASSES = {LETTER: r"[^\p{L}]", NUMBER: r"[^\p{N}]", WHITE: r"\S"}
_KINDS: dict[str, np.ndarray] = {}


def kinds(spark: SparkSession) -> np.ndarray:
    """The kind of every code point. The JVM tells its own classes, for its Unicode is not that of Python."""
    sc = spark.sparkContext
    if (out := _KINDS.get(sc.applicationId)) is None:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        out = np.zeros(0x110000, np.uint8)
        for kind, others in _CLASSES.items():
            own = sc._jvm.java.util.regex.Pattern.compile("(?U)" + others).matcher(every).replaceAll("")
            out[np.frombuffer(own.encode("utf-32-le"), np.uint32)] = kind
        _KINDS.clear()
        _KINDS[sc.applicationId] = out
    return out


def code_points(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The characters that start at these places of valid UTF-8."""
    code = raw[at].astype(np.int32)
    wide = np.flatnonzero(code >= 0x80)
    if len(wide):
        first, place = code[wide], at[wide]
        more = [raw[np.minimum(place + i, len(raw) - 1)].astype(np.int32) & 0x3F for i in (1, 2, 3)]
        two = (first & 0x1F) << 6 | more[0]
        three = (first & 0x0F) << 12 | more[0] << 6 | more[1]
        four = (first & 0x07) << 18 | more[0] << 12 | more[1] << 6 | more[2]
        code[wide] = np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))
    return code


def split(raw: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """First bytes of the pieces of texts that stand one after the other, each from a bound to the next.

    Pieces are runs of one kind. The last character of white space before another run stands by itself, and
    goes with that run if it is a space; 's, 't, 'm, 'd, 're, 've, 'll are cut off where a quote starts a piece.
    """
    if not len(raw):
        return np.zeros(0, np.int64)
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    code = code_points(raw, at)
    own = kind[code]
    edge = np.zeros(len(raw), bool)
    edge[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    edge = edge[at]
    cut = edge.copy()
    cut[1:] |= own[1:] != own[:-1]
    after = np.flatnonzero(cut[1:] & ~edge[1:] & (own[:-1] == WHITE)) + 1
    cut[after - 1] = True
    cut[after[code[after - 1] == ord(" ")]] = False
    quote = np.flatnonzero(cut[:-1] & (code[:-1] == ord("'")) & ~edge[1:])
    if len(quote):
        third = np.minimum(quote + 2, len(code) - 1)
        a, b, inside = code[quote + 1], code[third], (third == quote + 2) & ~edge[third]
        one = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
        two = inside & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        found = one | two
        cut[quote[found] + 1] = False
        end = (quote + np.where(two, 3, 2))[found]
        cut[end[end < len(cut)]] = True
    return at[cut]
