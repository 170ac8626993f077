"""Bytes as printable characters: the alphabet of byte-level vocabularies, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes that stand for themselves; the other 68 become U+0100 and on, in byte order.
OWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
MOVED = [b for b in range(256) if b not in OWN]
TABLE = {b: chr(b) for b in OWN} | {b: chr(0x100 + i) for i, b in enumerate(MOVED)}
BACK = {c: b for b, c in TABLE.items()}
_FROM, _TO = "".join(map(chr, MOVED)), "".join(TABLE[b] for b in MOVED)


def byte_chars(text: Column) -> Column:
    """Each UTF-8 byte of a text as its printable character."""
    return F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), _FROM, _TO)


def chars_to_bytes(text: Column) -> Column:
    """BINARY: each printable character as its byte; other characters keep their own UTF-8 bytes."""
    # translate() deletes what maps to NUL, so byte 0 is put back by itself
    latin = F.replace(F.translate(text, _TO[1:], _FROM[1:]), F.lit(_TO[0]), F.lit("\0"))
    two = F.create_map(*(x for c, b in BACK.items() for x in (F.lit(c), F.lit(f"{b:02X}"))))
    mixed = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(two, c), F.hex(F.encode(c, "UTF-8")))), "")
    all_mapped = F.translate(text, "".join(BACK), "") == ""  # quicker than a pattern
    return F.when(text == "", F.lit(b"")).when(all_mapped, F.encode(latin, "ISO-8859-1")).otherwise(F.unhex(mixed))


def chars_to_text(text: Column) -> Column:
    """chars_to_bytes() as a STRING, malformed bytes replaced by U+FFFD."""
    return F.make_valid_utf8(chars_to_bytes(text).cast("string"))


def map_bytes(raw: bytes) -> str:
    return "".join(TABLE[b] for b in raw)


def unmap_chars(text: str) -> bytes:
    return b"".join(bytes([BACK[c]]) if c in BACK else c.encode("utf-8") for c in text)


def byte_token(b: int) -> str:
    """The vocabulary entry that stands for a byte in byte fallback."""
    return f"<0x{b:02X}>"
