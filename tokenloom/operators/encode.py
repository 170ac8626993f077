"""Encoding of texts: native expressions where the merges allow it, else one Arrow pass.

Neither way shuffles: words repeat so much that a memory of encoded words in each worker does what a
distinct-encode-join would, without moving every word of the corpus over the network.
"""

from __future__ import annotations

import random
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import byte_level
from ..functions.bytechars import map_bytes
from ..functions.draws import first_draws
from .model import MAX_CACHED_LENGTH, NO_RANK, SHORT, Bpe, merge_with_dropout
from .pretokenize import PIECE, ByteLevel, only_step, unwritten

FIELDS = {"ids": "int", "tokens": "string", "starts": "int", "ends": "int"}
#: A field that is made if named: start-end of each token, parted by blanks, one text. As arrays, the JVM makes an object of each number to show it.
SHOWN = "spans"
OPEN, CLOSE, MISSED = "\x02", "\x03", "\x04"
#: Bytes of text that are encoded at once: Spark's batches are larger, and tokens take many times their bytes.
PORTION = 1 << 19
#: Pieces that draw at once, and the numbers that each gets: few need more.
AT_ONCE, DRAWS = 8192, 10


def portions(texts: pa.Array, most: int = PORTION) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of rows with up to `most` bytes, or of one row that has more."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64))
    at = 0
    while at < len(ends):
        till = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, till - at
        at = till


class Pieces:
    """Pieces of a run of rows, from struct<text, sizes, marks>: the text of each row is cut by the bytes of
    its pieces, without a copy; a mark is twice the bytes put in front, and one more if the piece is removed."""

    def __init__(self, rows: pa.StructArray):
        text, sizes = rows.field("text").cast(pa.string()), rows.field("sizes")
        self.lengths = sizes.value_lengths().fill_null(0).to_numpy()
        size, marks = sizes.flatten().to_numpy(), rows.field("marks").flatten().to_numpy()
        bounds = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, 4 * text.offset)
        ends = (int(bounds[0]) + np.r_[0, np.cumsum(size, dtype=np.int64)]).astype(np.int32)
        self.texts = pa.StringArray.from_buffers(len(size), pa.py_buffer(ends), text.buffers()[2])
        self.kept, self.put = marks % 2 == 0, (marks // 2).astype(np.int64)

    @classmethod
    def split(cls, texts: pa.StringArray, kind: np.ndarray, add_prefix_space: bool) -> "Pieces":
        """Of whole texts, by the byte-level pattern."""
        out = cls.__new__(cls)
        raw, unit = raw_of(texts)
        bounds = np.r_[0, np.cumsum(unit, dtype=np.int64)]
        led = np.zeros(len(unit), bool)
        if add_prefix_space:
            led[unit == 0] = True
            some = np.flatnonzero(unit)
            led[some] = raw[bounds[some]] != ord(" ")
            raw = np.insert(raw, bounds[:-1][led], ord(" "))
            bounds += np.r_[0, np.cumsum(led)]
        first = byte_level.split(raw, bounds, kind)
        of_row = np.searchsorted(first, bounds)
        out.lengths = np.diff(of_row)
        out.texts = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.r_[first, len(raw)].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw)))
        out.kept, out.put = np.ones(len(first), bool), np.zeros(len(first), np.int64)
        out.put[of_row[:-1][led]] = 1
        return out


def raw_of(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, bytes of each)."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    held = texts.buffers()[2]
    return np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8), np.diff(bounds)


class Words:
    """Encodes batches of piece arrays, each distinct piece of a batch once. Pieces whose symbols are their
    bytes are merged as arrays; others one by one, or taken from the memory."""

    def __init__(self, model: Bpe, mapped: bool, memory: int, write: bool = False, compat: bool = False, fields: Collection[str] = tuple(FIELDS)):
        """mapped: a character of a piece is one byte; write: pieces are plain text, to be so written; compat:
        a space put in front counts as a byte of its piece; fields: the parts of an encoding that are made."""
        self.fields = [f for f in (*FIELDS, SHOWN) if f in fields]
        self.model, self.mapped, self.memory, self.write, self.compat = model, mapped or write, memory, write, compat
        self.known: dict[str, tuple[list[int], list[int]]] = {}
        self.by_bytes = write and model.byte_symbols is not None
        self.ids = model.pairs.ids
        self.tokens = pa.array([model.tokens[i] for i in self.ids.tolist()], pa.string())

    def sizes(self, piece: str, got: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
        """Ids and bytes of a piece's tokens; a mapped character is one byte, whatever its own length."""
        ids, ends, at, raw = [], [], 0, piece.encode("utf-8", "surrogatepass") if self.mapped else b""
        for i, n in got:
            ids.append(i)
            ends.append(n if not self.mapped else len(raw[at : at + n].decode("utf-8", "surrogatepass")))
            at += n
        return ids, ends

    def encoded(self, piece: str, rng: random.Random | None = None) -> tuple[list[int], list[int]]:
        own = map_bytes(piece.encode("utf-8", "surrogatepass")) if self.write else piece
        return self.sizes(own, self.model.encode(own, rng))

    def unit(self, piece: str) -> int:
        """Bytes of the text that a piece stands for."""
        return len(piece) if self.mapped and not self.write else len(piece.encode("utf-8", "surrogatepass"))

    def word(self, piece: str) -> tuple[list[int], list[int]]:
        if (got := self.known.get(piece)) is None:
            got = self.encoded(piece)
            if len(piece) <= MAX_CACHED_LENGTH:
                if len(self.known) >= self.memory:
                    self.known.clear()
                self.known[piece] = got
        return got

    def batch(self, rows: pa.StructArray | Pieces) -> pa.Array:
        given = rows if isinstance(rows, Pieces) else Pieces(rows)
        coded = given.texts.dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        if self.by_bytes:
            raw, unit = raw_of(coded.dictionary)
            symbols, sizes, many = self.model.byte_symbols[raw], np.ones(len(raw), np.int32), unit.astype(np.int64)
            if self.model.options.dropout != 1:  # it drops every merge
                symbols, sizes, many = self.model.pairs.merge_all(symbols, unit, self.model.table)
            return self.gathered(given.lengths, index, given.kept, given.put, unit.astype(np.int64), many, np.cumsum(many) - many, self.ids[symbols], sizes.astype(np.int64))
        pieces = coded.dictionary.to_pylist()
        encoded = [self.word(x) for x in pieces]
        unit = np.array([self.unit(x) for x in pieces], np.int64)
        many = np.array([len(i) for i, _ in encoded], np.int64)
        first = np.cumsum(many) - many
        return self.gathered(
            given.lengths,
            index,
            given.kept,
            given.put,
            unit,
            many,
            first,
            np.fromiter((i for x, _ in encoded for i in x), np.int64, int(many.sum())),
            np.fromiter((n for _, x in encoded for n in x), np.int64, int(many.sum())),
        )

    def one_by_one(self, rows: pa.StructArray | Pieces, seeds: list) -> pa.Array:
        """As batch(), every piece encoded by itself with a random source of its row's seed and position."""
        given = rows if isinstance(rows, Pieces) else Pieces(rows)
        where = [(s, pos) for s, n in zip(seeds, given.lengths.tolist()) for pos in range(n)]
        if self.by_bytes:
            raw, unit = raw_of(given.texts)
            symbols, sizes, many = self.dropped(raw, unit, where)
            ids = self.ids[symbols]
        else:
            pieces = given.texts.to_pylist()
            encoded = [self.encoded(x, random.Random(f"{s}:{pos}")) for x, (s, pos) in zip(pieces, where)]
            unit = np.array([self.unit(x) for x in pieces], np.int64)
            many = np.array([len(i) for i, _ in encoded], np.int64)
            ids, sizes = np.array([i for x, _ in encoded for i in x], np.int64), np.array([n for _, x in encoded for n in x], np.int64)
        return self.gathered(given.lengths, np.arange(len(unit)), given.kept, given.put, unit.astype(np.int64), many, np.cumsum(many) - many, ids, sizes.astype(np.int64))

    def dropped(self, raw: np.ndarray, unit: np.ndarray, where: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, bytes, tokens of each piece) of pieces of bytes; only pieces with a pair that may merge draw. Short
        ones draw and merge as arrays; long ones, and the few that need more than DRAWS numbers, one by one."""
        pairs, rate = self.model.pairs, self.model.options.dropout
        symbols = self.model.byte_symbols[raw]
        word = np.repeat(np.arange(len(unit), dtype=np.int32), unit)
        draws = np.zeros(len(unit), bool)
        draws[word[pairs.ranks_in(symbols, word) < NO_RANK]] = True
        still = ~draws[word]
        done = [(symbols[still], np.ones(int(still.sum()), np.int32), word[still])]
        first = np.cumsum(unit, dtype=np.int64) - unit
        short = np.flatnonzero(draws & (unit <= SHORT))
        single = [np.flatnonzero(draws & (unit > SHORT))]
        seeds = [b"%a:%d" % where[w] for w in short.tolist()]
        alike = np.argsort([len(x) for x in seeds], kind="stable")  # seeds of one length draw together
        for at in range(0, len(short), AT_ONCE):
            some = alike[at : at + AT_ONCE]
            own = short[some]
            n = unit[own].astype(np.int64)
            places = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            drawn = first_draws([seeds[i] for i in some.tolist()], DRAWS)
            tokens, sizes, of, more = pairs.merge_drawn(symbols[places], n, drawn, rate)
            kept = ~np.isin(of, more)
            done.append((tokens[kept], sizes[kept], own[of[kept]]))
            single.append(own[more])
        for w in np.concatenate(single).tolist():
            s, pos = where[w]
            given = [(i, 1) for i in self.ids[symbols[first[w] : first[w] + unit[w]]].tolist()]
            got = merge_with_dropout(given, self.model.table, rate, random.Random(f"{s}:{pos}"))
            done.append((np.searchsorted(self.ids, [i for i, _ in got]).astype(np.int32), np.array([n for _, n in got], np.int32), np.full(len(got), w)))
        tokens, sizes, of = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(of, kind="stable")
        return tokens[order], sizes[order], np.bincount(of, minlength=len(unit)).astype(np.int64)

    def gathered(self, lengths, index, kept, put, unit, many, first, ids, sizes) -> pa.Array:
        """Encodings of rows of `lengths` pieces; piece j is word index[j], whose tokens start at first."""
        n = many[index] * kept
        total = int(n.sum())
        source = np.repeat(first[index] - (np.cumsum(n) - n), n) + np.arange(total)
        counts = np.r_[0, np.cumsum(n)]
        bounds = pa.array(counts[np.r_[0, np.cumsum(lengths)]].astype(np.int32))
        made: dict[str, pa.Array] = {}
        if "ids" in self.fields:
            made["ids"] = pa.array(ids.astype(np.int32)[source])
        if "tokens" in self.fields:
            made["tokens"] = self.tokens.take(pa.array(np.searchsorted(self.ids, ids)[source])) if total else pa.array([], pa.string())
        if {"starts", "ends", SHOWN} & set(self.fields):
            ends = np.cumsum(sizes)
            word_start = np.r_[0, ends][first] if len(ids) else np.zeros(len(first), np.int64)
            size = unit[index] - put
            at = np.cumsum(size) - size
            row_first = np.cumsum(lengths) - lengths
            row_at = np.r_[at, at[-1] + size[-1] if len(at) else 0][row_first]
            at = at - np.repeat(row_at, lengths)
            # how far a token lies from its place among the words; a space put in front counts none
            moved = np.repeat(at - word_start[index] - put * (not self.compat), n)
            least = np.repeat(at, n) if put.any() else None
            for f, x in (("starts", ends - sizes), ("ends", ends)):
                if f in self.fields or SHOWN in self.fields:
                    x = x[source] + moved
                    made[f] = pa.array((x if least is None else np.maximum(x, least)).astype(np.int32))
        listed = lambda values: pa.ListArray.from_arrays(bounds, values)
        arrays = {f: listed(made[f]) for f in self.fields if f != SHOWN}
        if SHOWN in self.fields:
            arrays[SHOWN] = pc.binary_join(listed(pc.binary_join_element_wise(made["starts"].cast(pa.string()), made["ends"].cast(pa.string()), "-")), " ")
        return pa.StructArray.from_arrays([arrays[f] for f in self.fields], self.fields)


def _encoded(df: DataFrame, model: Bpe, given: Column, out: str, seed: Column | None, cut: ByteLevel | None, fields: Collection[str], mapped: bool, memory: int, write: bool, compat: bool) -> DataFrame:
    """df with the encodings of a column: of struct<text, sizes, marks>, or of texts that are cut here."""
    if not fields or set(fields) - {*FIELDS, SHOWN}:
        raise ValueError(f"fields are some of {', '.join([*FIELDS, SHOWN])}")
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast((model, byte_level.kinds(spark) if cut else None))
    drop, seeded = model.options.dropout, seed is not None

    def run(batches: Iterator) -> Iterator[pa.Array]:
        model, kind = sent.value
        words = Words(model, mapped, memory, write, compat, fields)
        for rows, seeds, _ in batches:
            rows = rows.cast(pa.string()) if cut else rows
            for at, n in portions(rows if cut else rows.field("text")):
                part = rows.slice(at, n)
                part = Pieces.split(part, kind, cut.add_prefix_space) if cut else part
                if drop and not (drop == 1 and words.by_bytes):
                    yield words.one_by_one(part, seeds.slice(at, n).to_pylist() if seeded else [random.random() for _ in range(n)])
                else:
                    yield words.batch(part)
            rows = part = None  # gone before the next batch is read

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    # marked nondeterministic, it runs once a row: no filter is pushed through it
    kinds = ",".join([f"{f}:array<{FIELDS[f]}>" for f in FIELDS if f in fields] + [f"{SHOWN}:string"] * (SHOWN in fields))
    udf = F.arrow_udf(run, f"struct<{kinds}>").asNondeterministic()
    # what is used twice stays a column of its own: functions with lambdas cannot stand in a UDF's input
    again = F.lit(0) if cut else F.octet_length(given["text"])
    return df.withColumn(out, udf(given, seed if seed is not None else F.lit(0).cast("long"), again))


def encode_split(df: DataFrame, text: Column, model: Bpe, cut: ByteLevel, out: str = "encoding", seed: Column | None = None, compat_offsets: bool = False, fields: Collection[str] = tuple(FIELDS), memory: int = 200_000) -> DataFrame:
    """As encode_pieces() of the byte-level pieces of a text. Only the text goes to Python, which cuts it there:
    arrays of pieces take the JVM more time and memory than the encoding."""
    return _encoded(df, model, F.make_valid_utf8(F.coalesce(text, F.lit(""))), out, seed, cut, fields, True, memory, True, compat_offsets)


def encode_pieces(df: DataFrame, pieces: Column, model: Bpe, mapped: bool, out: str = "encoding", seed: Column | None = None, memory: int = 200_000, write: bool = False, compat_offsets: bool = False, fields: Collection[str] = tuple(FIELDS)) -> DataFrame:
    """df with struct<ids, tokens, starts, ends> of an array of pieces; offsets are bytes of the whole text.

    Tokens of a byte-mapped piece count one byte per character, the prefix put in front counts none; with
    compat_offsets it counts, so the tokens of the first piece lie one byte too far. fields: the struct's
    fields that are made, SHOWN among them if named; the others need neither time nor memory.
    With dropout, seed (a long column) makes the outcome a function of it and of the piece's position;
    without seed every run differs. Empty and null arrays give empty lists.
    """
    # Spark holds a batch of what goes in, and an array of structs takes ten times its text: so the text goes, and the
    # sizes of its pieces
    given = F.coalesce(F.col("_pieces"), F.array().cast(f"array<{PIECE}>"))
    held = df.withColumn("_pieces", pieces).withColumn(
        "_given",
        F.struct(
            F.array_join(F.transform(given, lambda x: x["t"]), "").alias("text"),
            F.transform(given, lambda x: F.octet_length(x["t"])).alias("sizes"),
            F.transform(given, lambda x: x["p"] * 2 + (~x["k"]).cast("int")).alias("marks"),
        ),
    )
    return _encoded(held, model, F.col("_given"), out, seed, None, fields, mapped, memory, write, compat_offsets).drop("_pieces", "_given")


def native_tokens(piece: Column, model: Bpe) -> Column:
    """array<string> of the tokens of one piece without a UDF; the merges must be rank-monotone.

    Symbols stand between control characters that the piece must not hold, and each merge, in order, is one
    replacement. Every step is named once, so none is worked out twice. Meant for up to a few hundred merges.
    """
    o = model.options
    if not model.rank_monotone or o.dropout or o.byte_fallback or o.fuse_unk:
        raise ValueError("the native way needs rank-monotone merges and no dropout, byte fallback or fused unknowns")
    prefix, suffix = o.continuing_subword_prefix or "", o.end_of_word_suffix or ""
    chars = F.split(piece, "")
    if prefix or suffix:
        chars = F.transform(chars, lambda c, i: F.concat(F.when(i > 0, prefix).otherwise(""), c, F.when(i == F.length(piece) - 1, suffix).otherwise("")))
    single = F.array(*(F.lit(t) for t in sorted(model.vocab) if len(t) <= 1 + len(prefix) + len(suffix)))
    unk = F.lit(o.unk_token if o.unk_token in model.vocab else MISSED)
    chars = F.transform(chars, lambda c: F.when(F.array_contains(single, c), c).otherwise(unk))
    rules = [(f"{OPEN}{a}{CLOSE}{OPEN}{b}{CLOSE}", f"{OPEN}{model.joined(a, b)}{CLOSE}") for a, b in model.merges_list()]
    start = F.concat(F.lit(OPEN), F.array_join(chars, CLOSE + OPEN), F.lit(CLOSE))
    steps = F.array(*(F.struct(F.lit(f).alias("f"), F.lit(t).alias("t")) for f, t in rules)) if rules else None
    done = F.aggregate(steps, start, lambda acc, m: F.replace(acc, m["f"], m["t"])) if rules else start
    none = F.array().cast("array<string>")
    tokens = F.transform(F.array(done), lambda d: F.when(F.contains(d, F.lit(MISSED)), none).otherwise(F.split(F.btrim(d, F.lit(OPEN + CLOSE)), CLOSE + OPEN)))
    out = F.when(piece == "", none).otherwise(F.get(tokens, 0))
    if o.ignore_merges:
        entire = F.array(*(F.lit(t) for t in sorted(model.vocab)))
        out = F.when(F.array_contains(entire, piece), F.array(piece)).otherwise(out)
    return out


def encode(df: DataFrame, text: str, model: Bpe, pre_tokenizer=None, out: str = "encoding", seed: Column | None = None, compat_offsets: bool = False, fields: Collection[str] = tuple(FIELDS)) -> DataFrame:
    """df with the encoding of a text column: ids, tokens and byte offsets, or those fields that are named."""
    return encode_text(df, F.coalesce(F.col(text), F.lit("")), model, pre_tokenizer, out, seed, compat_offsets, fields)


def encode_text(df: DataFrame, text: Column, model: Bpe, pre_tokenizer, out: str, seed: Column | None = None, compat_offsets: bool = False, fields: Collection[str] = tuple(FIELDS)) -> DataFrame:
    step = only_step(pre_tokenizer)
    if isinstance(step, ByteLevel) and step.use_regex:
        return encode_split(df, text, model, step, out, seed, compat_offsets, fields)
    pieces, write = unwritten(text, pre_tokenizer)
    mapped = bool(pre_tokenizer is not None and pre_tokenizer.mapped and not write)
    return encode_pieces(df, pieces, model, mapped, out, seed, write=write, compat_offsets=compat_offsets, fields=fields)
