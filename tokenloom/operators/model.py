"""The BPE model: vocabulary, merges, options, and exact encoding of one piece."""

from __future__ import annotations

import heapq
import random
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytechars import TABLE, byte_token

MAX_CACHED_LENGTH = 256


@dataclass(frozen=True)
class Options:
    unk_token: str | None = None
    continuing_subword_prefix: str | None = None
    end_of_word_suffix: str | None = None
    fuse_unk: bool = False
    byte_fallback: bool = False
    ignore_merges: bool = False
    dropout: float | None = None
    cache_capacity: int = 10_000

    def __post_init__(self):
        if self.dropout is not None and not 0 <= self.dropout <= 1:
            raise ValueError("dropout is between 0 and 1")
        if self.cache_capacity < 0:
            raise ValueError("cache_capacity is not negative")


@dataclass(frozen=True)
class Bpe:
    """An immutable model. merges are (left, right) strings in order of rank.

    A merge whose parts or result are not in the vocabulary is skipped, its rank still counted; of a pair
    named twice the last rank holds. If merges are given and all are skipped, that is an error.
    """

    vocab: dict[str, int]
    merges: Sequence[tuple[str, str]] = ()
    options: Options = field(default_factory=Options)
    strip_prefix: bool = False

    def __post_init__(self):
        if self.merges and not self.table:
            raise ValueError("no merge can be resolved in the vocabulary")

    def joined(self, a: str, b: str) -> str:
        """The token that a merge makes; strip_prefix drops the continuing prefix of its right part."""
        prefix = self.options.continuing_subword_prefix
        return a + (b[len(prefix) :] if self.strip_prefix and prefix and b.startswith(prefix) else b)

    @cached_property
    def table(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(left id, right id) -> (rank, merged id)."""
        out = {}
        for rank, (a, b) in enumerate(self.merges):
            ids = self.vocab.get(a), self.vocab.get(b), self.vocab.get(self.joined(a, b))
            if None not in ids:
                out[ids[0], ids[1]] = (rank, ids[2])
        return out

    @cached_property
    def tokens(self) -> dict[int, str]:
        return {i: t for t, i in self.vocab.items()}

    def token_to_id(self, token: str) -> int | None:
        return self.vocab.get(token)

    def id_to_token(self, i: int) -> str | None:
        return self.tokens.get(i)

    @property
    def vocab_size(self) -> int:
        return len(self.vocab)

    def merges_list(self) -> list[tuple[str, str]]:
        """Resolved merges by rank."""
        return [(self.tokens[a], self.tokens[b]) for (a, b), _ in sorted(self.table.items(), key=lambda x: x[1][0])]

    @cached_property
    def rank_monotone(self) -> bool:
        """Whether every token is made by earlier merges than any that uses it.

        Then applying each merge everywhere, in order of rank, gives the exact encoding.
        """
        made: dict[int, int] = {}
        used: dict[int, int] = {}
        for (a, b), (rank, new) in self.table.items():
            made[new] = max(made.get(new, -1), rank)
            for x in (a, b):
                used[x] = min(used.get(x, 1 << 60), rank)
        return all(rank < used.get(t, 1 << 60) for t, rank in made.items())

    @cached_property
    def singles(self) -> dict[str, tuple[int, int]]:
        """(id, bytes) of the characters that are tokens as they are."""
        o = self.options
        if o.continuing_subword_prefix or o.end_of_word_suffix:
            return {}
        return {t: (i, len(t.encode("utf-8", "surrogatepass"))) for t, i in self.vocab.items() if len(t) == 1}

    def symbols(self, piece: str) -> list[tuple[int, int]] | None:
        """(id, bytes) of each character, unknown ones by the options; None if one cannot be written."""
        known = self.singles
        out = [known[c] for c in piece if c in known]
        if len(out) == len(piece):
            return out
        o, out = self.options, []
        unk = self.vocab.get(o.unk_token) if o.unk_token is not None else None
        fused = False
        for i, c in enumerate(piece):
            key = (o.continuing_subword_prefix or "") * (i > 0) + c + (o.end_of_word_suffix or "") * (i == len(piece) - 1)
            raw = c.encode("utf-8", "surrogatepass")
            known = self.vocab.get(key)
            if known is not None:
                out.append((known, len(raw)))
                fused = False
            elif o.byte_fallback:
                ids = [self.vocab.get(byte_token(b), unk) for b in raw]
                if None in ids:
                    return None
                out += [(x, 1) for x in ids]
                fused = False
            elif unk is None:
                return None
            elif o.fuse_unk and fused:
                out[-1] = (unk, out[-1][1] + len(raw))
            else:
                out.append((unk, len(raw)))
                fused = True
        return out

    def encode(self, piece: str, rng: random.Random | None = None) -> list[tuple[int, int]]:
        """(id, bytes) of the tokens of one piece; nothing for an empty one or one that cannot be written."""
        if not piece:
            return []
        if self.options.ignore_merges and (known := self.vocab.get(piece)) is not None:
            return [(known, len(piece.encode("utf-8", "surrogatepass")))]
        symbols = self.symbols(piece)
        if not symbols:
            return []
        if self.options.dropout:
            return merge_with_dropout(symbols, self.table, self.options.dropout, rng or random.Random())
        return merge(symbols, self.table)

    @cached_property
    def pairs(self) -> "Pairs":
        return Pairs(self)

    @cached_property
    def byte_symbols(self) -> np.ndarray | None:
        """Places in pairs.ids of the 256 byte characters; None if a word's symbols are not just its bytes."""
        ids = [self.singles[c][0] for c in TABLE.values() if c in self.singles]
        if len(ids) < 256 or self.options.ignore_merges:
            return None
        return np.searchsorted(self.pairs.ids, [self.singles[TABLE[b]][0] for b in range(256)]).astype(np.int32)

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """vocab(token, id) and merges(rank, a, b)."""
        return (
            spark.createDataFrame(list(self.vocab.items()), "token string, id int"),
            spark.createDataFrame([(r, a, b) for r, (a, b) in enumerate(self.merges)], "rank int, a string, b string"),
        )


#: Pieces of up to so many symbols are searched anew for each merge, which is quicker than a queue.
SHORT = 40
NEVER = (1 << 62, -1)
#: Tables of pairs of up to so many entries are looked up by place, larger ones by search.
DENSE = 1 << 22
NO_RANK = np.iinfo(np.int32).max


class Pairs:
    """The merges of a model as arrays, for many words at once. A token is its place in ids."""

    def __init__(self, model: Bpe):
        self.ids = np.array(sorted(model.tokens), np.int64)
        pairs = sorted((a, b, rank, new) for (a, b), (rank, new) in model.table.items())
        a, b, rank, new = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else [np.zeros(0, np.int64)] * 4
        self.keys = np.searchsorted(self.ids, a) * len(self.ids) + np.searchsorted(self.ids, b)
        self.rank = rank.astype(np.int32)
        self.made = np.zeros(int(rank.max()) + 1 if pairs else 1, np.int32)
        self.made[rank] = np.searchsorted(self.ids, new)
        self.dense = None
        if len(self.ids) ** 2 <= DENSE:
            self.dense = np.full(len(self.ids) ** 2, NO_RANK, np.int32)
            self.dense[self.keys] = self.rank

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each pair, NO_RANK if it does not merge."""
        key = a.astype(np.int64) * len(self.ids) + b
        if self.dense is not None:
            return self.dense[key]
        if not len(self.keys):
            return np.full(len(key), NO_RANK, np.int32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NO_RANK)

    def ranks_in(self, symbols: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Of each symbol with the next one of its word."""
        found = np.full(len(symbols), NO_RANK, np.int32)
        found[:-1] = np.where(word[1:] == word[:-1], self.ranks(symbols[:-1], symbols[1:]), NO_RANK)
        return found

    def merge_all(self, symbols: np.ndarray, lengths: np.ndarray, table: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, bytes, tokens of each word) of words of so many symbols of one byte each, as merge() has
        them. Each round does one merge in every word that has one left; long words go to merge()."""
        word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        size = np.ones(len(symbols), np.int32)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        first = np.cumsum(lengths) - lengths
        for w in np.flatnonzero(lengths > SHORT).tolist():
            got = merge([(i, 1) for i in self.ids[symbols[first[w] : first[w] + lengths[w]]].tolist()], table)
            done.append((np.full(len(got), w, np.int32), np.searchsorted(self.ids, [i for i, _ in got]).astype(np.int32), np.array([n for _, n in got], np.int32)))
        if done:
            short = np.repeat(lengths <= SHORT, lengths)
            symbols, size, word = symbols[short], size[short], word[short]
        else:
            symbols = symbols.copy()
        while len(symbols):
            rank = self.ranks_in(symbols, word)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(word)]))
            left = best < NO_RANK
            done.append((word[~left], symbols[~left], size[~left]))
            at = np.flatnonzero(left & (rank == best))
            at = at[np.r_[True, word[at][1:] != word[at][:-1]][: len(at)]]
            symbols[at] = self.made[rank[at]]
            size[at] += size[at + 1]
            left[at + 1] = False
            symbols, size, word = symbols[left], size[left], word[left]
        if not done:
            return symbols, size, np.zeros(len(lengths), np.int64)
        word, symbols, size = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return symbols[order], size[order], np.bincount(word, minlength=len(lengths)).astype(np.int64)

    def merge_drawn(self, symbols: np.ndarray, lengths: np.ndarray, drawn: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, bytes, their words, words that ran out of numbers) of short words of symbols of one byte each, as
        merge_with_dropout() has them; drawn: (numbers, words). A round meets one candidate of every word."""
        word = np.repeat(np.arange(len(lengths)), lengths)
        size = np.ones(len(symbols), np.int32)
        met = np.full(len(lengths), -1, np.int64)  # rank and place of the last candidate passed over
        none, done, out = np.iinfo(np.int64).max, [], np.zeros(0, np.int64)
        for numbers in [*drawn, None]:
            if not len(symbols):
                break
            rank = self.ranks_in(symbols, word).astype(np.int64)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            own, sizes = word[starts], np.diff(np.r_[starts, len(word)])
            key = rank * 64 + np.arange(len(word)) - np.repeat(starts, sizes)
            key[(rank == NO_RANK) | (key <= np.repeat(met[own], sizes))] = none
            best = np.minimum.reduceat(key, starts)
            left = best < none
            if numbers is None:
                out, left = own[left], np.zeros(len(left), bool)
            taken = left & (numbers[own] >= rate) if numbers is not None else left
            met[own] = np.where(taken, -1, best)
            at = (starts + best % 64)[taken]
            symbols[at] = self.made[rank[at]]
            size[at] += size[at + 1]
            stay = np.repeat(left, sizes)
            done.append((symbols[~stay], size[~stay], word[~stay]))
            stay[at + 1] = False
            symbols, size, word = symbols[stay], size[stay], word[stay]
        return *(np.concatenate(x) for x in zip(*done)), out


def merge(symbols: Iterable[tuple[int, int]], table: dict[tuple[int, int], tuple[int, int]]) -> list[tuple[int, int]]:
    """Merge the pair of least rank, leftmost first, until none is left. Neighbours are index links."""
    ids, sizes = map(list, zip(*symbols))
    n = len(ids)
    if n <= SHORT:
        get = table.get
        found = [get(p, NEVER) for p in zip(ids, ids[1:])]
        while found and (best := min(found)) is not NEVER:
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            sizes[i : i + 2] = [sizes[i] + sizes[i + 1]]
            del found[i]
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), NEVER)
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), NEVER)
        return list(zip(ids, sizes))
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(*table[p], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in table]
    heapq.heapify(queue)
    while queue:
        _, new, i, a, b = heapq.heappop(queue)
        j = after[i] if ids[i] == a else n
        if j >= n or ids[j] != b:
            continue  # one of the two has changed since
        ids[i], sizes[i] = new, sizes[i] + sizes[j]
        ids[j], after[i] = None, after[j]
        if after[j] < n:
            before[after[j]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] < n and (p := (ids[left], ids[after[left]])) in table:
                heapq.heappush(queue, (*table[p], left, *p))
    return [(t, s) for t, s in zip(ids, sizes) if t is not None]


def merge_with_dropout(symbols, table, rate: float, rng: random.Random) -> list[tuple[int, int]]:
    """As merge(), but each candidate is passed over with probability rate; a merge brings all back.

    Candidates passed over are put aside, and go back to the queue with the next merge. A place has one
    live candidate, told by its stamp, so each costs one draw for each time it is met.
    """
    ids, sizes = map(list, zip(*symbols))
    n = len(ids)
    if n <= SHORT:
        while found := sorted((*table[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in table):
            for _, new, i in found:
                if rng.random() >= rate:
                    ids[i : i + 2] = [new]
                    sizes[i : i + 2] = [sizes[i] + sizes[i + 1]]
                    break
            else:
                break
        return list(zip(ids, sizes))
    after, before, stamp = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
    queue = [(*table[p], i, 0) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in table]
    heapq.heapify(queue)
    aside: list[tuple[int, int, int, int]] = []
    while queue:
        met = heapq.heappop(queue)
        _, new, i, made = met
        if stamp[i] != made:
            continue
        if rng.random() < rate:
            aside.append(met)
            continue
        j = after[i]
        ids[i], sizes[i] = new, sizes[i] + sizes[j]
        ids[j], after[i], stamp[j] = None, after[j], -1
        if after[j] < n:
            before[after[j]] = i
        for left in (before[i], i):
            if left >= 0:
                stamp[left] += 1
                if after[left] < n and (p := (ids[left], ids[after[left]])) in table:
                    heapq.heappush(queue, (*table[p], left, stamp[left]))
        for x in aside:
            heapq.heappush(queue, x)
        aside.clear()
    return [(t, s) for t, s in zip(ids, sizes) if t is not None]


def resolve_merges(vocab: DataFrame, merges: DataFrame) -> DataFrame:
    """(a_id, b_id, rank, merged_id) of merges(rank, a, b) against vocab(token, id), as DataFrames."""
    v = lambda t, i: F.broadcast(vocab.select(F.col("token").alias(t), F.col("id").alias(i)))  # noqa: E731  vocabularies are bounded by design
    found = merges.withColumn("ab", F.concat("a", "b")).join(v("a", "a_id"), "a").join(v("b", "b_id"), "b").join(v("ab", "merged_id"), "ab")
    return found.groupBy("a_id", "b_id").agg(F.max(F.struct("rank", "merged_id")).alias("m")).select("a_id", "b_id", "m.rank", "m.merged_id")
