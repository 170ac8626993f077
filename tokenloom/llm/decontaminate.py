"""Benchmark decontamination: passages of documents within a few word edits of a benchmark item.

Texts are sequences of lower-cased words. A window as long as an item is embedded by the CGK random
walk: at each step the walk writes the word it stands on and moves on if a random bit of (step, word)
says so, which turns edit distance into Hamming distance. Repeated bit sampling of the embeddings,
with as many tables as the target recall takes, gives candidates, and each is verified by exact
approximate matching (edit distance of the item to any passage around the window). Where no bounded number
of tables reaches the recall, every window that holds enough word pairs of an item is a candidate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import cut, forget

#: Characters and items of one block of benchmark items, the most that is sent to executors at once.
BLOCK_CHARS, BLOCK_ITEMS = 4_000_000, 20_000
#: Tables beyond which the windows themselves are verified.
MOST_TABLES = 4096


@dataclass(frozen=True)
class Cgk:
    """similarity: edits allowed are (1 - similarity) of an item's words, rounded down.
    bits: sampled positions of a table; recall: target for items at the bound."""

    similarity: float = 0.8
    bits: int = 4
    recall: float = 0.99
    seed: int = 7

    def allowed(self, n: int) -> int:
        return int((1 - self.similarity) * n + 1e-9)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def walk(symbols: np.ndarray, starts: np.ndarray, steps: int, walks: int, seed: int) -> np.ndarray:
    """(starts, walks, steps) offsets from the start at which each walk stands at each step."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, (steps, walks), dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, (steps, walks), dtype=np.uint64)
    at = np.zeros((len(starts), walks), np.int32)
    out = np.empty((len(starts), walks, steps), np.int32)
    last = len(symbols) - 1
    for j in range(steps):
        out[:, :, j] = at
        s = symbols[np.minimum(starts[:, None] + at, last)].astype(np.uint64) + np.uint64(1)
        at += ((s * a[j] + b[j]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(63)).astype(np.int32)
    return out


def embedded(symbols: np.ndarray, starts: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """Symbols under the walks, -1 behind the end of a window of this length."""
    at = np.minimum(starts[:, None, None] + offsets, len(symbols) - 1)
    return np.where(offsets < length, symbols[at], -1)


class ItemBlock:
    """Benchmark items indexed for one pass over the documents."""

    def __init__(self, items: list[tuple[int | None, str | None]], p: Cgk):
        self.p = p
        split = [(i, w) for i, t in items if (w := words_of(t))]
        self.vocab: dict[bytes, int] = {}
        for _, w in split:
            for x in w:
                self.vocab.setdefault(x, len(self.vocab) + 1)
        self.ids = [i for i, _ in split]
        self.items = [np.array([self.vocab[x] for x in w], np.int64) for _, w in split]
        self.size = np.array([len(x) for x in self.items], np.int64)
        self.most = int(self.size.max(initial=0))
        self.base = len(self.vocab) + 1
        pairs = [x[:-1] * self.base + x[1:] for x in self.items if len(x) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        # the items that hold each word pair, once each
        at = np.unique(np.array([(np.searchsorted(self.pairs, c), i) for i, x in enumerate(self.items) for c in set((x[:-1] * self.base + x[1:]).tolist())], np.int64).reshape(-1, 2), axis=0)
        self.holders = at[:, 1]
        self.holder_at = np.searchsorted(at[:, 0], np.arange(len(self.pairs) + 1))
        self.leasts = np.array([self.least(n) if n > 1 else 1 << 40 for n in self.size.tolist()], np.int64)
        self.flag = np.zeros(self.base**2, bool) if self.base <= 5_000 else None
        if self.flag is not None:
            self.flag[self.pairs] = True
        self.classes = {int(n): np.flatnonzero(self.size == n) for n in np.unique(self.size)}
        self.least_hits = min((self.least(n) for n in self.classes if n > 1), default=0)
        self.steps = 2 * max(self.most, 1)
        self.walks = self.tables_needed()
        rng = np.random.default_rng(p.seed + 1)
        self.table = {}
        for n, own in self.classes.items() if self.walks else ():
            pick = rng.integers(0, 2 * n, (self.walks, p.bits))
            sigs = np.concatenate([self.signatures(self.items[k], np.zeros(1, np.int64), n, pick, None) for k in own])
            order = np.argsort(sigs.ravel(), kind="stable")
            self.table[n] = (pick, sigs.ravel()[order], np.repeat(own, self.walks)[order])
        self.masks: dict[int, dict[int, int]] = {}

    def least(self, n: int) -> int:
        """Word pairs of an item that any passage within the bound still has in an item-sized window."""
        return max(1, n - 1 - 2 * self.p.allowed(n))

    def tables_needed(self) -> int:
        """Tables for the target recall, from walks over items and copies edited up to the bound; 0 if more
        than MOST_TABLES would be needed."""
        rng = np.random.default_rng(self.p.seed + 2)
        some = [x for x in self.items if self.p.allowed(len(x))]
        if not some:
            return 1
        rates = []
        for x in (some[i] for i in rng.integers(0, len(some), 60)):
            y = list(x)
            for _ in range(self.p.allowed(len(x))):
                i = int(rng.integers(0, len(y)))
                y[i : i + 1] = ([0], [0], [], [y[i], 0])[int(rng.integers(0, 4))]  # replaced, dropped, put in
            y = np.array(y, np.int64)
            start, n = np.zeros(1, np.int64), len(x)
            e = [embedded(z, start, walk(z, start, 2 * n, 32, self.p.seed + 3), n)[0] for z in (x, np.r_[y, np.zeros(n, np.int64)])]
            rates.append(((e[0] == e[1]).mean(axis=1) ** self.p.bits).mean())
        tables = 1
        while ((1 - np.array(rates)) ** tables).mean() > 1 - self.p.recall:
            tables = math.ceil(tables * 1.25)
            if tables > MOST_TABLES:
                return 0
        return tables

    def signatures(self, symbols: np.ndarray, starts: np.ndarray, n: int, pick: np.ndarray, offsets: np.ndarray | None) -> np.ndarray:
        """(starts, tables) hashes of the sampled positions of the windows' embeddings."""
        if offsets is None:
            offsets = walk(symbols, starts, self.steps, self.walks, self.p.seed)
        off = np.take_along_axis(offsets, pick[None, :, :], axis=2)
        e = embedded(symbols, starts, off, n)
        sig = np.arange(self.walks, dtype=np.int64)[None, :] * 0x5851F42D4C957F2D + n
        with np.errstate(over="ignore"):
            for j in range(self.p.bits):
                sig = (sig ^ e[:, :, j]) * 0x2545F4914F6CDD1D
                sig = sig ^ (sig >> 29)
        return sig

    def symbols(self, text: str | None) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(w, 0) for w in words_of(text)], np.int64)

    def windows(self, s: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, starts of windows of its size that hold enough of its word pairs).

        What is left out cannot be within the bound: an edit undoes at most two word pairs of an item.
        """
        n = len(s)
        if 1 in self.classes and (one := np.flatnonzero(s)).size:
            yield from ((int(i), one) for i in self.classes[1])
        code = s[:-1] * self.base + s[1:]
        if self.flag is not None:
            at = np.flatnonzero(self.flag[code])
        else:
            at = np.flatnonzero(np.isin(code, self.pairs))
        if len(at) >= max(1, self.least_hits):
            k = np.searchsorted(self.pairs, code[at])
            many = self.holder_at[k + 1] - self.holder_at[k]
            own = np.repeat(self.holder_at[k] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            item, where = self.holders[own], np.repeat(at, many)
            for i in np.flatnonzero(np.bincount(item, minlength=len(self.items)) >= self.leasts):
                size, hits = int(self.size[i]), where[item == i]
                starts = np.arange(max(0, hits[0] - size), min(hits[-1], n - size + self.p.allowed(size)) + 1)
                inside = np.searchsorted(hits, starts + size - 1) - np.searchsorted(hits, starts)
                yield int(i), starts[inside >= self.leasts[i]]

    def candidates(self, s: np.ndarray) -> dict[int, dict[int, int]]:
        """item -> window start -> number of tables that agree; or every window where there are no tables."""
        found: dict[int, dict[int, int]] = {}
        by_size: dict[int, list[np.ndarray]] = {}
        for item, starts in self.windows(s):
            if not self.walks:
                found[item] = dict.fromkeys(starts.tolist(), 1)
            by_size.setdefault(int(self.size[item]), []).append(starts)
        windows = {size: got for size, x in by_size.items() if len(got := np.unique(np.concatenate(x)))}
        if not self.walks or not windows:
            return found
        padded = np.r_[s, np.zeros(self.most, np.int64)]
        starts = np.unique(np.concatenate(list(windows.values())))
        step = max(1, 4_000_000 // (self.walks * self.steps))
        for a in range(0, len(starts), step):
            some = starts[a : a + step]
            offsets = walk(padded, some, self.steps, self.walks, self.p.seed)
            for size, at in windows.items():
                own = np.flatnonzero(np.isin(some, at, assume_unique=True))
                if not len(own):
                    continue
                pick, keys, items = self.table[size]
                sig = self.signatures(padded, some[own], size, pick, offsets[own])
                low = np.searchsorted(keys, sig)
                hits = keys[np.minimum(low, len(keys) - 1)] == sig
                for w, t in zip(*np.nonzero(hits)):
                    k = low[w, t]
                    while k < len(keys) and keys[k] == sig[w, t]:
                        by_start = found.setdefault(int(items[k]), {})
                        start = int(some[own[w]])
                        by_start[start] = by_start.get(start, 0) + 1
                        k += 1
        return found

    def edits(self, item: int, passage: np.ndarray) -> int:
        """Least edit distance of the item to any part of the passage (bit-parallel, exact)."""
        x = self.items[item]
        n = len(x)
        if item not in self.masks:
            masks: dict[int, int] = {}
            for i, c in enumerate(x.tolist()):
                masks[c] = masks.get(c, 0) | 1 << i
            self.masks[item] = masks
        masks, full, top = self.masks[item], (1 << n) - 1, 1 << n - 1
        pv, mv, score = full, 0, n
        best = n
        for c in passage.tolist():
            eq = masks.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv) & full, pv & xh
            score += bool(ph & top) - bool(mh & top)
            ph, mh = ph << 1 & full, mh << 1 & full
            pv, mv = mh | ~(xv | ph) & full, ph & xv
            best = min(best, score)
        return best

    def matches(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """(item_id, word the best window starts at, edits, the item's words) of a whole text."""
        if not self.items:
            return []
        s = self.symbols(text)
        out = []
        for item, starts in self.candidates(s).items():
            n = int(self.size[item])
            most, best = self.p.allowed(n), None
            for start in sorted(starts, key=lambda x: (-starts[x], x)):
                if best and (best[0] == 0 or abs(start - best[1]) <= n):
                    continue
                if np.array_equal(s[start : start + n], self.items[item]):
                    e = 0
                else:
                    e = self.edits(item, s[max(0, start - most) : start + n + most])
                if e <= most and (best is None or (e, start) < best):
                    best = (e, start)
            if best:
                out.append((self.ids[item], best[1], best[0], n))
        return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, one block in memory at a time."""
    block, chars = [], 0
    for r in benchmark.select("item_id", "text").filter("text IS NOT NULL").distinct().orderBy("item_id", "text").toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or chars + len(r["text"]) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((r["item_id"], r["text"]))
        chars += len(r["text"])
    if block:
        yield block


MATCH = "doc_id long, item_id long, at_word int, edits int, item_words int"


def contaminated(docs: DataFrame, benchmark: DataFrame, p: Cgk = Cgk()) -> DataFrame:
    """docs (doc_id, text) -> doc_id, item_id, at_word, edits, item_words: a row for each document and item.

    The benchmark is a stated set searched block by block, each block one pass over the documents without
    a shuffle. Null and empty texts and items match nothing; an item without id is searched like any other
    and matches as null; an item that repeats under one id counts once; items of under five words match
    only exactly. Of equally good places of an item in a document the first is told. Repeated rows give
    repeated matches, a null doc_id stays null. Very long texts are searched whole, in steps of bounded
    memory; other columns are ignored; an empty table or benchmark gives no rows.
    """
    spark = docs.sparkSession
    found = None
    for items in blocks(benchmark):
        sent = spark.sparkContext.broadcast(ItemBlock(items, p))

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            block = sent.value
            for b in batches:
                rows = [(d, *m) for d, t in zip(b["doc_id"], b["text"]) for m in block.matches(t)]
                out = pd.DataFrame(rows, columns=["doc_id", "item_id", "at_word", "edits", "item_words"])
                yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(search, MATCH)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], MATCH) if found is None else found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, p: Cgk = Cgk()) -> DataFrame:
    """docs without the documents that hold a benchmark passage; rows without doc_id are judged by text.

    The search runs where the documents lie and its verdict is a column, so no text is shuffled. With
    several blocks of items, what a block leaves is written before the next, so that a worker holds one.
    """
    spark = docs.sparkSession

    def clean_of(sent):
        @F.pandas_udf("boolean")
        def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([not sent.value.matches(t) for t in texts], dtype=bool)

        return clean

    kept, path = docs, None
    for i, items in enumerate(blocks(benchmark)):
        if i:
            before = path
            kept, path = cut(kept)
            if before:
                forget(spark, before)
        kept = kept.filter(clean_of(spark.sparkContext.broadcast(ItemBlock(items, p)))(F.col("text")))
    return kept


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
