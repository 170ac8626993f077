"""Training: word counts, alphabet, and canonical BPE merges.

Counting is one partial and final aggregate. The merge loop works on distinct words: on the driver
with an incremental index while their number is below a checked bound, else as Spark jobs that each
settle as many merges as are certain. Both give the same merges: highest count first, ties to the
smaller pair of ids.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Container, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut, forget, shared_dir
from .model import Bpe, Options
from .pretokenize import kept_texts, pieces_of


@dataclass(frozen=True)
class TrainerOptions:
    min_frequency: int = 2
    vocab_size: int = 30_000
    special_tokens: tuple[str, ...] = ()
    limit_alphabet: int | None = None
    initial_alphabet: str = ""
    continuing_subword_prefix: str | None = None
    end_of_word_suffix: str | None = None
    max_token_length: int | None = None
    progress: Callable[[int, int, str], None] | None = None


def word_counts(df: DataFrame, text: str, pre_tokenizer=None) -> DataFrame:
    """(word, n): occurrences of each kept, non-empty piece. Null texts count for nothing."""
    words = F.explode(kept_texts(pieces_of(F.col(text), pre_tokenizer)))
    return df.filter(F.col(text).isNotNull()).select(words.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def merged_counts(*counts: DataFrame) -> DataFrame:
    """Word counts of several feeds as one."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("word").agg(F.sum("n").alias("n"))


def alphabet(counts: DataFrame, o: TrainerOptions) -> DataFrame:
    """(c, n, forced): characters by weight; those of initial_alphabet are forced, whatever their count."""
    seen = counts.select(F.explode(F.split("word", "")).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n"))
    forced = counts.sparkSession.createDataFrame([(c,) for c in sorted(set(o.initial_alphabet))], "c string").withColumn("forced", F.lit(True))
    both = seen.join(forced, "c", "full").select("c", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("forced", F.lit(False)).alias("forced")).filter("c <> ''")
    both = both.orderBy(F.desc("forced"), F.desc(F.when(F.col("forced"), 0).otherwise(F.col("n"))), F.ascii("c"))
    return both.limit(o.limit_alphabet) if o.limit_alphabet is not None else both


def pair_counts(words: DataFrame) -> DataFrame:
    """(a, b, n): adjacent pairs of words(ids array<int>, n), weighted."""
    pairs = F.explode(F.arrays_zip(F.slice("ids", F.lit(1), F.greatest(F.size("ids") - 1, F.lit(0))).alias("a"), F.slice("ids", F.lit(2), F.size("ids")).alias("b")))
    return words.filter(F.size("ids") > 1).select(pairs.alias("p"), "n").groupBy("p.a", "p.b").agg(F.sum("n").alias("n"))


def best_pair(pairs: DataFrame) -> DataFrame:
    """The pair with the highest count, ties to the smaller ids."""
    return pairs.orderBy(F.desc("n"), "a", "b").limit(1)


class _State:
    """Vocabulary, sizes and merges while training goes on."""

    def __init__(self, o: TrainerOptions, chars: list[str]):
        self.o, self.vocab, self.merges = o, {}, []
        for t in [*o.special_tokens, *chars]:
            self.vocab.setdefault(t, len(self.vocab))
        self.names = {i: t for t, i in self.vocab.items()}
        self.done: dict[tuple[int, int], int] = {}  # in order of rank
        self.unused: set[tuple[int, int]] = set()  # recorded, not applied
        self.remade = False  # a token has come about in a second way
        self.kept = {c: self.vocab[c] for c in chars}
        self.bytes = {i: len(c.encode("utf-8")) for c, i in self.kept.items()}

    def composites(self, totals: dict[str, int]) -> None:
        """Ids for characters with prefix or suffix, by count, then by string."""
        for t in sorted(totals, key=lambda t: (-totals[t], t)):
            if t not in self.vocab:
                self.vocab[t] = len(self.vocab)
                self.names[self.vocab[t]] = t

    def add(self, a: int, b: int) -> tuple[int, bool]:
        """Record a merge: (its token's id, whether it is applied)."""
        prefix = self.o.continuing_subword_prefix or ""
        right = self.names[b]
        token = self.names[a] + (right[len(prefix) :] if prefix and right.startswith(prefix) else right)
        self.remade = token in self.vocab
        new = self.vocab.setdefault(token, len(self.vocab))
        self.names[new] = token
        self.merges.append((self.names[a], right))
        self.done[a, b] = new
        size = self.bytes.get(a, 0) + self.bytes.get(b, 0)
        self.bytes.setdefault(new, size)
        if self.o.max_token_length is not None and size > self.o.max_token_length:
            self.unused.add((a, b))
        if self.o.progress:
            self.o.progress(len(self.vocab), self.o.vocab_size, "Compute merges")
        return new, (a, b) not in self.unused

    @property
    def full(self) -> bool:
        return len(self.vocab) >= self.o.vocab_size

    def model(self, options: Options | None) -> Bpe:
        o = replace(options or Options(), continuing_subword_prefix=self.o.continuing_subword_prefix, end_of_word_suffix=self.o.end_of_word_suffix)
        return Bpe(dict(self.vocab), tuple(self.merges), o, strip_prefix=True)


def _local(state: _State, words: list[tuple[list[int], int]]) -> None:
    """Incremental merge loop over distinct words in memory."""
    import heapq

    counts: dict[tuple[int, int], int] = defaultdict(int)
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for w, (ids, n) in enumerate(words):
        for p in zip(ids, ids[1:]):
            counts[p] += n
            where[p].add(w)
    queue = [(-n, p) for p, n in counts.items()]
    heapq.heapify(queue)
    least = max(1, state.o.min_frequency)
    while queue and not state.full:
        n, p = heapq.heappop(queue)
        if counts.get(p, 0) != -n or p in state.done:
            continue
        if -n < least:
            break
        _apply(state, p, words, counts, where, queue)


def _apply(state: _State, p, words, counts, where, queue) -> None:
    import heapq

    new, applied = state.add(*p)
    if not applied:
        return
    rank = {q: i for i, q in enumerate(state.done)} if state.remade else {}
    todo = [(len(state.done), p, new)]
    while todo:
        _, p, new = heapq.heappop(todo)
        changed: set[tuple[int, int]] = set()
        for w in where.pop(p, ()):
            ids, n = words[w]
            out = _replaced(ids, p, new)
            if len(out) == len(ids):
                continue
            for q in zip(ids, ids[1:]):
                counts[q] -= n
                changed.add(q)
            for q in zip(out, out[1:]):
                counts[q] += n
                where[q].add(w)
                changed.add(q)
            words[w] = (out, n)
        for q in changed:
            if counts[q] <= 0:
                counts.pop(q)
            elif q not in state.done:
                heapq.heappush(queue, (-counts[q], q))
            elif q not in state.unused and rank:
                heapq.heappush(todo, (rank[q], q, state.done[q]))  # an old pair is adjacent again


def _replaced(ids: list[int], p: tuple[int, int], new: int) -> list[int]:
    out, i = [], 0
    while i < len(ids):
        if i + 1 < len(ids) and (ids[i], ids[i + 1]) == p:
            out.append(new)
            i += 2
        else:
            out.append(ids[i])
            i += 1
    return out


def _replaced_text(text: Column, merges: list[tuple[int, int, int]]) -> Column:
    """Ids written as "<1><2>" after merges, in order: one expression, however many there are."""
    if not merges:
        return text
    steps = F.array(*(F.struct(F.lit(f"<{a}><{b}>").alias("f"), F.lit(f"<{new}>").alias("t")) for a, b, new in merges))
    return F.aggregate(steps, text, lambda done, m: F.replace(done, m["f"], m["t"]))


def _ids_of(text: Column) -> Column:
    return F.transform(F.split(F.btrim(text, F.lit("<>")), "><"), lambda x: x.cast("int"))


def certain_merges(top: list[tuple[int, int, int]], full_list: bool, done: Container[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Leading pairs whose order no merge before them can change, from the highest counts (a, b, n).

    Merging (a, b) makes pairs (x, ab) and (ab, y), at most as often as itself and as (x, a) and (b, y)
    occur, and lowers the counts of pairs (x, a) and (b, y) only. So a pair that ends in no left part and
    starts with no right part of the merges before it, and occurs more often than all that they can make,
    is next for certain. Pairs in done are no candidates, but count for what can be made.
    """
    floor = 0 if full_list or not top else top[-1][2]
    starts: dict[int, int] = {}
    ends: dict[int, int] = {}
    for a, b, n in top:
        starts[a], ends[b] = max(starts.get(a, floor), n), max(ends.get(b, floor), n)
    out: list[tuple[int, int]] = []
    lefts: set[int] = set()
    rights: set[int] = set()
    made = 0
    for a, b, n in top:
        if (a, b) in done:
            continue
        if out and (n <= made or a in rights or b in lefts):
            break
        out.append((a, b))
        lefts.add(a)
        rights.add(b)
        made = max(made, min(n, max(ends.get(a, floor), starts.get(b, floor))))
    return out


class _Tables:
    """Distinct words, as ids written "<1><2>", and the counts of their pairs, as tables in a shared folder.

    A batch of merges reads the words once; only words that hold one of its pairs are split, and what they
    gain and lose is added to the counts. Words are written anew after so many merges; until then these
    are one expression on top of the table, so the plan is as small in the last round as in the first.
    """

    def __init__(self, words: DataFrame, folder: str, written: int = 64):
        self.spark, self.folder, self.written = words.sparkSession, folder, written
        self.pending: list[tuple[int, int, int]] = []
        self.words, self.words_path = self.keep(words)
        self.pairs, self.pairs_path = self.keep(pair_counts(self.words.select(_ids_of(F.col("e")).alias("ids"), "n")))

    def keep(self, df: DataFrame) -> tuple[DataFrame, str]:
        return cut(df, self.folder)

    def apply(self, merges: list[tuple[int, int, int]]) -> None:
        if not merges:
            return
        now = self.words.select(_replaced_text(F.col("e"), self.pending).alias("e"), "n")
        pairs = F.array(*(F.lit(f"<{a}><{b}>") for a, b, _ in merges))
        touched = now.filter(F.exists(pairs, lambda p: F.contains(F.col("e"), p)))
        both = F.array(
            F.struct(_ids_of(F.col("e")).alias("ids"), (-F.col("n")).alias("n")),
            F.struct(_ids_of(_replaced_text(F.col("e"), merges)).alias("ids"), F.col("n").alias("n")),
        )
        change = pair_counts(touched.select(F.explode(both).alias("x")).select("x.*"))
        old = self.pairs_path
        self.pairs, self.pairs_path = self.keep(self.pairs.unionByName(change).groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n > 0"))
        forget(self.spark, old)
        self.pending += merges
        if len(self.pending) >= self.written:
            old = self.words_path
            self.words, self.words_path = self.keep(self.words.select(_replaced_text(F.col("e"), self.pending).alias("e"), "n"))
            forget(self.spark, old)
            self.pending = []

    def best(self, n: int) -> list[tuple[int, int, int]]:
        return [(r["a"], r["b"], r["n"]) for r in self.pairs.orderBy(F.desc("n"), "a", "b").limit(n).collect()]

    def adjacent(self, merged: list[tuple[int, int]]) -> bool:
        """Whether any of these pairs occurs; there are at most vocab_size of them."""
        old = self.spark.createDataFrame(merged, "a int, b int")
        return not self.pairs.join(F.broadcast(old), ["a", "b"], "left_semi").isEmpty()

    def close(self) -> None:
        forget(self.spark, self.words_path)
        forget(self.spark, self.pairs_path)


def _spark(state: _State, words: DataFrame, folder: str, top: int = 2000) -> None:
    """Merge loop as Spark jobs over words (e, n): each round settles all merges that are certain."""
    least = max(1, state.o.min_frequency)
    tables = _Tables(words, folder)
    while not state.full:
        most = top + len(state.unused)
        best = tables.best(most)
        sure = certain_merges(best, len(best) < most, state.done)
        count = {(a, b): n for a, b, n in best}
        if not sure or count[sure[0]] < least:
            break
        applied = []
        for p in sure:
            if count[p] < least or state.full:
                break
            new, use = state.add(*p)
            if use:
                applied.append((*p, new))
            if state.remade:
                break  # pairs merged before may be adjacent again
        tables.apply(applied)
        while state.remade and tables.adjacent([p for p in state.done if p not in state.unused]):
            tables.apply([(*p, new) for p, new in state.done.items() if p not in state.unused])
    tables.close()


def train(counts: DataFrame, o: TrainerOptions, options: Options | None = None, local_words: int = 2_000_000, folder: str | None = None) -> Bpe:
    """A model from word counts (word, n). Nothing counted is an error.

    The counts are written to folder (shared by the executors, by default the one of shared_dir()), so that
    the corpus is read once. The driver holds at most local_words distinct words; with more, the words stay
    there and each round is a job. The alphabet is at most all of Unicode, and it and its forms with prefix
    and suffix are all else that the driver holds.
    """
    counts, path = cut(counts.select("word", "n"), folder)
    try:
        return _trained(counts, o, options, local_words, folder)
    finally:
        forget(counts.sparkSession, path)


def _trained(counts: DataFrame, o: TrainerOptions, options: Options | None, local_words: int, folder: str | None) -> Bpe:
    distinct = counts.count()
    if not distinct:
        raise ValueError("nothing was counted; feed texts first")
    chars = [r["c"] for r in alphabet(counts, o).collect()]
    state = _State(o, chars)
    prefix, suffix = o.continuing_subword_prefix or "", o.end_of_word_suffix or ""
    own = {(c, c): 0 for c in state.kept}
    if prefix or suffix:
        at = F.split("word", "")
        shaped = F.transform(at, lambda c, i: F.struct(c.alias("c"), F.concat(F.when(i > 0, prefix).otherwise(""), c, F.when(i == F.size(at) - 1, suffix).otherwise("")).alias("t")))
        forms = counts.select(F.explode(shaped).alias("x"), "n").groupBy("x.c", "x.t").agg(F.sum("n").alias("n"))
        own = {(r["c"], r["t"]): r["n"] for r in forms.collect() if r["c"] in state.kept}
    totals: dict[str, int] = defaultdict(int)
    for (_, t), n in own.items():
        totals[t] += n
    state.composites(totals)
    for c, t in own:
        state.bytes.setdefault(state.vocab[t], len(c.encode("utf-8")))
    ids = {t: state.vocab[t] for _, t in own}

    def spelled(word: str, ids: dict[str, int], kept: Container[str]) -> list[int]:
        last = len(word) - 1
        return [ids[prefix * (i > 0) + c + suffix * (i == last)] for i, c in enumerate(word) if c in kept]

    if distinct <= local_words:
        words = ((spelled(r["word"], ids, state.kept), r["n"]) for r in counts.toLocalIterator())
        _local(state, [(w, n) for w, n in words if w])
        return state.model(options)
    spark = counts.sparkSession
    sent = spark.sparkContext.broadcast((ids, set(state.kept)))

    @F.pandas_udf("string")
    def written(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(["".join(f"<{i}>" for i in spelled(w, *sent.value)) for w in batch], dtype=object)

    _spark(state, counts.select(written("word").alias("e"), "n").filter("e <> ''"), folder or shared_dir(spark))
    return state.model(options)


def train_on(df: DataFrame, text: str, o: TrainerOptions, pre_tokenizer=None, **more) -> Bpe:
    return train(word_counts(df, text, pre_tokenizer), o, **more)
