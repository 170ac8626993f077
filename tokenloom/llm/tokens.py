r"""Exact token counts of byte-level BPE by prefix dynamic programming.

For every prefix of a piece of text the table holds its last token and its token count. The last
token of a prefix is the one vocabulary entry that ends it, follows the last token of the prefix
before it, and stays apart from that token when the two are encoded together; the count is one more
than that prefix's. So the table is filled in one pass and kept, and truncation and budget questions are
look-ups in it. Pieces are what the vocabulary's pattern splits off; special strings stand for one token.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytechars import BACK
from ..functions.regex_compat import GPT2
from ..sources.tables import read_table

#: Pieces whose counts a worker keeps; beyond, the memory is emptied and filled anew.
KEPT_PIECES = 600_000
SPACES = regex.compile(r"\s+")


class PrefixCounter:
    """Token counts for one vocabulary, given as the text of its tokenizer file."""

    def __init__(self, file_text: str):
        told = json.loads(file_text)
        model, back = told["model"], BACK
        if (told["pre_tokenizer"] or {}).get("type") != "ByteLevel" or told["normalizer"] or told["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level vocabularies without normalizer or prefix space are handled")
        special = {x["content"]: x["id"] for x in told["added_tokens"]}
        raw = lambda s: bytes(back[c] for c in s)
        self.vocab = {raw(t): i for t, i in model["vocab"].items() if t not in special}
        self.text = {i: t for t, i in self.vocab.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            a, b = raw(a), raw(b)
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        # what ends a token: its id, or -1 where only longer texts are tokens
        self.ends = {t[i:]: -1 for t in self.vocab for i in range(1, len(t))} | self.vocab
        # how each token is made: (rank, left, right), if in one way and from tokens made before it
        self.made = {new: (rank, a, b) for (a, b), (rank, new) in self.merges.items()}
        rank_of = {t: rank for t, (rank, _, _) in self.made.items()}
        self.one_way = len(self.made) == len(self.merges) and all(max(rank_of.get(a, -1), rank_of.get(b, -1)) < rank for rank, a, b in self.made.values())
        self.split = regex.compile(GPT2)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.apart: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.counts: dict[str, int] = {}
        self.tables: dict[str, tuple[int, ...]] = {}

    def encode(self, b: bytes) -> list[int]:
        """Reference encoding of a short byte string: merge the lowest rank, leftmost first."""
        ids = [self.vocab[b[i : i + 1]] for i in range(len(b))]
        while len(ids) > 1:
            (rank, new), i = min(((self.merges.get(p, (1 << 60, -1)), i) for i, p in enumerate(zip(ids, ids[1:]))), key=lambda x: (x[0][0], x[1]))
            if new < 0:
                break
            ids[i : i + 2] = [new]
        return ids

    def stays_apart(self, a: int, b: int) -> bool:
        key = a << 32 | b
        if (known := self.apart.get(key)) is None:
            if len(self.apart) > 4 * KEPT_PIECES:
                self.apart.clear()
            known = self.apart[key] = self.no_merge_across(a, b) if self.one_way else self.encode(self.text[a] + self.text[b]) == [a, b]
        return known

    def edge(self, t: int, right: bool) -> list[tuple[int, float, float]]:
        """(part, rank it is made at, rank it is used up at) of the parts that stand at one edge of a token."""
        out, until = [], float("inf")
        while t in self.made:
            rank, a, b = self.made[t]
            out.append((t, rank, until))
            t, until = (b if right else a), rank
        return [*out, (t, -1, until)]

    def no_merge_across(self, a: int, b: int) -> bool:
        """Whether no merge joins the parts that stand at the border of a and b at the same time.

        Of equal merges the leftmost comes first: a's own before one across, one across before b's own.
        """
        edge_b = self.edge(b, False)
        for x, made_x, used_x in self.edge(a, True):
            for y, made_y, used_y in edge_b:
                if (m := self.merges.get((x, y))) and made_x < m[0] < used_x and made_y < m[0] <= used_y:
                    return False
        return True

    def is_whole(self, a: int) -> bool:
        if (known := self.whole.get(a)) is None:
            known = self.whole[a] = self.encode(self.text[a]) == [a]
        return known

    def table(self, piece: bytes) -> list[int]:
        """Token counts of all prefixes of a piece, from the empty one on."""
        ends, get = self.ends, self.apart.get
        n = len(piece)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for start in range(i - 1, -1, -1):
                t = ends.get(piece[start:i])
                if t is None:
                    break  # nothing longer is the end of a token
                if t < 0:
                    continue
                if not start:
                    fits = self.is_whole(t)
                else:
                    fits = get(last[start] << 32 | t)
                    if fits is None:
                        fits = self.stays_apart(last[start], t)
                if fits:
                    last[i], count[i] = t, count[start] + 1
                    break
        return count

    def piece_count(self, piece: str) -> int:
        if (n := self.counts.get(piece)) is None:
            if len(self.counts) >= KEPT_PIECES:
                self.counts.clear()
            n = self.table(piece.encode("utf-8", "surrogatepass"))[-1]
            if len(piece) < 200:
                self.counts[piece] = n
        return n

    def parts(self, text: str) -> Iterator[tuple[int, str, bool]]:
        """(start, text, special?) of a text, split at the special strings."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            if m.start() > at:
                yield at, text[at : m.start()], False
            yield m.start(), m[0], True
            at = m.end()
        if at < len(text):
            yield at, text[at:], False

    def count(self, text: str) -> int:
        total, known = 0, self.counts.get
        for _, part, special in self.parts(text):
            if special:
                total += 1
                continue
            for piece in self.split.findall(part):
                n = known(piece)
                total += self.piece_count(piece) if n is None else n
        return total

    def prefix_counts(self, piece: str) -> tuple[int, ...]:
        """Token counts of the prefixes of a piece in code points, from the empty one on, each a text of its own."""
        if (known := self.tables.get(piece)) is None:
            raw = piece.encode("utf-8", "surrogatepass")
            counts = self.table(raw)
            if len(raw) == len(piece):
                known = tuple(counts)
            else:
                ends = accumulate((len(c.encode("utf-8", "surrogatepass")) for c in piece), initial=0)
                known = tuple(counts[e] for e in ends)
            if len(piece) == 3 and piece[0] == "'" and len(self.split.findall(piece[:2])) > 1:
                known = (*known[:2], self.count(piece[:2]), known[3])  # "'re" cut short is two pieces
            if len(piece) < 200:
                if len(self.tables) >= KEPT_PIECES // 8:
                    self.tables.clear()
                self.tables[piece] = known
        return known

    def prefixes(self, text: str) -> "PrefixTable":
        return PrefixTable(self, text)

    def truncate(self, text: str, budget: int) -> int:
        """Code points of the longest prefix that is a text of at most so many tokens.

        Counts at the ends of pieces never fall, so the prefix ends near the first piece over the budget:
        what follows it is not read, and only prefixes from the last settled places on are looked up.
        """
        total, known = 0, self.counts.get
        last = before = (0, 0)  # the last two places that no longer text can split elsewhere, and tokens before them

        def found(end: int) -> int:
            start, spent = before
            return start + PrefixTable(self, text[start:end]).truncate(budget - spent)

        for at, part, special in self.parts(text):
            if special:
                total += 1
                if total > budget:
                    return found(at + len(part))
                last, before = (at + len(part), total), last
                continue
            after_space = False
            for m in self.split.finditer(part):
                piece = m[0]
                if not after_space:
                    last, before = (at + m.start(), total), last
                n = known(piece)
                total += self.piece_count(piece) if n is None else n
                # white space may go with what follows it, so only the end of another piece settles it
                after_space = piece.isspace()
                if total > budget and not after_space:
                    return found(at + m.end())
        return found(len(text)) if total > budget else len(text)


class PrefixTable:
    """Exact token counts of all prefixes (in code points) of one text, each taken as a text of its own.

    The counts of a piece's prefixes are stored once for each different piece, and a prefix's count is
    that of the pieces before plus one stored number, so answers are look-ups. A run of white space has a
    table of its own: a text that ends within it takes the run as one piece, and one that goes on leaves
    its last character to what follows. Prefixes that end inside a special string are ordinary text there.
    """

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        # entry: first prefix it answers, where its piece starts, tokens before that, counts of its prefixes
        self.entries: list[tuple[int, int, int, tuple[int, ...]]] = []
        total, tail = 0, (0, 0)  # the last place that no longer text can split elsewhere, and tokens before it
        for at, part, special in counter.parts(text):
            if special:
                start, before = tail if tail[0] < at else (at, total)
                cut = [counter.count(text[start : at + k]) - total + before for k in range(1, len(part))]
                total += 1
                self.entries.append((at + 1, at, total - 1, (0, *cut, 1)))
                tail = (at + len(part), total)
                continue
            run_end = 0
            for m in counter.split.finditer(part):
                a, b = m.span()
                if a >= run_end and (run := SPACES.match(part, a)):
                    run_end = run.end()
                    tail = (at + a, total)
                    self.entries.append((at + a + 1, at + a, total, counter.prefix_counts(part[a:run_end])))
                if b > run_end:
                    if a >= run_end:
                        tail = (at + a, total)
                    self.entries.append((at + max(a, run_end) + 1, at + a, total, counter.prefix_counts(m[0])))
                total += counter.piece_count(m[0])
        self.total = total
        self.firsts = [e[0] for e in self.entries]
        self.befores = [e[2] for e in self.entries]

    def count_at(self, n: int) -> int:
        """Tokens of text[:n]."""
        n = min(max(n, 0), len(self.text))
        if not n:
            return 0
        _, start, before, counts = self.entries[bisect_right(self.firsts, n) - 1]
        return before + counts[n - start]

    def truncate(self, budget: int) -> int:
        """The longest prefix of at most so many tokens."""
        last = len(self.text)
        for k in range(bisect_right(self.befores, budget) - 1, -1, -1):
            first, start, before, counts = self.entries[k]
            end = self.firsts[k + 1] - 1 if k + 1 < len(self.entries) else last
            for n in range(end, first - 1, -1):
                if before + counts[n - start] <= budget:
                    return n
        return 0


_COUNTERS: dict[int, PrefixCounter] = {}


def counter_for(file_text: str) -> PrefixCounter:
    """One counter for each vocabulary and worker."""
    key = hash(file_text)
    if key not in _COUNTERS:
        _COUNTERS[key] = PrefixCounter(file_text)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, file_text: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """Adds n_bytes, n_tokens, over_limit (n_tokens > limit) and fits_chars to every row.

    fits_chars: code points of the longest prefix of at most limit tokens, looked up in the stored counts.
    Null texts count as empty (0 tokens, prefix 0). Rows and other columns stay, repeated rows too; columns
    of those four names are replaced; an empty table gives no rows. Very long texts, and very long pieces
    of them, take time in proportion to their length. The vocabulary file (a few MB, its size fixed by the
    tokenizer) is broadcast; each worker keeps a bounded number of pieces.
    """
    told = docs.sparkSession.sparkContext.broadcast(file_text)

    @F.pandas_udf("n long, fits long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = counter_for(told.value)
        for texts in batches:
            counts = [counter.count(t) if t else 0 for t in texts]
            fits = [len(t or "") if n <= limit else counter.truncate(t, limit) for n, t in zip(counts, texts)]
            yield pd.DataFrame({"n": pd.Series(counts, dtype="int64"), "fits": pd.Series(fits, dtype="int64")})

    counted = docs.select(*(c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit", "fits_chars")), tokens(F.col(text)).alias("_told"))
    return (
        counted.withColumn("n_bytes", F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long"))
        .withColumn("n_tokens", F.col("_told.n"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
        .withColumn("fits_chars", F.col("_told.fits"))
        .drop("_told")
    )


def with_prefix_tokens(docs: DataFrame, file_text: str, text: str = "text") -> DataFrame:
    """Adds prefix_tokens, array<int>: the count at every prefix of the text, the empty one first.

    Questions of budget are then expressions on the array: tokens_at(), chars_within(). Null is like empty.
    """
    told = docs.sparkSession.sparkContext.broadcast(file_text)

    @F.pandas_udf("array<int>")
    def stored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = counter_for(told.value)
        for texts in batches:
            tables = (counter.prefixes(t or "") for t in texts)
            yield pd.Series([[x.count_at(n) for n in range(len(x.text) + 1)] for x in tables], dtype=object)

    return docs.withColumn("prefix_tokens", stored(F.col(text)))


def tokens_at(n: int) -> Column:
    """Tokens of the first n code points, from prefix_tokens."""
    return F.element_at("prefix_tokens", F.least(F.lit(n + 1), F.size("prefix_tokens")))


def chars_within(budget: int) -> Column:
    """Code points of the longest prefix of at most so many tokens, from prefix_tokens."""
    fits = F.transform(F.reverse("prefix_tokens"), lambda x: x <= budget)
    return F.size("prefix_tokens") - F.array_position(fits, True).cast("int")


def vocabulary(name: str = "byte_bpe_50k.json", path: str | None = None) -> str:
    """The text of a tokenizer file: of path if given, else of the installed public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return count_tokens(docs, vocabulary(), 1024).select("doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars")
