"""SimHash near-duplicates: fingerprints, candidate buckets, pivot distance tables, components.

Every document gets a fingerprint of 64 bits or a multiple. Distinct fingerprints meet in buckets:
for 64 bits, pairs of five blocks (two fingerprints that differ in at most 3 bits agree in two blocks
at least, so no link is lost); for wide ones, sampled bits. In a bucket, Hamming distances to the
reference fingerprints (the pivots) are tabled beforehand, and a pair is discarded when the largest
difference of its coordinates is over the radius; survivors are verified on all bits. Where the radius is
wide, whole fingerprints are too far from any pivot for that to tell much; so their bits are cut into
parts, each part has its own coordinates, and the largest differences of the parts, which bound the parts'
distances from below, are added up. A bucket gives the edges of a spanning forest, never all its pairs;
very large buckets are dealt out in pairs of blocks, so their work grows with the square of the bucket.

Where a similarity is asked for, these links only propose: the documents of each component of them are
brought together with their sets of shingles, and a forest of links of that Jaccard similarity is taken.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import components, cut


@dataclass(frozen=True)
class SimHash:
    """Parameters. words: 64-bit words of a fingerprint; radius: differing bits that still link.

    With one word and a radius of up to 3 candidates are complete. Else tables keys of key_bits sampled
    bits are used; the chance that a pair at the radius is met is recall().

    With a similarity above 0, each distinct shingle has one vote, and links are those of this Jaccard
    similarity of the sets of shingles among the ones within the radius.

    carried: words that the radius is about and that go to the buckets, all if 0; keys are sampled from all.
    parts: how many parts of equal size the pivots' distances are kept for.
    """

    shingle: int = 3
    words: int = 1
    radius: int = 3
    pivots: int = 16
    tables: int = 64
    key_bits: int = 20
    block: int = 8192
    seed: int = 42
    similarity: float = 0.0
    carried: int = 0
    parts: int = 1

    @property
    def held(self) -> int:
        return self.carried or self.words

    @property
    def exact(self) -> bool:
        return self.words == 1 and self.radius <= 3

    def recall(self, share: float) -> float:
        """Chance that two fingerprints with this share of differing bits meet in a table."""
        return 1.0 if self.exact else 1 - (1 - (1 - share) ** self.key_bits) ** self.tables

    @staticmethod
    def for_similarity(similarity: float = 0.8, shingle: int = 5, words: int = 8, carried: int = 4, tables: int = 96, key_bits: int = 16, **more) -> "SimHash":
        """Links of a Jaccard similarity of the shingles, verified; a radius of three standard deviations more
        than the bits in which such texts are expected to differ. expected_recall(0.8) is 0.99."""
        share = differing(similarity)
        bits = 64 * carried
        radius = round(bits * share + 3 * math.sqrt(bits * share * (1 - share)))
        return SimHash(shingle=shingle, words=words, carried=carried, radius=radius, pivots=6, parts=4 * carried, tables=tables, key_bits=key_bits, similarity=similarity, **more)

    def expected_recall(self, similarity: float) -> float:
        """Chance that texts of this similarity are within the radius and meet in a table."""
        share = differing(similarity)
        chance = lambda bits, d: math.comb(bits, d) * share**d * (1 - share) ** (bits - d)
        bits = 64 * self.words
        met = sum(chance(bits, d) * self.recall(d / bits) for d in range(bits + 1))
        return met * sum(chance(64 * self.held, d) for d in range(self.radius + 1))


def differing(similarity: float) -> float:
    """The share of bits in which texts of this Jaccard similarity are expected to differ, at most."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def mixed(h: np.ndarray, words: int) -> np.ndarray:
    """(n, words) 64-bit hashes from one: the hash itself, then its mixes with a counter."""
    if words == 1:
        return h[:, None]
    step = np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = h[:, None] + step[None, :]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    z[:, 0] = h
    return z


def shingles(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """64-bit hashes of the shingles, in order; a text of fewer words is one shingle, one of none has none."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    count = max(1, len(w) - shingle + 1) if w else 0
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(w[i : i + shingle]), seed) for i in range(count)), np.uint64, count)


def voted(h: np.ndarray, words: int) -> bytes:
    """Big-endian words; a bit is 1 if set in over half of the hashes. No hashes: zero."""
    if not len(h):
        return bytes(8 * words)
    votes = np.zeros(64 * words, np.int64)
    for at in range(0, len(h), 4096):
        wide = mixed(h[at : at + 4096], words).astype(">u8")
        votes += np.unpackbits(wide.view(np.uint8).reshape(len(wide), 8 * words), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(h)).tobytes()


def fingerprint(text: str | None, shingle: int, words: int = 1, seed: int = 42) -> bytes:
    """Every shingle has a vote, repeats too."""
    return voted(shingles(text, shingle, seed), words)


def shingle_set(text: str | None, p: SimHash) -> tuple[np.ndarray, bytes]:
    """The distinct hashes, in order of size, and a name of the set."""
    h = np.unique(shingles(text, p.shingle, p.seed))
    return h, hashlib.md5(h.tobytes()).digest()


def with_fingerprints(docs: DataFrame, p: SimHash, text: str = "text") -> DataFrame:
    """doc_id, fp and, where a similarity is asked for, the name of the set of shingles."""

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, p.shingle, p.words, p.seed) for t in texts], dtype=object)

    @F.pandas_udf("fp binary, name binary")
    def of_sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = (shingle_set(t, p) for t in texts)
            yield pd.DataFrame([(voted(h, p.words), name) for h, name in sets], columns=["fp", "name"], dtype=object)

    if p.similarity:
        return docs.select("doc_id", of_sets(F.col(text)).alias("_made")).select("doc_id", "_made.*")
    return docs.select("doc_id", of(F.col(text)).alias("fp"))


def unpack(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) bytes of a binary column whose values are all of that width."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def pivot_bits(p: SimHash) -> np.ndarray:
    return np.random.default_rng(p.seed).integers(0, 1 << 64, (p.pivots, p.held), dtype=np.uint64)


def pivot_table(words: np.ndarray, p: SimHash) -> np.ndarray:
    """(rows, pivots, parts) Hamming distances to the reference fingerprints."""
    short = np.ascontiguousarray(words).view(np.uint16)
    out = np.empty((len(words), p.pivots, p.parts), np.int16 if p.parts < 4 * p.held else np.int8)
    for k, ref in enumerate(pivot_bits(p)):
        differs = np.bitwise_count(short ^ ref.view(np.uint16))
        out[:, k] = differs.reshape(len(words), p.parts, -1).sum(axis=2)
    return out


def bucket_keys(fp: np.ndarray, p: SimHash) -> np.ndarray:
    """(rows, tables) bucket keys of fingerprints given as bytes, the table's number above bit 40."""
    if p.exact:
        x = fp.view(">u8")[:, 0].astype(np.uint64)
        cuts = (0, 13, 26, 39, 52, 64)
        part = [(x >> np.uint64(a)) & np.uint64((1 << b - a) - 1) for a, b in zip(cuts, cuts[1:])]
        keys = [part[i] << np.uint64(13) | part[j] for i in range(5) for j in range(i)]
    else:
        bits = np.unpackbits(fp, axis=1)
        rng = np.random.default_rng(p.seed + 1)
        weight = np.uint64(1) << np.arange(p.key_bits, dtype=np.uint64)
        keys = [(bits[:, rng.choice(bits.shape[1], p.key_bits, replace=False)].astype(np.uint64) * weight).sum(axis=1, dtype=np.uint64) for _ in range(p.tables)]
    return np.stack([k | np.uint64(t) << np.uint64(40) for t, k in enumerate(keys)], axis=1).astype(np.int64)


def near(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, radius: int) -> np.ndarray:
    """Which rows of a and b (or a row and rows) are within the radius: pivots first, then all bits."""
    ok = np.abs(pa_ - pb).max(axis=1).sum(axis=1, dtype=np.int32) <= radius
    at = np.flatnonzero(ok)
    if len(at):
        left, right = (x if x.ndim == 1 else x[at] for x in (a, b))
        ok[at] = np.bitwise_count(left ^ right).sum(axis=1) <= radius
    return ok


def forest(n: int, close: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Spanning forest of n rows: each reached row is compared with rows not reached yet only."""
    edges, left = [], np.arange(n)
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = close(i, left)
            if hit.any():
                found = left[hit].tolist()
                edges += [(i, j) for j in found]
                queue += found
                left = left[~hit]
    return edges


SMALL = 6


def linked(group: np.ndarray, nodes: np.ndarray, words: np.ndarray, p: SimHash) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the nodes of equal groups; rows come sorted by group."""
    table = pivot_table(words, p)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, len(group)])
    own = np.repeat(size, size)
    us, vs = [], []
    for s in range(1, SMALL):
        at = np.flatnonzero((group[s:] == group[:-s]) & (own[s:] <= SMALL))
        if not len(at):
            break
        at = at[near(words[at], words[at + s], table[at], table[at + s], p.radius)]
        us.append(nodes[at]), vs.append(nodes[at + s])
    for k in np.flatnonzero(size > SMALL):
        a, b = start[k], start[k] + size[k]
        w, t = words[a:b], table[a:b]
        if e := forest(b - a, lambda i, left: near(w[i], w[left], t[i], t[left], p.radius)):
            e = np.array(e) + a
            us.append(nodes[e[:, 0]]), vs.append(nodes[e[:, 1]])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def links(classes: DataFrame, p: SimHash) -> DataFrame:
    """classes (node long, fp) with distinct fp -> edges (u, v) that span each class of links."""
    spark = classes.sparkSession
    width = 8 * p.words
    number = 10 if p.exact else p.tables

    def emit(batches: Iterator[pa.RecordBatch], full: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            bits = unpack(b["fp"], width)
            keys = bucket_keys(bits, p).ravel()
            if not full:
                yield pa.RecordBatch.from_arrays([pa.array(keys)], ["key"])
                continue
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * (8 * p.held)
            fp = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(bits[:, : 8 * p.held]))])
            for at in range(0, b.num_rows, 2000):
                own = pa.array(np.repeat(np.arange(at, min(at + 2000, b.num_rows)), number))
                yield pa.RecordBatch.from_arrays([pa.array(keys[at * number : (at + 2000) * number]), b["node"].take(own), fp.take(own)], ["key", "node", "fp"])

    rows = classes.mapInArrow(lambda x: emit(x, True), "key long, node long, fp binary")
    counts = classes.mapInArrow(lambda x: emit(x, False), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot, _ = cut(counts.filter(F.col("n") > p.block))
    rows = rows.withColumns({"lo": F.lit(0), "hi": F.lit(0)})
    if n_hot := hot.count():
        blocks = F.ceil(F.col("n") / p.block).cast("int")
        own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
        many = F.broadcast(hot) if n_hot <= 100_000 else hot  # 16 bytes each
        rows = rows.join(many, "key", "left").withColumn("own", F.coalesce(own, F.lit(0)))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(blocks, F.lit(1)) - 1)))
        rows = rows.select("key", "node", "fp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    dealt = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []

        def out(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            key, lo, hi, node, words = (np.concatenate(x) for x in zip(*parts))
            group = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
            u, v = linked(group, node, words, p)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            words = unpack(b["fp"], 8 * p.held).view(">u8").astype(np.uint64)
            now = (*(b[c].to_numpy() for c in ("key", "lo", "hi", "node")), words)
            # the last group of a batch may go on in the next
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1]) & (now[2] == now[2][-1])
            at = len(same) if same.all() else len(same) - int(np.argmin(same[::-1]))
            if same.all():
                if kept and any(kept[-1][i][-1] != now[i][0] for i in range(3)):
                    yield out(kept)
                    kept = []
                kept.append(now)
                continue
            yield out([*kept, tuple(x[:at] for x in now)])
            kept = [tuple(x[at:] for x in now)]
        if kept:
            yield out(kept)

    return dealt.mapInArrow(join, "u long, v long").distinct()


#: Documents of a component that are compared at once, with as many others.
MEMBERS = 128


def similar(i: int, left: np.ndarray, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which sets of left have this Jaccard similarity with set i; no set is empty."""
    sizes = np.array([len(sets[j]) for j in left])
    ok = np.minimum(sizes, len(sets[i])) >= similarity * np.maximum(sizes, len(sets[i])) - 1e-9
    at = np.flatnonzero(ok)
    if len(at):
        every = np.concatenate([sets[j] for j in left[at]])
        place = np.minimum(np.searchsorted(sets[i], every), len(sets[i]) - 1)
        both = np.add.reduceat((sets[i][place] == every).astype(np.int64), np.r_[0, np.cumsum(sizes[at])[:-1]])
        ok[at] = both >= similarity * (sizes[at] + len(sets[i]) - both) - 1e-9
    return ok


def verified(docs: DataFrame, classes: DataFrame, found: DataFrame, p: SimHash, text: str) -> DataFrame:
    """Edges (u, v) that span the links of p.similarity within the components found; classes (node, fp, name).

    Only documents of those components are read again, one for each set of shingles. Components of more
    than MEMBERS are dealt out in pairs of blocks.
    """
    members, _ = cut(classes.join(found, "node").select("node", F.substring("fp", 1, 8 * p.held).alias("fp"), "name", "component"))
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("blocks"))
    members, _ = cut(members.join(sizes, "component"))
    own = docs.select(F.col("doc_id").cast("long").alias("node"), F.col(text).alias("_text"))
    texts = own.join(members.hint("merge"), "node").select("node", "fp", "name", "component", "blocks", "_text")

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shingle_set(t, p) for t in b["_text"].to_pylist()]
            # a repeated doc_id has other texts, too
            at = [i for i, ((_, name), want) in enumerate(zip(made, b["name"].to_pylist())) if name == want]
            kept = b.drop_columns(["_text"]).take(pa.array(at, pa.int64()))
            yield kept.append_column("shingles", pa.array([made[i][0].tobytes() for i in at], pa.binary()))

    rows = texts.mapInArrow(with_sets, "node long, fp binary, name binary, component long, blocks int, shingles binary")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "fp", "name", "shingles")

    def join(group: pa.Table) -> pa.Table:
        first = list({x: i for i, x in enumerate(group["name"].to_pylist())}.values())
        group = group.take(pa.array(first, pa.int64()))
        nodes = group["node"].to_numpy()
        words = unpack(group["fp"], 8 * p.held).view(">u8").astype(np.uint64)
        sets = [np.frombuffer(x, np.uint64) if x else np.zeros(1, np.uint64) for x in group["shingles"].to_pylist()]

        def close(i: int, left: np.ndarray) -> np.ndarray:
            ok = np.bitwise_count(words[i] ^ words[left]).sum(axis=1) <= p.radius
            ok[ok] = similar(i, left[ok], sets, p.similarity)
            return ok

        e = np.array(forest(len(nodes), close), np.int64).reshape(-1, 2)
        return pa.table({"u": nodes[e[:, 0]], "v": nodes[e[:, 1]]})

    return rows.groupBy("component", "lo", "hi").applyInArrow(join, "u long, v long")


def near_duplicates(docs: DataFrame, p: SimHash = SimHash(), text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (binary), component_id.

    component_id is the smallest doc_id reachable over links. Null and empty texts have fingerprint
    zero and link like any other. A row without doc_id is in the component of its fingerprint. Repeated
    rows give repeated rows; other columns are ignored; an empty table gives no rows.
    """
    prints, _ = cut(with_fingerprints(docs, p, text).withColumn("doc_id", F.col("doc_id").cast("long")))
    key = ["fp", "name"] if p.similarity else ["fp"]
    classes, _ = cut(prints.groupBy(*key).agg(F.min("doc_id").alias("node")))
    found = components(links(classes.filter("node IS NOT NULL").select("fp", "node"), p))
    if p.similarity:
        found = components(verified(docs, classes, found, p, text))
    of = classes.join(found, "node", "left").select(*key, F.coalesce("component", "node").alias("component_id"))
    return prints.join(of, key).select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, p: SimHash) -> DataFrame:
    """docs without the copies: the row with the smallest doc_id of each component stays.

    Rows without doc_id stay. Of rows that repeat both doc_id and text one stays; a repeated doc_id with
    another text is taken for another document and goes only if its id does. Columns are those of docs.
    """
    found, _ = cut(near_duplicates(docs, p).select("doc_id", "component_id").filter("doc_id IS NOT NULL"))
    # how many copies there are grows with the corpus: a merge join at every size
    copies = found.filter("doc_id <> component_id").select("doc_id").distinct().hint("merge")
    kept = docs.join(copies.withColumnRenamed("doc_id", "_copy"), F.col("doc_id") == F.col("_copy"), "left_anti")
    if found.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    twice = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("_twice"))
    single = kept.join(twice, F.col("doc_id") == F.col("_twice"), "left_anti")
    first = kept.join(twice, F.col("doc_id") == F.col("_twice"), "left_semi").groupBy("doc_id", "text").agg(F.first(F.struct(*docs.columns)).alias("_row"))
    return single.unionByName(first.select("_row.*"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    found = near_duplicates(docs, SimHash(shingle=3, words=1, radius=3))
    return found.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")
