"""Mixing sources to target weights by Pfair scheduling of blocks.

Each source's documents are put in a fixed shuffled order and cut into blocks. Block j (from 1) of a
source with weight w of W is released at slot floor((j - 1) W / w) and due at ceil(j W / w); each slot
goes to the released block with the earliest deadline. While all sources last, the blocks of a source
among the first t slots differ from t w / W by less than one. When a source runs out the others go on
with their weights, from a new origin of time; every document is scheduled.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, forget

#: Rows of a range in which a source is numbered, and blocks whose slots one row of the plan gives.
BUCKET, PIECE = 4096, 1 << 16


def earliest_deadlines(weights: dict) -> Iterator:
    """The source of each slot while all sources last; weights: positive integers.

    Ties between equal deadlines go to the smaller source. Memory holds one entry per source.
    """
    total = sum(weights.values())
    done = dict.fromkeys(weights, 0)
    ready: list[tuple] = []
    later = [(0, s) for s in sorted(weights)]
    slot = 0
    while True:
        while later and later[0][0] <= slot:
            s = heapq.heappop(later)[1]
            heapq.heappush(ready, (-(-(done[s] + 1) * total // weights[s]), s))
        s = heapq.heappop(ready)[1]
        yield s
        done[s] += 1
        slot += 1
        heapq.heappush(later, (done[s] * total // weights[s], s))


def phases(counts: dict, weights: dict, block: int) -> Iterator[tuple]:
    """(source, first block, blocks, weight, origin, period, slots in the period, rows missing before) of each
    source in each phase; counts: its rows.

    A phase lasts until a source runs out. In it, after as many slots as the weights sum to, every source
    has had exactly its weight of blocks and all begins anew, so one period tells them all: block j of the
    phase is in slot origin + j // weight * period + slots[j % weight]. Rows missing are those that the
    last blocks of the sources that ran out before are short of.
    """
    left = {s: -(-n // block) for s, n in counts.items() if n}
    done, origin, short = dict.fromkeys(left, 0), 0, 0
    while left:
        divisor = math.gcd(*(weights[s] for s in left))
        own = {s: weights[s] // divisor for s in left}
        period = sum(own.values())
        slots: dict = {s: [] for s in left}
        ended = None
        for slot, s in enumerate(itertools.islice(earliest_deadlines(own), period)):
            slots[s].append(slot)
            if len(slots[s]) == left[s]:
                ended = slot
                break
        if ended is None:
            ended = min((n - 1) // own[s] * period + slots[s][(n - 1) % own[s]] for s, n in left.items())
        whole, rest = divmod(ended + 1, period)
        for s in sorted(left):
            n = whole * own[s] + bisect.bisect_left(slots[s], rest)
            if n:
                yield s, done[s], n, own[s], origin, period, slots[s], short
            done[s] += n
            left[s] -= n
        for s in [s for s, n in left.items() if not n]:
            short += done[s] * block - counts[s]
            del left[s]
        origin += ended + 1


def ranked(docs: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Adds rank (from 0) of each row in its source, in the order of a hash of doc_id.

    Rows are dealt to hash ranges of about BUCKET rows, numbered within them and shifted by the ranges
    before, so no task holds a source. A range that many rows of one id make long is dealt again by the
    rows' own numbers (_n). ranges (_source, ranges) has a row for each source and is small.
    """
    hashed = docs.withColumn("h", F.xxhash64("doc_id", F.lit(1)).bitwiseAND(F.lit((1 << 40) - 1)))
    dealt = hashed.join(F.broadcast(ranges), F.col("source").eqNullSafe(F.col("_source")), "inner").drop("_source")
    dealt = dealt.withColumn("range", F.floor(F.col("h") * F.col("ranges") / float(1 << 40)))
    long, _ = cut(dealt.groupBy("source", "range").agg(F.ceil(F.count(F.lit(1)) / BUCKET).alias("parts")).filter("parts > 8"))
    if long.isEmpty():
        dealt = dealt.withColumn("part", F.lit(0))
    else:
        long = F.broadcast(long.select(F.col("source").alias("_s"), F.col("range").alias("_r"), "parts"))  # one for 8 BUCKET rows at most
        dealt = dealt.join(long, F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r")), "left").drop("_s", "_r")
        dealt = dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64("_n"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    sizes = dealt.groupBy("source", "range", "part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("source").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col("source").alias("_s"), F.col("range").alias("_r"), F.col("part").alias("_p"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    own = Window.partitionBy("source", "range", "part").orderBy("h", *keys, "_n")
    inner = dealt.withColumn("inner", F.row_number().over(own) - 1)
    return inner.join(shift, F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r")) & (F.col("part") == F.col("_p"))).withColumn("rank", F.col("shift") + F.col("inner")).drop("h", "_n", "ranges", "range", "part", "_s", "_r", "_p", "shift", "inner")


def tempered(counts: dict, power: float = 0.5, scale: int = 10_000) -> dict:
    """Target weights in proportion to a power of the sources' sizes, as integers of sum about scale."""
    total = sum(n**power for n in counts.values())
    return {s: max(1, round(scale * n**power / total)) for s, n in counts.items()}


def mix(docs: DataFrame, weights: dict | None = None, block: int = 64, most_sources: int = 100_000) -> DataFrame:
    """(doc_id, source) of every row -> doc_id, source, block (from 0), slot, position (from 0).

    weights: integers by source (null is a source of its own, named None); sources it lacks get 1; None
    means tempered() ones. position is the place in the mixture: slot by slot, in a block by rank. Rows
    that repeat a doc_id are rows of their own next to each other, as are those without. Every row is
    placed once; other columns are ignored; an empty table gives no rows. More than most_sources sources
    are an error, nothing is left out. Only one count for each source reaches the driver. One task works
    out a period of slots for each phase, which no number of documents makes longer than the weights' sum,
    and the slots of all blocks follow from these in parallel.
    """
    spark = docs.sparkSession
    rows, _ = cut(docs.select("doc_id", "source", F.monotonically_increasing_id().alias("_n")))
    name = lambda s: (s is not None, s or "")  # noqa: E731  null sorts first
    got = rows.groupBy("source").count().limit(most_sources + 1).collect()
    if len(got) > most_sources:
        raise ValueError(f"more than {most_sources} sources; group them first")
    counts = {name(r["source"]): r["count"] for r in got}
    if not counts:
        return spark.createDataFrame([], "doc_id long, source string, block long, slot long, position long")
    own = tempered(counts) if weights is None else {s: weights.get(s[1] if s[0] else None, 1) for s in counts}
    if min(own.values()) < 1:
        raise ValueError("weights are positive integers")
    columns = ["_s", "first", "n", "weight", "origin", "period", "slots", "short"]

    def planned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            entries = phases(counts, own, block)
            while some := list(itertools.islice(entries, 1000)):
                yield pd.DataFrame([(s[1] if s[0] else None, *rest) for s, *rest in some], columns=columns).astype({"_s": object})

    schema = "_s string, first long, n long, weight long, origin long, period long, slots array<long>, short long"
    entries, entries_path = cut(spark.range(0, 1, 1, 1).mapInPandas(planned, schema))
    pieces = entries.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long")))).repartition("_s", "first", "from")
    each = pieces.withColumn("j", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + PIECE, F.col("n")) - 1)))
    slot = F.col("origin") + F.floor(F.col("j") / F.col("weight")) * F.col("period") + F.get("slots", (F.col("j") % F.col("weight")).cast("int"))
    plan, _ = cut(each.select("_s", (F.col("first") + F.col("j")).alias("_b"), slot.alias("slot"), (slot * block - F.col("short")).alias("at")))
    forget(spark, entries_path)
    ranges = spark.createDataFrame([(s[1] if s[0] else None, -(-n // BUCKET)) for s, n in counts.items()], "_source string, ranges long")
    placed = ranked(rows, ranges, ["doc_id"]).withColumn("block", F.floor(F.col("rank") / block))
    return placed.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).select(
        "doc_id", "source", "block", "slot", (F.col("at") + F.col("rank") - F.col("block") * block).alias("position")
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))
