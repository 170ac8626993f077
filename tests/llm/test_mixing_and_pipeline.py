import math
import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tokenloom.llm import decontaminate as dc
from tokenloom.llm import lines, mixing, quality

from .test_chat_and_lines import dedup_by_hand
from .test_verified_links import components_by_hand


def by_hand(blocks, weights):
    """The rule said plainly: (slot, source, block); every slot looks at the next block of every source."""
    done, order, origin = dict.fromkeys(blocks, 0), [], 0
    while live := [s for s in sorted(blocks) if done[s] < blocks[s]]:
        total, first, t = sum(weights[s] for s in live), dict(done), 0
        while all(done[s] < blocks[s] for s in live):
            j = {s: done[s] - first[s] + 1 for s in live}
            released = [s for s in live if Fraction((j[s] - 1) * total, weights[s]) // 1 <= t]
            s = min(released, key=lambda s: (math.ceil(Fraction(j[s] * total, weights[s])), s))
            order.append((origin + t, s, done[s]))
            done[s] += 1
            t += 1
        origin += t
    return order


def planned(counts, weights, block=1):
    """All blocks of phases(), by slot, with the place of their first row."""
    out = []
    for s, first, n, weight, origin, period, slots, short in mixing.phases(counts, weights, block):
        for j in range(n):
            slot = origin + j // weight * period + slots[j % weight]
            out.append((slot, s, first + j, slot * block - short))
    return sorted(out)


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 2}, {"a": 1, "b": 1}, {"a": 97, "b": 2, "c": 1}, {"a": 7}, {"a": 4, "b": 6}])
def test_less_than_a_block_of_deviation(weights):
    blocks = {s: 40 * w for s, w in weights.items()}
    total, done = sum(weights.values()), Counter()
    order = planned(blocks, weights)
    assert [s for s, *_ in order] == list(range(sum(blocks.values()))) and [x[:3] for x in order] == by_hand(blocks, weights)
    for slot, s, b, _ in order:
        assert b == done[s]
        done[s] += 1
        for x, w in weights.items():
            assert abs(done[x] - Fraction((slot + 1) * w, total)) < 1
    assert done == blocks


@pytest.mark.parametrize("seed", range(30))
def test_sources_that_run_out(seed):
    rng = random.Random(seed)
    names = "abcdef"[: rng.randint(1, 6)]
    counts = {s: rng.randint(1, 90) for s in names}
    weights = {s: rng.choice([1, 1, 2, 3, 7, 50, 1000]) for s in names}
    block = rng.choice([1, 3, 7])
    blocks = {s: -(-n // block) for s, n in counts.items()}
    got = planned(counts, weights, block)
    assert [x[:3] for x in got] == by_hand(blocks, weights)
    at = 0
    for _, s, b, start in got:
        assert start == at
        at += min(block, counts[s] - b * block)


def test_a_period_tells_any_number_of_blocks():
    """10^12 rows are planned in as many steps as the weights sum to."""
    got = list(mixing.phases({"a": 6 * 10**11, "b": 4 * 10**11}, {"a": 6000, "b": 4000}, 64))
    assert sum(len(x[6]) for x in got) < 20 and sum(x[2] for x in got) == -(-6 * 10**11 // 64) - (-4 * 10**11 // 64)


def test_mix_places_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 50)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"s{i % 5}") for i in range(1000)] + [(5, "hot"), (5, "hot"), (None, "s1"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("block", F.lit("clash")).withColumn("position", F.lit(1))
    got = mixing.mix(df, {"hot": 3, None: 2}, block=7).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["source"] or "") for r in got) == sorted((-1 if i is None else i, s or "") for i, s in rows)
    assert sorted(r["position"] for r in got) == list(range(len(rows)))
    own = sorted(got, key=lambda r: r["position"])
    assert [r["slot"] for r in own] == sorted(r["slot"] for r in own)
    sizes = Counter((r["source"], r["block"]) for r in got)
    last = {s: max(b for x, b in sizes if x == s) for s, _ in sizes}
    assert all(n == 7 for (s, b), n in sizes.items() if b < last[s])
    blocks = {(s is not None, s or ""): b + 1 for s, b in last.items()}
    plan = {(s[1] if s[0] else None, b): slot for slot, s, b in by_hand(blocks, {s: {"hot": 3}.get(s[1], 1) if s[0] else 2 for s in blocks})}
    assert all(plan[r["source"], r["block"]] == r["slot"] for r in got)
    assert mixing.mix(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, most_sources=2)


def test_one_id_in_very_many_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 10)
    monkeypatch.setattr(mixing, "PIECE", 3)
    df = spark.createDataFrame([(None, "a")] * 300 + [(7, "a")] * 200 + [(i, "a") for i in range(50)] + [(1, "b")] * 100, "doc_id long, source string")
    got = mixing.mix(df, {"a": 2, "b": 1}, block=4).collect()
    assert sorted(r["position"] for r in got) == list(range(650)) and Counter((r["doc_id"], r["source"]) for r in got)[None, "a"] == 300


def test_op7_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").collect()
    counts = Counter(r["source"] for r in docs)
    total = sum(n**0.5 for n in counts.values())
    weights = {s: max(1, round(10_000 * n**0.5 / total)) for s, n in counts.items()}
    order = by_hand({s: -(-n // 64) for s, n in counts.items()}, weights)
    start, at = {}, 0
    for slot, s, b in order:
        start[s, b] = (slot, at)
        at += min(64, counts[s] - 64 * b)
    hashes = {r["doc_id"]: r["h"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.xxhash64("doc_id", F.lit(1)).alias("h")).collect()}
    by_source = {}
    for r in sorted(docs, key=lambda r: (hashes[r["doc_id"]] & (1 << 40) - 1, r["doc_id"])):
        by_source.setdefault(r["source"], []).append(r["doc_id"])
    want = {i: (s, k // 64, start[s, k // 64][0], start[s, k // 64][1] + k % 64) for s, ids in by_source.items() for k, i in enumerate(ids)}
    assert {r["doc_id"]: tuple(r)[1:] for r in mixing.op7_mixing(spark, sf_dir).collect()} == want


def test_stages(spark, sf_dir):
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mixing_to_target_weights"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    for i, (name, stage) in enumerate(cp.STAGES):
        out, _ = cp.cut(stage(spark, docs, sf_dir))
        rows = docs.collect()
        if name == "quality_classifier":
            model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
            assert ids(out) == {r["doc_id"] for r in rows if model.score(quality.features(r["text"])[None])[0] >= 0.3}
        elif name == "line_dedup":
            want = dedup_by_hand([(r["doc_id"], r["text"]) for r in rows])
            assert {r["doc_id"]: r["text"] for r in out.collect()} == {k[0]: t for k, t in want.items() if t == k[1] or t.strip(" \t\r\n\x0b\x0c")}
            assert out.filter("n_chars <> length(text)").count() == 0
        elif name == "simhash_near_dedup":
            kept = ids(out)
            of = components_by_hand([(r["doc_id"], r["text"]) for r in rows], 0.8)
            assert kept >= set(of.values()) and len(kept) <= len(set(of.values())) + 0.02 * (len(of) - len(set(of.values())))
        elif name == "benchmark_decontamination":
            items = dc.ItemBlock([tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()], dc.Cgk())
            assert ids(out) == {r["doc_id"] for r in rows if not items.matches(r["text"])} < ids(docs)
        else:
            assert ids(out) == ids(docs)
        if i < len(cp.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = out


def test_run_and_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "a b c", "en", "a", 5), (2, "", "en", "a", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 2  # the empty texts are one group; the row without id stays
    assert lines.dedup_lines(spark.createDataFrame(rows, schema)).count() == 4
